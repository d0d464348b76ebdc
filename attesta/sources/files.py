"""A data source for documents: files and members of archives, named by a manifest or found under a folder.

``spark.read.format("attesta_documents")`` gives (doc_id, side, path, submitted,
content) with the options

* ``manifest``: a manifest, or a folder of them, as JSON arrays or as JSON lines;
* ``path``: instead of a manifest, a folder (or one file) whose documents, and members of .tar, .tar.gz and .zip archives, are all read;
* ``content``: ``false`` leaves files unopened and ``content`` null.

The driver's part is to cut manifests into slices by their size, or to list the
folder; what a slice names is read, looked for and opened by the task that has
it. A path ``archive.zip!a/b.png`` is a member of an archive. Comparisons of
doc_id and side with values are pushed down: other documents aren't opened.
"""

from __future__ import annotations

import io
import json
import os
import re
import tarfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .documents import SUFFIXES

#: Bytes of a manifest that a task reads.
SLICE_BYTES = 4 << 20
#: An array can't be cut by bytes, so each of its slices reads it whole: so many at most. Long manifests are JSON lines.
ARRAY_SLICES = 64
SCHEMA = "doc_id string, side string, path string, submitted map<string,string>, content binary"
_ARROW = pa.schema([("doc_id", pa.string()), ("side", pa.string()), ("path", pa.string()), ("submitted", pa.map_(pa.string(), pa.string())), ("content", pa.binary())])
_ARCHIVES = (".tar", ".tar.gz", ".tgz", ".zip")


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a name with or without a scheme."""
    if re.match(r"^[a-z][a-z0-9+.-]+://", path) and not path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), re.sub(r"^file:(//)?(?=/)", "", path)


def _kind(path: str) -> pafs.FileType:
    fs, at = located(path)
    return fs.get_file_info(at).type


def read_bytes(path: str) -> bytes:
    """A file's content, or an archive member's."""
    archive, _, member = path.partition("!")
    fs, at = located(archive)
    with fs.open_input_file(at) as f:
        if not member:
            return f.read()
        if archive.lower().endswith(".zip"):
            with zipfile.ZipFile(f) as z:
                return z.read(member)
        with tarfile.open(fileobj=f) as t:
            found = t.extractfile(member)
            if found is None:
                raise FileNotFoundError(path)
            return found.read()


def exists(path: str) -> bool:
    archive, _, member = path.partition("!")
    if _kind(archive) != pafs.FileType.File:
        return False
    return not member or member in {name for name, _ in members(archive, False)}


def members(archive: str, content: bool) -> Iterator[tuple[str, bytes | None]]:
    """(name, content) of the documents of an archive, one after the other."""
    fs, at = located(archive)
    with fs.open_input_file(at) as f:
        if archive.lower().endswith(".zip"):
            with zipfile.ZipFile(f) as z:
                for info in z.infolist():
                    if not info.is_dir():
                        yield info.filename, z.read(info) if content else None
            return
        with tarfile.open(fileobj=f) as t:
            for info in t:
                if info.isfile():
                    yield info.name, t.extractfile(info).read() if content else None


def stem(path: str) -> str:
    return re.sub(r"(?<=.)\.[^.]*$", "", re.split(r"[/\\!]", path)[-1])


def is_document(name: str) -> bool:
    return name.lower().rsplit(".", 1)[-1] in SUFFIXES


@dataclass
class Slice(InputPartition):
    """A part of a manifest (every ``of``-th entry from ``start``, or lines that begin in a range of bytes), or a file of a folder."""

    path: str
    kind: str
    start: int = 0
    end: int = 0
    of: int = 1

    def entries(self) -> Iterator[dict]:
        fs, at = located(self.path)
        if self.kind == "array":
            yield from json.loads(read_bytes(self.path))[self.start :: self.of]
            return
        with fs.open_input_file(at) as f:
            f.seek(max(0, self.start - 1))
            lines = io.BufferedReader(f) if not isinstance(f, io.BufferedReader) else f
            here = self.start
            if self.start:
                here = self.start - 1 + len(lines.readline())  # a line belongs to the slice that it begins in
            while here < self.end:
                line = lines.readline()
                if not line:
                    return
                here += len(line)
                if line.strip():
                    yield json.loads(line)


class DocumentReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.manifest, self.path = options.get("manifest"), options.get("path")
        if bool(self.manifest) == bool(self.path):
            raise ValueError("give either a manifest or a path")
        self.content = options.get("content", "true").lower() != "false"
        self.slice_bytes = int(options.get("sliceBytes", SLICE_BYTES))
        self.only: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else ""
            if column in ("doc_id", "side"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only[column] = self.only[column] & values if column in self.only else values
            else:
                yield f

    def _listed(self, top: str) -> Iterator[tuple[str, int]]:
        fs, at = located(top)
        if fs.get_file_info(at).type == pafs.FileType.File:
            yield top, fs.get_file_info(at).size
            return
        scheme = top[: len(top) - len(at)] if top.endswith(at) else ""
        for info in sorted(fs.get_file_info(pafs.FileSelector(at, recursive=True)), key=lambda x: x.path):
            if info.type == pafs.FileType.File and not os.path.basename(info.path).startswith(("_", ".")):
                yield scheme + info.path, info.size

    def partitions(self) -> list[Slice]:
        return self._slices() or [Slice("", "none")]

    def _slices(self) -> list[Slice]:
        if self.path:
            return [Slice(p, "archive" if p.lower().endswith(_ARCHIVES) else "file") for p, _ in self._listed(self.path) if is_document(p) or p.lower().endswith(_ARCHIVES)]
        out = []
        for path, size in self._listed(self.manifest):
            fs, at = located(path)
            with fs.open_input_file(at) as f:
                first = f.read(4096).lstrip()[:1]
            n = max(1, -(-size // self.slice_bytes))
            if first == b"[":
                n = min(n, ARRAY_SLICES)
                out += [Slice(path, "array", k, 0, n) for k in range(n)]
            elif first:
                out += [Slice(path, "lines", size * k // n, size * (k + 1) // n) for k in range(n)]
        return out

    def _wanted(self, **values: str) -> bool:
        return all(v in self.only[c] for c, v in values.items() if c in self.only)

    def _row(self, doc_id: str, side: str, path: str, submitted: dict | None, content: Callable[[], bytes] | None) -> Iterator[pa.RecordBatch]:
        """One document is one batch: a task holds one at a time."""
        if self._wanted(doc_id=doc_id, side=side):
            values = None if submitted is None else [(str(k), None if v is None else str(v)) for k, v in submitted.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((doc_id, side, path, values, content() if content else None), _ARROW.types, strict=True)], schema=_ARROW)

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        opened = lambda p: (lambda: read_bytes(p)) if self.content else None
        if partition.kind == "none":
            return
        if partition.kind == "file":
            yield from self._row(stem(partition.path), "front", partition.path, None, opened(partition.path))
        elif partition.kind == "archive":
            for name, data in members(partition.path, self.content):
                if is_document(name):
                    yield from self._row(stem(name), "front", f"{partition.path}!{name}", None, (lambda d=data: d) if self.content else None)
        else:
            for entry in partition.entries():
                front, back = entry.get("document_path"), entry.get("back_document_path")
                if front is None or not self._wanted(doc_id=stem(front)) or not exists(front):
                    continue  # an entry whose front isn't there is left out
                yield from self._row(stem(front), "front", front, entry.get("submitted") or {}, opened(front))
                if back is not None:
                    if not self.content and not exists(back):
                        raise FileNotFoundError(f"no such file: {back}")
                    yield from self._row(stem(front), "back", back, None, opened(back))


class DocumentSource(DataSource):
    """``attesta_documents``; see this module."""

    @classmethod
    def name(cls) -> str:
        return "attesta_documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DocumentReader:
        return DocumentReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the source known to the session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DocumentSource)
