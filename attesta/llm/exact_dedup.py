"""Exact dedup by an extendible-hash index kept in files of a shared folder.

Each owner task holds one range of the 64-bit keys and builds that range's
part of the index: a directory of 2**depth slots that point to buckets; an
overfull bucket splits on its next key bit, and the directory doubles when the
bucket was as deep as the directory. Entries whose keys collide are chained in
their bucket and told apart by comparing bytes. Buckets and the texts' bytes
live in segment files of the shared folder; what a task keeps in memory is the
directory and a bounded cache of buckets.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, drop_path, materialize, new_path, table, unused

_SPACE = b" \t\n\x0b\x0c\r"
#: Depth below which splits stop: equal 64-bit keys can't be split further and are chained.
_MAX_DEPTH = 60
#: Rows that one owner task is meant for: their number follows the input's.
OWNER_ROWS = 1_000_000


def normalise(text: str | None) -> bytes:
    """UTF-8 of the text without the characters ``[\\x20\\x09-\\x0D]``; null is empty."""
    return (text or "").encode("utf-8", "surrogatepass").translate(None, _SPACE)


class SegmentFile:
    """Append-only bytes in the shared folder: written under a name of this attempt's own."""

    def __init__(self, fs, path: str, buffer_bytes: int = 4 << 20):
        self.fs, self.path, self.buffer, self.flushed = fs, path, bytearray(), 0
        self.limit, self.parts, self.opened = buffer_bytes, [], (None, None)

    def append(self, data: bytes) -> tuple[int, int]:
        at = self.flushed + len(self.buffer)
        self.buffer += data
        if len(self.buffer) >= self.limit:
            self.flush()
        return at, len(data)

    def flush(self) -> None:
        """Object stores cannot append, so each flush is a file of its own."""
        if self.buffer:
            name = f"{self.path}.{len(self.parts):05d}"
            with self.fs.open_output_stream(name, compression=None) as out:
                out.write(bytes(self.buffer))
            self.parts.append((self.flushed, name))
            self.flushed += len(self.buffer)
            self.buffer = bytearray()

    def read(self, at: int, length: int) -> bytes:
        if at >= self.flushed:
            return bytes(self.buffer[at - self.flushed : at - self.flushed + length])
        k = bisect_right(self.parts, at, key=lambda p: p[0]) - 1
        if k != self.opened[0]:  # the last part read stays open: reads of a bucket's texts stand close together
            self.shut()
            self.opened = k, self.fs.open_input_file(self.parts[k][1])
        return self.opened[1].read_at(length, at - self.parts[k][0])

    def shut(self) -> None:
        if self.opened[1]:
            self.opened[1].close()
        self.opened = None, None


class ExtendibleHash:
    """Extendible hash from a 64-bit key and bytes to an integer group number.

    ``put`` returns the group of equal bytes, making one if there is none.
    Buckets beyond ``cached`` are written to the segment file and read again
    when touched; the bytes of every distinct entry are in ``blobs``.
    """

    _ENTRY = struct.Struct("<QQQI")  # key, group, blob offset, blob length

    def __init__(self, blobs: SegmentFile, pages: SegmentFile, capacity: int = 256, cached: int = 1024, shift: int = 0, unpack: Callable[[bytes], bytes] = bytes):
        self.blobs, self.pages, self.capacity, self.cached, self.shift, self.unpack = blobs, pages, capacity, cached, shift, unpack
        self.depth, self.directory = 0, [0]
        self.local = [0]
        self.live: OrderedDict[int, list[tuple[int, int, int, int]]] = OrderedDict({0: []})
        self.on_disk: dict[int, tuple[int, int]] = {}
        self.groups = 0

    def _slot(self, key: int) -> int:
        return ((key << self.shift) & (2**64 - 1)) >> (64 - self.depth) if self.depth else 0

    def _bucket(self, b: int) -> list[tuple[int, int, int, int]]:
        got = self.live.get(b)
        if got is None:
            at, n = self.on_disk[b]
            got = list(self._ENTRY.iter_unpack(self.pages.read(at, n)))
            self.live[b] = got
        self.live.move_to_end(b)
        while len(self.live) > self.cached:
            old, entries = self.live.popitem(last=False)
            self.on_disk[old] = self.pages.append(b"".join(self._ENTRY.pack(*e) for e in entries))
        return got

    def put(self, key: int, data: bytes) -> int:
        bucket = self._bucket(self.directory[self._slot(key)])
        for k, group, at, n in bucket:  # the chain of this key
            if k == key and ((held := self.blobs.read(at, n)) == data or self.unpack(held) == self.unpack(data)):
                return group
        at, n = self.blobs.append(data)
        bucket.append((key, self.groups, at, n))
        self.groups += 1
        self._split(self.directory[self._slot(key)], key)
        return self.groups - 1

    def _split(self, b: int, key: int) -> None:
        bucket = self._bucket(b)
        if len(bucket) <= self.capacity or self.local[b] >= _MAX_DEPTH - self.shift or len({e[0] for e in bucket}) == 1:
            return
        if self.local[b] == self.depth:  # directory doubling
            self.directory = [x for x in self.directory for _ in (0, 1)]
            self.depth += 1
        self.local[b] += 1
        fresh = len(self.local)
        self.local.append(self.local[b])
        bit = 1 << (63 - self.shift - (self.local[b] - 1))
        self.live[fresh] = [e for e in bucket if e[0] & bit]
        bucket[:] = [e for e in bucket if not e[0] & bit]
        span = 1 << (self.depth - self.local[b])
        first = self._slot(key) >> (self.depth - self.local[b]) << (self.depth - self.local[b])
        base = first & ~span  # the slots of the split bucket: the half with the new bit set moves
        for i in range(base | span, (base | span) + span):
            self.directory[i] = fresh
        self._split(self.directory[self._slot(key)], key)

    def close(self) -> bytes:
        """Write what is in memory; the returned bytes are the directory page."""
        for b, entries in self.live.items():
            self.on_disk[b] = self.pages.append(b"".join(self._ENTRY.pack(*e) for e in entries))
        for file in (self.blobs, self.pages):
            file.flush()
            file.shut()
        return struct.pack(f"<I{len(self.directory)}I", self.depth, *self.directory)


_KEYED = pa.schema([("owner", pa.int32()), ("key", pa.int64()), ("sha256", pa.string()), ("group_size", pa.int64()), ("length", pa.int64()), ("keep_id", pa.int64()), ("keep_rows", pa.int64()), ("body", pa.binary())])
_GROUPS = pa.schema([_KEYED.field(n) for n in ("sha256", "keep_id", "length", "keep_rows", "group_size")])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _fold(group: dict, length: int, doc_id: int | None, rows: int, size: int) -> None:
    """Add rows to a group: the longest original stays, then the smallest id; a null id is last."""
    group["group_size"] += size
    order = lambda n, i: (-n, i is None, i or 0)
    new, old = order(length, doc_id), order(group["length"], group["keep_id"])
    if new == old:
        group["keep_rows"] += rows
    elif new < old:
        group |= {"length": length, "keep_id": doc_id, "keep_rows": rows}


def _keyed(owners: int, window_bytes: int):
    """Map side: normalise, key, and fold the copies that meet within a bounded window."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        window: dict[bytes, dict] = {}
        held = 0

        def flush():
            out = list(window.values())
            window.clear()
            for i in range(0, len(out), 512):
                yield pa.RecordBatch.from_pylist(out[i : i + 512], schema=_KEYED)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = normalise(text)
                digest = hashlib.sha256(data).digest()
                n = len(text or "")
                if got := window.get(digest):  # owners compare bytes again across windows
                    _fold(got, n, doc_id, 1, 1)
                    continue
                key = xxhash.xxh64_intdigest(data)
                body = packer.compress(data)
                window[digest] = {"owner": key * owners >> 64, "key": key - 2**63, "sha256": digest.hex(), "group_size": 1, "length": n, "keep_id": doc_id, "keep_rows": 1, "body": body}
                held += len(body) + 600
                if held > window_bytes:
                    yield from flush()
                    held = 0
        yield from flush()

    return rows


def _place(key: int, owners: int) -> int:
    """A key's place in its owner's range, spread over 64 bits: no two keys of an owner share one.

    Keys of one owner have their leading bits in common; a directory over the
    keys themselves would double for each of those bits before it tells any apart.
    """
    return key * owners & (2**64 - 1)


def _owned(root: str, owners: int, capacity: int, cached: int):
    """Owner side: one key range after another through its part of the index.

    A range comes sorted by key. The index would find copies in any order; the
    sort gives its accesses an order: a bucket is filled before the next one, so
    that it is written once and read back hardly ever, and no text of a later
    key can be a copy of an earlier one, so that groups are handed on as soon as
    their key ends and a task keeps those of one key.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        unpacker = zstandard.ZstdDecompressor()
        attempt = uuid.uuid4().hex[:12]  # a task that runs again writes files of its own
        index, owner, key, done = None, None, None, []
        groups: dict[int, dict] = {}  # of the present key

        def finish() -> None:
            if index is not None:
                page = index.close()
                with fs.open_output_stream(f"{base}/owner-{owner:06d}-{attempt}.directory", compression=None) as out:
                    out.write(page)

        for batch in batches:
            for r in batch.to_pylist():
                if (r["owner"], r["key"]) != (owner, key):
                    done += groups.values()
                    key, groups = r["key"], {}
                    if len(done) >= 4096:
                        yield pa.RecordBatch.from_pylist(done, schema=_GROUPS)
                        done = []
                if r["owner"] != owner:
                    finish()
                    owner = r["owner"]
                    fs.create_dir(base, recursive=True)
                    name = f"{base}/owner-{owner:06d}-{attempt}"
                    index = ExtendibleHash(SegmentFile(fs, f"{name}.blobs"), SegmentFile(fs, f"{name}.pages"), capacity, cached, unpack=unpacker.decompress)
                g = index.put(_place(r["key"] + 2**63, owners), r["body"])
                if g not in groups:
                    groups[g] = {n: r[n] for n in _GROUPS.names}
                else:
                    _fold(groups[g], r["length"], r["keep_id"], r["keep_rows"], r["group_size"])
        finish()
        if done := [*done, *groups.values()]:
            yield pa.RecordBatch.from_pylist(done, schema=_GROUPS)

    return rows


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owners: int | None = None, window_bytes: int = 32 << 20, capacity: int = 256, cached_buckets: int = 1024, root: str | None = None) -> DataFrame:
    """One row per distinct normalised text: sha256, keep_id, length, keep_rows, group_size.

    Copies are folded before the shuffle (within ``window_bytes`` of distinct
    packed texts per task), so a text that fills a third of the corpus reaches
    its owner as one row per task. ``keep_rows`` counts the rows that have both
    the id and the length of the row that stays (over 1 for repeated rows).
    """
    spark = docs.sparkSession
    n = owners or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // OWNER_ROWS + 1)
    root = root or new_path(spark, "exact-index")
    keyed = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_keyed(n, window_bytes), _ddl(_KEYED))
    placed = keyed.repartition(n, "owner").sortWithinPartitions("owner", "key")
    return placed.mapInArrow(_owned(root, n, capacity, cached_buckets), _ddl(_GROUPS))


def _sha256(text_col: str):
    return F.sha2(F.translate(F.coalesce(F.col(text_col), F.lit("")), ASCII_SPACE, "").cast("binary"), 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting ASCII white space. The row
    with the most code points in its original text stays, then the smallest id.
    Null text counts as empty; a null id orders last; rows that repeat both the
    id and the length of the row that stays are all marked kept here, and
    ``keep_first`` leaves one of them. An empty table gives no rows; further
    columns are ignored.
    """
    # only what the join needs crosses it: the text's length, not the text
    light = docs.select(F.col(id_col).alias("_id"), F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("_n"), _sha256(text_col).alias("_sha256"))
    groups = _found_groups(docs, id_col, text_col).where("group_size > 1")
    many = groups.select(F.col("sha256").alias("_sha256"), F.col("keep_id").alias("_keep_id"), F.col("length").alias("_length"), F.col("group_size").alias("_size"))
    me, alone = F.col("_id").cast("long"), F.col("_size").isNull()
    return light.join(many, "_sha256", "left").select(
        me.alias("doc_id"),
        F.when(alone, me).otherwise(F.col("_keep_id")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (me.eqNullSafe(F.col("_keep_id")) & (F.col("_n") == F.col("_length")))).alias("kept"),
        F.col("_sha256").alias("text_sha256"),
    )


def _found_groups(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``duplicate_groups``, written; the index that found them goes."""
    root = new_path(docs.sparkSession, "exact-index")
    groups = materialize(duplicate_groups(docs, id_col, text_col, root=root), "exact-groups")
    drop_path(docs.sparkSession, root)
    return groups


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` (all its columns) without the rows that are copies of the one that stays."""
    groups = _found_groups(docs, id_col, text_col).where("group_size > 1")
    sha, keep, length = unused(docs, "sha256", "keep_id", "length")
    many = groups.select(F.col("sha256").alias(sha), F.col("keep_id").alias(keep), F.col("length").alias(length))
    joined = docs.withColumn(sha, _sha256(text_col)).join(many, sha, "left")
    stays = F.col(id_col).cast("long").eqNullSafe(F.col(keep)) & (F.char_length(F.coalesce(F.col(text_col), F.lit(""))) == F.col(length))
    kept = joined.where(F.col(length).isNull() | stays)
    if not groups.where("keep_rows > 1").isEmpty():  # repeated rows: one of each stays
        kept = kept.dropDuplicates([id_col, sha])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, first_value(len) OVER w AS keep_len,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY len DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND len = keep_len AS kept, text_sha256 FROM g
"""
