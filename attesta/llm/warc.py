"""WARC archives: an index first, then byte-range reads of the selected records.

Writing gives archive files of bounded size (every record a gzip member of its
own, as is usual for .warc.gz) and an index with the file, offset, length, URL
and payload digest of every record. Reading takes rows of the index, sorts them
by place, joins ranges that lie close together into one read each, and parses
the records.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_path, table

#: Payloads below this many bytes are always stored in full.
LEAST_REVISIT = 1000
_INDEX = [("page_id", "long"), ("url", "string"), ("payload_digest", "string"), ("payload_bytes", "long"), ("record_type", "string"), ("refers_to", "long"), ("file", "string"), ("offset", "long"), ("length", "long")]
_READ = [("page_id", "long"), ("url", "string"), ("payload_bytes", "long"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "long"), ("payload", "binary"), ("whole", "boolean")]
_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def _schema(fields: list[tuple[str, str]]) -> pa.Schema:
    return pa.schema([(n, _ARROW[t]) for n, t in fields])


def _ddl(fields: list[tuple[str, str]]) -> str:
    return ", ".join(f"{n} {t}" for n, t in fields)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record. A revisit has no block; its headers give the payload's digest and size."""
    block = payload if kind == "response" else b""
    one_line = lambda s: (s or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {one_line(url)}",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}",
    ]
    if url is None:
        head.append("X-No-Target: true")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers (lower-case names) and block of one record; raises ValueError if it is cut short."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    n = int(headers.get("content-length", -1))
    if not sep or not lines[0].startswith("WARC/") or n < 0 or rest[n:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    return {"headers": headers, "block": rest[:n]}


def _number(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _writer(root: str, file_bytes: int, level: int, date: str):
    schema = _schema(_INDEX)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        fs.create_dir(base, recursive=True)
        stem = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}"  # an attempt's own name
        out, name, at, files = None, "", 0, 0
        try:
            for batch in batches:
                index = []
                for r in (row for i in range(0, batch.num_rows, 64) for row in batch.slice(i, 64).to_pylist()):
                    payload = (r["html"] or "").encode("utf-8", "surrogatepass")
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    raw = record(r["page_id"], r["url"], payload, r["payload_digest"], r["record_type"], r["refers_to"], date)
                    member = packer.compress(raw) + packer.flush()
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name, at, files = f"{stem}-{files:04d}.warc.gz", 0, files + 1
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(member)
                    index.append({k: r[k] for k in ("page_id", "url", "payload_digest", "record_type", "refers_to")} | {"payload_bytes": len(payload), "file": name, "offset": at, "length": len(member)})
                    at += len(member)
                yield pa.RecordBatch.from_pylist(index, schema=schema)
        finally:
            if out is not None:
                out.close()

    return rows


def _reader(root: str, gap: int, most: int, keep_payload: bool):
    schema = _schema([f for f in _READ if keep_payload or f[0] != "payload"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        state: dict = {"name": None, "file": None}

        def fetch(group: list[dict]) -> pa.RecordBatch:
            """One read for the whole run of ranges."""
            if state["name"] != group[0]["file"]:
                if state["file"] is not None:
                    state["file"].close()
                state["name"], state["file"] = group[0]["file"], fs.open_input_file(f"{base}/{group[0]['file']}")
            start = group[0]["offset"]
            data = state["file"].read_at(max(g["offset"] + g["length"] for g in group) - start, start)
            out = []
            for g in group:
                got = parse(zlib.decompress(data[g["offset"] - start : g["offset"] - start + g["length"]], 31))
                h, block = got["headers"], got["block"]
                digest, kind = h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"]
                row = {
                    "page_id": _number(h["warc-record-id"]), "url": None if "x-no-target" in h else h["warc-target-uri"], "payload_bytes": int(h["x-payload-length"]), "payload_digest": digest, "record_type": kind,
                    "refers_to": _number(h.get("warc-refers-to")), "whole": kind == "revisit" or (len(block) == int(h["x-payload-length"]) and hashlib.sha1(block).hexdigest() == digest),
                }
                out.append(row | ({"payload": block} if keep_payload else {}))
            return pa.RecordBatch.from_pylist(out, schema=schema)

        group: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if group and (r["file"] != group[0]["file"] or r["offset"] > group[-1]["offset"] + group[-1]["length"] + gap or r["offset"] + r["length"] - group[0]["offset"] > most):
                    yield fetch(group)
                    group = []
                group.append(r)
        if group:
            yield fetch(group)
        if state["file"] is not None:
            state["file"].close()

    return rows


def plan_records(pages: DataFrame) -> DataFrame:
    """``pages`` with payload_digest, record_type and refers_to: which record stores a payload, which revisit it.

    Of equal payloads (same SHA-1 and size) of ``LEAST_REVISIT`` bytes or more
    the largest page_id is the response. Payloads are folded by digest before
    the shuffle and only digests seen twice or more are joined back, so one
    payload that fills a third of the pages is the hot key of one join, whose
    large side (the pages with their html) Spark splits. A page without an id
    revisits the response, if there is a page that has one.
    """
    raw = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    cols = pages.select("page_id", "url", "html", F.sha1(raw).alias("payload_digest"), F.octet_length(raw).cast("long").alias("_n"))
    long = cols.select("page_id", "payload_digest", "_n").where(F.col("_n") >= LEAST_REVISIT)
    same = long.groupBy("payload_digest", "_n").agg(F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_c")).where("_c > 1").select("payload_digest", F.col("_n").alias("_m"), "_last")
    joined = cols.join(same, "payload_digest", "left")
    again = F.col("_last").isNotNull() & (F.col("_n") == F.col("_m")) & ~F.col("page_id").eqNullSafe(F.col("_last"))
    return joined.select("page_id", "url", "html", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("_last")).alias("refers_to"))


def write_archive(pages: DataFrame, root: str | None = None, file_bytes: int = 64 << 20, level: int = 5, date: str = "1970-01-01T00:00:00Z") -> tuple[DataFrame, str]:
    """Write one record per page and return (index, folder of the archives).

    Columns page_id, url, html; null html is an empty payload, a null url an
    empty target, and null ids are kept; a page that repeats is written again.
    An empty table gives an empty index. Files of attempts that did not end
    aren't in the index.
    """
    root = root or new_path(pages.sparkSession, "warc")
    index = plan_records(pages).mapInArrow(_writer(root, file_bytes, level, date), _ddl(_INDEX))
    return materialize(index, "warc-index"), root


def read_records(index: DataFrame, root: str, gap: int = 64 << 10, most: int = 8 << 20, payload: bool = True) -> DataFrame:
    """The records that rows of ``index`` name, by coalesced sorted range reads.

    Ranges of one file no more than ``gap`` bytes apart are read together, up to
    ``most`` bytes at once. ``whole`` says that the block has the size and
    digest that its headers give. Work is dealt by ranges of place, so a large
    file is shared by several tasks.
    """
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = index.select("file", "offset", "length").repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    return placed.mapInArrow(_reader(root, gap, most, payload), _ddl([f for f in _READ if payload or f[0] != "payload"]))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, root = write_archive(table(spark, sf_dir, "pages"))
    return read_records(index, root, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "whole")


OP1_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND last_id IS NOT NULL AND page_id IS DISTINCT FROM last_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM last_id THEN last_id END AS refers_to, true AS whole
FROM g
"""
