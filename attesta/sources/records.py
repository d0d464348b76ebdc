"""Verification records: an append-only Parquet table with tombstones."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.views import python_round
from ..schemas import RECORDS
from . import statistics
from .index import RecordIndex, fold, folded

_TEXTS = ("applicant_name", "dob", "gender", "document_id", "address", "front_filename", "back_filename", "front_file_path", "back_file_path", "annotated_front_path", "annotated_back_path", "crops_dir")
MOST_ROWS = 200
#: Rows of a data file; a batch is sorted, written and indexed by a task for each.
FILE_ROWS = 100_000
_TOMBSTONES = "id string, tier string, day date, batch string"
_STORED = T.StructType([*RECORDS, T.StructField("batch", T.StringType())])


def like(c: Column, term: str) -> Column:
    """LIKE '%term%' without regard to case of ASCII letters; % and _ of the term are wildcards."""
    return folded(c).like("%" + fold(term).replace("\\", "\\\\") + "%")


def filtered(records: DataFrame, tier: str | None = None, search: str | None = None) -> DataFrame:
    """Records of a tier (none, blank or ALL: any) whose name, document id or id is like the search term."""
    d = records
    if tier and tier.upper() != "ALL":
        d = d.where(F.col("tier") == tier.upper())
    if search and search.strip():
        term = search.strip()
        d = d.where(like(F.col("applicant_name"), term) | like(F.col("document_id"), term) | like(F.col("id"), term))
    return d


def page(records: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest first, the id breaks ties; one TakeOrderedAndProject, no full sort."""
    return records.orderBy(F.desc("timestamp"), "id").offset(offset).limit(limit)


def checked(limit: int, offset: int) -> None:
    if not 1 <= limit <= MOST_ROWS or offset < 0:
        raise ValueError(f"limit must be 1 to {MOST_ROWS} and offset 0 or more")


def checked_page(records: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """``page`` with the bounds of the service: 1 to 200 rows, no negative offset."""
    checked(limit, offset)
    return page(records, limit, offset)


def stats(records: DataFrame) -> DataFrame:
    """One row: total_records and a map of tier to count; one pass, also over an empty table."""
    by = records.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("tier", "n")))).alias("tier_breakdown"))


def needs_attention(records: DataFrame) -> DataFrame:
    return records.agg(F.count_if(F.col("tier").isin("CRITICAL_MISMATCH", "LOW")).alias("needs_attention"))


def record_id(at: Column | None = None) -> Column:
    """VERIF-<time>-<6 hex>: not deterministic, so write it before it is used twice."""
    return F.concat(F.lit("VERIF-"), F.date_format(at if at is not None else F.current_timestamp(), "yyyyMMddHHmmss"), F.lit("-"), F.upper(F.substring(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")), 1, 6)))


class RecordStore:
    """Records under a folder: ``records`` partitioned by batch and tier, ``deleted`` ids and indexes beside them.

    Deleting appends a tombstone; reading leaves tombstones out by an anti-join;
    ``compact`` rewrites what is left. Every batch is a folder of its own, so
    writers don't hold each other up, and none mistakes another's rows for its own.

    A batch's files are sorted by time, newest first, within tier, and carry a
    bloom filter of ids. Pages, lookups and searches ask the batch's index
    (``sources.index``) which files or rows to read; batches without one, such
    as a writer's that ended early, are scanned.
    """

    def __init__(self, spark: SparkSession, root: str, file_rows: int = FILE_ROWS):
        self.spark, self.root, self.file_rows = spark, root.rstrip("/"), file_rows
        self.index = RecordIndex(spark, self.root)

    def create(self) -> RecordStore:
        """Lay out the empty table if there is none."""
        if not self._children("records"):
            self.spark.createDataFrame([], RECORDS).write.partitionBy("tier").parquet(f"{self.root}/records/batch=b-0")
        return self

    # --- batches

    def _fs(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _children(self, name: str) -> list[str]:
        path, fs = self._fs(name)
        return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []

    def _remove(self, name: str) -> None:
        path, fs = self._fs(name)
        fs.delete(path, True)

    def batches(self) -> list[str]:
        """Batches that count: what a compaction writes does once its commit is there, and what it read no longer does."""
        into, retired = set(), set()
        if self._children("compactions"):
            for r in self.spark.read.schema("into string, retired array<string>").json(f"{self.root}/compactions").collect():
                into.add(r["into"])
                retired.update(r["retired"])
        there = [x.removeprefix("batch=") for x in self._children("records") if x.startswith("batch=")]
        return [b for b in there if b not in retired and (b in into or not b.startswith("c-"))]

    def indexed(self, batches: list[str]) -> tuple[list[str], list[str]]:
        """Batches with their index, and those without."""
        done = {x.removeprefix("batch=") for x in self._children("files") if "_SUCCESS" in self._children(f"files/{x}")}
        return [b for b in batches if b in done], [b for b in batches if b not in done]

    def _scan(self, batches: list[str]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], _STORED)
        base = f"{self.root}/records"
        return self.spark.read.schema(_STORED).option("basePath", base).parquet(*[f"{base}/batch={b}" for b in batches])

    def _left(self, d: DataFrame) -> DataFrame:
        """Without the records that were deleted."""
        d = d.select(*RECORDS.fieldNames())
        if not self._children("deleted"):
            return d
        gone = self.spark.read.schema("id string").parquet(f"{self.root}/deleted")
        return d.join(gone, "id", "left_anti").select(*RECORDS.fieldNames())

    def records(self) -> DataFrame:
        """All records that weren't deleted; the audit stays text until it is asked for (``with_audit``)."""
        return self._left(self._scan(self.batches()))

    # --- writing

    def save(self, rows: DataFrame) -> DataFrame:
        """Append ``rows``; missing columns get the defaults of the table. Returns the ids that were written."""
        there = rows.columns
        text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in there else F.lit("")
        flag = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)) if c in there else F.lit(False)
        d = rows.select(
            (F.col("id") if "id" in there else record_id()).alias("id"), (F.col("timestamp") if "timestamp" in there else F.localtimestamp()).cast("timestamp_ntz").alias("timestamp"), *[text(c).alias(c) for c in _TEXTS],
            python_round(F.coalesce(F.col("overall_score") if "overall_score" in there else F.lit(None), F.lit(0.0)), 1).alias("overall_score"), F.coalesce(F.col("tier") if "tier" in there else F.lit(None), F.lit("UNKNOWN")).alias("tier"),
            *[flag(c).alias(c) for c in ("critical_flag", "manual_review_priority", "has_back_document")], (F.coalesce("audit_json", F.lit("{}")) if "audit_json" in there else F.lit("{}")).alias("audit_json"),
        ).select(*RECORDS.fieldNames())
        # a folder of this batch's own, written once: whoever else writes meanwhile, these ids are the batch's
        batch = f"b-{uuid.uuid4().hex}"
        self.write_batch(d, batch)
        return self.spark.read.schema(RECORDS).parquet(f"{self.root}/records/batch={batch}").select("id")

    def write_batch(self, d: DataFrame, batch: str) -> None:
        """Write and index a batch of whole records; writing it again replaces it.

        Rows are costly to make and their ids are drawn, so they are written as
        they come first, then sorted into files of about ``file_rows``.
        """
        staged = f"staging/{batch}"
        d.write.mode("overwrite").parquet(f"{self.root}/{staged}")
        rows = self.spark.read.schema(RECORDS).parquet(f"{self.root}/{staged}")
        n = rows.count()
        order = [F.col("tier"), F.desc_nulls_last("timestamp"), F.col("id")]
        bloom = {"parquet.bloom.filter.enabled#id": "true", "parquet.bloom.filter.expected.ndv#id": str(min(max(n, 1), self.file_rows))}
        self._remove(f"files/batch={batch}")
        ranged = rows.repartitionByRange(max(1, math.ceil(n / self.file_rows)), *order).sortWithinPartitions(*order)
        ranged.write.mode("overwrite").options(**bloom).partitionBy("tier").parquet(f"{self.root}/records/batch={batch}")
        if n:
            self.index.build(batch)
        self._remove(f"lists/batch={batch}")
        self._remove(staged)

    def delete(self, record: str, on_files: Callable[[dict], None] | None = None) -> bool:
        """Mark a record as deleted; False if there is none. ``on_files`` gets the row, to remove what belongs to it."""
        row = self.get(record).collect()
        if not row:
            return False
        if on_files is not None:
            on_files(row[0].asDict())
        self.delete_all(self.spark.createDataFrame([(record,)], "id string"), self._holders(record))
        return True

    def delete_all(self, ids: DataFrame, among: DataFrame | None = None) -> None:
        """Mark the records with these ids (id) as deleted; ids that aren't there make no tombstone.

        A tombstone says where its record counts: in which batch, day and tier.
        """
        there = self._scan(self.batches()) if among is None else among
        if self._children("deleted"):
            there = there.join(self._tombstones().select("id"), "id", "left_anti")
        found = there.join(ids.select("id").distinct(), "id", "left_semi")
        found.select("id", "tier", statistics.day_of(F.col("timestamp")).alias("day"), "batch").write.mode("append").parquet(f"{self.root}/deleted")

    def _tombstones(self) -> DataFrame:
        if not self._children("deleted"):
            return self.spark.createDataFrame([], _TOMBSTONES)
        return self.spark.read.schema(_TOMBSTONES).parquet(f"{self.root}/deleted")

    def compact(self, to: str | None = None) -> RecordStore:
        """Write the records that are left to one batch, here or in another folder.

        Here, readers see the old batches until the commit, one small file, is
        there, and the new one from then on; batches that others write meanwhile
        aren't touched. The old folders stay for readers that have begun, until
        ``vacuum``.
        """
        if to is not None:
            other = RecordStore(self.spark, to, self.file_rows)
            other.write_batch(self.records(), f"b-{uuid.uuid4().hex}")
            return other
        old, batch = self.batches(), f"c-{uuid.uuid4().hex}"
        self.write_batch(self._left(self._scan(old)), batch)
        commit = self.spark.createDataFrame([(batch, old)], "into string, retired array<string>").coalesce(1)
        commit.write.mode("append").json(f"{self.root}/compactions")
        return self

    def vacuum(self) -> list[str]:
        """Remove the folders of batches that no longer count; returns their names."""
        live = set(self.batches())
        retired = {x for r in self.spark.read.schema("retired array<string>").json(f"{self.root}/compactions").collect() for x in r["retired"]} if self._children("compactions") else set()
        gone = sorted(b for b in (x.removeprefix("batch=") for x in self._children("records")) if b in retired and b not in live)
        for b in gone:
            for name in ("files", "grams", "postings", "statistics", "records"):
                self._remove(f"{name}/batch={b}")
        return gone

    # --- reading by index

    def get(self, record: str) -> DataFrame:
        """The record with this id, from the files whose ids take it in; their bloom filters skip what hasn't got it."""
        return self._left(self._holders(record)).limit(1)

    def _holders(self, record: str) -> DataFrame:
        """Stored rows with this id, with their batch, deleted or not."""
        done, rest = self.indexed(self.batches())
        files = self.index.holding(done, record)
        found = self._scan(done) if files is None else self.index.read(files, _STORED)
        return found.select(*_STORED.fieldNames()).union(self._scan(rest)).where(F.col("id") == record)

    def search(self, term: str) -> DataFrame:
        """``filtered(records(), search=term)``, by the trigram index where the term has a run of three letters that is rare enough."""
        batches = self.batches()
        done, rest = self.indexed(batches)
        near = self.index.candidates(term, done)
        if near is None:
            return self._left(filtered(self._scan(batches), search=term))
        files = sorted(r[0] for r in near.select("file").distinct().collect())
        at = self.index.read(files, _STORED).join(F.broadcast(near), ["file", "row"], "left_semi")  # bounded: see MOST_CANDIDATES
        both = at.select(*RECORDS.fieldNames()).union(self._scan(rest).select(*RECORDS.fieldNames()))
        return self._left(filtered(both, search=term))

    def newest(self, tier: str | None = None, rows: int = MOST_ROWS) -> DataFrame:
        """Records that hold the ``rows`` newest ones of a tier, read from few files.

        Deleted records fill places on a page, so as many more are taken as
        there are tombstones; a store with many is compacted.
        """
        done, rest = self.indexed(self.batches())
        gone = self.spark.read.schema("id string").parquet(f"{self.root}/deleted").count() if self._children("deleted") else 0
        files = self.index.newest(done, tier, rows + gone)
        found = self._scan(done) if files is None else self.index.read(files, _STORED)
        both = found.select(*RECORDS.fieldNames()).union(self._scan(rest).select(*RECORDS.fieldNames()))
        return self._left(filtered(both, tier))

    def list(self, tier: str | None = None, search: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        """A page of the records of a tier that are like the search term, newest first."""
        d = filtered(self.search(search.strip()), tier) if search and search.strip() else self.newest(tier, limit + offset)
        return with_audit(page(d, limit, offset))

    def statistics(self, by: Sequence[str] = ("tier",), quantiles: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
        """Exact counts by day or tier or both, with quantiles of the scores and distinct document numbers by sketches.

        Merged from the batches' partial statistics; only batches without an
        index are counted record by record.
        """
        if not set(by) <= {"day", "tier"}:
            raise ValueError("statistics are by day, tier or both")
        batches = self.batches()
        done, rest = self.indexed(batches)
        parts = self.index.statistics(done).drop("batch").unionByName(statistics.partial(self._scan(rest)))
        # two writers may have deleted a record at once; what a compaction dropped is in no live batch
        gone = self._tombstones().where(F.col("batch").isin(batches)).dropDuplicates(["id"]).groupBy("day", "tier").agg(F.count(F.lit(1)).alias("n"))
        return statistics.merged(parts, gone, list(by), quantiles)

    def stats(self) -> dict:
        """Total and count of each tier, from the partial statistics."""
        by = {r["tier"]: r["n"] for r in self.statistics().select("tier", "n").collect()}
        return {"total_records": sum(by.values()), "tier_breakdown": dict(sorted(by.items())), "storage_path": self.root}

    def needs_attention(self) -> int:
        return self.statistics().where(F.col("tier").isin(*statistics.ATTENTION)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def with_audit(records: DataFrame) -> DataFrame:
    """Adds ``audit``, the parsed audit as VARIANT; text that isn't JSON gives null and stays in ``audit_json``."""
    return records.withColumn("audit", F.try_parse_json("audit_json"))


def audit_fields(records: DataFrame) -> DataFrame:
    """(id, field_name, submitted, ocr_text, score, status, doc_side, diff, audit_text): a row for each field of each stored audit.

    The audit is parsed once, as VARIANT, and taken apart by ``variant_explode``.
    An audit that isn't JSON, or has no fields, is one row without a field, and
    keeps its text in ``audit_text``.
    """
    d = records.select("id", "audit_json", F.expr("try_variant_get(try_parse_json(audit_json), '$.fields', 'variant')").alias("f"))
    part = lambda name, kind: f"try_variant_get(x.value, '$.{name}', '{kind}') AS {name}"
    return records.sparkSession.sql(
        f"""SELECT d.id, x.key AS field_name, {part('submitted', 'string')}, {part('ocr_text', 'string')}, {part('score', 'double')}, {part('status', 'string')}, {part('doc_side', 'string')}, {part('diff', 'string')},
        CASE WHEN x.key IS NULL THEN d.audit_json END AS audit_text FROM {{d}} d, LATERAL variant_explode_outer(d.f) x""",
        d=d,
    )


def envelope(rows: DataFrame) -> dict:
    """What the service returns for a page."""
    found = [r.asDict(recursive=True) for r in rows.drop("audit").collect()]
    return {"count": len(found), "records": found}
