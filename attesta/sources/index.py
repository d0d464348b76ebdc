"""Indexes of the record store: what each file holds, and which rows hold which trigrams.

Both are tables beside the records, a folder for each batch:

* ``statistics``: counts and sketches by day and tier (``sources.statistics``).
* ``files``: (file, tier, n, first_time, last_time, first_id, last_id) of each data file. It is written last; a batch without it isn't indexed yet and is scanned.
* ``grams``: (field, gram, n), how many rows of the batch hold a trigram.
* ``postings``: (field, gram, file, rows), those rows as lists, sorted, so that a reader of one trigram opens few row groups. A list is of one batch of records at most.

Searching stays what the scan does (``records.filtered``): the index only says
which rows can match at all.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import statistics

#: Fields that a search term is looked for in.
SEARCHED = ("applicant_name", "document_id", "id")
#: Trigrams of a term that candidates must hold; the final test does the rest.
RAREST = 3
#: Rows of a posting file, and candidates beyond which a search reads the records instead.
POSTING_ROWS, MOST_CANDIDATES = 5_000_000, 1_000_000
#: A search for what more than this share of the records may hold reads them all.
SCAN_SHARE = 0.2
FILES = "file string, tier string, n long, first_time timestamp_ntz, last_time timestamp_ntz, first_id string, last_id string"
GRAMS = "field string, gram string, n long"
POSTINGS = "field string, gram string, file string, rows array<int>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(c: Column) -> Column:
    """Lower case of ASCII letters alone."""
    return F.translate(c, _UPPER, _LOWER)


def fold(term: str) -> str:
    return "".join(x.lower() if x.isascii() else x for x in term)


_KIND = pa.schema([("field", pa.string()), ("gram", pa.string()), ("file", pa.string()), ("rows", pa.list_(pa.int32()))])


def posting_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For (file, row, folded texts of ``SEARCHED``) the rows of each trigram, batch by batch: a list instead of a row for each of its records."""
    for batch in batches:
        files, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for field, texts in zip(SEARCHED, batch.columns[2:], strict=True):
            lists: dict[tuple[str, str], list[int]] = {}
            for file, row, text in zip(files, rows, texts.to_pylist(), strict=True):
                for gram in {text[i : i + 3] for i in range(len(text) - 2)}:
                    lists.setdefault((gram, file), []).append(row)
            if lists:
                grams, of = zip(*lists, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([field] * len(lists)), pa.array(grams), pa.array(of), pa.array(lists.values(), pa.list_(pa.int32()))], schema=_KIND)


def literal_trigrams(term: str) -> list[str]:
    """Trigrams that any text like the term must hold: those of the runs between its wildcards."""
    return sorted({run[i : i + 3] for run in re.split("[%_]", fold(term)) for i in range(len(run) - 2)})


class RecordIndex:
    """The indexes of a store's folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _table(self, name: str, batches: list[str], schema: str) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema + ", batch string")
        base = f"{self.root}/{name}"
        return self.spark.read.schema(schema + ", batch string").option("basePath", base).parquet(*[f"{base}/batch={b}" for b in batches])

    def files(self, batches: list[str]) -> DataFrame:
        return self._table("files", batches, FILES)

    def build(self, batch: str) -> None:
        """Index a batch that was written; running it again gives the same tables."""
        path = f"{self.root}/records/batch={batch}"
        place = F.regexp_extract(F.col("_metadata.file_path"), r"(batch=[^/]+/.*)$", 1)
        stored = self.spark.read.schema("id string, timestamp timestamp_ntz, applicant_name string, document_id string, overall_score double, tier string").option("basePath", f"{self.root}/records").parquet(path)
        d = stored.select("*", place.alias("file"), F.col("_metadata.row_index").alias("row"))
        write = lambda t, name: t.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch}")
        texts = [folded(F.coalesce(f, F.lit(""))).alias(f) for f in SEARCHED]
        # made once: counts, ranges and the lists themselves are read off this table
        write(d.select("file", "row", *texts).mapInArrow(posting_lists, POSTINGS), "lists")
        lists = self.spark.read.schema(POSTINGS).parquet(f"{self.root}/lists/batch={batch}")
        write(lists.groupBy("field", "gram").agg(F.sum(F.size("rows").cast("long")).alias("n")).coalesce(1).sortWithinPartitions("field", "gram"), "grams")
        total = self.spark.read.schema(GRAMS).parquet(f"{self.root}/grams/batch={batch}").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        order = ["field", "gram", "file", F.get("rows", F.lit(0))]  # ranges go down to lists: a trigram that every row holds is split like any other
        write(lists.repartitionByRange(max(1, math.ceil(total / POSTING_ROWS)), *order).sortWithinPartitions(*order), "postings")
        write(statistics.partial(d).coalesce(1), "statistics")
        time = F.col("timestamp")
        first = F.when(F.count(time) == F.count(F.lit(1)), F.min(time))  # rows without a time come last: such a file goes on to the end
        write(d.groupBy("file", "tier").agg(F.count(F.lit(1)).alias("n"), first.alias("first_time"), F.max(time).alias("last_time"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).coalesce(1), "files")

    def statistics(self, batches: list[str]) -> DataFrame:
        return self._table("statistics", batches, statistics.PARTIAL)

    def read(self, files: list[str], schema) -> DataFrame:
        """Records of these data files alone, with the place of each row."""
        base = f"{self.root}/records"
        if not files:
            return self.spark.createDataFrame([], schema).withColumns({"file": F.lit(""), "row": F.lit(0).cast("long")})
        d = self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/{unquote(f)}" for f in files])
        return d.select("*", F.regexp_extract(F.col("_metadata.file_path"), r"(batch=[^/]+/.*)$", 1).alias("file"), F.col("_metadata.row_index").alias("row"))

    def candidates(self, term: str, batches: list[str]) -> DataFrame | None:
        """(file, row) of the rows that can match, at most ``MOST_CANDIDATES``; None if the records had better be read.

        A field's candidates hold its rarest trigrams of the term. What reaches
        the driver is a count for each of the term's trigrams.
        """
        grams = literal_trigrams(term)
        if not grams or not batches:
            return None
        of = self._table("grams", batches, GRAMS).where(F.col("gram").isin(grams)).groupBy("field", "gram").agg(F.sum("n").alias("n"))
        counts: dict[str, dict[str, int]] = {}
        for r in of.collect():
            counts.setdefault(r["field"], {})[r["gram"]] = r["n"]
        chosen = {f: sorted(n, key=lambda g: (n[g], g))[:RAREST] for f, n in counts.items() if len(n) == len(grams)}
        most = sum(counts[f][g[0]] for f, g in chosen.items())
        total = self.files(batches).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if most > min(MOST_CANDIDATES, max(1, SCAN_SHARE * total)):
            return None
        postings = self._table("postings", batches, POSTINGS)
        met = F.lit(False)
        for f, g in chosen.items():
            met |= (F.col("field") == f) & F.col("gram").isin(g)
        needed = F.create_map(*[F.lit(x) for f, g in chosen.items() for x in (f, len(g))]) if chosen else None
        hits = postings.where(met).select("field", "file", F.explode(F.col("rows").cast("array<long>")).alias("row"))
        if needed is not None:
            hits = hits.groupBy("field", "file", "row").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == needed[F.col("field")])
        return hits.select("file", "row").distinct()

    def newest(self, batches: list[str], tier: str | None, rows: int) -> list[str] | None:
        """Data files that hold the ``rows`` newest records; None if that can't be told by few files.

        As every file has a row, the ``rows`` files whose oldest record is newest
        are enough to know a time that so many records reach.
        """
        files = self.files(batches)
        if tier and tier.upper() != "ALL":
            files = files.where(F.col("tier") == tier.upper())
        seen, since = 0, None
        for r in files.where("first_time IS NOT NULL").orderBy(F.desc("first_time"), "file").limit(rows).select("first_time", "n").collect():
            seen, since = seen + r["n"], r["first_time"]
            if seen >= rows:
                break
        needed = files if seen < rows else files.where(F.col("last_time") >= F.lit(since))
        return self._names(needed)

    def holding(self, batches: list[str], record: str) -> list[str] | None:
        """Data files whose range of ids takes in this one."""
        return self._names(self.files(batches).where((F.col("first_id") <= record) & (F.col("last_id") >= record)))

    def _names(self, files: DataFrame, most: int = 10_000) -> list[str] | None:
        got = [r[0] for r in files.select("file").limit(most + 1).collect()]
        return sorted(got) if len(got) <= most else None
