"""Fronts and backs that arrive apart: a document's sides are merged in keyed state.

The stream's rows are sides (doc_id, side, full_text, event_time); forms are a
table. A side is read and matched in its own row, as in the batch; then the
document's state takes its matches in. A document leaves when both sides are
there, or when the watermark has passed ``wait`` since its first side; a side
that comes later makes it leave again, as the next version. The last version is
what the batch gives for the same sides, in whatever order they came.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.extract import all_fields
from ..operators.match import found_fields, matched
from ..operators.verdict import verdicts_of_arrays
from ..plans.verification import form_rows

#: A match, as ``operators.match`` makes it.
MATCH = "struct<side: string, field_name: string, submitted: string, ocr_text: string, score: double, status: string, bbox: array<int>, diff: string, is_critical: boolean, ocr_confidence: double, doc_side: string>"
_STATE = MATCH.removeprefix("struct<").removesuffix(">").replace(": ", " ")
_NAMES = tuple(c.split(" ")[0] for c in _STATE.split(", "))
OUT = f"doc_id string, version int, sides array<string>, complete boolean, fields array<{MATCH}>"
MILLISECOND = timedelta(milliseconds=1)
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _rank(m: dict) -> tuple:
    """The higher score wins; of equal ones one that isn't missing, then the front."""
    return m["score"], m["status"] != "missing", m["side"] == "front"


class SideMerger(StatefulProcessor):
    """State of a document: its sides and versions, and the best match of each field.

    ``wait`` is how long, by the watermark, a lone side waits; ``keep`` how long
    the state of a document that left stays for late sides. After that it is
    dropped, and a side that comes still is a document of its own.
    """

    def __init__(self, wait: int, keep: int):
        self.wait, self.keep = wait, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.about = handle.getValueState("about", "sides array<string>, version int, ends boolean")
        self.best = handle.getMapState("best", "field_name string", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.about.get() if self.about.exists() else None
        sides, version, ends = (set(known[0]), known[1], known[2]) if known else (set(), 0, False)
        before = len(sides)
        for row in rows:
            sides.add(row.side)
            for m in row.matches:
                field = (m["field_name"],)
                old = self._match(self.best.getValue(field)) if self.best.containsKey(field) else None
                if old is None or _rank(m) > _rank(old):
                    self.best.updateValue(field, tuple(m[n] for n in _NAMES))
        both = {"front", "back"} <= sides
        leaves = len(sides) > before and (both or version > 0)  # a side that comes again changes no version
        if leaves:
            version += 1
        now = max(0, timerValues.getCurrentWatermarkInMs())
        if leaves or not known:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            ends = leaves
            self.handle.registerTimer(now + (self.keep if leaves else self.wait))
        self.about.update((sorted(sides), version, ends))
        if leaves:
            yield self._row(key[0], version, sides)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        sides, version, ends = self.about.get()
        if ends:
            self.about.clear()
            self.best.clear()
            return
        self.about.update((sides, version + 1, True))
        self.handle.registerTimer(max(0, timerValues.getCurrentWatermarkInMs()) + self.keep)
        yield self._row(key[0], version + 1, set(sides))

    @staticmethod
    def _match(stored: tuple) -> dict:
        return dict(zip(_NAMES, stored, strict=True))

    def _row(self, doc_id: str, version: int, sides: set[str]) -> Row:
        fields = [self._match(m) for _, m in sorted(self.best.iterator(), key=lambda kv: kv[0][0])]
        return Row(doc_id=doc_id, version=version, sides=sorted(sides), complete={"front", "back"} <= sides, fields=fields)


def use_rocksdb(spark: SparkSession) -> None:
    """State with timers needs the RocksDB store; set before a stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def merge_sides_of_stream(sides: DataFrame, forms: DataFrame, wait: timedelta = timedelta(hours=1), keep: timedelta = timedelta(days=1), delay: str = "10 minutes", weights: dict[str, float] | None = None) -> DataFrame:
    """A stream of verdicts: (doc_id, version, sides, complete, fields, overall_score, tier, ...).

    ``sides``: a stream of (doc_id, side, full_text, event_time), each side once
    or again; ``forms``: a table with doc_id and submitted columns. Sides without
    a form don't leave. ``delay`` is the watermark's. What is kept grows with the
    documents of ``wait`` and ``keep``, not with the stream.
    """
    use_rocksdb(sides.sparkSession)
    timed = sides.withWatermark("event_time", delay)
    found = F.struct("side", found_fields(all_fields(F.col("full_text"))).alias("fields"))
    rows = timed.select("doc_id", F.col("side").alias("came"), "event_time", F.array(found).alias("sides")).join(form_rows(forms).select("doc_id", "submitted"), "doc_id")
    # without the time column, behind which Spark drops late rows: the state takes them, while it is kept
    mine = matched(rows).select("doc_id", F.col("came").alias("side"), "matches")
    merger = SideMerger(int(wait / MILLISECOND), int(keep / MILLISECOND))
    merged = mine.groupBy("doc_id").transformWithState(merger, OUT, "update", "eventTime")
    return verdicts_of_arrays(merged, weights)
