"""Statistics of the record store that are merged, not recounted.

Each batch keeps partial statistics by day and tier: exact counts, a KLL sketch
of the scores and an HLL sketch of the document numbers. A reader merges those
of the live batches, a row for each batch, day and tier instead of one for each
record, and takes tombstones off the counts. Sketches can't be subtracted from:
quantiles and distinct numbers stand for what was stored until a compaction
drops deleted records for good.

Bounds: a quantile's rank is off by at most ``RANK_ERROR`` of the rows (KLL,
99 of 100 times); the estimate of distinct numbers has a relative standard error
of ``DISTINCT_ERROR``, so three times that holds as good as always. Merging
keeps both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of the sketches, and the errors that follow from it.
KLL_K, RANK_ERROR = 200, 0.0165
HLL_LOG2, DISTINCT_ERROR = 12, 1.04 / 64
PARTIAL = "day date, tier string, n long, scores binary, numbers binary"
#: Tiers that need attention.
ATTENTION = ("CRITICAL_MISMATCH", "LOW")


def day_of(time: Column) -> Column:
    return F.to_date(time)


def partial(records: DataFrame) -> DataFrame:
    """(day, tier, n, scores, numbers) of records; one partial aggregate before the shuffle."""
    return records.groupBy(day_of(F.col("timestamp")).alias("day"), "tier").agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.coalesce("overall_score", F.lit(0.0)), F.lit(KLL_K)).alias("scores"), F.hll_sketch_agg(F.coalesce("document_id", F.lit("")), F.lit(HLL_LOG2)).alias("numbers")
    )


def merged(parts: DataFrame, tombstones: DataFrame, by: list[str], quantiles: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """``by`` (of day and tier), n, quantiles (an array of scores) and distinct numbers.

    ``tombstones``: (day, tier, n) of deleted records. Groups of which nothing is
    left don't show.
    """
    stored = parts.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("scores").alias("scores"), F.hll_union_agg("numbers").alias("numbers"))
    gone = tombstones.groupBy(*by).agg(F.sum("n").alias("gone")) if by else tombstones.agg(F.sum("n").alias("gone"))
    both = stored.join(gone.withColumnsRenamed({c: f"_{c}" for c in by}), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], "left") if by else stored.crossJoin(gone)  # one row each
    left = (F.col("n") - F.coalesce("gone", F.lit(0))).alias("n")
    at = F.kll_sketch_get_quantile_double("scores", F.array(*[F.lit(q) for q in quantiles]))
    return both.where((F.col("n") > F.coalesce("gone", F.lit(0)))).select(*by, left, at.alias("quantiles"), F.hll_sketch_estimate("numbers").alias("distinct_numbers"))
