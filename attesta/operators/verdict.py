"""Evidence of both sides merged, scored and sorted into tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..schemas import FIELDS

# Weights of the fields, tier limits, and the texts that go with a tier.
WEIGHTS = {"name": 0.30, "dob": 0.20, "document_id": 0.20, "gender": 0.15, "address": 0.15}
OTHER_WEIGHT = 0.25
HIGH_FROM, MEDIUM_FROM = 95.0, 50.0
REASONS = {
    "CRITICAL_MISMATCH": "Critical mismatch in identity numbers or date of birth",
    "MEDIUM": "Moderate confidence match; minor formatting or OCR variations",
    "LOW": "Technical clarity/scan uncertainty requires manual priority officer verification; not an automated rejection.",
}


def merge_sides(matches: DataFrame) -> DataFrame:
    """One row per document and field: the side with the better evidence, with its ``doc_side``.

    The higher score wins; of equal scores one that isn't missing, then the
    front. One partial aggregate before the only shuffle.
    """
    rank = F.struct("score", (F.col("status") != "missing").alias("there"), (F.col("side") == "front").alias("front"))
    rest = [c for c in matches.columns if c not in ("doc_id", "field_name")]
    best = matches.groupBy("doc_id", "field_name").agg(F.max_by(F.struct(*rest), rank).alias("m"))
    return best.select("doc_id", "field_name", "m.*")


def merged_arrays(matches: Column) -> Column:
    """``merge_sides`` within a document's array of matches: an array with the better side of each field."""

    def best(matches: Column, field: str) -> Column:
        ranked = F.transform(F.filter(matches, lambda m: m["field_name"] == field), lambda m: F.struct(m["score"], (m["status"] != "missing").alias("there"), (m["side"] == "front").alias("front"), m.alias("m")))
        return F.array_max(ranked)["m"]

    def merged(matches: Column) -> Column:
        every = F.filter(F.array(*[best(matches, f) for f in FIELDS]), lambda m: m.isNotNull())
        # documents of one side are most: their matches are each a field's only one, in the order of the fields
        names = F.transform(matches, lambda m: m["field_name"])
        return F.when(names == F.array(*[F.lit(f) for f in FIELDS]), matches).otherwise(every)

    return let(matches, merged)


def tier_of(score: Column, critical: Column) -> Column:
    return F.when(critical, "CRITICAL_MISMATCH").when(score >= HIGH_FROM, "HIGH").when(score >= MEDIUM_FROM, "MEDIUM").otherwise("LOW")


def review(tier: Column) -> tuple[Column, Column]:
    """(manual_review_priority, review_reason)"""
    reasons = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    return tier.isin("CRITICAL_MISMATCH", "LOW"), F.try_element_at(reasons, tier)


def verdicts(merged: DataFrame, documents: DataFrame | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """One row per document: overall_score, tier, critical_flag, manual_review_priority, review_reason.

    ``merged`` has one row per document and field. Missing fields count with 0.
    The five fields are summed in a fixed order, so that results don't depend on
    the order of rows. ``documents`` (doc_id) adds those without a submitted
    field: score 0, LOW. No or empty ``weights`` are the default ones.
    """
    of = lambda f, c: F.max(F.when(F.col("field_name") == f, c))
    cols = [of(f, F.col("score")).alias(f"_{f}") for f in FIELDS]
    critical = F.bool_or(F.col("is_critical") & (F.col("status") == "mismatch"))
    d = merged.groupBy("doc_id").agg(*cols, critical.alias("critical_flag"))
    if documents is not None:
        d = documents.select("doc_id").distinct().join(d, "doc_id", "left")
    return judged(d, {f: F.col(f"_{f}") for f in FIELDS}, F.col("critical_flag"), ["doc_id"], weights)


def verdicts_of_arrays(documents: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The same of documents whose merged matches are an array, ``fields``, in their row; other columns stay."""
    one = lambda fields, f: F.get(F.filter(fields, lambda m: m["field_name"] == f), F.lit(0))["score"]
    critical = lambda fields: F.exists(fields, lambda m: m["is_critical"] & (m["status"] == "mismatch"))
    given = let(F.col("fields"), lambda fields: F.struct(*[one(fields, f).alias(f) for f in FIELDS], critical(fields).alias("critical")))
    return _judged(documents, given, documents.columns, weights)


def judged(d: DataFrame, scores: dict[str, Column], critical: Column, keep: list[str], weights: dict[str, float] | None) -> DataFrame:
    """Verdict columns from the fields' scores (null: not submitted), beside ``keep``."""
    return _judged(d, F.struct(*[scores[f].alias(f) for f in FIELDS], critical.alias("critical")), keep, weights)


def _judged(d: DataFrame, given: Column, keep: list[str], weights: dict[str, float] | None) -> DataFrame:
    """``given``: a struct of the fields' scores and ``critical``.

    The verdict is one expression that names ``given`` once: a filter on a tier
    takes the place of the columns by what they stand for, all the way down to
    the matches, and would else make these a hundred times for each document.
    """
    w = weights or WEIGHTS
    zero = F.lit(0.0)

    def scored(g: Column) -> Column:
        total, over = zero, zero
        for f in FIELDS:
            total = total + F.coalesce(g[f] * w.get(f, OTHER_WEIGHT), zero)
            over = over + F.when(g[f].isNotNull(), w.get(f, OTHER_WEIGHT)).otherwise(zero)
        score = F.when(over > 0, F.least(F.lit(100.0), F.greatest(zero, total / over))).otherwise(zero)
        return F.struct(score.alias("overall_score"), F.coalesce(g["critical"], F.lit(False)).alias("critical_flag"))

    tiered = let(let(given, scored), lambda v: F.struct(v["overall_score"].alias("overall_score"), v["critical_flag"].alias("critical_flag"), tier_of(v["overall_score"], v["critical_flag"]).alias("tier")))
    d = d.select(*keep, tiered.alias("_v")).select(*keep, "_v.overall_score", "_v.tier", "_v.critical_flag")
    manual, reason = review(F.col("tier"))
    return d.select(*keep, "overall_score", "tier", "critical_flag", manual.alias("manual_review_priority"), reason.alias("review_reason"))


def tier_counts(verdict: DataFrame) -> DataFrame:
    return verdict.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))
