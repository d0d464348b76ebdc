"""What is shown or sent of matches, verdicts and records."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the notice that goes with every audit.
POLICY_NOTICE = "Confidence measures technical clarity and imaging uncertainty, not citizen guilt. Low confidence routes to manual priority review and is never auto-rejected."


def python_round(c: Column, digits: int) -> Column:
    """Half to even on the exact binary value, as JSON of the audit has it."""

    def rounded(x: pd.Series) -> pd.Series:
        return x.map(lambda v: round(v, digits), na_action="ignore")

    rounded.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return F.pandas_udf(rounded, "double")(c.cast("double"))


def match_view(matches: DataFrame) -> DataFrame:
    """(doc_id, field_name, json): null members, such as an empty diff, are left out."""
    body = F.struct("submitted", "ocr_text", python_round(F.col("score"), 1).alias("score"), "status", "bbox", "doc_side", F.nullif("diff", F.lit("")).alias("diff"))
    return matches.select("doc_id", "field_name", F.to_json(body).alias("json"))


def field_view(fields: DataFrame) -> DataFrame:
    """(doc_id, side, field_name, json) of extracted fields, confidence with two digits."""
    body = F.struct("field_name", "raw_text", "normalized_text", "bbox", python_round(F.col("confidence"), 2).alias("confidence"), "matched_pattern")
    return fields.select("doc_id", "side", "field_name", F.to_json(body).alias("json"))


def extraction_view(fields: DataFrame, texts: DataFrame, images: DataFrame | None = None, backend: str | None = None) -> DataFrame:
    """(doc_id, side, json): what was extracted from each side: full_text, token_count, fields by name, image_shape, backend_used.

    ``texts``: (doc_id, side, full_text, token_count), as ``layout.full_text``
    gives them; ``fields`` of the same; ``images`` (doc_id, side, width, height).
    A side without fields has an empty map, one without an image no shape.
    """
    one = F.struct("field_name", F.struct("field_name", "raw_text", "normalized_text", "bbox", python_round(F.col("confidence"), 2).alias("confidence"), "matched_pattern").alias("v"))
    named = fields.withColumn("_x", one).groupBy("doc_id", "side").agg(F.map_from_entries(F.array_sort(F.collect_list("_x"))).alias("fields"))  # five at most
    d = texts.select("doc_id", "side", "full_text", "token_count").join(named, ["doc_id", "side"], "left")
    if images is None:
        d = d.withColumn("image_shape", F.lit(None).cast("array<int>"))
    else:
        d = d.join(images.select("doc_id", "side", F.array("height", "width").alias("image_shape")), ["doc_id", "side"], "left")
    empty = F.expr("map()").cast(named.schema["fields"].dataType)
    body = F.struct("full_text", "token_count", F.coalesce("fields", empty).alias("fields"), "image_shape", F.lit(backend).cast("string").alias("backend_used"))
    return d.select("doc_id", "side", F.to_json(body).alias("json"))


def rounded(values: Column, digits: int) -> Column:
    """``python_round`` of an array's values."""

    def over(x: pa.Array) -> pa.Array:
        flat = [None if v is None else round(v, digits) for v in x.flatten().to_pylist()]
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(x), 0).to_numpy())])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.float64()))

    over.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return F.arrow_udf(over, "array<double>").asNondeterministic()(values)


def audits(documents: DataFrame, extended: bool = True) -> DataFrame:
    """``documents`` with audit_json: overall score, tier, fields by name, flags; ``extended`` adds review and policy.

    ``documents``: a row for each, with its merged matches as the array
    ``fields``, has_back and the verdict's columns; nothing is joined or shuffled.
    """
    d = documents.withColumn("_r", rounded(F.concat(F.array("overall_score"), F.col("fields.score")), 1))
    body = lambda m, i: F.struct(m["submitted"], m["ocr_text"], F.get("_r", i + 1).alias("score"), m["status"], m["bbox"], m["doc_side"], F.nullif(m["diff"], F.lit("")).alias("diff"))
    fields = F.map_from_entries(F.array_sort(F.transform("fields", lambda m, i: F.struct(m["field_name"], body(m, i).alias("v")))))
    parts = [F.get("_r", F.lit(0)).alias("overall_score"), F.col("tier"), fields.alias("fields"), F.col("critical_flag"), F.col("has_back").alias("has_back_document")]
    if extended:
        parts += [F.col("manual_review_priority"), F.col("review_reason"), F.lit(POLICY_NOTICE).alias("policy_notice")]
    d = d.withColumn("_t", F.to_json(F.struct(*parts)))
    text = F.col("_t")
    if extended:  # a reason that is null is said to be null, while empty diffs are left out
        text = F.when(F.col("review_reason").isNull(), F.concat(F.expr("left(_t, length(_t) - 1)"), F.lit(',"review_reason":null}'))).otherwise(text)
    return d.withColumn("audit_json", text).drop("_r", "_t")


def data_url(png: Column) -> Column:
    return F.concat(F.lit("data:image/png;base64,"), F.base64(png))


def label_text(field: Column, score: Column) -> Column:
    """NAME (98%)"""
    return F.concat(F.upper(F.replace(field, F.lit("_"), F.lit(" "))), F.lit(" ("), F.format_string("%.0f", score), F.lit("%)"))


def initials(name: Column) -> Column:
    """First characters of the first two words, upper case; a nameless applicant is Anonymous, a blank one ID."""
    words = F.slice(F.split(F.coalesce(F.nullif(name, F.lit("")), F.lit("Anonymous")), " "), 1, 2)
    return F.coalesce(F.nullif(F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")), F.lit("")), F.lit("ID"))


def chip(tier: Column) -> Column:
    return F.when(tier == "MEDIUM", "Mostly Match").when(tier == "LOW", "Needs Review").when(tier == "CRITICAL_MISMATCH", "Difference Found").otherwise("High Match")


def score_band(score: Column) -> Column:
    return F.when(score >= 95, "high").when(score >= 50, "medium").otherwise("low")


def card_class(score: Column) -> Column:
    return F.when(score < 50, "low").when(score < 95, "med").otherwise("high")


def gauge_offset(score: Column) -> Column:
    return 314 * (1 - F.least(F.lit(100.0), F.greatest(F.lit(0.0), score)) / 100)


def escape_html(c: Column) -> Column:
    out = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def valid_box(bbox: Column) -> Column:
    return F.coalesce((F.size(bbox) == 4) & (F.get(bbox, 2) > 0) & (F.get(bbox, 3) > 0), F.lit(False))


def on_side(side: Column, wanted: str) -> Column:
    return F.coalesce(side, F.lit("front")) == wanted


def crop_box(bbox: Column, width: Column, height: Column, padding: int = 4) -> Column:
    """(x1, y1, x2, y2) of a padded crop held within the image; null if nothing is left."""
    zero = F.lit(0)
    x1, y1 = F.greatest(zero, F.get(bbox, 0) - padding), F.greatest(zero, F.get(bbox, 1) - padding)
    x2, y2 = F.least(width, F.get(bbox, 0) + F.get(bbox, 2) + padding), F.least(height, F.get(bbox, 1) + F.get(bbox, 3) + padding)
    return F.when(valid_box(bbox) & (x2 > x1) & (y2 > y1), F.array(x1, y1, x2, y2))


def rotated_size(width: Column, height: Column, angle: Column) -> Column:
    """(width, height) of the canvas that holds an image turned by ``angle`` degrees."""
    s, c = F.abs(F.sin(F.radians(angle))), F.abs(F.cos(F.radians(angle)))
    turned = F.array((height * s + width * c).cast("int"), (height * c + width * s).cast("int"))
    return F.when(F.abs(angle) < 0.01, F.array(width.cast("int"), height.cast("int"))).otherwise(turned)


def fold_skew(angle: Column, longest: float = 45.0) -> Column:
    """The turn that undoes a rectangle's angle, within -45..45; 0 if it is under a fifth of a degree or beyond ``longest``."""
    a = F.when(angle < -45, -(angle + 90)).when(angle > 45, 90 - angle).otherwise(-angle)
    return F.when((F.abs(a) < 0.2) | (F.abs(a) > longest), F.lit(0.0)).otherwise(a)


def report(matches: DataFrame) -> DataFrame:
    """Rows of the terminal report: values cut to 18 and 25 characters, scores with one digit."""
    return matches.select(
        "doc_id", F.col("field_name").alias("field"), F.concat(F.format_string("%.1f", "score"), F.lit("%")).alias("score"), "status",
        F.substring("submitted", 1, 18).alias("submitted"), F.substring("ocr_text", 1, 25).alias("ocr_extracted"), F.nullif("diff", F.lit("")).alias("diff"), "bbox",
    )
