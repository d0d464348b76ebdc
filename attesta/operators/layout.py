"""Rebuilding text from OCR tokens, and finding the tokens of a span."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DOC = ("doc_id", "side")


def ocr_words(lines: DataFrame) -> DataFrame:
    """Tokens of OCR lines (doc_id, side, line_idx, poly, text, conf): polygons become boxes, lines are split into words.

    A word's width is its share of the line's characters; words start where the
    ones before end, plus a fiftieth of the line's width each. Blank lines go,
    confidences up to 1 are percentages, coordinates are truncated.
    """
    corner = lambda f, axis: f(F.transform("poly", lambda p: p[axis])).cast("int")
    words = F.split(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""), r"(?U)\s+")
    d = lines.where(F.coalesce(F.regexp_replace("text", r"(?U)\s+", ""), F.lit("")) != "").select(
        *DOC, "line_idx", corner(F.array_min, 0).alias("x0"), corner(F.array_min, 1).alias("y0"), corner(F.array_max, 0).alias("x1"), corner(F.array_max, 1).alias("y1"),
        F.when(F.col("conf") <= 1.0, F.col("conf") * 100.0).otherwise(F.col("conf")).alias("confidence"), words.alias("words"), F.regexp_replace("text", r"(?U)^\s+|\s+$", "").alias("whole"),
    )
    d = d.withColumns({"w": F.greatest(F.lit(1), F.col("x1") - F.col("x0")), "h": F.greatest(F.lit(1), F.col("y1") - F.col("y0"))})
    chars = F.aggregate("words", F.lit(0), lambda n, x: n + F.char_length(x))
    width = lambda x: F.greatest(F.lit(1), F.floor(F.col("w") * (F.char_length(x) / F.greatest(F.lit(1), chars))).cast("int"))
    d = d.withColumns({"widths": F.when(F.size("words") > 1, F.transform("words", width)).otherwise(F.array("w")), "gap": F.floor(F.col("w") * 0.02).cast("int")})
    # positions follow from the widths inside the row: no window, no shuffle
    boxes = F.transform("widths", lambda w, i: F.struct(i.alias("i"), (F.col("x0") + F.aggregate(F.slice("widths", F.lit(1), i), F.lit(0), lambda s, v: s + v) + i * F.col("gap")).cast("int").alias("x"), w.alias("w"), F.when(F.size("words") > 1, F.get("words", i)).otherwise(F.col("whole")).alias("text")))
    d = d.select(*DOC, "line_idx", "confidence", "y0", "h", F.explode(boxes).alias("t"))
    order = Window.partitionBy(*DOC).orderBy("line_idx", "t.i")
    return d.select(*DOC, (F.row_number().over(order) - 1).alias("tok_id"), F.col("t.text").alias("text"), F.array("t.x", "y0", "t.w", "h").alias("bbox"), "confidence", F.col("line_idx").alias("line_num"), F.lit(0).alias("block_num"))


def clean_ocr_tokens(tokens: DataFrame) -> DataFrame:
    """Tokens of an engine that gives words: blank text and negative confidence go, confidences are held to 0..100."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "")
    return tokens.where((text != "") & (F.col("confidence") >= 0)).withColumns({"text": text, "confidence": F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("confidence")))})


def token_spans(tokens: DataFrame) -> DataFrame:
    """Tokens with span_start and span_end in the document's text (lines in order, words by x)."""
    order = Window.partitionBy(*DOC).orderBy("line_num", F.col("bbox")[0], "tok_id")
    before = F.coalesce(F.sum(F.char_length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    return tokens.withColumn("span_start", before).withColumn("span_end", F.col("span_start") + F.char_length("text"))


def lines_by_place(tokens: DataFrame) -> DataFrame:
    """Tokens with ``line_num`` from where they are, for engines that don't number lines.

    The page's slope is the median over neighbours in the engine's order that can
    be on one line: the next one lies to the right, off by less than its height.
    Taking the slope away makes lines level; then tokens, from the top, start a
    new line where their middle halves overlap none of the ones before. Windows
    over a document's side only; tokens without a box of positive size get null.
    """
    x, y, w, h = (F.get("bbox", i).cast("double") for i in range(4))
    page = Window.partitionBy(*DOC)
    d = tokens.withColumns({"_x": x, "_y": y, "_h": F.when((w > 0) & (h > 0), h)})
    order = page.orderBy("tok_id")
    run, rise = F.lead("_x").over(order) - F.col("_x"), F.lead("_y").over(order) - F.col("_y")
    d = d.withColumn("_step", F.when((run > 0) & (F.abs(rise) < F.col("_h")), rise / run))
    # the height of a level token is its own; only its place moves
    d = d.withColumn("_top", F.when(F.col("_h").isNotNull(), F.col("_y") - F.coalesce(F.median("_step").over(page), F.lit(0.0)) * F.col("_x") + F.col("_h") / 4))
    down = page.orderBy(F.asc_nulls_last("_top"), "tok_id")
    d = d.withColumn("_reach", F.max(F.col("_top") + F.col("_h") / 2).over(down.rowsBetween(Window.unboundedPreceding, -1)))
    d = d.withColumn("_new", F.when(F.col("_top") >= F.col("_reach"), 1).otherwise(0))
    number = F.sum("_new").over(down.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("line_num", F.when(F.col("_top").isNotNull(), number).cast("int")).drop("_x", "_y", "_h", "_step", "_top", "_reach", "_new")


def full_text(tokens: DataFrame) -> DataFrame:
    """(doc_id, side, full_text, token_count): words joined by spaces, every line ends in a newline."""
    item = F.struct("line_num", F.col("bbox")[0].alias("x"), "tok_id", "text")
    grouped = tokens.groupBy(*DOC).agg(F.array_sort(F.collect_list(item)).alias("items"))  # one document's words
    numbers = F.array_sort(F.array_distinct(F.transform("items", lambda t: t["line_num"])))
    line = lambda n: F.array_join(F.transform(F.filter("items", lambda t: t["line_num"] == n), lambda t: t["text"]), " ")
    return grouped.select(*DOC, F.concat(F.array_join(F.transform(numbers, line), "\n"), F.lit("\n")).alias("full_text"), F.size("items").alias("token_count"))


def locate(found: DataFrame, spans: DataFrame) -> DataFrame:
    """``found`` (doc_id, side, field_name, ..., span_start, span_end) with bbox and confidence of the tokens that overlap the span."""
    t = spans.select(*DOC, F.col("span_start").alias("_s"), F.col("span_end").alias("_e"), "bbox", "confidence")
    hit = F.greatest("span_start", "_s") < F.least("span_end", "_e")
    x, y, w, h = (F.col("bbox")[i] for i in range(4))
    keys = found.columns
    boxes = (
        found.select(*DOC, "field_name", "span_start", "span_end").join(t, [*DOC]).where(hit).groupBy(*DOC, "field_name")
        .agg(F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x + w).alias("x1"), F.max(y + h).alias("y1"), F.avg("confidence").alias("c"))
    )
    one = F.lit(1)
    box = F.array("x0", "y0", F.greatest(one, F.col("x1") - F.col("x0")), F.greatest(one, F.col("y1") - F.col("y0")))
    zero = F.array(*[F.lit(0)] * 4)
    return found.join(boxes, [*DOC, "field_name"], "left").select(*keys, F.coalesce(box, zero).alias("bbox"), F.coalesce("c", F.lit(0.0)).alias("confidence"))
