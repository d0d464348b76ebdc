"""Submitted values against extracted fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import SCORES, fuzzy_score_arrays, token_diff_arrays
from ..functions.text import gender_of_form, let, normalize_address, normalize_date, normalize_id, normalize_string
from ..schemas import ALIASES, BBOX

# What a missing field says, and from which scores a field counts as a match or a partial one.
NOT_FOUND = {
    "name": "Field not detected in document", "dob": "DOB not detected on credential", "document_id": "Document ID not found on credential",
    "gender": "Gender not detected on credential", "address": "Address field not detected in document",
}
MATCH_FROM = {"name": 85.0, "address": 80.0}
PARTIAL_FROM = 50.0
CRITICAL = ("dob", "document_id")


def submitted_rows(forms: DataFrame) -> DataFrame:
    """(doc_id, field_name, submitted), one row per field that was submitted.

    A field is submitted if its column or an alias isn't null; its value is the
    first that isn't empty. Columns that don't exist count as null.
    """
    return forms.select("doc_id", F.explode(F.array(*_pairs(forms))).alias("p")).where("p.submitted IS NOT NULL").select("doc_id", "p.*")


def _pairs(forms: DataFrame) -> list[Column]:
    pairs = []
    for field, names in ALIASES.items():
        there = [F.col(f"`{n}`").cast("string") for n in names if n in forms.columns] or [F.lit(None).cast("string")]
        value = F.when(F.coalesce(*there).isNotNull(), F.coalesce(*[F.nullif(c, F.lit("")) for c in there], F.lit("")))
        pairs.append(F.struct(F.lit(field).alias("field_name"), value.alias("submitted")))
    return pairs


def submitted_arrays(forms: DataFrame) -> DataFrame:
    """(doc_id, submitted) of every form: what ``submitted_rows`` gives for it, as an array."""
    return forms.select("doc_id", submitted_array(forms).alias("submitted"))


def submitted_array(forms: DataFrame) -> Column:
    return F.filter(F.array(*_pairs(forms)), lambda p: p["submitted"].isNotNull())


def submitted_rows_of_map(forms: DataFrame, map_col: str = "submitted") -> DataFrame:
    """The same for forms given as a map of key to value."""
    keys = sorted({n for names in ALIASES.values() for n in names})
    return submitted_rows(forms.select("doc_id", *[F.try_element_at(map_col, F.lit(k)).alias(k) for k in keys]))


def name_score(s: Column, ts: Column, lev: Column, jw: Column) -> Column:
    """Score from token-sort, plain ratio and Jaro-Winkler; ``s`` says that the normal forms are equal."""
    mixed = F.when(ts >= 60.0, F.greatest(ts, lev, 0.5 * ts + 0.5 * jw)).otherwise(F.least(ts, lev))
    return F.when(s, F.lit(100.0)).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), mixed)))


def address_score(s: Column, tset: Column, ts: Column, part: Column, lev: Column) -> Column:
    full = F.greatest(0.5 * tset + 0.3 * part + 0.2 * ts, 0.6 * tset + 0.4 * ts)
    mixed = F.when(tset >= 70.0, full).when(ts >= 40.0, 0.5 * tset + 0.3 * ts + 0.2 * lev).otherwise(F.least(ts, lev))
    return F.when(s, F.lit(100.0)).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), mixed)))


def dates_agree(submitted: Column, normalized: Column) -> Column:
    """Equal dates, or equal years if one of the two is a year alone."""
    year = lambda c: F.regexp_extract(c, r"\b(19\d{2}|20\d{2})\b", 1)

    def agree(mine: Column) -> Column:
        one_year = (year(mine) != "") & (year(mine) == year(normalized))
        return (mine == normalized) | (one_year & ((F.char_length(normalized) == 4) | (F.char_length(mine) == 4)))

    return let(normalize_date(submitted), agree)


def sides_of_texts(texts: DataFrame, fields: Column) -> DataFrame:
    """(doc_id, side, fields): ``fields`` is an array of what was found on the side, made in the row where its text is."""
    return texts.select("doc_id", "side", found_fields(fields).alias("fields"))


def found_fields(fields: Column) -> Column:
    """Those of a text's fields (field_name, f) that were found, as matching takes them."""
    return F.transform(F.filter(fields, lambda f: f["f"].isNotNull()), _found_of_text)


def _found_of_text(f: Column) -> Column:
    x = f["f"]
    return F.struct(f["field_name"].alias("field_name"), x["raw_text"].alias("raw_text"), x["normalized_text"].alias("normalized_text"), F.array(*[F.lit(0)] * 4).cast(BBOX).alias("box"), F.lit(0.0).alias("conf"))


def sides_of_fields(fields: DataFrame, sides: DataFrame | None = None) -> DataFrame:
    """(doc_id, side, fields) of extracted fields as rows; ``sides`` (doc_id, side) may have nothing found on them."""
    has_boxes = {"bbox", "confidence"} <= set(fields.columns)
    found = F.struct(
        "field_name", "raw_text", "normalized_text", (F.col("bbox") if has_boxes else F.array(*[F.lit(0)] * 4)).cast(BBOX).alias("box"), (F.col("confidence") if has_boxes else F.lit(0.0)).alias("conf")
    )
    rows = fields.select("doc_id", "side", found.alias("x"))
    if sides is not None:
        rows = rows.unionByName(sides.select("doc_id", "side").distinct(), allowMissingColumns=True)
    return rows.groupBy("doc_id", "side").agg(F.array_sort(F.collect_list("x")).alias("fields"))  # five at most, nulls aren't collected


def match_fields(submitted: DataFrame, fields: DataFrame, sides: DataFrame | None = None) -> DataFrame:
    """One row per submitted field and side of the document.

    ``submitted``: (doc_id, field_name, submitted). ``fields``: (doc_id, side,
    field_name, raw_text, normalized_text[, bbox, confidence]). ``sides`` (doc_id,
    side) are the sides that the documents have, found fields or not; without it
    they are those of ``fields``. The front counts in any case.
    """
    forms = submitted.groupBy("doc_id").agg(F.collect_list(F.struct("field_name", "submitted")).alias("submitted"))  # five at most
    return match_rows(match_documents(forms, sides_of_fields(fields, sides)))


def match_rows(documents: DataFrame) -> DataFrame:
    """``match_documents`` with a row for each match."""
    return documents.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


def match_documents(forms: DataFrame, sides: DataFrame, with_diffs: bool = True, fuzzy: bool = True) -> DataFrame:
    """``forms`` with has_back and ``matches``: an array of a match for each submitted field and side.

    ``forms``: (doc_id, submitted, ...), an array of (field_name, submitted).
    ``sides``: (doc_id, side, fields). A document's sides meet in one row by
    doc_id and its form joins them there; everything after happens within that
    row, so nothing else is shuffled.
    """
    # rows are short and what follows costs much for each: by their bytes they would be gathered into a few tasks
    tasks = int(forms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if not with_diffs:
        sides = sides.withColumn("fields", F.transform("fields", lambda f: F.struct(f["field_name"].alias("field_name"), f["normalized_text"].alias("normalized_text"))))
    have = sides.repartition(tasks, "doc_id").groupBy("doc_id").agg(F.collect_list(F.struct("side", "fields")).alias("sides"))
    return matched(forms.repartition(tasks, "doc_id").join(have, "doc_id", "left"), with_diffs, fuzzy)


def matched(documents: DataFrame, with_diffs: bool = True, fuzzy: bool = True) -> DataFrame:
    """Documents (doc_id, submitted, sides, ...) with has_back and ``matches`` instead of sides and submitted; one pass, row by row.

    A document that came without a front has one on which nothing is found.
    Pairs whose normal forms are equal need no similarity; only the others cross
    to Python, a document's together. Without ``fuzzy`` (no names or addresses
    were submitted) nothing does. Without ``with_diffs`` matches have only what
    verdicts are made of: (side, field_name, score, status, is_critical).
    """
    kind = documents.schema["sides"].dataType
    there = F.coalesce("sides", F.array().cast(kind))
    front = F.array(F.struct(F.lit("front").alias("side"), F.array().cast(kind.elementType["fields"].dataType).alias("fields")))
    whole = F.when(F.exists(there, lambda s: s["side"] == "front"), there).otherwise(F.concat(there, front))
    hit = lambda s, p: F.get(F.filter(s["fields"], lambda f: f["field_name"] == p["field_name"]), F.lit(0))
    # structs are copied by every step: what a verdict doesn't ask for isn't in them
    evidence = lambda s, p: hit(s, p).alias("f") if with_diffs else F.coalesce(hit(s, p)["normalized_text"], F.lit("")).alias("norm")
    met = F.flatten(F.transform(whole, lambda s: F.transform("submitted", lambda p: F.struct(s["side"].alias("side"), p["field_name"].alias("field"), p["submitted"].alias("sub"), evidence(s, p)))))
    d = documents.withColumns({"has_back": F.exists(there, lambda s: s["side"] == "back"), "_p": met}).drop("sides", "submitted")

    def formed(p: Column) -> Column:
        norm = F.coalesce(p["f"]["normalized_text"], F.lit("")) if with_diffs else p["norm"]
        form = lambda c: F.when(p["field"] == "address", normalize_address(c)).when(p["field"] == "name", normalize_string(c)).otherwise(F.lit(""))
        found = [p["f"].alias("f")] if with_diffs else []
        return F.struct(p["side"].alias("side"), p["field"].alias("field"), p["sub"].alias("sub"), *found, norm.alias("norm"), (norm == "").alias("missing"), F.when(norm == "", F.lit("")).otherwise(form(p["sub"])).alias("a"), form(norm).alias("b"))

    def settled(p: Column) -> Column:
        field, sub, norm = p["field"], p["sub"], p["norm"]
        fuzzy = field.isin("name", "address")
        equal = (
            F.when(fuzzy, p["a"] == p["b"]).when(field == "dob", dates_agree(sub, norm)).when(field == "document_id", normalize_id(sub) == normalize_id(norm)).otherwise(gender_of_form(sub) == gender_of_form(norm))
        )
        return p.withField("same", ~p["missing"] & F.coalesce(equal, F.lit(False)))

    def compared(p: Column) -> Column:
        field, same = p["field"], p["same"]
        fuzzy = field.isin("name", "address")
        open_ = fuzzy & ~same & ~p["missing"]  # pairs that are settled send empty strings, which cost nothing
        blank = F.lit("")
        a, b = F.when(open_, p["a"]).otherwise(blank), F.when(open_, p["b"]).otherwise(blank)
        if not with_diffs:
            return F.struct(p["side"].alias("side"), field.alias("field"), p["missing"].alias("missing"), same.alias("same"), a.alias("a"), b.alias("b"))
        said = ~p["missing"] & ((field == "address") | ((field == "name") & ~same))
        return p.withField("a", a).withField("b", b).withField("s", F.when(said, p["sub"]).otherwise(blank)).withField("t", F.when(said, p["f"]["raw_text"]).otherwise(blank))

    d = d.withColumn("_p", F.transform("_p", formed)).withColumn("_p", F.transform("_p", settled)).withColumn("_p", F.transform("_p", compared))
    scores = fuzzy_score_arrays(F.col("_p.a"), F.col("_p.b"), F.transform("_p", lambda p: p["field"] == "address"))
    d = d.withColumn("_f", scores if fuzzy else F.lit(None).cast("array<struct<" + ", ".join(f"{n}: double" for n in SCORES) + ">>"))
    d = d.withColumn("_d", token_diff_arrays(F.col("_p.s"), F.col("_p.t")) if with_diffs and fuzzy else F.lit(None).cast("array<string>"))
    d = d.withColumn("_p", F.transform("_p", lambda p, i: p.withField("score", _score(p, F.get("_f", i))).withField("said", F.get("_d", i))))
    return d.withColumn("matches", F.transform("_p", _outcome if with_diffs else _judged)).drop("_p", "_f", "_d")


def _score(p: Column, f: Column) -> Column:
    field, same = p["field"], p["same"]
    by_name = name_score(same, f["token_sort"], f["ratio"], f["jaro_winkler"])
    by_address = address_score(same, f["token_set"], f["token_sort"], f["partial"], f["ratio"])
    return F.when(p["missing"], F.lit(0.0)).when(field == "name", by_name).when(field == "address", by_address).otherwise(F.when(same, F.lit(100.0)).otherwise(F.lit(0.0)))


def _status(p: Column) -> Column:
    field, score = p["field"], p["score"]
    enough = F.when(field == "name", F.lit(MATCH_FROM["name"])).when(field == "address", F.lit(MATCH_FROM["address"])).otherwise(F.lit(100.0))
    return F.when(p["missing"], "missing").when(score >= enough, "match").when(field.isin("name", "address") & (score >= PARTIAL_FROM), "partial_match").otherwise("mismatch")


def _judged(p: Column) -> Column:
    """What merging and judging ask of a match."""
    return F.struct(p["side"].alias("side"), p["field"].alias("field_name"), p["score"].alias("score"), _status(p).alias("status"), p["field"].isin(*CRITICAL).alias("is_critical"))


def _outcome(p: Column) -> Column:
    """A match: (side, field_name, submitted, ocr_text, score, status, bbox, diff, is_critical, ocr_confidence, doc_side)."""
    field, sub, raw, missing, score = p["field"], p["sub"], p["f"]["raw_text"], p["missing"], p["score"]
    fuzzy = field.isin("name", "address")
    gone = F.create_map(*[F.lit(x) for kv in NOT_FOUND.items() for x in kv])[field]
    plain = F.when(field == "document_id", F.format_string("ID mismatch: submitted '%s' != document '%s'", sub, raw)).otherwise(F.format_string("Submitted '%s' != document '%s'", sub, raw))
    diff = F.when(missing, gone).when(fuzzy, p["said"]).when(~p["same"], plain)
    zero = F.array(*[F.lit(0)] * 4).cast(BBOX)
    return F.struct(
        p["side"].alias("side"), field.alias("field_name"), sub.alias("submitted"), F.when(missing, F.lit("")).otherwise(raw).alias("ocr_text"), score.alias("score"), _status(p).alias("status"),
        F.when(missing, zero).otherwise(F.coalesce(p["f"]["box"], zero)).alias("bbox"), diff.alias("diff"), field.isin(*CRITICAL).alias("is_critical"),
        F.when(missing, F.lit(0.0)).otherwise(F.coalesce(p["f"]["conf"], F.lit(0.0))).alias("ocr_confidence"), p["side"].alias("doc_side"),
    )
