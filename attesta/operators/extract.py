"""Fields of documents: text in, one row per field found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import FIELD_NAMES, extract_all
from .layout import full_text, locate, token_spans


def all_fields(text: Column, names: tuple[str, ...] = FIELD_NAMES) -> Column:
    """An array of (field_name, f) for the five fields, or those named; f is null where a field isn't found."""
    return F.array(*[F.struct(F.lit(name).alias("field_name"), f.alias("f")) for name, f in extract_all(text, names)])


def extract_fields(texts: DataFrame, text_col: str = "full_text") -> DataFrame:
    """(doc_id, side, field_name, raw_text, normalized_text, matched_pattern, span_start, span_end) of every field found.

    One pass over the texts finds the five fields and one explode makes rows of
    them; nothing is shuffled.
    """
    rows = texts.select("doc_id", "side", F.explode(all_fields(F.col(text_col))).alias("x")).where("x.f IS NOT NULL")
    return rows.select("doc_id", "side", "x.field_name", "x.f.*")


def extract_from_tokens(tokens: DataFrame) -> DataFrame:
    """Fields of documents given as OCR tokens, with bbox and confidence of their tokens."""
    return locate(extract_fields(full_text(tokens)), token_spans(tokens))
