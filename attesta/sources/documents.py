"""Documents as files: binary scan, manifest, and tokens by a pluggable OCR engine."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MANIFEST, OCR_LINES

#: Kinds of files that are accepted.
SUFFIXES = ("png", "jpg", "jpeg", "pdf", "tif", "tiff", "webp", "bmp")


def scan(spark: SparkSession, path: str | list[str], side: str = "front") -> DataFrame:
    """(doc_id, side, path, content, is_pdf) of the image and PDF files under ``path``, or under each of several; doc_id is the file's stem.

    A file that lies under more than one of the paths is one row; no path at all gives no rows.
    """
    paths = [path] if isinstance(path, str) else sorted(set(path))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join([*SUFFIXES, *map(str.upper, SUFFIXES)]) + "}")
    inside = [p for p in paths if not any(p != q and p.startswith(q.rstrip("/") + "/") for q in paths)]
    d = files.load(inside) if inside else spark.createDataFrame([], "path string, content binary")
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return d.select(stem.alias("doc_id"), F.lit(side).alias("side"), "path", "content", is_pdf(F.col("content")).alias("is_pdf"))


def is_pdf(content: Column) -> Column:
    return F.substring(content, 1, 4) == F.lit(b"%PDF")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, document_path, back_document_path, submitted) of a JSON array of documents."""
    d = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    stem = F.regexp_extract("document_path", r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)
    return d.select(stem.alias("doc_id"), "document_path", "back_document_path", "submitted")


def bare_path(c: Column) -> Column:
    """A path without its scheme."""
    return F.regexp_replace(c, r"^[a-z]+:(//)?(?=/)", "")


def present(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Entries whose document is among ``files`` (path); the path is compared without its scheme."""
    return entries.join(files.select(bare_path(F.col("path")).alias("_p")), bare_path(F.col("document_path")) == F.col("_p"), "left_semi")


def form(values: dict[str, str | None]) -> dict[str, str]:
    """Values of a submitted form, stripped; blank ones go."""
    return {k: v.strip() for k, v in values.items() if v is not None and v.strip()}


def form_columns(forms: DataFrame, columns: list[str]) -> DataFrame:
    """The same for a table of forms: blank values become null."""
    return forms.withColumns({c: F.nullif(F.trim(c), F.lit("")) for c in columns})


Engine = Callable[[bytes, int], list[tuple[list[list[float]], str, float]]]


def ocr_lines(documents: DataFrame, engine: Callable[[], Engine], page: int = 0) -> DataFrame:
    """OCR lines (doc_id, side, line_idx, poly, text, conf) by an engine of the caller's.

    ``engine`` makes a function (content, page) -> [(polygon, text, confidence)];
    it is called once per task, so that models load once. Feed the result to
    ``operators.layout.ocr_words``.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = engine()
        for batch in batches:
            out = [(d, s, i, [[float(v) for v in p] for p in poly], text, float(conf)) for d, s, content in zip(batch["doc_id"], batch["side"], batch["content"], strict=True) for i, (poly, text, conf) in enumerate(read(content, page))]
            yield pd.DataFrame(out, columns=OCR_LINES.fieldNames())

    return documents.select("doc_id", "side", "content").mapInPandas(rows, OCR_LINES)
