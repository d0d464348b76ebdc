"""Table functions over images, for LATERAL joins: pages of a file, lines and words of a page.

``register`` makes them known to SQL; each call handles one image, and what it
gives is rows, so that neither pages nor words of many files are held at once. (Spark takes table
functions over whole Arrow batches in no LATERAL join, so these get a value at a
time; what they return travels as Arrow.)::

    SELECT f.doc_id, p.page, w.* FROM files f, LATERAL document_pages(f.content) p, LATERAL ocr_tokens(p.png) w

An engine is a function that a maker returns; makers run once in each worker,
so that models load once.

Over whole collections ``file_pages``, ``page_lines`` and ``page_tokens`` give
the same rows without the cost of a call for each image. What they send back
goes out whenever ``SENT_BYTES`` are there, however many rows Spark hands over
at a time, so a worker holds that and one image.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from . import glyphs, images

#: What a decoder or an engine may raise on a broken file.
BROKEN = (ValueError, IndexError, KeyError, OSError, zlib.error, struct.error)
PAGES = "page int, png binary, width int, height int, error string"
LINES = "line_idx int, poly array<array<double>>, text string, conf double"
TOKENS = "tok_id int, text string, bbox array<int>, confidence double, line_num int, block_num int"

#: Bytes and rows of a batch that is sent back.
SENT_BYTES, SENT_ROWS = 1 << 22, 10_000

Splitter = Callable[[bytes], Iterable[np.ndarray]]
LineEngine = Callable[[np.ndarray], list[tuple[list[list[float]], str, float]]]
WordEngine = Callable[[np.ndarray], list[tuple[str, list[int], float, int, int]]]


def netpbm_pages(content: bytes) -> Iterator[np.ndarray]:
    """Pages of a file: the images that follow one another in a Netpbm stream, or the one image of another format."""
    if content[:2] not in (b"P5", b"P6"):
        yield images.decode(content)
        return
    at = 0
    while at < len(content):
        if content[at : at + 1].isspace():
            at += 1
            continue
        image, size = images.netpbm(content[at:])
        yield image
        at += size


class DocumentPages:
    """(page, png, width, height, error) of a file; where it breaks, a row with ``error`` ends its pages. Null gives no rows."""

    split: Splitter = staticmethod(netpbm_pages)

    def eval(self, content: bytes) -> Iterator[tuple]:
        if content is None:
            return
        page = 0
        try:
            for image in self.split(bytes(content)):
                yield page, images.encode(image), image.shape[1], image.shape[0], None
                page += 1
        except BROKEN as e:
            yield page, None, None, None, str(e)


class _Reader:
    """Reads the pages of one worker with one engine. Null gives no rows."""

    make: Callable

    def __init__(self) -> None:
        self.engine = self.make()

    def read(self, png: bytes) -> list:
        return [] if png is None else self.engine(images.decode(bytes(png)))


class OcrLines(_Reader):
    """(line_idx, poly, text, conf) of a page, for ``operators.layout.ocr_words``."""

    def eval(self, png: bytes) -> Iterator[tuple]:
        for i, (poly, text, conf) in enumerate(self.read(png)):
            yield i, [[float(v) for v in p] for p in poly], text, float(conf)


class OcrTokens(_Reader):
    """Words of a page, as an engine gives them that finds words: blank ones and those without confidence go, confidences are held to 0..100."""

    def eval(self, png: bytes) -> Iterator[tuple]:
        kept = [w for w in self.read(png) if w[0].strip() and w[2] >= 0]
        for i, (text, box, confidence, line, block) in enumerate(kept):
            yield i, text.strip(), [int(v) for v in box], min(100.0, max(0.0, float(confidence))), line, block


def _glyph_lines() -> LineEngine:
    return glyphs.line_engine


def _glyph_words() -> WordEngine:
    return glyphs.word_engine


def register(spark: SparkSession, split: Splitter = netpbm_pages, lines: Callable[[], LineEngine] = _glyph_lines, words: Callable[[], WordEngine] = _glyph_words) -> None:
    """Make ``document_pages``, ``ocr_lines`` and ``ocr_tokens`` available to SQL, with the caller's splitter and engines."""
    made = {
        "document_pages": (DocumentPages, {"split": staticmethod(split)}, PAGES),
        "ocr_lines": (OcrLines, {"make": staticmethod(lines)}, LINES),
        "ocr_tokens": (OcrTokens, {"make": staticmethod(words)}, TOKENS),
    }
    for name, (base, plugged, schema) in made.items():
        spark.udtf.register(name, udtf(type(base.__name__, (base,), plugged), returnType=schema, useArrow=True))


def in_batches(rows: Iterable[tuple], kind: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about ``SENT_BYTES`` of their binary and text values, at most ``SENT_ROWS`` rows."""
    held, size = [], 0
    columns = lambda: [pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kind, strict=True)]
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, (bytes, str)))
        if size >= SENT_BYTES or len(held) >= SENT_ROWS:
            yield pa.RecordBatch.from_arrays(columns(), schema=kind)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays(columns(), schema=kind)


def _over(images: DataFrame, column: str, make: Callable[[], object], schema: str) -> DataFrame:
    """The rows that ``make().eval`` gives for each value of a binary column, beside the other columns."""
    keys = [c for c in images.columns if c != column]
    kind = to_arrow_schema(T.StructType([*(images.schema[c] for c in keys), *T.DataType.fromDDL(schema)]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        reader = make()
        for batch in batches:
            values = batch.column(len(keys))
            kept = list(zip(*(c.to_pylist() for c in batch.columns[:-1]), strict=True)) if keys else [()] * len(batch)
            for key, value in zip(kept, values, strict=True):  # one image at a time becomes Python's
                for row in reader.eval(value.as_py()):
                    yield (*key, *row)

    return images.select(*keys, column).mapInArrow(lambda batches: in_batches(each(batches), kind), from_arrow_schema(kind))


def file_pages(files: DataFrame, split: Splitter = netpbm_pages) -> DataFrame:
    """``document_pages`` of files (content, ...): the other columns with a row for each page."""
    return _over(files, "content", type("Pages", (DocumentPages,), {"split": staticmethod(split)}), PAGES)


def page_lines(pages: DataFrame, make: Callable[[], LineEngine] = _glyph_lines) -> DataFrame:
    """``ocr_lines`` of pages (png, ...): the other columns with a row for each line."""
    return _over(pages, "png", type("Lines", (OcrLines,), {"make": staticmethod(make)}), LINES)


def page_tokens(pages: DataFrame, make: Callable[[], WordEngine] = _glyph_words) -> DataFrame:
    """``ocr_tokens`` of pages (png, ...): the other columns with a row for each word."""
    return _over(pages, "png", type("Tokens", (OcrTokens,), {"make": staticmethod(make)}), TOKENS)
