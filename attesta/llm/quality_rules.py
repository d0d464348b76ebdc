"""Quality rules by tokeniser fertility.

Public vocabularies, trained on ordinary text, spend few tokens on ordinary
text. Whole texts are encoded with a piece vocabulary that falls back to bytes
and with a byte-level one; characters per token (both), the share of bytes that
no piece covers, and the entropy of the token distribution must lie in the bands
of the text's main script. The entropy that prose reaches grows with the
logarithm of its length up to some length, and so does the least that is asked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import ByteBpe, vocabulary

SYMBOLS = b"#*$%&|<>"
#: First code points of script ranges, and the script from there on ("" is none in particular).
SCRIPT_RANGES = (
    (0x0000, ""), (0x0041, "latin"), (0x005B, ""), (0x0061, "latin"), (0x007B, ""), (0x00AA, "latin"), (0x00AB, ""), (0x00BA, "latin"), (0x00BB, ""), (0x00C0, "latin"), (0x00D7, ""), (0x00D8, "latin"), (0x00F7, ""), (0x00F8, "latin"),
    (0x02B9, ""), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, ""), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"), (0x0E00, "thai"), (0x0E80, ""),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, ""), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""), (0x3040, "kana"), (0x3100, ""), (0x3400, "han"), (0x4DC0, ""), (0x4E00, "han"), (0xA000, ""), (0xAC00, "hangul"),
    (0xD7B0, ""), (0xF900, "han"), (0xFB00, ""), (0xFB50, "arabic"), (0xFE00, ""), (0xFE70, "arabic"), (0xFF00, ""), (0x20000, "han"), (0x30000, ""),
)
_STARTS = np.array([a for a, _ in SCRIPT_RANGES], np.uint32)
SCRIPTS = tuple(dict.fromkeys(s for _, s in SCRIPT_RANGES))
_OF_RANGE = np.array([SCRIPTS.index(s) for _, s in SCRIPT_RANGES])
#: By script: characters per piece from and to, least characters per byte-level token, most of the pieces that may be
#: bytes, least entropy in bits at 64 pieces. Latin is set from the labelled good prose of four languages: below all of
#: it at any length (sf0.1: 3,302 texts, the nearest 0.27 bits above). For the others there is no labelled text; their
#: bands are wide and only meet texts that no tokeniser of the script would produce.
BANDS = {
    "latin": (1.8, 8.0, 2.0, 0.12, 4.8), "cyrillic": (1.2, 8.0, 1.2, 0.15, 3.6), "greek": (0.6, 6.0, 0.6, 0.4, 3.1), "han": (0.3, 3.0, 0.3, 0.9, 2.6), "kana": (0.4, 4.0, 0.4, 0.9, 2.6), "hangul": (0.3, 4.0, 0.3, 0.95, 2.6),
    "arabic": (0.5, 5.0, 0.5, 0.5, 2.6), "hebrew": (0.5, 5.0, 0.5, 0.5, 2.6),
}
#: For any other script, and for texts without letters.
OTHER_BAND = (0.25, 8.0, 0.25, 0.97, 2.1)
#: The least entropy rises by so many bits with each doubling of the pieces, up to this many.
ENTROPY_RISE, RISE_TO = 0.34, 1024


def least_entropy(at_64: float, pieces: int) -> float:
    """The least entropy asked of a text of so many pieces."""
    return at_64 + ENTROPY_RISE * (math.log2(min(pieces, RISE_TO)) - 6.0)


def main_script(text: str) -> str:
    """The script of most of the text's letters; '' if it has none."""
    if text.isascii():
        return "latin" if any(c.isalpha() for c in text[:256]) or any(c.isalpha() for c in text) else ""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    counts = np.bincount(_OF_RANGE[np.searchsorted(_STARTS, codes, "right") - 1], minlength=len(SCRIPTS))
    counts[0] = 0
    return SCRIPTS[int(counts.argmax())]


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words that lie in a window of ``width`` words found twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint64, len(words))
    if len(numbers) == len(words):
        return 0
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h = (h * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + n]) ^ (h >> np.uint64(29))
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    a, b = order[:-1][same], order[1:][same]
    view = np.lib.stride_tricks.sliding_window_view(ids, width)
    exact = np.fromiter((np.array_equal(view[i], view[j]) for i, j in zip(a, b, strict=True)), bool, len(a)) if len(a) < 64 else np.concatenate([(view[a[k : k + 65536]] == view[b[k : k + 65536]]).all(axis=1) for k in range(0, len(a), 65536)])
    edge = np.zeros(len(words) + 1, np.int64)
    hit = np.unique(np.concatenate([a[exact], b[exact]]))
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_counts(text: str) -> dict:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of a whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: at ASCII white space only
    packed = raw.translate(None, b" \t\n\x0b\x0c\r")
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeats, n = repeated_words(words), len(words)
    return {
        "n_words": n, "word_chars": len(text) - (len(raw) - len(packed)), "n_symbols": len(raw) - len(raw.translate(None, SYMBOLS)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeats,
        "base_failed": n < 20 or 100 * repeats > 30 * n,
    }


class Fertility:
    """Measures of a text under two public vocabularies, and the verdict of its script's bands."""

    def __init__(self, pieces: str, ranks: str, bands: dict = BANDS):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        self.bytes, self.bands = ByteBpe(ranks), bands

    def measure(self, text: str) -> dict:
        ids, script = np.array(self.pieces.encode(text), np.int64), main_script(text)
        n, m, chars = len(ids), len(self.bytes.ids(text)), len(text)
        if not n or not m:
            return {"script": script, "n_tokens": n, "chars_per_token": None, "chars_per_byte_token": None, "byte_share": None, "token_entropy": None}
        share = (np.unique(ids, return_counts=True)[1] if n < 8192 else np.bincount(ids)) / n
        share = share[share > 0]
        entropy = max(0.0, float(-(share * np.log2(share)).sum()))
        return {"script": script, "n_tokens": n, "chars_per_token": chars / n, "chars_per_byte_token": chars / m, "byte_share": float(self.is_byte[ids].mean()), "token_entropy": entropy}

    def accepts(self, m: dict) -> bool:
        if m["chars_per_token"] is None:
            return False
        least, most, least_bytes, most_bytes, at_64 = self.bands.get(m["script"], OTHER_BAND)
        return least <= m["chars_per_token"] <= most and least_bytes <= m["chars_per_byte_token"] <= most and m["byte_share"] <= most_bytes and m["token_entropy"] >= least_entropy(at_64, m["n_tokens"])


_SCHEMA = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("kept", "boolean"), ("script", "string"), ("n_tokens", "long"), ("chars_per_token", "double"), ("chars_per_byte_token", "double"), ("byte_share", "double"), ("token_entropy", "double")]
_ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}


def _judge(pieces: str, ranks: str, bands: dict, filter_only: bool, text_col: str):
    schema = pa.schema([("doc_id", pa.int64()), *((n, _ARROW[t]) for n, t in _SCHEMA)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fertility = Fertility(pieces, ranks, bands)

        def judge(text: str | None) -> dict:
            text = text or ""
            base, m = base_counts(text), fertility.measure(text)
            return base | m | {"kept": not base["base_failed"] and fertility.accepts(m)}

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = [judge(t.as_py()) for t in part.column(text_col)]
                if filter_only:
                    keep = part.filter(pa.array([x["kept"] for x in found], pa.bool_()))
                    yield keep
                else:
                    yield pa.RecordBatch.from_pylist([x | {"doc_id": i} for i, x in zip(part.column("doc_id").to_pylist(), found, strict=True)], schema=schema)

    return rows


def quality_rules(docs: DataFrame, pieces: str | None = None, ranks: str | None = None, bands: dict = BANDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts, measures, base_failed and kept.

    Words are runs of anything but ASCII white space. Null text counts as
    empty: no words, base_failed, no measures. A text without letters is judged
    by the band of other scripts. Rows that repeat are judged alike; an empty
    table gives no rows; further columns are ignored. Nothing is shuffled.
    """
    pieces, ranks = pieces or vocabulary("piece_bpe_32k.model"), ranks or vocabulary("byte_bpe_multi_50k.tiktoken")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_judge(pieces, ranks, bands, False, "text"), ", ".join(["doc_id long", *(f"{n} {t}" for n, t in _SCHEMA)]))


def keep_good(docs: DataFrame, pieces: str | None = None, ranks: str | None = None, bands: dict = BANDS, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) that the rules keep."""
    pieces, ranks = pieces or vocabulary("piece_bpe_32k.model"), ranks or vocabulary("byte_bpe_multi_50k.tiktoken")
    return docs.mapInArrow(_judge(pieces, ranks, bands, True, text_col), docs.schema)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
