"""Language identification of spans.

A word is a run of characters other than ASCII white space whose letters are of
one script: where the script changes a word ends, so that text without spaces
has words as well. Every word gets a score for each language from hashed
character n-grams; only languages that are written in the word's script are
candidates, and for letters of a script without a range of its own all are. A
Viterbi pass
over the words, with a penalty for each switch, labels spans; the document's
language is the one of most letters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table
from .quality_rules import _OF_RANGE, _STARTS, SCRIPTS

#: Lengths of the character n-grams and the number of hash cells that they share.
GRAMS, CELLS = (1, 2, 3, 4), 1 << 15  # cells: a power of two
#: At most about so many training documents (by a hash of their id); the model stays the same size.
TRAIN_DOCS = 20_000
#: Log-odds that a change of language within a text must be worth.
SWITCH = 8.0
#: A language is written in a script if it has this share of the language's training letters.
SCRIPT_SHARE = 0.02
_ASCII_SPACES = np.array([9, 10, 11, 12, 13, 32], np.uint32)


@cache
def _kinds() -> np.ndarray:
    """By code point: 2 for letters (category L), 1 for the marks that belong to letters (M), 0 for all else."""
    return np.fromiter(({"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8, 0x110000)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")


class Words:
    """Words of a text as runs of code points, with n-gram cells for each position."""

    def __init__(self, codes: np.ndarray):
        space = np.isin(codes, _ASCII_SPACES)
        edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        kind = _kinds()[codes]
        self.glyph, self.letter = kind > 0, kind == 2
        script = np.where(self.letter, _OF_RANGE[np.searchsorted(_STARTS, codes, "right") - 1], 0)
        at = np.flatnonzero(self.letter)
        cuts = at[1:][script[at[1:]] != script[at[:-1]]]  # letters of another script than the letter before
        if len(cuts):
            cuts = cuts[~np.isin(cuts, starts) & ~space[cuts]]
            starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
        self.starts, self.ends, self.codes, self.n = starts, ends, codes, len(starts)
        counts = np.concatenate([[0], np.cumsum(self.letter)])
        self.letters = counts[self.ends] - counts[self.starts]
        # script of a word: that of its first letter
        first = np.searchsorted(at, self.starts)
        has = self.letters > 0
        self.script = np.zeros(self.n, np.int64)
        self.script[has] = script[at[np.minimum(first, max(len(at) - 1, 0))[has]]] if len(at) else 0
        self.scripts = script

    def cells(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(start positions, cells) per n-gram length; grams lie within letters of one word, with the word's edges as marks."""
        n = len(self.codes)
        padded = np.zeros(n + 8, np.uint32)
        padded[1 : n + 1] = np.where(self.glyph, self.codes, 0)  # whatever isn't a letter is an edge
        for k in GRAMS:
            h = np.full(n, k, np.uint32)
            for i in range(k):
                h = (h ^ padded[i + (k == 1) : i + (k == 1) + n]) * np.uint32(0x01000193)
                h ^= h >> np.uint32(13)
            yield np.arange(n), h & np.uint32(CELLS - 1)


def word_scores(words: Words, table: np.ndarray) -> np.ndarray:
    """Sum over each word's n-grams of the cells' log-probabilities, one row per word."""
    langs = table.shape[1]
    if not words.n:
        return np.zeros((0, langs), np.float32)
    total = np.zeros((len(words.codes) + 1, langs), np.float32)
    for _, cells in words.cells():
        total[:-1] += table.take(cells, axis=0)
    total[:-1][~words.glyph] = 0
    bounds = np.stack([words.starts, words.ends], 1).ravel()
    return np.add.reduceat(total, bounds, axis=0)[::2]


def viterbi(scores: np.ndarray, switch: float) -> np.ndarray:
    """Best path of labels for one sequence of score rows."""
    n, langs = scores.shape
    back = np.zeros((n, langs), np.int16)
    best = scores[0].astype(np.float64)
    for i in range(1, n):
        top = int(best.argmax())
        stay = best >= best[top] - switch
        back[i] = np.where(stay, np.arange(langs), top)
        best = np.where(stay, best, best[top] - switch) + scores[i]
    path = np.empty(n, np.int64)
    path[-1] = best.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def one_label(scores: np.ndarray, switch: float) -> int | None:
    """The label that the whole best path has, where that can be told without walking it; else None.

    It is that of the highest sum if no run of rows gains another label a
    switch's worth, so that no leave from it pays, and if the best of the other
    labels, row by row and switches for nothing, stay below it. Both by a margin,
    so that rounding and ties are left to the walk.
    """
    if scores.shape[1] == 1:
        return 0
    best = int(scores.sum(axis=0, dtype=np.float64).argmax())
    over = np.delete(scores, best, axis=1).astype(np.float64) - scores[:, best : best + 1]
    if over.max(axis=1).sum() >= -1e-3:
        return None
    gained = np.cumsum(over, axis=0)
    lowest = np.minimum.accumulate(np.concatenate([np.zeros((1, gained.shape[1])), gained[:-1]]), axis=0)
    return best if (gained - lowest).max() < switch - 1e-3 else None


def viterbi_many(scores: list[np.ndarray], switch: float) -> list[np.ndarray]:
    """``viterbi`` of many sequences: those of one label at once, of the others one step of all that are still running at a time."""
    out = [np.zeros(0, np.int64)] * len(scores)
    walked = []
    for k, own in enumerate(scores):
        label = one_label(own, switch) if len(own) else None
        if label is None:
            walked.append(k)
        else:
            out[k] = np.full(len(own), label, np.int64)
    for k, path in zip(walked, _walk([scores[k] for k in walked], switch), strict=True):
        out[k] = path
    return out


def _walk(scores: list[np.ndarray], switch: float) -> list[np.ndarray]:
    order = sorted(range(len(scores)), key=lambda k: -len(scores[k]))
    sizes = np.array([len(scores[k]) for k in order])
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(scores)
    live = int((sizes > 0).sum())
    if not live:
        return out
    langs = scores[order[0]].shape[1]
    flat = np.concatenate([scores[k] for k in order[:live]])
    base = np.concatenate([[0], np.cumsum(sizes[:live])])[:-1]
    back = np.zeros((len(flat), langs), np.int8 if langs < 128 else np.int16)
    own = np.arange(langs)
    best = flat[base].astype(np.float64)
    last = best.copy()
    for i in range(1, int(sizes[0])):
        run = int(np.searchsorted(-sizes[:live], -i, "left"))  # sequences longer than i
        at, b = base[:run] + i, best[:run]
        top = b.argmax(axis=1)
        floor = b[np.arange(run), top][:, None] - switch
        stay = b >= floor
        back[at] = np.where(stay, own, top[:, None])
        best = np.where(stay, b, floor) + flat[at]
        last[:run] = best
    path = np.empty(len(flat), np.int64)
    state = last.argmax(axis=1)
    for i in range(int(sizes[0]) - 1, -1, -1):
        run = int(np.searchsorted(-sizes[:live], -i, "left"))
        at = base[:run] + i
        path[at] = state[:run]
        state[:run] = back[at, state[:run]]
    for j in range(live):
        out[order[j]] = path[base[j] : base[j] + sizes[j]]
    return out


class Model:
    """Languages, log-probabilities by cell, and which languages each script may be."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        if not langs:
            return
        smooth = counts + 0.5
        grams = np.log(smooth / smooth.sum(axis=0, keepdims=True))
        # n-grams of several lengths overlap: their evidence is counted by half
        self.table = (0.5 * (grams - grams.mean(axis=1, keepdims=True))).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(axis=0, keepdims=True), 1)
        allowed = share >= SCRIPT_SHARE
        allowed[~allowed.any(axis=1)] = True  # a script that no language has: all are candidates
        allowed[0] = True  # letters of scripts that aren't told apart
        self.bar = np.where(allowed, 0.0, -1e4).astype(np.float32)

    def scores(self, words: Words) -> np.ndarray:
        return word_scores(words, self.table) + self.bar[words.script] * (words.letters > 0)[:, None]

    def label(self, texts: list[str | None], switch: float = SWITCH) -> list[dict]:
        """For each text: lang, score and spans (first word, words, lang)."""
        if not self.langs:
            return [{"lang": "und", "score": 0.0, "spans": []} for _ in texts]
        words = [Words(codes_of(t or "")) for t in texts]
        scores = [self.scores(w) for w in words]
        paths = viterbi_many(scores, switch)
        out = []
        for w, own, path in zip(words, scores, paths, strict=True):
            letters = np.bincount(path, weights=w.letters, minlength=len(self.langs)) if w.n else np.zeros(1)
            if letters.sum() == 0:
                out.append({"lang": "und", "score": 0.0, "spans": []})
                continue
            cut = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1, [w.n]])
            spans = [(int(a), int(b - a), self.langs[path[a]]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            best = int(letters.argmax())
            evidence = own[(path == best) & (w.letters > 0)].sum(axis=0, dtype=np.float64)
            sure = 1.0 / np.exp(np.minimum(evidence - evidence[best], 700.0)).sum()  # of the winner among all, on its own words
            out.append({"lang": self.langs[best], "score": float(letters[best] / letters.sum() * sure), "spans": spans})
        return out


def _counter(langs: list[str]):
    """Per task: sums by language of n-gram cells, and of letters by script."""
    schema = pa.schema([("lang", pa.int32()), ("cell", pa.int32()), ("n", pa.int64())])
    number = {x: i for i, x in enumerate(langs)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.zeros((len(langs), CELLS + len(SCRIPTS)), np.int64)
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = Words(codes_of(text.as_py() or ""))
                k = number[lang]
                for _, cells in words.cells():
                    grams[k, :CELLS] += np.bincount(cells[words.glyph], minlength=CELLS)
                grams[k, CELLS:] += np.bincount(words.scripts[words.letter], minlength=len(SCRIPTS))
        k, cell = np.nonzero(grams)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(grams[k, cell])], schema=schema)

    return rows


def train(docs: DataFrame, most: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on rows that aren't held out and have a language; about ``most`` of them, chosen by a hash of the id.

    What reaches the driver are sums by language and cell: the number of
    languages times ``CELLS`` at most.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & ~held_out("doc_id"))
    per_lang = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs, total = sorted(per_lang), sum(per_lang.values())
    if not langs:
        return Model([], np.zeros((CELLS, 0)), np.zeros((len(SCRIPTS), 0)))
    # every language gets an equal part of the bound, so that rare ones are learned as well
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20))
    bound = F.lit(1 << 20)
    if total > most:
        bound = F.create_map(*[F.lit(x) for lang in langs for x in (lang, max(1, min(1 << 20, int((1 << 20) * most / len(langs) / per_lang[lang]))))])[F.col("lang")]
    sums = rows.where(draw < bound).select("text", "lang").mapInArrow(_counter(langs), "lang int, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    got = sums.toArrow()
    counts = np.zeros((CELLS + len(SCRIPTS), len(langs)))
    counts[got["cell"].to_numpy(), got["lang"].to_numpy()] = got["n"].to_numpy()
    return Model(langs, counts[:CELLS], counts[CELLS:])


def _labeller(model: Model, switch: float, with_spans: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    if with_spans:
        schema = schema.append(pa.field("spans", pa.list_(pa.struct([("first_word", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(ids: list, texts: list) -> pa.RecordBatch:
            found = model.label(texts, switch)
            out = [{"doc_id": i, "lang_pred": f["lang"], "score": f["score"]} for i, f in zip(ids, found, strict=True)]
            if with_spans:
                for o, f in zip(out, found, strict=True):
                    o["spans"] = [{"first_word": a, "words": n, "lang": x} for a, n, x in f["spans"]]
            return pa.RecordBatch.from_pylist(out, schema=schema)

        for batch in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = t.as_py()
                ids.append(i)
                texts.append(text)
                size += len(text or "")
                if size > 1 << 20 or len(ids) >= 2048:  # bounds memory: about 50 bytes a character
                    yield emit(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield emit(ids, texts)

    return rows


def identify(docs: DataFrame, model: Model, switch: float = SWITCH, spans: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score and spans of one language each.

    ``score`` is the share of the text's letters in spans of the predicted
    language, times the probability of that language, among all, for the words
    of these spans. Null and letterless texts are ``und`` with score 0 and no spans;
    ties go to the language first in order. Nothing is shuffled; rows that
    repeat are labelled alike; an empty table gives no rows; further columns
    are ignored.
    """
    kinds = "doc_id long, lang_pred string, score double" + ", spans array<struct<first_word: long, words: long, lang: string>>" * spans
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_labeller(model, switch, spans), kinds)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs), spans=False)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
