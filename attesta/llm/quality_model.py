"""Quality classifier: random Fourier features and ridge regression.

A text becomes a few dozen statistics; standardised, they are mapped to random
cosines, whose inner products approximate a Gaussian kernel. Each task sums its
rows' part of the normal equations, so that fitting moves one matrix per task
whatever the number of rows; ridge scores are then calibrated by isotonic
regression on rows that the scoring weights have not seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, materialize, table
from .quality_rules import base_counts

FEATURES, RIDGE, FOLDS, BINS = 256, 1e-3, 3, 512
#: At most about so many labelled rows are fitted, chosen by a hash of the id.
TRAIN_ROWS = 2_000_000
#: Tasks that sum normal equations: bounds what reaches the driver to so many matrices.
SUM_TASKS = 16
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
STATISTICS = (
    "log_chars", "log_words", "word_chars", "log_lines", "words_per_line", "upper", "lower", "digits", "high", "exclaim", "points", "symbols", "pipes", "marks", "brackets",
    "dup_lines", "repeats", "distinct_words", "distinct_stems", "capital_words", "shout_words", "tailed_words", "one_char_words", "long_words", "top_word", "empty",
)
_TAILED = re.compile(rb"[#*$%&|<>!]{2,}$")


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text, each bounded or logarithmic; null and empty texts give zeros and ``empty``."""
    text = text or ""
    base = base_counts(text)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * (len(STATISTICS) - 1) + [1.0]
    size = len(raw)
    share = lambda drop: 1 - len(raw.translate(None, drop)) / size
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    kinds = list(seen.items())
    count = lambda f: sum(c for w, c in kinds if f(w)) / n
    lines = raw.count(b"\n") + 1
    return [
        np.log1p(len(text)), np.log1p(n), min(base["word_chars"] / n, 40.0), np.log1p(lines), np.log1p(n / lines), share(_UPPER), share(_LOWER), share(b"0123456789"), share(bytes(range(128, 256))), share(b"!?"), share(b".,;:"),
        base["n_symbols"] / n if base["n_symbols"] < 8 * n else 8.0, min(8.0, raw.count(b"|") / n), share(b"-_/\\=+~^"), share(b"()[]{}"),
        base["n_dup_lines"] / lines, base["n_repeat_words"] / n, len(seen) / n, len({w[:4].lower() for w in seen}) / n, count(lambda w: 65 <= w[0] <= 90), count(lambda w: len(w) > 2 and w.isupper()), count(lambda w: _TAILED.search(w) is not None),
        count(lambda w: len(w) == 1), count(lambda w: len(w) > 15), max(seen.values()) / n, 0.0,
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            x = np.array([statistics(t.as_py()) for t in part.column(1)], np.float32)
            x = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), x], names=["doc_id", "x"])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics ``x`` of every row's whole text."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(_measure, "doc_id long, x array<float>")


class Map:
    """Standardised statistics -> random cosines of a Gaussian kernel, and a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, seed: int = 0):
        rng = np.random.default_rng(seed)
        d = len(mean)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0.0, 1.0 / np.sqrt(2.0 * d), (d, features))  # a kernel as wide as typical distances
        self.b = rng.uniform(0.0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6.0, 6.0)
        return np.concatenate([np.cos(z @ self.w + self.b) * np.sqrt(2.0 / len(self.b)), np.ones((len(z), 1))], axis=1)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(STATISTICS)
    total = np.zeros((2, d))
    n = 0
    for batch in batches:
        x = _matrix(batch)
        total += [x.sum(axis=0), (x * x).sum(axis=0)]
        n += len(x)
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "sums"])


def _equations(to: Map):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(to.b) + 1
        parts = np.zeros((FOLDS, d, d + 1))
        n = 0
        for batch in batches:
            z, y, fold = to(_matrix(batch)), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            for f in range(FOLDS):
                zf = z[fold == f]
                parts[f] += zf.T @ np.concatenate([zf, y[fold == f, None]], axis=1)
            n += len(z)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([parts.tobytes()], pa.binary())], names=["n", "sums"])

    return rows


def _histogram(to: Map, weights: np.ndarray):
    """Rows and labels 1 by bin of the score that the fold's own weights give."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((2, BINS))
        n = 0
        for batch in batches:
            z, y, fold = to(_matrix(batch)), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            at = _bin((z * weights[fold]).sum(axis=1))
            out[0] += np.bincount(at, minlength=BINS)
            out[1] += np.bincount(at, weights=y, minlength=BINS)
            n += len(z)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([out.tobytes()], pa.binary())], names=["n", "sums"])

    return rows


def _bin(score: np.ndarray) -> np.ndarray:
    """Scores of a regression on 0 and 1, from -0.5 to 1.5, by bin."""
    return np.clip(((score + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)


def isotonic(rows: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins; returns knots (bin centre, share of ones), both rising."""
    blocks: list[list[float]] = []  # rows, ones, sum of bin places
    for k in np.flatnonzero(rows):
        blocks.append([rows[k], ones[k], rows[k] * (k + 0.5)])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks)
    return b[:, 2] / b[:, 0] / BINS * 2 - 0.5, (b[:, 1] + 0.5) / (b[:, 0] + 1)


class Model:
    def __init__(self, to: Map, weights: np.ndarray, knots: tuple[np.ndarray, np.ndarray]):
        self.to, self.weights, self.knots = to, weights, knots

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores, straight between the knots, so that ties stay few; beyond the ends a slope keeps the order."""
        raw = self.to(x) @ self.weights
        at, value = self.knots
        s = np.interp(raw, at, np.maximum.accumulate(value))
        return np.clip(s + 1e-6 * np.clip(raw, -10, 10), 0.0, 1.0)


def _summed(df: DataFrame, task, shape: tuple[int, ...]) -> tuple[int, np.ndarray]:
    got = df.mapInArrow(task, "n long, sums binary").toArrow()
    sums = sum((np.frombuffer(s.as_py()).reshape(shape) for s in got["sums"]), np.zeros(shape))
    return sum(got["n"].to_pylist()), sums


def fit(measured: DataFrame, labels: DataFrame, label_col: str = "quality", most: int = TRAIN_ROWS) -> Model | None:
    """Fit on ``measured`` rows (doc_id, x) that have a label and aren't held out. None without such rows.

    More than about ``most`` of them are thinned by a hash of the id. Rows
    without a label count for nothing; an id with several labels counts once
    for each.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("y IS NOT NULL")
    known = known.where(~held_out("doc_id"))
    n = known.count()
    if n > most:  # thinned before anything is joined or moved
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * most / n))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(FOLDS)).cast("int")
    rows = materialize(measured.join(known, "doc_id").select("x", "y", fold.alias("fold")).repartition(SUM_TASKS), "labelled")
    if rows.isEmpty():
        return None
    d = len(STATISTICS)
    n, moments = _summed(rows, _moments, (2, d))
    mean = moments[0] / n
    scale = np.sqrt(np.maximum(moments[1] / n - mean**2, 1e-6))
    to = Map(mean, scale)
    m = len(to.b) + 1
    _, parts = _summed(rows, _equations(to), (FOLDS, m, m + 1))

    def solve(part: np.ndarray) -> np.ndarray:
        weight = max(part[-1, -2], 1.0)  # rows: the constant's square
        ridge = np.eye(m) * (RIDGE * weight + 0.05)
        ridge[-1, -1] = 1e-9
        return np.linalg.solve(part[:, :-1] + ridge, part[:, -1])

    whole = parts.sum(axis=0)
    out_of_fold = np.stack([solve(whole - parts[f]) for f in range(FOLDS)])
    _, histogram = _summed(rows, _histogram(to, out_of_fold), (2, BINS))
    return Model(to, solve(whole), isotonic(*histogram))


def _scorer(model: Model | None):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(_matrix(batch)) if model and batch.num_rows else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return rows


def score(measured: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score (0 to 1) of measured rows; 0.5 for all if there is no model."""
    return measured.mapInArrow(_scorer(model), "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null text counts as empty, and empty texts have a score like others. Rows
    that repeat are scored alike; an empty table gives no rows; further columns
    are ignored. Texts are read once: the statistics are written to the shared
    folder, and fitting and scoring read those.
    """
    measured = materialize(measure(docs), "statistics")
    scored = score(measured, fit(measured, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
