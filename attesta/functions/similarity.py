"""String similarity, 0 to 100.

The native ``ratio`` is an expression of nested ``aggregate``; the others, and
the one that scoring uses, run over Arrow batches with a bit-parallel longest
common subsequence. Values follow the public definitions of the indel ratio,
its token forms and Jaro-Winkler.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .text import let


def _shared_start(a: Iterable[str], b: Iterable[str]) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence; one machine-word operation per character and word of ``a``.

    Equal characters at the ends belong to a longest one; only what is between them is compared.
    """
    ends = _shared_start(a, b)
    a, b = a[ends:], b[ends:]
    if after := _shared_start(reversed(a), reversed(b)):
        a, b, ends = a[:-after], b[:-after], ends + after
    if not a or not b:
        return ends
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    row = whole = (1 << len(a)) - 1
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & whole
    return ends + len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 200.0 * lcs(a, b) / n if n else 100.0


def _tokens(s: str) -> str:
    return " ".join(sorted(s.split()))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(_tokens(a), _tokens(b))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = x & y, x - y, y - x
    if both and not (only_x and only_y):
        return 100.0
    common, p, q = len(" ".join(sorted(both))), " ".join(sorted(only_x)), " ".join(sorted(only_y))
    gap = 1 if common else 0
    left, right = common + gap + len(p), common + gap + len(q)
    share = lambda distance, total: 100.0 * (1 - distance / total) if total else 100.0
    best = share(len(p) + len(q) - 2 * lcs(p, q), left + right)
    if common:
        best = max(best, share(gap + len(p), common + left), share(gap + len(q), common + right))
    return best


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string with any window of the longer, cut at its ends or not."""
    return partial_ratios([a], [b])[0]


#: Cells of a block of pairs that are compared together.
BLOCK_CELLS = 1 << 22


def partial_ratios(a: list[str], b: list[str]) -> list[float]:
    """``partial_ratio`` of many pairs; those of like size are compared together, unless one of the two strings is within the other."""
    out = [100.0 if not x and not y or x and y and (x in y or y in x) else 0.0 for x, y in zip(a, b, strict=True)]
    todo = [(k, *((x, y) if len(x) <= len(y) else (y, x))) for k, (x, y) in enumerate(zip(a, b, strict=True)) if x and y and not out[k]]
    todo += [(k, y, x) for k, x, y in todo if len(x) == len(y)]  # of two strings as long as each other both are slid
    todo.sort(key=lambda t: (len(t[1]), len(t[2])))
    at = 0
    while at < len(todo):
        end, wide = at, 0
        while end < len(todo):
            wide = max(wide, len(todo[end][2]))
            if end > at and (end - at + 1) * len(todo[end][1]) * wide > BLOCK_CELLS:
                break
            end += 1
        block = todo[at:end]
        for (k, _, _), best in zip(block, _best_windows([t[1] for t in block], [t[2] for t in block]), strict=True):
            out[k] = max(out[k], best)
        at = end
    return out


def _codes(texts: list[str], filler: int) -> np.ndarray:
    out = np.full((len(texts), max(map(len, texts))), filler, np.int32)
    for row, t in zip(out, texts, strict=True):
        row[: len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.int32)
    return out


def strands(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where the strand that ends below each character of ``b`` starts above it; under 0: it comes in from the side.

    ``a`` and ``b`` are rows of characters, a row for each pair. A strand comes in
    for each character of ``a`` from the left and for each of ``b`` from above;
    in each cell of the table the two that meet cross, unless the characters are
    equal or they have crossed before. From the strands the common subsequences
    of ``a`` with every window of ``b`` can be read (``_best_windows``). Cells of
    a diagonal don't depend on each other and are done at once, for all pairs.
    """
    n, m = a.shape[1], b.shape[1]
    left = np.tile(np.arange(n - 1, -1, -1, dtype=np.int32), (len(a), 1))
    above = np.tile(np.arange(n, n + m, dtype=np.int32), (len(a), 1))
    back = b[:, ::-1]
    for d in range(n + m - 1):
        lo, hi = max(0, d - m + 1), min(n - 1, d)
        h, v = left[:, lo : hi + 1], above[:, d - hi : d - lo + 1][:, ::-1]
        swap = (a[:, lo : hi + 1] == back[:, m - 1 - d + lo : m - d + hi]) | (h > v)
        h[...], v[...] = np.where(swap, v, h), np.where(swap, h, v)
    return above - n


def _best_windows(short: list[str], long: list[str]) -> np.ndarray:
    """Best ratio of each short string with a window of the long one that is as long, or is cut at an end.

    Of a window's characters those are not common whose strands start and end
    within it. A strand from p to r lies within the windows of width n that start
    in r - n + 1 .. p, the prefixes that end behind r and the suffixes that start
    up to p: three sums give the counts of all windows.
    """
    n, m = np.array([len(t) for t in short]), np.array([len(t) for t in long])
    starts = strands(_codes(short, -1), _codes(long, -2))
    width = starts.shape[1]
    pair, end = np.nonzero((starts >= 0) & (np.arange(width) < m[:, None]))
    p = starts[pair, end]
    step = np.zeros((len(n), width + 1), np.int64)
    np.add.at(step, (pair, np.maximum(0, end - n[pair] + 1)), p >= end - n[pair] + 1)
    np.add.at(step, (pair, p + 1), -(p >= end - n[pair] + 1).astype(np.int64))
    whole = n[:, None] - np.cumsum(step, axis=1)
    i = np.arange(width + 1)
    best = np.where(i <= (m - n)[:, None], 100.0 * whole / n[:, None], 0.0).max(axis=1)
    ends, begins = np.zeros((len(n), width + 1), np.int64), np.zeros((len(n), width + 1), np.int64)
    np.add.at(ends, (pair, end + 1), 1)
    np.add.at(begins, (pair, p), 1)
    size = np.where((i >= 1) & (i < n[:, None]), i, 0)
    common = np.where(size > 0, size - np.cumsum(ends, axis=1), 0)  # of prefixes
    best = np.maximum(best, (200.0 * common / (n[:, None] + size)).max(axis=1))
    size = np.where((i > (m - n)[:, None]) & (i < m[:, None]), m[:, None] - i, 0)
    common = np.where(size > 0, size - np.cumsum(begins[:, ::-1], axis=1)[:, ::-1], 0)  # of suffixes
    return np.maximum(best, (200.0 * common / (n[:, None] + size)).max(axis=1))


def jaro_winkler(a: str, b: str) -> float:
    """0 to 1; the common prefix counts up to 4 characters, above a Jaro similarity of 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used = [False] * len(b)
    of_a = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                of_a.append(c)
                break
    m = len(of_a)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(of_a, (c for c, u in zip(b, used, strict=True) if u), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


def token_diff(submitted: str, ocr: str) -> str | None:
    """The first two differences between the words of two texts, read from the document's side."""
    strip = ".,;:()"
    sub, doc = ([w for w in (x.strip(strip) for x in s.split()) if w] for s in (submitted, ocr))
    said = []
    for kind, i1, i2, j1, j2 in difflib.SequenceMatcher(None, [w.lower() for w in doc], [w.lower() for w in sub]).get_opcodes():
        a, b = " ".join(doc[i1:i2]), " ".join(sub[j1:j2])
        if kind != "equal":
            said.append({"replace": f"{a} vs {b}", "delete": f"Extra in OCR: '{a}'", "insert": f"Missing in OCR: '{b}'"}[kind])
    return ", ".join(said[:2]) or None


def _paired(f: Callable, kind: str):
    def over(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype="object" if kind == "string" else "float64")

    over.__name__ = f.__name__
    return F.pandas_udf(over, kind)


FUNCTIONS = {f.__name__: (f, "double") for f in (ratio, token_sort_ratio, token_set_ratio, partial_ratio, jaro_winkler)} | {"token_diff": (token_diff, "string")}


def similarity(name: str, a: Column, b: Column) -> Column:
    return _column_function(name)(a, b)


def _column_function(name: str):
    if name != "partial_ratio":
        return _paired(*FUNCTIONS[name])

    def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        there = a.notna() & b.notna()
        out = pd.Series(np.nan, index=a.index, dtype="float64")
        out[there] = partial_ratios(a[there].tolist(), b[there].tolist())
        return out.astype(object).where(there, None)

    partial_ratio.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(partial_ratio, "double")


def register(spark: SparkSession) -> None:
    """Make the functions available to SQL under their names, with the native ratio as ``ratio_native``."""
    for name in FUNCTIONS:
        spark.udf.register(name, _column_function(name))


#: Characters of the shorter string that fit a row of bits.
_BITS = 62


def native_ratio(a: Column, b: Column) -> Column:
    """``ratio`` of built-in functions only: rows of the dynamic programme folded over the characters of one string.

    A row of up to 62 characters is the bits of a number, as in ``lcs``; of two
    longer strings it is an array.
    """
    swap = F.char_length(a) > F.char_length(b)
    short, long = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    both = F.char_length(a) + F.char_length(b)
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    common = F.when(F.char_length(short) == 0, F.lit(0)).when(F.char_length(short) <= _BITS, let(chars(short), lambda s: _common_bits(s, chars(long)))).otherwise(_common_rows(chars(short), chars(long)))
    return F.when(both == 0, F.lit(100.0)).otherwise(F.lit(200.0) * common / both)


def _common_bits(short: Column, long: Column) -> Column:
    one = F.lit(1).cast("long")
    full = F.call_function("shiftleft", one, F.size(short)) - one
    # a number has a bit for each place of a character
    mask = lambda c: F.aggregate(F.transform(short, lambda x, i: F.when(x == c, F.call_function("shiftleft", one, i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))
    places = F.map_from_entries(F.transform(F.array_distinct(short), lambda c: F.struct(c, mask(c))))

    def folded(known: Column) -> Column:
        def step(row: Column, c: Column) -> Column:
            hit = row.bitwiseAND(F.coalesce(F.try_element_at(known, c), F.lit(0).cast("long")))
            return (row + hit).bitwiseOR(row - hit).bitwiseAND(full)

        return F.size(short) - F.bit_count(F.aggregate(long, full, step))

    return let(places, folded)


def _common_rows(left: Column, right: Column) -> Column:
    start = F.transform(F.sequence(F.lit(0), F.size(right)), lambda _: F.lit(0))

    def step(row: Column, c: Column) -> Column:
        # cell j: diagonal + 1 on a match, else the larger of above and left
        def cell(done: Column, j: Column) -> Column:
            hit = F.element_at(right, j) == c
            value = F.when(hit, F.element_at(row, j) + 1).otherwise(F.greatest(F.element_at(row, j + 1), F.element_at(done, -1)))
            return F.concat(done, F.array(value))

        return F.aggregate(F.sequence(F.lit(1), F.size(right)), F.array(F.lit(0)), cell)

    return F.element_at(F.aggregate(left, start, step), -1)


SCORES = ("ratio", "token_sort", "token_set", "partial", "jaro_winkler")


def score_pairs(a: list[str], b: list[str], wide: list[bool]) -> dict[str, list[float]]:
    """What scoring asks of each pair; where ``wide`` is set (addresses) word sets and windows count, else Jaro-Winkler does.

    Scores that a pair's own rule doesn't ask for are 0: windows where the word
    sets differ much, the plain ratio where they don't. Empty pairs have none.
    """
    out = {name: [0.0] * len(a) for name in SCORES}
    windows = []
    for k, (x, y, w) in enumerate(zip(a, b, wide, strict=True)):
        if not x and not y:
            continue
        out["token_sort"][k] = token_sort_ratio(x, y)
        if w:
            out["token_set"][k] = token_set_ratio(x, y)
            if out["token_set"][k] >= 70.0:
                windows.append(k)
                continue
        else:
            out["jaro_winkler"][k] = 100.0 * jaro_winkler(x, y)
        out["ratio"][k] = ratio(x, y)
    for k, best in zip(windows, partial_ratios([a[k] for k in windows], [b[k] for k in windows]), strict=True):
        out["partial"][k] = best
    return out


def _ends(lists: pa.Array) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())]), pa.int32())


def fuzzy_score_arrays(a: Column, b: Column, wide: Column) -> Column:
    """``score_pairs`` of arrays: a struct of scores for each pair of a row; a batch's pairs are compared together."""

    def over(a: pa.Array, b: pa.Array, wide: pa.Array) -> pa.Array:
        scores = score_pairs(a.flatten().to_pylist(), b.flatten().to_pylist(), wide.flatten().to_pylist())
        return pa.ListArray.from_arrays(_ends(a), pa.StructArray.from_arrays([pa.array(scores[n], pa.float64()) for n in SCORES], names=list(SCORES)))

    over.__annotations__ = {"a": pa.Array, "b": pa.Array, "wide": pa.Array, "return": pa.Array}
    # not to be copied into the expressions that use it: it would run again for each
    return F.arrow_udf(over, "array<struct<" + ", ".join(f"{n}: double" for n in SCORES) + ">>").asNondeterministic()(a, b, wide)


def token_diff_arrays(a: Column, b: Column) -> Column:
    """``token_diff`` of each pair of two arrays; empty pairs have none."""

    def over(a: pa.Array, b: pa.Array) -> pa.Array:
        said = [token_diff(x, y) if x or y else None for x, y in zip(a.flatten().to_pylist(), b.flatten().to_pylist(), strict=True)]
        return pa.ListArray.from_arrays(_ends(a), pa.array(said, pa.string()))

    over.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}
    return F.arrow_udf(over, "array<string>").asNondeterministic()(a, b)
