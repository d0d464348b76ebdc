"""Near duplicates by order MinHash, verified by banded alignment.

A text is its sequence of word shingles. Every sketch takes the few shingles
with the least hash values and keeps them in text order, so that equal sketches
speak of equal order and not only of equal sets. Some sketches sample
occurrence-labelled shingles (the first and the second time a shingle occurs are
two items), the others the first occurrences, which are what is aligned: how
often a line is repeated changes neither those nor a link. Texts that share a
sketch are candidates. A candidate pair is a link if its words align to
SIMILARITY or more and its shingles to SHARED or more (``near_copies``), and
classes are the connected components of links. A changed word is one of the
words but five of the shingles, so shingles alone would take for other texts
what differs in one word of thirty.

Buckets are never expanded into all pairs. First every bucket's members are held
against one head, the text that meets the most others. Of what then still is of
several components, members beyond the commonest component are held against all
members of other components if there are FEW of them or less, so a large group
of copies and some others cost each member a bounded number of looks at
profiles. The texts of more crowded buckets, each once, meet by finer sketches instead, of more and
shorter shingles (texts of few shingles stay in their buckets), and go the same
way. Only what is crowded even then is split by pivots, in rounds without a
bound: members are held against a pivot, the text from which the head's
component seems to be copied, and split by what they have beyond the pivot:
texts whose shingles align to SIMILARITY have either a shingle in common that
the pivot lacks, which makes parts of those few that do, or both have so much of
the pivot that this, with their lengths, allows a link, which makes a pair.
Pairs are compared by their numbers of words in classes before any text is
moved.

A pair of words 0.8 and shingles 0.8 in common misses the first sketches with
a chance below 1e-6, and one of shingles 0.6 or 0.5 in common with 0.01 or 0.13.
Splitting loses no pair of shingles 0.8, but for texts of the pivot's own
shingles in another order (they meet by ORDER_SKETCHES sketches, a miss below
0.001) and those of crowded parts (finer sketches, a miss below 0.001 from 40
shingles on); pairs of fewer shingles in common meet by the head, the pivot, the
least of what they have beyond it, or the finer sketches.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table, unused

SHINGLE = 5
SIMILARITY = 0.8
#: A pair of similarity 0.8 shares a sketch of ORDER shingles with chance 0.4, hence one of the SKETCHES of first
#: occurrences all but surely. LABELLED more sketches are of occurrence-labelled shingles.
SKETCHES, LABELLED, ORDER = 28, 4, 4
#: Members of a bucket beyond its commonest component that are held against all its members rather than against a pivot.
FEW = 512
#: Sketches by which texts of the same shingles as their pivot are told apart by order.
ORDER_SKETCHES, ORDER_OF_SAME = 24, 6
#: Classes of words by which pairs are ruled out before their texts are fetched, and those of texts in open buckets.
BINS, MARKS = 32, 256
#: Least aligned share of the shingles of a link, whose words align to SIMILARITY.
SHARED = 0.5
#: Sketches by which the texts of crowded parts are told apart: FINE_ORDER shingles of FINE_WIDTH words each; the last FINE_LABELLED sample occurrence-labelled ones.
FINE, FINE_LABELLED, FINE_ORDER, FINE_WIDTH = 96, 32, 10, 3
#: Shingles from which on a text of crowded buckets meets by finer sketches; shorter ones stay in their buckets.
FINE_FROM = 40
#: Rows up to which a written table of numbers is broadcast rather than shuffled.
SMALL = 20_000
#: Words in a row that are aligned at once.
STRETCH = 4096
#: Distinct shingles in order, and the words that they start with.
Text = tuple[np.ndarray, np.ndarray]
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


def word_hashes(text: bytes) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in text.split()], np.uint64)


def shingles(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the text's word shingles in order; a shorter text is one shingle, one without words none."""
    return shingled(word_hashes(text), width)


def shingled(words: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    n = max(1, len(words) - width + 1) if len(words) else 0
    h = np.zeros(n, np.uint64)
    for i in range(min(width, len(words))):
        h = _mix(h + words[i : i + n] * _GOLD)
    return h


def labelled(h: np.ndarray) -> np.ndarray:
    """A shingle sequence with each repeat as an item of its own: the k-th occurrence of a shingle is labelled k."""
    order = np.argsort(h, kind="stable")
    at = np.arange(len(h))
    starts = np.concatenate([[True], h[order][1:] != h[order][:-1]]) if len(h) else np.zeros(0, bool)
    seen = np.empty(len(h), np.uint64)
    seen[order] = at - np.maximum.accumulate(np.where(starts, at, 0))
    return np.where(seen > 0, _mix(h + seen * _GOLD), h)


def order_sketches(h: np.ndarray, sketches: int = SKETCHES, order: int = ORDER, first: int = 1) -> np.ndarray:
    """Sketch keys of a sequence of distinct items: those of least hash values, in text order; ``first`` numbers the hash functions."""
    n = len(h)
    if not n or not sketches:
        return np.zeros(0, np.int64)
    base = _mix(h)
    seeds = _mix(np.arange(first, first + sketches, dtype=np.uint64) * _GOLD)
    keys = np.empty(sketches, np.uint64)
    step = max(1, (1 << 18) // n)
    for s in range(0, sketches, step):
        seed = seeds[s : s + step, None]
        values = (base[None, :] ^ seed) * np.uint64(0xD6E8FEB86659FD93)
        values ^= values >> np.uint64(32)
        k = min(order, n)
        least = np.sort(np.argpartition(values, k - 1, axis=1)[:, :k], axis=1)
        key = seed[:, 0].copy()
        for j in range(k):
            key = _mix(key + h[least[:, j]] * _GOLD)
        keys[s : s + step] = key
    return keys.view(np.int64)


def sketch_keys(h: np.ndarray, sketches: int = SKETCHES, order: int = ORDER, repeats: int = LABELLED) -> np.ndarray:
    """Sketches of the first occurrences of a shingle sequence, then those of its occurrence-labelled shingles."""
    distinct = distinct_in_order(h)
    if len(distinct) == len(h):
        return order_sketches(h, sketches + repeats, order)
    return np.concatenate([order_sketches(distinct, sketches, order), order_sketches(labelled(h), repeats, order, sketches + 1)])


def profile(words: np.ndarray, classes: int) -> np.ndarray:
    """How many of a text's items fall in each of some (a power of two) classes of words, 127 at most."""
    return np.minimum(np.bincount((words >> np.uint64(65 - classes.bit_length())).astype(np.int64), minlength=classes), 127).astype(np.int8)


def distinct_in_order(h: np.ndarray) -> np.ndarray:
    return h[np.sort(np.unique(h, return_index=True)[1])]


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether the aligned share of two sequences of distinct shingles is ``least`` or more.

    The share is m / (|a| + |b| - m) for m aligned shingles: the Jaccard
    similarity, if what they share is in the same order. A share of ``least``
    leaves at most (|a| + |b|) * (1 - least) / (1 + least) shingles without a
    partner, so an alignment that reaches it never leaves the diagonal band of
    that width; shingles are aligned only within the band.
    """
    total = len(a) + len(b)
    need = total * least / (1 + least)
    if min(len(a), len(b)) < need - 1e-9:
        return False
    sorted_a = np.argsort(a)
    at = np.minimum(np.searchsorted(a, b, sorter=sorted_a), len(a) - 1)
    i = sorted_a[at]
    j = np.flatnonzero(a[i] == b)
    i = i[j]
    if len(j) < need - 1e-9:
        return False
    inside = np.abs(i - j) <= total * (1 - least) / (1 + least) + 1
    i = i[inside]
    if len(i) < need - 1e-9:
        return False
    if (np.diff(i) > 0).all():
        return True
    tails: list[int] = []  # longest increasing run of places: the alignment of distinct items
    for x in i.tolist():
        p = bisect_left(tails, x)
        if p == len(tails):
            tails.append(x)
        else:
            tails[p] = x
    return len(tails) >= need - 1e-9


def _rising(i: np.ndarray) -> np.ndarray:
    """Places of a longest rising run of ``i``."""
    if (np.diff(i) > 0).all():
        return np.arange(len(i))
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for k, x in enumerate(i.tolist()):
        p = bisect_left(tails, x)
        if p == len(tails):
            tails.append(x)
            ends.append(k)
        else:
            tails[p], ends[p] = x, k
        before.append(ends[p - 1] if p else -1)
    run, k = [], ends[-1]
    while k >= 0:
        run.append(k)
        k = before[k]
    return np.array(run[::-1], np.int64)


def common_words(x: list[int], y: list[int]) -> int:
    """Length of the longest common subsequence, a row of the table as the bits of one integer.

    A stretch of more than STRETCH words is aligned in as many proportional pieces as it takes.
    """
    if not x or not y:
        return 0
    pieces = -(-max(len(x), len(y)) // STRETCH)
    if pieces > 1:
        cut = lambda z, k: z[len(z) * k // pieces : len(z) * (k + 1) // pieces]
        return sum(common_words(cut(x, k), cut(y, k)) for k in range(pieces))
    at: dict[int, int] = {}
    for k, w in enumerate(x):
        at[w] = at.get(w, 0) | 1 << k
    full = row = (1 << len(x)) - 1
    for w in y:
        u = row & at.get(w, 0)
        row = ((row + u) | (row - u)) & full
    return len(x) - row.bit_count()


def near_copies(a: Text, b: Text, least: float = SIMILARITY, shared: float = SHARED) -> bool:
    """Whether two texts are linked: their words align to ``least`` or more, their shingles to ``shared`` or more.

    The items of a text are its distinct shingles in order of first occurrence,
    each with the word that it starts with, so what is repeated counts once.
    Shingles of both texts are aligned within the band that an alignment of
    share ``least`` never leaves; the words between aligned shingles are then
    aligned with each other. With m items aligned the share is
    m / (|a| + |b| - m). Every pair of which the shingles alone align to
    ``least`` is a link.
    """
    if (len(b[0]), b[0][:1].tolist()) < (len(a[0]), a[0][:1].tolist()):
        a, b = b, a
    (h, words), (other, other_words) = a, b
    total = len(h) + len(other)
    need, anchors = total * least / (1 + least) - 1e-9, total * shared / (1 + shared) - 1e-9
    if not len(h) or len(h) < need:
        return False
    order = np.argsort(h)
    at = order[np.minimum(np.searchsorted(h, other, sorter=order), len(h) - 1)]
    j = np.flatnonzero(h[at] == other)
    j = j[np.abs(at[j] - j) <= total * (1 - least) / (1 + least) + 1]
    if len(j) < anchors:
        return False
    i = at[j]
    run = _rising(i)
    i, j = i[run], j[run]
    if len(i) < anchors or len(i) >= need:
        return len(i) >= need
    i, j = np.concatenate([[-1], i, [len(h)]]), np.concatenate([[-1], j, [len(other)]])
    gaps = np.flatnonzero((np.diff(i) > 1) & (np.diff(j) > 1))
    room = np.minimum(np.diff(i), np.diff(j))[gaps] - 1
    reach = len(run) + int(room.sum())  # what is aligned if all that is still to be looked at is
    for k, most in zip(gaps.tolist(), room.tolist(), strict=True):
        if reach < need:
            return False
        reach += common_words(words[i[k] + 1 : i[k + 1]].tolist(), other_words[j[k] + 1 : j[k + 1]].tolist()) - most
    return reach >= need


def items(text: bytes, width: int = SHINGLE) -> Text:
    """The distinct shingles of a text in order of first occurrence, and the words that they start with."""
    words = word_hashes(text)
    h = shingled(words, width)
    first = np.sort(np.unique(h, return_index=True)[1])
    return h[first], words[first]


def _sequence(text: Column) -> Column:
    """128 bits of the text's word sequence: equal for texts that differ in white space between words only."""
    one = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return F.unhex(F.md5(F.trim(one).cast("binary")))


def _utf8(text: pa.StringScalar) -> bytes:
    return (text.as_py() or "").encode("utf-8", "surrogatepass")


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays]), kind))


def _sketcher(width: int, sketches: int, order: int):
    schema = pa.schema([("doc_id", pa.int64()), ("raw", pa.int64()), ("seq", pa.binary()), ("keys", pa.list_(pa.int64())), ("n", pa.int32()), ("bins", pa.list_(pa.int8()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                seq, keys, n, bins = [], [], [], []
                for text in map(_utf8, part.column(2)):
                    seq.append(hashlib.md5(b" ".join(text.split())).digest())  # as _sequence
                    words = word_hashes(text)
                    h = shingled(words, width)
                    keys.append(sketch_keys(h, sketches, order))
                    words = words[np.unique(h, return_index=True)[1]]
                    n.append(len(words))
                    bins.append(profile(words, BINS))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(seq, pa.binary()), _lists(keys, pa.int64()), pa.array(n, pa.int32()), _lists(bins, pa.int8())], schema=schema)

    return rows


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            body = [packer.compress(_utf8(t)) for t in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(body, pa.binary())], names=["doc_id", "raw", "body"])


class _Bodies:
    """Items of packed texts; those of the last few heads are kept, as pairs of one head stand together."""

    def __init__(self, width: int):
        self.width, self.unpack, self.held = width, zstandard.ZstdDecompressor().decompress, {}

    def __call__(self, body: pa.BinaryScalar) -> Text:
        return items(self.unpack(body.as_py()), self.width)

    def head(self, node: int, body: pa.BinaryScalar) -> Text:
        if node not in self.held:
            if len(self.held) >= 4:
                del self.held[next(iter(self.held))]
            self.held[node] = self(body)
        return self.held[node]


def _verifier(width: int, least: float):
    """Rows (a, b, body_a, body_b) -> the pairs that are links."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _Bodies(width)
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            links = [k for k in range(batch.num_rows) if near_copies(read.head(b[k], batch.column(3)[k]), read(batch.column(2)[k]), least)]
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in links], pa.int64()), pa.array([b[k] for k in links], pa.int64())], schema=schema)

    return rows


def beyond(h: np.ndarray, known: np.ndarray, least: float) -> tuple[np.ndarray, int]:
    """Of a text's distinct shingles those outside ``known`` by which it meets its links, and how many are inside.

    Texts a and b of similarity ``least`` or more share at least
    (|a| + |b|) * least / (1 + least) shingles. What they share inside ``known``
    is no more than either has there; if that is less, they share one outside.
    At least ``least * |a|`` of a's shingles are shared, so of those outside all
    but that many, less those inside, plus one are enough, if every text takes
    its least by value: both then take one that they share.
    """
    outside = np.sort(h[~np.isin(h, known)])
    inside = len(h) - len(outside)
    return outside[: max(0, len(outside) - max(1, math.ceil(least * len(h) - 1e-9) - inside) + 1)], inside


def _splitter(width: int, least: float):
    """Rows (node, pivot, root, their bodies) -> how a node stands to its pivot, and the keys of the parts that it goes to.

    ``known`` are the shingles of the pivot and of the root, the pivot of the
    first split. ``most`` is the greatest size of a text with which the node can
    be linked though they share nothing beyond. Texts with the pivot's own
    shingles, perhaps in another order (``near``), also meet by sketches of that
    order.
    """
    schema = pa.schema([("node", pa.int64()), ("pivot", pa.int64()), ("root", pa.int64()), ("linked", pa.bool_()), ("near", pa.bool_()), ("n", pa.int32()), ("most", pa.float64()), ("keys", pa.list_(pa.int64()))])
    share = least / (1 + least)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _Bodies(width)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                pivots, roots = part.column("pivot").to_pylist(), part.column("root").to_pylist()
                linked, near, n, most, keys = [], [], [], [], []
                for k, (pivot, root) in enumerate(zip(pivots, roots, strict=True)):
                    original, text = read.head(pivot, part.column("pivot_body")[k]), read(part.column("body")[k])
                    p, h = original[0], text[0]
                    known = p if root == pivot else np.union1d(p, read.head(root, part.column("root_body")[k])[0])
                    outside, inside = beyond(h, known, least)
                    linked.append(near_copies(original, text, least))
                    near.append(bool(np.isin(h, p).sum() >= (len(h) + len(p)) * share - 1e-9))
                    n.append(len(h))
                    most.append(inside / share - len(h) + 1e-6)
                    if near[-1]:
                        outside = np.concatenate([outside, order_sketches(h, ORDER_SKETCHES, ORDER_OF_SAME, 1001).view(np.uint64)])
                    keys.append(_mix(outside + _mix(np.array([pivot, root], np.uint64) * _GOLD).sum()).view(np.int64))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("node", "pivot", "root")), pa.array(linked, pa.bool_()), pa.array(near, pa.bool_()), pa.array(n, pa.int32()), pa.array(most), _lists(keys, pa.int64())], schema=schema)

    return rows


def _marker(width: int):
    """Rows (node, body) -> the node's profile in MARKS classes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _Bodies(width)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists([profile(read(b)[1], MARKS) for b in part.column(1)], pa.int8())], names=["node", "marks"])

    return rows


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, body) -> the node's finer sketches."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            keys = [sketch_keys(shingles(unpack(b.as_py()), FINE_WIDTH), FINE, FINE_ORDER, FINE_LABELLED) for b in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(keys, pa.int64())], names=["node", "keys"])


def _sent(written: DataFrame):
    """How a join gets what is made of a written table: broadcast if the table is SMALL, else as Spark does it."""
    return F.broadcast if written.count() <= SMALL else lambda df: df


def connect(scratch: Scratch, labels: DataFrame, links: DataFrame) -> DataFrame:
    """Update labels (node, comp) by links (a, b): comp becomes the least node that is connected.

    Only nodes that have a link have a label; any other is its own component.
    Components, not nodes, are joined: every component takes the least
    neighbouring one, pointers are followed twice, and the edges that are left
    between components shrink to none in about as many rounds as the logarithm
    of the longest chain.
    """
    if links.isEmpty():
        return labels
    ends = links.select("a", "a").union(links.select("b", "b")).toDF("node", "comp")
    labels = scratch.write(labels.union(ends).groupBy("node").agg(F.min("comp").alias("comp")), "labels")  # a component is its least node
    sent = _sent(labels)  # as many rows in every round
    while True:
        la, lb = sent(labels.toDF("a", "ca")), sent(labels.toDF("b", "cb"))
        edges = scratch.write(links.join(la, "a").join(lb, "b").where("ca <> cb").select("ca", "cb").distinct(), "edges")
        if edges.isEmpty():
            return labels
        both = edges.union(edges.select("cb", "ca")).toDF("c", "p")
        up = both.groupBy("c").agg(F.min("p").alias("p")).where("p < c")
        for _ in range(2):
            step = up.toDF("p", "q")
            up = up.join(sent(step), "p", "left").select("c", F.coalesce("q", "p").alias("p"))
        labels = scratch.write(labels.join(sent(up), F.col("comp") == F.col("c"), "left").select("node", F.coalesce("p", "comp").alias("comp")), "labels")


def _may_match(n: Column, bins: Column, other_n: Column, other_bins: Column, least: float) -> Column:
    """False only for pairs that cannot reach ``least``: items without a partner are at least the difference of the
    profiles, and at most (n + n') * (1 - least) / (1 + least)."""
    apart = F.aggregate(F.zip_with(bins, other_bins, lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda s, v: s + v)
    room = (n + other_n) * ((1 - least) / (1 + least)) + 1e-6
    return (F.abs(n - other_n) <= room) & (apart <= room)


def near_classes(docs: DataFrame, least: float = SIMILARITY, width: int = SHINGLE, sketches: int = SKETCHES, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): every row's doc_id and seq; every distinct word sequence's seq, first_id, class_id, class_size.

    See ``near_duplicates`` for what the classes are.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    raw = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))  # with the id, it finds a row's text again
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), raw.alias("raw"), F.col(text_col).alias("text"))
    rows = scratch.write(base.mapInArrow(_sketcher(width, sketches, order), "doc_id long, raw long, seq binary, keys array<long>, n int, bins array<tinyint>"), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "raw")).alias("f")
    nodes = rows.groupBy("seq").agg(first, F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys"), F.first("n").alias("n"), F.first("bins").alias("bins"))
    nodes = scratch.write(nodes.select(F.monotonically_increasing_id().alias("node"), "seq", F.col("f.doc_id").alias("first_id"), F.col("f.raw").alias("raw"), "copies", "keys", "n", "bins"), "nodes")
    labels = spark.range(0).select(F.col("id").alias("node"), F.col("id").alias("comp"))

    def shared(buckets: DataFrame, name: str) -> DataFrame:
        """Of (key, node, root) those in buckets of m > 1 members, each node its own component; buckets of the same members are one."""
        sizes = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("node")).alias("who")).where("m > 1")
        keys = sizes.groupBy("m", "who").agg(F.min("key").alias("key"))
        return scratch.write(buckets.join(keys, "key").select("key", "node", "root", F.col("node").alias("comp"), "m"), name)

    def opened(members: DataFrame, name: str) -> DataFrame:
        """Of (key, node, root) those in buckets of more than one component, with comp, the bucket's commonest component ``main`` and how many members are not in it, ``rest``.

        Buckets of the same members are one: of several such keys one stays.
        """
        known = members.join(_sent(labels)(labels), "node", "left").select("key", "node", "root", F.coalesce("comp", "node").alias("comp"))
        comps = known.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("node")).alias("who"), F.min("root").alias("root"))
        keys = comps.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("most"), F.sum("c").alias("m"), F.bit_xor("who").alias("who"), F.min("root").alias("root"))
        keys = keys.select("key", "m", "who", "root", F.col("most.comp").alias("main"), (F.col("m") - F.col("most.c")).alias("rest")).where("rest > 0")
        return scratch.write(known.join(keys.groupBy("main", "m", "rest", "who", "root").agg(F.min("key").alias("key")).select("key", "main", "rest"), "key"), name)

    def bodies(of: DataFrame, node: str, body: str, sent=lambda df: df) -> DataFrame:
        """(node, body) of the texts that ``of`` names, so that a join moves those and no others."""
        return texts.join(sent(of.select(F.col(node).alias("node"))), "node", "left_semi").toDF(node, body)

    def linked(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) of nodes those that are links, written; b is the one that many pairs may have."""
        pairs = scratch.write(pairs.distinct(), "pairs")
        if pairs.isEmpty():
            return pairs
        sent = _sent(pairs)
        both = sent(pairs).join(bodies(pairs, "a", "body_a", sent), "a").join(bodies(pairs, "b", "body_b", sent), "b").select("a", "b", "body_a", "body_b")
        return scratch.write(both.mapInArrow(_verifier(width, least), "a long, b long"), "links")

    def matching(pairs: DataFrame) -> DataFrame:
        """Of rows with profiles (n, bins) and (_n, _bins) those that may be links."""
        return pairs.where(_may_match(F.col("n"), F.col("bins"), F.col("_n"), F.col("_bins"), least))

    buckets = nodes.select(F.explode(F.array_distinct("keys")).alias("key"), "node", F.lit(None).cast("long").alias("root"))
    live = shared(buckets, "open")  # every node is a component as yet
    met = live.groupBy("node").agg(F.sum("m").alias("w"))  # a text meets so many members in all its buckets
    known = scratch.write(nodes.join(met, "node").select("node", "w", "n", "bins", F.col("raw").alias("_raw"), "first_id"), "known")
    profiles, sent_profiles = known.select("node", "w", "n", "bins"), _sent(known)
    packed = base.mapInArrow(_packed, "doc_id long, raw long, body binary")  # before the join, which moves all texts
    found = packed.join(known.hint("merge"), (F.col("raw") == F.col("_raw")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    texts = scratch.write(found.groupBy("node").agg(F.first("body").alias("body")), "texts")  # rows may repeat

    def met_heads(live: DataFrame, labels: DataFrame, more: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Every bucket's members against one head: the text that meets the most, as that does from which copies were made.

        The members without the heads, which have met all, and the labels by the links found and ``more`` links.
        """
        live = live.join(sent_profiles(profiles), "node")
        heads = live.groupBy("key").agg(F.max(F.struct("w", "node", "comp", "n", "bins")).alias("h"))
        held = scratch.write(live.join(heads, "key").where("node <> h.node").select("key", "node", "root", "comp", "n", "bins", F.col("h.node").alias("head"), F.col("h.comp").alias("head_comp"), F.col("h.n").alias("_n"), F.col("h.bins").alias("_bins")), "held")
        links = linked(matching(held.where("comp <> head_comp")).select(F.col("node").alias("a"), F.col("head").alias("b")))
        return held.select("key", "node", "root"), connect(scratch, labels, links.union(more) if more else links)

    members, labels = met_heads(live, labels)
    live = opened(members, "live")
    marks = texts.join(live.select("node"), "node", "left_semi").mapInArrow(_marker(width), "node long, marks array<tinyint>")
    marks = scratch.write(profiles.join(marks, "node").select("node", "n", "bins", "marks"), "marks")

    def likely(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) of nodes in open buckets those that may be links by their finer profiles."""
        pairs, finer = scratch.write(pairs.select("a", "b").distinct(), "met"), marks.select("node", "n", F.col("marks").alias("bins"))
        return matching(pairs.join(finer.withColumnRenamed("node", "a"), "a").join(finer.toDF("b", "_n", "_bins"), "b")).select("a", "b")

    def within(live: DataFrame) -> DataFrame:
        """Links of buckets with few members beyond their commonest component: those few against all members of other components."""
        few = live.where(F.col("rest") <= FEW).join(marks, "node")
        rest = few.where("comp <> main").toDF(*[f"_{c}" for c in few.columns])
        met = (F.col("key") == F.col("_key")) & (F.col("comp") != F.col("_comp")) & ((F.col("comp") == F.col("main")) | (F.col("node") < F.col("_node")))
        for c in ("bins", "marks"):
            met = met & _may_match(F.col("n"), F.col(c), F.col("_n"), F.col(f"_{c}"), least)
        return linked(few.join(rest, met).select(F.greatest("node", "_node").alias("a"), F.least("node", "_node").alias("b")))

    links, many = within(live), live.where(F.col("rest") > FEW)
    if not many.isEmpty():  # the texts of crowded buckets meet by finer sketches instead, each text once
        crowd = scratch.write(many.join(profiles.select("node", "n"), "node").select("key", "node", "root", "n"), "crowd")
        fine = texts.join(crowd.where(F.col("n") >= FINE_FROM), "node", "left_semi").mapInArrow(_fine, "node long, keys array<long>")
        fine = scratch.write(fine, "fine").select(F.explode(F.array_distinct("keys")).alias("key"), "node", F.lit(None).cast("long").alias("root"))
        members, labels = met_heads(opened(shared(fine, "shared").select("key", "node", "root"), "open"), labels, links)
        live = opened(crowd.where(F.col("n") <= FINE_FROM / least).select("key", "node", "root").union(members), "live")
        links, many = within(live), live.where(F.col("rest") > FEW)

    band = lambda n: F.floor(F.log(F.greatest(n, F.lit(1.0))) * 20)
    while not many.isEmpty():
        # the pivot: at first the text of the head's component that meets the most, later the head itself
        heads = many.join(profiles, "node").groupBy("key").agg(F.max(F.struct("w", "node", "comp")).alias("h")).select("key", F.col("h.node").alias("head"), F.col("h.comp").alias("comp"))
        centers = profiles.join(labels, "node").groupBy("comp").agg(F.max(F.struct("w", "node")).alias("c")).select("comp", F.col("c.node").alias("center"))
        pivots = heads.join(centers, "comp", "left").select("key", "head", F.coalesce("center", "head").alias("center"))
        pivot = F.when(F.col("root").isNull(), F.col("center")).otherwise(F.col("head"))
        against = many.join(pivots, "key").select("node", pivot.alias("pivot"), F.coalesce("root", "center").alias("root")).where("node <> pivot").distinct()
        against = scratch.write(against, "against")
        both = against.join(bodies(against, "node", "body"), "node").join(bodies(against, "root", "root_body"), "root").join(bodies(against, "pivot", "pivot_body"), "pivot")
        parts = both.mapInArrow(_splitter(width, least), "node long, pivot long, root long, linked boolean, near boolean, n int, most double, keys array<long>")
        parts = scratch.write(parts, "parts")

        # pairs that may be links without a shingle beyond the pivot in common: by size, in bands of it
        sized = parts.join(labels, "node", "left").select("node", "pivot", "root", "near", "n", "most", F.coalesce("comp", "node").alias("comp"))
        low, high = F.ceil(F.col("n") * least - 1e-6), F.least(F.col("most"), F.col("n") / least)
        off = sized.where(~F.col("near")).withColumn("low", low.cast("double")).withColumn("high", high).where("low <= high").withColumn("band", F.explode(F.sequence(band(F.col("low")), band(F.col("high")))))
        others = sized.withColumn("band", band(F.col("n").cast("double"))).select(*[F.col(c).alias(f"_{c}") for c in ("node", "pivot", "root", "n", "most", "comp", "band")])
        fits = F.col("_n").between(F.col("low"), F.col("high")) & (F.col("n") <= F.col("_most")) & (F.col("comp") != F.col("_comp"))
        pairs = off.join(others, (F.col("pivot") == F.col("_pivot")) & (F.col("root") == F.col("_root")) & (F.col("band") == F.col("_band")) & fits)
        pairs = pairs.select(F.greatest("node", "_node").alias("a"), F.least("node", "_node").alias("b"))
        by_size = linked(likely(pairs))
        labels = connect(scratch, labels, links.union(parts.where("linked").select("node", "pivot")).union(by_size))
        live = opened(parts.select(F.explode("keys").alias("key"), "node", "root"), "live")
        links, many = within(live), live.where(F.col("rest") > FEW)
    labels = connect(scratch, labels, links)

    joined = nodes.join(_sent(labels)(labels), "node", "left").select("seq", "first_id", "copies", F.coalesce("comp", "node").alias("comp"))
    classes = joined.groupBy("comp").agg(F.min("first_id").alias("class_id"), F.sum("copies").alias("class_size"))
    out = scratch.write(joined.join(classes, "comp").select("seq", "first_id", "class_id", "class_size"), "classes")
    scratch.keep_only(rows, out)
    return rows.select("doc_id", "seq"), out


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, class_size, kept.

    Two texts are linked if their words align to 0.8 or more and their shingles
    (five words) to 0.5 or more (``near_copies``); texts of fewer words are one shingle, so only equal ones
    meet. Texts that differ only in white space between words are one. The
    class is the connected component, class_id its smallest id, and that row is
    kept. Null text counts as empty, and empty texts are one class; a class of
    null ids alone has a null class_id and keeps all its rows, and rows that repeat an
    id and its text are kept together. An empty table gives no rows; further
    columns are ignored.
    """
    rows, nodes = near_classes(docs, **options)
    return rows.join(nodes, "seq").select("doc_id", "class_id", F.col("class_size").cast("long").alias("class_size"), _kept(F.col("doc_id")).alias("kept"))


def _kept(doc_id: Column, first_id: str = "first_id", class_id: str = "class_id") -> Column:
    return F.col(first_id).eqNullSafe(F.col(class_id)) & doc_id.eqNullSafe(F.col(class_id))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` (all columns) without those that are near duplicates of one that stays."""
    _, nodes = near_classes(docs, id_col=id_col, text_col=text_col, **options)
    of, seq, first, klass = unused(docs, "of", "seq", "first_id", "class_id")
    many = nodes.where("class_size > 1").select(F.col("seq").alias(seq), F.col("first_id").alias(first), F.col("class_id").alias(klass))
    joined = docs.withColumn(of, _sequence(F.col(text_col))).join(many, F.col(of) == F.col(seq), "left")
    kept = joined.where(F.col(seq).isNull() | _kept(F.col(id_col).cast("long"), first, klass))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
