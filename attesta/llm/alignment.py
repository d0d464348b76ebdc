"""Alignment of two tokenizers over a corpus.

Two vocabularies cut the same bytes at different places. Where both cut, a
group of tokens ends: a merge of the two lists of token ends with two pointers
finds the groups of a text in one pass. Every token of one side of a group is
linked with every token of the other. Over the corpus a pair of ids counts the
documents that hold it linked; each text is then scored by the counts of its
links, and by how many of them are the best of their A id.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .tokens import ByteBpe, vocabulary

#: Tokens of a batch on its way out.
BATCH_TOKENS = 1 << 18
#: A pair's count is broadcast if more than one in so many of all (document, pair) rows is its: so many pairs at most.
COMMON = 100_000
#: Links of a group from which its ids are counted first.
WIDE = 4096
_PAIR = 32  # bits of the B id in a pair's number

ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>"


def shared_ends(a_ends: list[int], b_ends: list[int]) -> tuple[list[int], list[int]]:
    """How many tokens of each side lie before each byte offset at which tokens of both sides end.

    Both lists rise and end with the same number of bytes. Two pointers: the one
    that stands at the lesser end moves on, both do at a shared one.
    """
    i, j, of_a, of_b = 0, 0, [], []
    x, y = a_ends[0], b_ends[0]
    last_a, last_b = len(a_ends) - 1, len(b_ends) - 1
    while True:
        if x == y:
            of_a.append(i + 1)
            of_b.append(j + 1)
            if i == last_a or j == last_b:
                return of_a, of_b
            i += 1
            j += 1
            x, y = a_ends[i], b_ends[j]
        elif x < y:
            i += 1
            x = a_ends[i]
        else:
            j += 1
            y = b_ends[j]


class Groups:
    """Groups of two lists of ids, cut at ``of_a`` and ``of_b`` (from ``shared_ends``)."""

    def __init__(self, a: list[int], b: list[int], of_a: list[int], of_b: list[int]):
        self.a, self.b = np.array(a, np.int64), np.array(b, np.int64)
        self.ia, self.ib = np.array([0, *of_a]), np.array([0, *of_b])
        self.da, self.db = np.diff(self.ia), np.diff(self.ib)

    def __len__(self) -> int:
        return len(self.da)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct linked pairs (A id and B id in one number) and how often each is linked."""
        size = self.da * self.db
        small = np.flatnonzero(size <= WIDE)
        n, across = size[small], np.repeat(self.db[small], size[small])
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)  # a link's number in its group
        down = within // across
        x = self.a[np.repeat(self.ia[small], n) + down] << _PAIR
        pairs, times = np.unique(x | self.b[np.repeat(self.ib[small], n) + within - down * across], return_counts=True)
        more: Counter[int] = Counter()
        for g in np.flatnonzero(size > WIDE):  # a long group is one of few ids, repeated: they are counted before they are paired
            there = Counter(self.b[self.ib[g] : self.ib[g + 1]].tolist()).items()
            for p, k in Counter(self.a[self.ia[g] : self.ia[g + 1]].tolist()).items():
                for q, m in there:
                    more[p << _PAIR | q] += k * m
        if more:
            wide = np.fromiter(more.values(), np.int64, len(more))
            pairs, place = np.unique(np.concatenate([pairs, np.fromiter(more.keys(), np.int64, len(more))]), return_inverse=True)
            both = np.zeros(len(pairs), np.int64)
            np.add.at(both, place, np.concatenate([times, wide]))
            times = both
        return pairs, times

    def text(self, marked: Marked) -> str:
        """Groups as ``a1,a2|b1;a3|b2,b3``."""
        # a group's A tokens come right before its B tokens, each with what stands behind it
        out = np.empty(len(self.a) + len(self.b), object)
        ends = np.zeros(len(self.a), bool)
        ends[self.ia[1:] - 1] = True
        out[np.arange(len(self.a)) + np.repeat(self.ib[:-1], self.da)] = np.where(ends, marked.bar[self.a], marked.comma[self.a])
        ends = np.zeros(len(self.b), bool)
        ends[self.ib[1:] - 1] = True
        out[np.arange(len(self.b)) + np.repeat(self.ia[1:], self.db)] = np.where(ends, marked.semicolon[self.b], marked.comma[self.b])
        return "".join(out.tolist())[:-1]


class Marked:
    """The decimal form of each id with the marks that may stand behind it."""

    def __init__(self, ids: int):
        text = [str(i) for i in range(ids)]
        self.comma, self.bar, self.semicolon = (np.array([t + mark for t in text], object) for mark in ",|;")


class Aligner:
    """Tokens of a text, with a space before it, by a byte-level and by a piece vocabulary."""

    def __init__(self, ranks: str, letters_file: str, pieces: str):
        self.a = ByteBpe(ranks)
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        with open(letters_file, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.a_size = {i: len(token) for token, i in vocab.items()}  # a letter is a byte
        self.marked = Marked(1 + max(max(self.a_size), self.b.get_piece_size()))
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())

    def tokens(self, text: str) -> tuple[list[int], list[int], list[int], list[int]] | None:
        """(A ids, B ids, A ends, B ends); none for an empty text, or if a side's bytes aren't the text's."""
        if not text:
            return None
        whole = f" {text}"
        a, b = self.a.ids(whole), self.b.encode(text, num_threads=1)
        parts = [self.b_bytes[i] for i in b]
        a_ends, b_ends = list(accumulate(map(self.a_size.__getitem__, a))), list(accumulate(map(len, parts)))
        # byte-level tokens spell any text; pieces may not
        if b"".join(parts) != whole.encode() or a_ends[-1] != b_ends[-1]:
            return None
        return a, b, a_ends, b_ends


@lru_cache(maxsize=1)
def _aligner(ranks: str, letters_file: str, pieces: str) -> Aligner:
    return Aligner(ranks, letters_file, pieces)


def _aligned(files: tuple[str, str, str]):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner, number = _aligner(*files), TaskContext.get().partitionId() << 40
        none = np.zeros(0, np.int64)
        names = [c.split(" ")[0] for c in ALIGNED.split(", ")]
        out: list[tuple] = []
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True):
                got = aligner.tokens(text if isinstance(text, str) else "")
                doc = None if pd.isna(doc_id) else int(doc_id)  # as text: pandas would make ids beside a null inexact
                if got is None:
                    out.append((number, doc, 0, 0, 0, 0, "", none, none))
                else:
                    a, b, a_ends, b_ends = got
                    groups = Groups(a, b, *shared_ends(a_ends, b_ends))
                    pairs, times = groups.links()
                    out.append((number, doc, len(a), len(b), len(groups), int(times.sum()), groups.text(aligner.marked), pairs, times))
                    size += len(a) + len(b)
                number += 1
                if size >= BATCH_TOKENS or len(out) >= 8192:
                    yield _frame(out, names)
                    out, size = [], 0
        if out:
            yield _frame(out, names)

    return rows


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})


def aligned(docs: DataFrame, ranks: str | None = None, letters_file: str | None = None, pieces: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times) of each text.

    A is the byte-level vocabulary (its ``ranks``, and the file that names its
    tokens), B the piece vocabulary. ``groups`` says which ids stand for the same
    bytes; ``pairs`` are the distinct linked ids, A's shifted by 32 bits with B's
    below, ``times`` how often each is linked. ``row`` numbers the rows.

    Null and empty texts, and texts whose bytes a vocabulary doesn't give back
    (it may normalise), have no tokens. Strings of special tokens are ordinary
    text. One narrow pass; a task holds one text at a time and a batch of results.
    """
    files = (ranks or vocabulary("byte_bpe_50k.tiktoken"), letters_file or vocabulary("byte_bpe_50k.json"), pieces or vocabulary("piece_bpe_32k.model"))
    return docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(_aligned(files), ALIGNED)


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, docs, best): in how many texts a pair is linked, and whether that is the most of its A id."""
    counts = found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs"))
    a = F.shiftright("pair", _PAIR)
    most = counts.groupBy(a.alias("a")).agg(F.max("docs").alias("most"))
    # a row for each id of the A vocabulary at most
    return counts.withColumn("a", a).join(F.broadcast(most), "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def link_scores(found: DataFrame) -> DataFrame:
    """``found`` (from ``aligned``) without its pairs, with n_best and count_sum.

    ``count_sum`` adds up the corpus-wide counts of a text's links, ``n_best``
    counts the links whose pair has the highest count of its A id, ties
    included. The table is written once and read for both passes. Few pairs are
    linked in very many texts, and most rows are theirs: those counts, at most
    ``COMMON`` of them, go to the rows; the rest of the rows is shuffled to the
    other pairs' counts, none of which has more than one in ``COMMON`` of them.
    """
    found = materialize(found, "aligned")
    counts = materialize(pair_counts(found), "pair-counts")
    total = counts.agg(F.sum("docs")).first()[0] or 0
    common = F.col("docs").cast("decimal(19,0)") * F.lit(COMMON) > F.lit(total).cast("decimal(19,0)")
    held = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    met = held.join(F.broadcast(counts.where(common)), "pair", "left")
    rest = met.where("docs IS NULL").select("row", "pair", "times").join(counts.where(~common), "pair")
    columns = ("row", "times", "docs", "best")
    scored = met.where("docs IS NOT NULL").select(*columns).union(rest.select(*columns))
    times = F.col("times")
    sums = scored.groupBy("row").agg(F.sum(F.when(F.col("best"), times).otherwise(F.lit(0))).alias("n_best"), F.sum(times * F.col("docs")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return found.drop("pairs", "times").join(sums, "row", "left").drop("row").withColumns({c: F.coalesce(c, zero) for c in ("n_best", "count_sum")})


def align(docs: DataFrame, **options: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum) of each text: ``aligned``, scored by ``link_scores``.

    Rows that repeat an id are texts of their own, and count as documents; an
    empty table gives no rows; other columns are ignored.
    """
    return link_scores(aligned(docs, **options))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aligned(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    # the groups' digest is taken before the table is written: their text is longer than the documents
    return link_scores(found.withColumn("groups_sha256", digest).drop("groups"))
