"""Packing by minimum bin slack.

Documents are cut into windows of ``length`` ids; only each document's last
piece is shorter. Those pieces are packed per block of documents: a window is
opened with the longest piece left, and a bitset dynamic programme over the
multiset of remaining lengths finds the fill closest to the window's capacity;
walking back through the programme's steps gives how many pieces of each length
to take. The same multiset is used again for as long as the counts allow. If
the best fill leaves a gap, a piece is cut to fill it; what is left at the end
of a block is cut into sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import BYTE_BPE_SPECIAL, ByteBpe, vocabulary

LENGTH = 1024
#: Ids that a task gathers before it hands them on.
BATCH_TOKENS = 1 << 18
_NAMES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many pieces of each length to take, so that their sum is as near below ``capacity`` as can be.

    ``reach`` has bit s set if some sub-multiset of the lengths seen so far
    sums to s. A length with n pieces enters as groups of 1, 2, 4, ... pieces,
    so that a window with many equal pieces takes few steps. Longest first;
    it stops once the capacity itself is reached.
    """
    full, mask, reach = 1 << capacity, (1 << (capacity + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted(counts, reverse=True):
        left, group = min(counts[length], capacity // length), 1
        while left > 0:
            group = min(group, left)
            steps.append((length, group, reach))
            reach |= reach << (length * group) & mask
            left -= group
            group *= 2
        if reach & full:
            break
    at, taken = reach.bit_length() - 1, defaultdict(int)
    for length, group, before in reversed(steps):
        if not before >> at & 1:  # this sum needs the step
            taken[length] += group
            at -= length * group
    return dict(taken)


def pack_lengths(counts: dict[int, int], capacity: int = LENGTH) -> Iterator[tuple[dict[int, int], int, int]]:
    """Yield (multiset, times, slack): windows that use up ``counts`` (lengths below the capacity)."""
    counts = {n: c for n, c in counts.items() if c}
    while counts:
        longest = max(counts)
        rest = counts | {longest: counts[longest] - 1}
        window = best_fill({n: c for n, c in rest.items() if c and n <= capacity - longest}, capacity - longest)
        window[longest] = window.get(longest, 0) + 1
        times = min(counts[n] // c for n, c in window.items())
        for n, c in window.items():
            counts[n] -= c * times
            if not counts[n]:
                del counts[n]
        yield window, times, capacity - sum(n * c for n, c in window.items())


class _Block:
    """Short pieces of some documents, and the sequences made of them."""

    def __init__(self, capacity: int):
        self.capacity, self.by_length, self.tokens = capacity, defaultdict(list), 0

    def add(self, doc: tuple, start: int, ids: bytes) -> None:
        self.by_length[len(ids) // 4].append((doc, start, ids))
        self.tokens += len(ids) // 4

    def _cut(self, piece: tuple, at: int) -> tuple[tuple, tuple]:
        doc, start, ids = piece
        return (doc, start, ids[: 4 * at]), (doc, start + at, ids[4 * at :])

    def sequences(self) -> Iterator[list[tuple]]:
        counts = {n: len(p) for n, p in self.by_length.items()}
        gaps = []
        for window, times, slack in pack_lengths(counts, self.capacity):
            for _ in range(times):
                got = [self.by_length[n].pop() for n, c in window.items() for _ in range(c)]
                if slack:
                    gaps.append((slack, got))
                else:
                    yield got
        # Windows with a gap: the emptiest give up their pieces, cut, to fill the others.
        gaps.sort(key=lambda g: g[0])
        spare: list[tuple] = []
        while gaps:
            slack, got = gaps.pop(0)
            while slack and (spare or gaps):
                if not spare:
                    spare = gaps.pop()[1]
                piece = spare.pop()
                if len(piece[2]) // 4 > slack:
                    piece, back = self._cut(piece, slack)
                    spare.append(back)
                got.append(piece)
                slack -= len(piece[2]) // 4
            if slack:
                spare = got
            else:
                yield got
        left = sum(len(p[2]) // 4 for p in spare)
        while left:
            size, got = 1 << (left.bit_length() - 1), []
            left -= size
            while size:
                piece = spare.pop()
                if len(piece[2]) // 4 > size:
                    piece, back = self._cut(piece, size)
                    spare.append(back)
                got.append(piece)
                size -= len(piece[2]) // 4
            yield got


class _Out:
    """Pieces on their way to Arrow: numbers by column, ids as the bytes that they are."""

    def __init__(self, with_ids: bool):
        self.with_ids = with_ids
        self._empty()

    def _empty(self) -> None:
        self.columns: list[list] = [[] for _ in _NAMES]
        self.ids: list[bytes] = []
        self.tokens = 0

    def add(self, row: tuple, ids: bytes) -> None:
        for column, value in zip(self.columns, row, strict=True):
            column.append(value)
        self.tokens += len(ids) // 4
        if self.with_ids:
            self.ids.append(ids)

    def full(self) -> bool:
        return self.tokens >= BATCH_TOKENS or len(self.columns[0]) >= 8192

    def batch(self) -> pa.RecordBatch:
        arrays, names = [pa.array(c, pa.int64()) for c in self.columns], list(_NAMES)
        if self.with_ids:
            ends = np.cumsum([0, *(len(x) // 4 for x in self.ids)]).astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(self.ids), np.int32))))
            names.append("ids")
        self._empty()
        return pa.RecordBatch.from_arrays(arrays, names=names)


def _packer(ranks: str, special: dict[str, int], capacity: int, end_id: int, block_tokens: int, with_ids: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ByteBpe(ranks, special).encode
        end = end_id.to_bytes(4, "little")
        number = TaskContext.get().partitionId() << 40
        out = _Out(with_ids)

        def emit(pieces: list[tuple]) -> None:
            nonlocal number
            at = 0
            for (doc_id, total), start, ids in pieces:
                out.add((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, number, at), ids)
                at += len(ids) // 4
            number += 1

        def packed(block: _Block) -> Iterator[pa.RecordBatch]:
            for got in block.sequences():
                emit(got)
                if out.full():
                    yield out.batch()

        block = _Block(capacity)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):  # one text at a time: they may be long
                ids = next(encode([text.as_py() or ""])) + end
                doc, whole = (doc_id, len(ids) // 4), len(ids) // (4 * capacity)
                for i in range(whole):
                    emit([(doc, i * capacity, ids[4 * capacity * i : 4 * capacity * (i + 1)])])
                    if out.full():
                        yield out.batch()
                if rest := ids[4 * capacity * whole :]:
                    block.add(doc, whole * capacity, rest)
                if block.tokens >= block_tokens:
                    yield from packed(block)
                    block = _Block(capacity)
        yield from packed(block)
        if out.columns[0]:
            yield out.batch()

    return rows


def pack(docs: DataFrame, length: int = LENGTH, ranks: str | None = None, special: dict[str, int] = BYTE_BPE_SPECIAL, end_id: int = 0, block_tokens: int = 2_000_000, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A document's ids are those of the public byte-level vocabulary (strings of
    its ``special`` tokens are those tokens) and then ``end_id``. Every id lies in exactly one piece; sequences hold ``length``
    ids or a power of two, so none needs padding. Packing happens where the
    text is read: nothing is shuffled, a task holds one block of ids (as bytes)
    and one batch of pieces, and
    sequence numbers start from the task's number, so a task that runs again
    gives the same rows. Null and empty texts are documents of one id; rows
    that repeat an id are documents of their own; an empty table gives no rows.
    """
    ranks = ranks or vocabulary("byte_bpe_50k.tiktoken")
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_packer(ranks, special, length, end_id, block_tokens, with_ids), kinds)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)
