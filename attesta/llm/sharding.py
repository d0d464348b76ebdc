"""A reproducible shuffle into shards by a Feistel permutation (DataFrame functions only).

Rows are numbered 0..N-1 in order of their id. A Feistel network over pairs of
digits below m = ceil(sqrt(N)) permutes 0..m*m-1; a value beyond N-1 is put
through the network again until it falls below N (cycle walking), which makes
a permutation of 0..N-1. Row i goes to shard p(i) mod shards, slot
p(i) div shards: shard counts differ by one at most, and where a row lies can
be computed from its number, the seed and N alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import global_index, table

_PRIME = 2**31 - 1
#: At most so many walks: exact below 961 rows, as a cycle has at most 2m values beyond N;
#: above, a longer walk has a chance under 1e-75, and raises rather than give a wrong place.
_WALKS = 64


def round_keys(seed: int, rounds: int = 4) -> list[tuple[int, int]]:
    """Multiplier and addend of each round, from the seed by a linear congruential generator."""
    x, out = (seed * 2654435761 + 1013904223) % _PRIME or 1, []
    for _ in range(rounds):
        a = x = x * 48271 % _PRIME
        b = x = x * 48271 % _PRIME
        out.append((a, b))
    return out


def permute(i: int, n: int, seed: int = 0) -> int:
    """The same permutation for one number: where row ``i`` of ``n`` goes."""
    m = math.isqrt(n - 1) + 1
    while True:
        left, right = divmod(i, m)
        for a, b in round_keys(seed):
            x = (right * a + b) % _PRIME
            left, right = right, (left + x * x % _PRIME) % m
        i = left * m + right
        if i < n:
            return i


def _network(i: Column, m: int, seed: int) -> Column:
    right = F.pmod(i, F.lit(m))
    left = ((i - right) / m).cast("long")
    for a, b in round_keys(seed):
        x = F.pmod(right * F.lit(a) + F.lit(b), F.lit(_PRIME))
        left, right = right, F.pmod(left + F.pmod(x * x, F.lit(_PRIME)), F.lit(m))
    return left * F.lit(m) + right


def permuted(index: Column, n: int, seed: int = 0) -> Column:
    """Column form of ``permute`` for a bigint column of 0..n-1."""
    m = math.isqrt(max(n, 1) - 1) + 1
    first = _network(index, m, seed)
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(_WALKS)), first, lambda acc, _: F.when(acc < n, acc).otherwise(_network(acc, m, seed)))
    return F.when(first < n, first).otherwise(walk)


def shard(docs: DataFrame, shards: int = 40, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``rows``: shard counts are at most one apart. Null text has size 16 and
    the crc32 of nothing; a null id is numbered last; rows that repeat an id are
    ordered by their text's hash, and rows that are alike take either place.
    An empty table gives no rows; further columns are ignored.
    """
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    light = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    placed = global_index(light, [F.col("doc_id").asc_nulls_last(), "text_crc32", "size"], "shards", write_first=True)
    n = placed.count()
    p = placed.withColumn("_p", permuted(F.col("_g"), n, seed))
    p = p.withColumn("_p", F.when(F.col("_p") < n, F.col("_p")).otherwise(F.raise_error(F.lit("cycle walk too long"))))
    return p.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.pmod(F.col("_p"), F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"_p div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
