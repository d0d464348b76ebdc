"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Within a source every document is expected ``target / source_size`` times.
Documents are put in order of size, the expected copies are summed up along
that order, one offset drawn from the seed is added, and a document is taken
once for each integer that its stretch of the sum crosses. As neighbours have
nearly equal sizes, the words taken miss the target by no more than twice the
size of the source's largest document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, global_index, table

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: A target stops at this many times its source's size.
MAX_REPEAT = 3


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per source: _source, source_size, target, _first (its lowest row number).

    All sizes together are shared out by weight; a target stops at
    ``max_repeat`` times the source's size and the excess goes to the others by
    weight. The sources that stop are those first in order of size over weight,
    so running sums over the sources find them without iterating. Sums are
    integers, hence exact in any order. The running sums are one task over one
    row of some 100 bytes per source, which is fine for a million sources;
    Spark broadcasts the result only below its own threshold.
    """
    s = sized.groupBy(F.col("_source")).agg(F.sum("size").alias("source_size"), F.min("_g").alias("_first"))
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    s = s.withColumn("_w", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    fill = Window.orderBy((F.col("source_size") / F.col("_w")).asc(), F.col("_source").asc_nulls_last())
    whole = Window.partitionBy(F.lit(0))
    s = s.select(
        "*",
        F.sum("source_size").over(whole).alias("_all"),
        F.coalesce(F.sum("source_size").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_w").over(fill.rowsBetween(0, Window.unboundedFollowing)).alias("_rest"),
    )
    stops = (F.col("_all") - max_repeat * F.col("_before")) * F.col("_w") > max_repeat * F.col("source_size") * F.col("_rest")
    s = s.withColumn("_stops", stops)
    s = s.select(
        "*",
        (F.col("_all") - max_repeat * F.coalesce(F.sum(F.when(F.col("_stops"), F.col("source_size"))).over(whole), F.lit(0))).alias("_left"),
        F.sum(F.when(~F.col("_stops"), F.col("_w"))).over(whole).alias("_open"),
    )
    target = F.when(F.col("_stops"), (max_repeat * F.col("source_size")).cast("double")).otherwise((F.col("_w") * F.col("_left")).cast("double") / F.col("_open"))
    return s.select("_source", "source_size", target.alias("target"), "_first")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, copies, taken.

    ``size`` counts words (runs of anything but ASCII white space); null text
    has 0. A null source is a source, last in order. A source without words has
    target 0 and nothing is taken. Rows that repeat an id are rows like others.
    An empty table gives no rows. ``carry`` names further columns to keep.
    Reruns agree: the offset is drawn from the seed and the source's name, and
    the order (size, id) is total up to rows that are alike.
    """
    spark_cols = [F.col(f"`{c}`") for c in carry]
    light = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.col(source_col).alias("_source"),
        *[c.alias(f"_carry_{i}") for i, c in enumerate(spark_cols)],
    )
    placed = global_index(light, [F.col("_source").asc_nulls_last(), F.col("size"), F.col("doc_id").asc_nulls_last()], "mix", write_first=not carry)
    targets = source_targets(placed, weights, max_repeat).withColumnRenamed("_source", "_of")
    d = placed.join(targets, F.col("_source").eqNullSafe(F.col("_of")))
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("_source", F.lit(""))).cast("binary"), 256), 1, 3), 16, 10).cast("double")
    offset = (draw + 0.5) / 4096  # few bits, so that sums with it stay exact for long
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank = (F.col("_g") - F.col("_first")).cast("double")
    copies = (F.floor(offset + rate * (rank + 1)) - F.floor(offset + rate * rank)).cast("long")
    return d.withColumn("copies", copies).select(
        "doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"),
        *[F.col(f"_carry_{i}").alias(c) for i, c in enumerate(carry)],
    )


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: a row appears once for each of its copies."""
    cols = [c for c in docs.columns]
    got = mix(docs, carry=tuple(cols), **options).where("copies > 0")
    names = [f"_c{i}" for i in range(len(cols))]
    start = len(got.columns) - len(cols)
    got = got.toDF(*[f"_k{i}" for i in range(start)], *names)
    copies = F.col("_k4").cast("int")
    return got.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).select(*[F.col(n).alias(c) for n, c in zip(names, cols, strict=True)])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("copies")


#: Takes {docs}; gives doc_id, size, source_size, target, copies, taken and the row itself.
MIX_SQL = r"""
sized AS (SELECT *, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM {docs}),
src AS (SELECT source AS s, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY s NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS w FROM src),
filled AS (SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum(source_size) OVER (ORDER BY CAST(source_size AS DOUBLE) / w, s NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(w) OVER (ORDER BY CAST(source_size AS DOUBLE) / w, s NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM weighted),
stopped AS (SELECT *, (total - 3 * before) * w > 3 * source_size * rest AS stops FROM filled),
shared AS (SELECT *, total - 3 * coalesce(sum(source_size) FILTER (stops) OVER (), 0) AS remaining, sum(w) FILTER (NOT stops) OVER () AS open FROM stopped),
targets AS (SELECT s, source_size, CASE WHEN stops THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(w * remaining AS DOUBLE) / CAST(open AS DOUBLE) END AS target,
    (CAST('0x' || substr(sha256('0:' || coalesce(s, '')), 1, 3) AS INTEGER) + 0.5::DOUBLE) / 4096 AS u FROM shared),
ranked AS (SELECT d.*, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    CAST(row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS LAST) - 1 AS DOUBLE) AS k
    FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.s),
mixed AS (SELECT *, CAST(floor(u + rate * (k + 1)) - floor(u + rate * k) AS BIGINT) AS copies FROM ranked)
"""
OP5_SQL = "WITH " + MIX_SQL.replace("{docs}", "documents") + "SELECT doc_id, size, source_size, target, copies * size AS taken FROM mixed"
