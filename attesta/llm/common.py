"""Shared plumbing for the training-data operators.

Intermediate tables are written under the folder that the cluster names in
``spark.checkpoint.dir``; that folder is shared by the driver and all
executors, so a lost executor never loses an intermediate result.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Deletes the ASCII white space of ``[\x20\x09-\x0D]``.
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: A word, wherever operators count words.
WORD = r"[^\x20\x09-\x0D]+"


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables (``spark.checkpoint.dir``).

    Only if the session names none and runs in one process (tests, a laptop) a
    temporary folder is made, set as the checkpoint folder and removed at exit;
    on a cluster a machine's own folder would lose rows, so that is an error.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="attesta-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        sc.setCheckpointDir(f"file://{base}")
        base = sc.getCheckpointDir()
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back (cuts lineage)."""
    return written(df, new_path(df.sparkSession, name))


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """The intermediate tables of one operator, which go once nothing reads them.

    ``keep_only`` names the tables that the frames returned to the caller read
    (results are lazy, so those must stay for as long as the caller needs them).
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, new_path(spark, name)
        self.tables: list[tuple[str, DataFrame]] = []
        self.made = 0

    def path(self, name: str) -> str:
        self.made += 1
        return f"{self.root}/{self.made:03d}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        out = written(df, path)
        self.tables.append((path, out))
        return out

    def keep_only(self, *frames: DataFrame) -> None:
        for path, df in self.tables:
            if not any(df is f for f in frames):
                drop_path(self.spark, path)
        self.tables = [x for x in self.tables if any(x[1] is f for f in frames)]


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that ``df`` doesn't have (names are compared without regard to case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id's decimal text, mod 3, is 1. A null id is not held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def global_index(df: DataFrame, order: list[str | Column], name: str, index: str = "_g", write_first: bool = False) -> DataFrame:
    """Number all rows 0..N-1 in ``order``, without a single-task sort.

    Range partitioning samples its input by running it: ``write_first`` writes
    the input before, for light rows that are costly to compute.

    Rows are range-partitioned and sorted; ``monotonically_increasing_id``
    then holds the partition and the place in it. The table is written once,
    so that the numbers cannot change, and each partition's start is the
    running sum of the row counts before it: one row per partition, which is
    what is broadcast (its size is the number of shuffle partitions).
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if write_first:
        df = materialize(df, f"{name}-rows")
    placed = materialize(
        df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), name
    )
    pid = F.shiftright("_m", 33)
    counts = placed.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_start"))
    return (
        placed.withColumn("_pid", pid)
        .join(F.broadcast(starts), "_pid")
        .withColumn(index, F.col("_start") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_pid", "_m", "_start")
    )
