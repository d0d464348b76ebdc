"""Streaming extension: records that arrive in a landing folder."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RECORDS
from ..sources.records import RecordStore


def landing(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Records of JSON files as they arrive, each id once within the watermark."""
    d = spark.readStream.schema(RECORDS).option("maxFilesPerTrigger", files_per_trigger).json(path)
    # event time needs an instant; records carry local times
    d = d.withColumn("event_time", F.to_timestamp(F.col("timestamp").cast("string")))
    return d.withWatermark("event_time", "1 hour").dropDuplicatesWithinWatermark(["id"])


def tier_windows(records: DataFrame, size: str = "10 minutes") -> DataFrame:
    """Counts by tier in tumbling windows; late rows within the watermark count."""
    return records.groupBy(F.window("event_time", size), "tier").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "tier", "n")


def append_to(records: DataFrame, root: str, checkpoint: str):
    """Start appending the stream to a store's records.

    Every micro-batch is a batch of the store, named by the stream's checkpoint
    and the micro-batch's number: one that runs again writes the same folder.
    """
    stream = hashlib.sha1(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, number: int) -> None:
        RecordStore(batch.sparkSession, root).write_batch(batch, f"s-{stream}-{number}")

    out = records.drop("event_time").select(*RECORDS.fieldNames())
    return out.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
