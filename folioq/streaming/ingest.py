"""Incremental ingestion: files of points arrive, the collection follows.

The checkpoint is the run's state: files that were taken in are not read again. A batch is written by key, so that doing it
again after a failure gives the same collection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioq.operators.store import latest, upsert


def read_points(spark: SparkSession, folder: str, schema: str, files_a_batch: int = 1000) -> DataFrame:
    """Stream of the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


#: Buckets of a collection by its key's hash.
BUCKETS = 64


def keep_collection(points: DataFrame, folder: str, key: str, order: str, checkpoint: str) -> StreamingQuery:
    """Keep a collection in folders `folder`/_v=<batch + 1>/_bucket=<n>: a batch writes anew the buckets that its keys fall in, and
    only these. Of each bucket the greatest version counts."""

    def take(batch: DataFrame, number: int) -> None:
        spark, bucket = batch.sparkSession, F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
        fresh = latest(batch, key, [order]).withColumn("_bucket", bucket)
        touched = [r._bucket for r in fresh.select("_bucket").distinct().collect()]  # BUCKETS at most
        if touched:
            stored = _stored(spark, folder, number).where(F.col("_bucket").isin(touched)) if number else None
            merged = fresh if stored is None else upsert(stored, fresh, key)
            merged.write.mode("overwrite").partitionBy("_bucket").parquet(f"{folder}/_v={number + 1}")

    return points.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _stored(spark: SparkSession, folder: str, version: int) -> DataFrame:
    every = spark.read.parquet(folder).where(F.col("_v") <= version)
    newest = every.groupBy("_bucket").agg(F.max("_v").alias("_v"))  # a row a bucket
    return every.join(F.broadcast(newest), ["_bucket", "_v"], "left_semi").drop("_v")


def current(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """The collection as of a version."""
    return _stored(spark, folder, version).drop("_bucket")


def event_counts(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Stream of (start, event_type, n): run events a window, with late ones up to a limit."""
    counted = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n")
