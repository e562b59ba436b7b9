"""Windowed counts and deduplication of event streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.session import shared_dir


def read_events(spark: SparkSession, folder: str, like: DataFrame, files_per_trigger: int = 4) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_counts(events: DataFrame, time_col: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, key, n) per time window; events later than ``late`` behind the newest are dropped."""
    t = events.withColumn("_t", F.col(time_col).cast("timestamp")).withWatermark("_t", late)
    return t.groupBy(F.window("_t", width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def once_within(events: DataFrame, time_col: str, keys: list[str], late: str = "2 hours") -> DataFrame:
    """Each key's first event within the watermark."""
    t = events.withColumn("_t", F.col(time_col).cast("timestamp")).withWatermark("_t", late)
    return t.dropDuplicatesWithinWatermark(keys).drop("_t")


def run_available(df: DataFrame) -> DataFrame:
    """Runs a stream over what is there and returns what it wrote.

    Output and checkpoint lie in the shared folder, so the stream survives the
    loss of an executor.
    """
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = df.writeStream.format("parquet").option("path", base + "/out").option("checkpointLocation", base + "/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(base + "/out")
