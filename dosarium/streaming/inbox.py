"""An inbox read as a stream: an extension, for folders that fill while the engine runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import paths


def inbox_stream(spark: SparkSession, folder: str, schema: str, path: str = "original_path") -> DataFrame:
    """Rows of Parquet files as they arrive, with name, suffix and kind; hidden names are left out."""
    c = F.col(path)
    rows = spark.readStream.schema(schema).parquet(folder)
    return rows.where(paths.visible(c)).withColumns({"name": paths.name(c), "suffix": paths.suffix(c), "kind": paths.kind(c)})


def arrivals(stream: DataFrame, time: str, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """(window_start, kind, n): arrivals by time window and kind; rows later than the watermark are dropped."""
    counted = stream.withWatermark(time, late).groupBy(F.window(time, window), "kind").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), "kind", "n")


def first_arrivals(stream: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def run_batches(stream: DataFrame, plan: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Every micro-batch goes through ``plan``; what has arrived is worked off, then the query stops."""
    return stream.writeStream.foreachBatch(plan).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
