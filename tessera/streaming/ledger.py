"""The usage ledger as a stream: calls arrive as files, totals per run and day are kept under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.numbers import half_up

SCHEMA = "id bigint, ts timestamp, run bigint, op string, cost double, ok boolean"


def append(calls: DataFrame, path: str) -> None:
    """Add calls to the ledger as JSON lines."""
    calls.write.mode("append").json(path)


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """Calls as they are appended; each id counts once while it may still come late."""
    return spark.readStream.schema(SCHEMA).json(path).withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["id"])


def rollup(calls: DataFrame, window: str = "1 day") -> DataFrame:
    """Calls, images and known cost of each run and window, and whether a call is unpriced; for streams and tables alike."""
    return calls.groupBy(F.window("ts", window), "run").agg(
        F.count("*").alias("calls"), F.count_if("ok").alias("images"), half_up(F.coalesce(F.sum("cost"), F.lit(0.0)), 4).alias("cost"), F.bool_or(F.col("cost").isNull()).alias("unknown")
    ).select(F.col("window.start").alias("day"), "run", "calls", "images", "cost", "unknown")


def write_rollup(calls: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Closed windows, appended as Parquet exactly once; a restart goes on from the checkpoint."""
    return rollup(calls).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
