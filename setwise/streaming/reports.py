"""Ingesting randomised reports as a stream. Support counts are sums, so batch and stream give the same estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.oue import aggregate

REPORT_SCHEMA = "uid bigint, ts timestamp, y bigint, bit int"


def read_reports(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(REPORT_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def estimates(reports: DataFrame, epsilon: float) -> DataFrame:
    """y, ones, n, est_count, est_freq over everything reported so far; for streams and for tables."""
    return aggregate(reports, epsilon, [])


def windowed_estimates(reports: DataFrame, epsilon: float, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """The same per event-time window; reports that come more than ``late`` behind are dropped with their window's state."""
    timed = reports.withWatermark("ts", late).withColumn("window", F.window("ts", window))
    return aggregate(timed, epsilon, ["window"]).select(F.col("window.start").alias("start"), "y", "ones", "n", "est_count", "est_freq")


def run_available(estimated: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Process what is there into the in-memory table ``name`` and stop."""
    query = estimated.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
