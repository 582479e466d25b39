"""Line formats: baskets, queries, ground-truth frequencies; parsers take any DataFrame with a ``value`` column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import Scratch


def _ints(csv: Column) -> Column:
    tokens = F.filter(F.transform(F.split(csv, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_distinct(F.transform(tokens, lambda x: x.cast("int")))


def parse_baskets(lines: DataFrame) -> DataFrame:
    """uid, items of each line that isn't blank. ``3,17,,3`` is {3, 17}; ``,`` is an empty set, which stays.

    The line's own ``uid`` is kept if there is one; otherwise rows get increasing ids in file order.
    """
    text = F.trim(F.col("value"))
    uid = F.col("uid") if "uid" in lines.columns else F.monotonically_increasing_id()
    return lines.where(F.length(text) > 0).select(uid.cast("bigint").alias("uid"), _ints(text).alias("items"))


def parse_queries(lines: DataFrame) -> DataFrame:
    """qid, threshold, items of lines ``<threshold> <csv items>``; the items may be missing."""
    text = F.trim(F.col("value"))
    parts = F.split(text, r"\s+", 2)
    qid = F.col("qid") if "qid" in lines.columns else F.monotonically_increasing_id()
    return lines.where(F.length(text) > 0).select(
        qid.cast("bigint").alias("qid"), parts[0].cast("int").alias("threshold"), F.when(F.size(parts) > 1, _ints(F.get(parts, F.lit(1)))).otherwise(F.array().cast("array<int>")).alias("items")
    )


def parse_frequencies(lines: DataFrame, queries: int) -> DataFrame:
    """qid (from 0), freq of the first ``queries`` lines that aren't blank; fails if there are fewer.

    ``line_no`` orders the lines; blank lines don't count.
    """
    filled = lines.where(F.length(F.trim("value")) > 0)
    first = filled.select("line_no", F.trim("value").cast("double").alias("freq")).orderBy("line_no").limit(queries)  # as many as there are queries
    ranked = first.select((F.row_number().over(Window.orderBy("line_no")) - 1).cast("bigint").alias("qid"), "freq")
    counted = first.agg(F.count("*").alias("n")).select(F.assert_true(F.col("n") == queries, F.lit("fewer frequencies than queries")).alias("ok"))
    return ranked.join(F.broadcast(counted)).where(F.col("ok").isNull()).select("qid", "freq")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (gapless from 0), value of the lines that aren't blank, in the order of file names and lines.

    Files are read in splits. The lines are written once with their place in their split, so that numbers and
    lines come from the same reading; the lines of earlier splits are then added, from a row for each split.
    """
    scratch = Scratch(spark, "lines")
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    placed = scratch.save(read.where(F.length(F.trim("value")) > 0).withColumn("id", F.monotonically_increasing_id()), "placed")
    splits = placed.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    earlier = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    shifts = scratch.save(splits.select("file", "start", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift")), "shifts")
    return placed.join(shifts, ["file", "start"]).select((F.col("id") + F.col("shift")).alias("line_no"), "value")


def read_baskets(spark: SparkSession, path: str) -> DataFrame:
    """uid is the number of the user's line among those that aren't blank, from 0."""
    return parse_baskets(numbered_lines(spark, path).withColumnRenamed("line_no", "uid"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """qid is the number of the query's line among those that aren't blank, from 0, as in the file of frequencies."""
    return parse_queries(numbered_lines(spark, path).withColumnRenamed("line_no", "qid"))


def read_frequencies(spark: SparkSession, path: str, queries: int) -> DataFrame:
    return parse_frequencies(numbered_lines(spark, path), queries)


def write_metrics(metrics: DataFrame, path: str | None = None) -> DataFrame:
    """Sink of per-epsilon metrics: Parquet if a path is given, and the rows for showing."""
    if path:
        metrics.write.mode("overwrite").parquet(path)
    return metrics.orderBy("epsilon")
