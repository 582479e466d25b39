"""Baskets built from relational tables, and the default query workload over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def encode_items(pairs: DataFrame, raw: str = "raw_key") -> DataFrame:
    """Dictionary of the item domain: item (dense from 0, in key order), raw_key. The domain is a dimension: thousands of rows."""
    return pairs.select(raw).distinct().select((F.row_number().over(Window.orderBy(raw)) - 1).cast("int").alias("item"), raw)


def basket_items(pairs: DataFrame, items: DataFrame, raw: str = "raw_key") -> DataFrame:
    """uid, item: distinct, keys replaced by item numbers."""
    return pairs.join(F.broadcast(items), raw).select("uid", "item").distinct()


def order_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid = order, raw_key = brand, repeats included."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("raw_key"))
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_orderkey").alias("uid"))
    return lines.join(part, "l_partkey").select("uid", "raw_key")


def customer_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid = customer, raw_key = part, repeats included."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("uid"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("raw_key"))
    return lines.join(orders, "l_orderkey").select("uid", "raw_key")


def brand_baskets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(items, basket_items) of the order -> brand baskets. Keys are mapped on the small table, before the join."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("raw_key"))
    items = encode_items(part)
    coded = part.join(F.broadcast(items), "raw_key").select("l_partkey", "item")
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_orderkey").alias("uid"))
    return items, lines.join(coded, "l_partkey").select("uid", "item").distinct()


def _query_order(qid: Column, item: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit("q"), qid.cast("string"), item.cast("string")))


def default_queries(spark: SparkSession, items: DataFrame, count: int = 20) -> DataFrame:
    """qid, threshold, items: query i holds 3 + i % 10 items in hash order and asks for 1 + i % 3 of them."""
    per_item = items.select("item", F.explode(F.sequence(F.lit(1), F.lit(count))).alias("qid"))
    ranked = per_item.withColumn("rn", F.row_number().over(Window.partitionBy("qid").orderBy(_query_order(F.col("qid"), F.col("item")))))
    chosen = ranked.where(F.col("rn") <= 3 + F.col("qid") % 10)
    return chosen.groupBy("qid").agg(F.sort_array(F.collect_list("item")).alias("items")).select(F.col("qid").cast("bigint").alias("qid"), (1 + F.col("qid") % 3).cast("int").alias("threshold"), "items")


def exploded(queries: DataFrame) -> DataFrame:
    """qid, item: distinct."""
    return queries.select("qid", F.explode(F.array_distinct("items")).alias("item"))


def baskets_of(pairs: DataFrame) -> DataFrame:
    """uid, items (sorted) from uid, item."""
    return pairs.groupBy("uid").agg(F.sort_array(F.collect_set("item")).alias("items"))
