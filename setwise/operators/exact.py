"""Exact threshold-overlap queries, and the metrics that compare estimates with them."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.mathx import clip01
from ..functions.prng import digest


#: Queries that one pass over baskets answers.
MOST_SMALL = 100


def overlap_counts(pairs: DataFrame, queries: DataFrame) -> DataFrame:
    """true_count of each query: users who hold at least ``threshold`` of its items.

    ``pairs``: uid, item, distinct. An inverted-index join: only users who share an item with a query take
    part. A user's rows lie together, so the map-side combine leaves one row per user and query hit. A
    threshold up to 0 counts all users of ``pairs``; queries without a hit count 0.
    """
    wanted = queries.select("qid", "threshold", F.explode(F.array_distinct("items")).alias("item"))
    shared = pairs.join(wanted.where("threshold > 0"), "item").groupBy("qid", "threshold", "uid").agg(F.count("*").alias("shared"))
    hits = shared.where(F.col("shared") >= F.col("threshold")).groupBy("qid").agg(F.count("*").alias("hits"))
    users = pairs.select("uid").distinct().agg(F.count("*").alias("users"))
    counted = queries.select("qid", "threshold").join(hits, "qid", "left").join(F.broadcast(users))
    return counted.select("qid", "threshold", F.when(F.col("threshold") <= 0, F.col("users")).otherwise(F.coalesce("hits", F.lit(0))).alias("true_count"), "users")


def overlap_counts_small(baskets: DataFrame, queries: DataFrame) -> DataFrame:
    """The same for up to ``MOST_SMALL`` queries, by one pass over ``baskets`` (uid, items) without a shuffle of users.

    More are an error: every query is an expression of the plan.
    """
    chosen = queries.select("qid", "threshold", "items").limit(MOST_SMALL + 1).collect()
    if len(chosen) > MOST_SMALL:
        raise ValueError(f"more than {MOST_SMALL} queries: use overlap_counts")
    hit = lambda q: F.size(F.array_intersect("items", F.array(*[F.lit(i) for i in q["items"]]).cast("array<int>"))) >= q["threshold"]
    counts = baskets.agg(*[F.count_if(hit(q)).alias(f"q{i}") for i, q in enumerate(chosen)])
    rows = F.explode(F.array(*[F.struct(F.lit(q["qid"]).cast("bigint").alias("qid"), F.lit(q["threshold"]).alias("threshold"), F.col(f"q{i}").alias("true_count")) for i, q in enumerate(chosen)]))
    return counts.select(rows.alias("r")).select("r.*")


def sample_queries(queries: DataFrame, most: int, seed: int) -> DataFrame:
    """min(most, all) queries in hash order: a top-k, without replacement."""
    return queries.withColumn("__d", digest(seed, "query_sample", "qid")).orderBy("__d", "qid").limit(most).drop("__d")


def estimated_count(freq: Column, users: Column) -> Column:
    """Half-even count of a frequency clamped to 0..1."""
    return F.rint(clip01(freq) * users).cast("bigint")


def metrics(answers: DataFrame, by: Iterable[str] = ("epsilon",)) -> DataFrame:
    """mse of frequencies; mre with terms capped at 100, zero truths left out of the sum but not of the divisor;
    mre_positive divides by the queries with a positive truth. ``answers``: true_count, est_count, users."""
    error = (F.col("true_count") - F.col("est_count")) / F.col("users")
    relative = F.when(F.col("true_count") > 0, F.least(F.lit(100.0), F.abs(F.col("est_count") - F.col("true_count")) / F.col("true_count"))).otherwise(F.lit(0.0))
    return answers.groupBy(*by).agg(
        F.avg(error * error).alias("mse"),
        (F.sum(relative) / F.count("*")).alias("mre"),
        (F.sum(relative) / F.greatest(F.count_if(F.col("true_count") > 0), F.lit(1))).alias("mre_positive"),
    )


def sweep(epsilons: Iterable[float], answer: Callable[[float], DataFrame]) -> DataFrame:
    """The union of ``answer(epsilon)`` with its epsilon; the exact counts don't depend on it and are made once."""
    out = None
    for epsilon in epsilons:
        one = answer(epsilon).withColumn("epsilon", F.lit(float(epsilon)))
        out = one if out is None else out.unionByName(one)
    return out
