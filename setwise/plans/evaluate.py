"""End to end: exact truth once, a private build and its answers per epsilon, metrics."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EPSILON_GRID, Config
from ..operators import answer, exact, tree
from ..storage import Scratch


def evaluate(pairs: DataFrame, items: DataFrame, queries: DataFrame, config: Config = Config(), epsilons: Iterable[float] = EPSILON_GRID) -> tuple[DataFrame, DataFrame]:
    """(answers, metrics). answers: epsilon, qid, f_hat, est_count, true_count, users and the components."""
    chosen = exact.sample_queries(queries, config.max_queries, config.seed)
    truth = Scratch(pairs.sparkSession, "truth").save(exact.overlap_counts(pairs, chosen))

    def one(epsilon: float) -> DataFrame:
        built = tree.grow(pairs, items, replace(config, epsilon=epsilon))
        got = answer.answers(built, chosen).join(truth.select("qid", "true_count", "users"), "qid")
        return got.withColumn("est_count", exact.estimated_count(F.col("f_hat"), F.col("users")))

    rows = exact.sweep(epsilons, one)
    return rows, exact.metrics(rows)
