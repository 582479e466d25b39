"""Optimised unary encoding: reports, aggregates, and the estimates built on them.

A user with value y reports a bit per domain element: the true bit is kept with probability 1/2, any other is
set with probability q = 1/(e^eps + 1). Counts are debiased by (ones - n q) / (1/2 - q).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import KEEP_RATE, Config, flip_rate
from ..functions.prng import digest, hash_rank, uniform
from ..storage import Scratch


# cohorts


def cohorts(users: DataFrame, alpha: float, blocks: int, seed: int) -> DataFrame:
    """uid, role, block_id, pos, block_size: the first floor(users * alpha) in hash order are ``underlying``; the
    others are cut into equal blocks, the remainder joining the last; with fewer users than blocks, one each.

    ``pos`` counts from 1 inside the block.
    """
    ranked = hash_rank(users.select("uid").withColumn("__d", digest(seed, "cohort", "uid")), "__d", "uid")
    total = users.agg(F.count("*").alias("users")).select((F.floor(F.col("users") * alpha)).alias("under"), "users")
    at = ranked.join(F.broadcast(total)).withColumn("__rest", F.col("users") - F.col("under")).withColumn("__i", F.col("rank") - F.col("under") - 1)
    base = F.greatest(F.lit(1), F.floor(F.col("__rest") / blocks))
    last = F.least(F.lit(blocks), F.greatest(F.col("__rest"), F.lit(1))) - 1
    block = F.least(F.floor(F.col("__i") / base), last)
    size = F.when(block < last, base).otherwise(F.col("__rest") - base * last)
    tree = F.col("__i") >= 0
    return at.select(
        "uid",
        F.when(tree, "tree").otherwise("underlying").alias("role"),
        F.when(tree, block).cast("int").alias("block_id"),
        F.when(tree, F.col("__i") - base * block + 1).otherwise(F.col("rank")).cast("bigint").alias("pos"),
        F.when(tree, size).otherwise(F.col("under")).cast("bigint").alias("block_size"),
    )


# samples


def sample_item(pairs: DataFrame, seed: int, tag: str = "item_sample") -> DataFrame:
    """One item a user, uniform: the one with the least digest. Users without items don't appear."""
    return pairs.groupBy("uid").agg(F.min_by("item", digest(seed, tag, "uid", "item")).alias("item"))


def sample_pair(things: DataFrame, seed: int, tag: str, by: list[str], value: str = "item") -> DataFrame:
    """*by, a, b: an unordered pair of distinct values of each group, uniform; null where there are fewer than two."""
    drawn = things.groupBy(*by).agg(F.slice(F.array_sort(F.collect_list(F.struct(digest(seed, tag, *by, value).alias("d"), F.col(value).alias("v")))), 1, 2).alias("two"))
    two = F.size("two") >= 2
    first, second = F.get(F.col("two.v"), F.lit(0)), F.get(F.col("two.v"), F.lit(1))
    return drawn.select(*by, F.when(two, F.least(first, second)).alias("a"), F.when(two, F.greatest(first, second)).alias("b"))


def pair_id(a: Column, b: Column, size: Column) -> Column:
    """Row-major number (from 1) of the pair a < b of 0..size-1; 0 for no pair."""
    return F.coalesce(F.lit(1) + _pairs_before(a, size) + (b - a - 1), F.lit(0)).cast("bigint")


def _pairs_before(a: Column, size: Column) -> Column:
    """Pairs whose smaller element is under ``a``, in whole numbers."""
    a, size = a.cast("bigint"), size.cast("bigint")
    return F.shiftright(a * (2 * size - a - 1), 1)


def pair_of(y: Column, size: Column) -> tuple[Column, Column]:
    """(a, b) of a pair's number, null for 0: the root of a quadratic, set right by whole numbers."""
    at = y.cast("bigint") - 1
    edge = 2 * size.cast("double") - 1
    guess = F.floor((edge - F.sqrt(F.greatest(edge * edge - 8 * at, F.lit(0.0)))) / 2)
    a = guess - F.when(_pairs_before(guess, size) > at, 1).otherwise(0) + F.when(_pairs_before(guess + 1, size) <= at, 1).otherwise(0)
    b = at - _pairs_before(a, size) + a + 1
    return F.when(y > 0, a).cast("int"), F.when(y > 0, b).cast("int")


# reports and aggregates


def reported(value: Column, y: Column, epsilon: float, draw: Column) -> Column:
    """The bit a user with ``value`` reports for ``y``."""
    return (draw < F.when(value == y, F.lit(KEEP_RATE)).otherwise(F.lit(flip_rate(epsilon)))).cast("int")


def reports(values: DataFrame, domain: Column, epsilon: float, seed: int, tag: str, keys: list[str], value: str = "value") -> DataFrame:
    """*keys, value, y, bit for each y in 0..domain-1. ``keys`` tell reports apart (uid, and node if there is one)."""
    wide = values.select(*keys, value, F.explode(F.sequence(F.lit(0).cast("bigint"), (domain - 1).cast("bigint"))).alias("y"))
    return wide.withColumn("bit", reported(F.col(value), F.col("y"), epsilon, uniform(seed, tag, *keys, "y")))


def debiased(ones: Column, n: Column, epsilon: float) -> Column:
    q = flip_rate(epsilon)
    return (ones - n * q) / (KEEP_RATE - q)


def aggregate(bits: DataFrame, epsilon: float, by: list[str], y: list[str] | None = None) -> DataFrame:
    """*by, *y, ones, n, est_count, est_freq."""
    y = y or ["y"]
    summed = bits.groupBy(*by, *y).agg(F.sum("bit").alias("ones"), F.count("*").alias("n"))
    count = debiased(F.col("ones"), F.col("n"), epsilon)
    return summed.withColumn("est_count", count).withColumn("est_freq", count / F.col("n"))


def aggregate_grid(wide: DataFrame, hit: Column, draw: Column, epsilons: Sequence[float], by: list[str], y: list[str] | None = None) -> DataFrame:
    """epsilon, *by, *y, ones, n, est_count, est_freq: ``aggregate`` at each report epsilon, each bit's draw made once.

    ``wide``: *by, *y, a row a bit; ``hit``: whether it is the true one. A draw is the same at every epsilon; only the
    rate it is held against is not.
    """
    y = y or ["y"]
    drawn = wide.select(*by, *y, hit.alias("__hit"), draw.alias("__u"))
    ones = [F.count_if(F.col("__u") < F.when(F.col("__hit"), F.lit(KEEP_RATE)).otherwise(F.lit(flip_rate(e)))).alias(f"__{i}") for i, e in enumerate(epsilons)]
    summed = drawn.groupBy(*by, *y).agg(F.count("*").alias("n"), *ones)
    each = F.explode(F.array(*[F.struct(F.lit(float(e)).alias("epsilon"), F.lit(flip_rate(e)).alias("q"), F.col(f"__{i}").alias("ones")) for i, e in enumerate(epsilons)]))
    rows = summed.select(*by, *y, "n", each.alias("__e")).select("__e.*", *by, *y, "n")
    count = (F.col("ones") - F.col("n") * F.col("q")) / (F.lit(KEEP_RATE) - F.col("q"))
    return rows.withColumn("est_count", count).withColumn("est_freq", count / F.col("n")).drop("q")


def simulated_aggregate(true_counts: DataFrame, epsilon: float, seed: int, tag: str, by: list[str]) -> DataFrame:
    """The same columns drawn directly: ones ~ Binomial(t, 1/2) + Binomial(n - t, q). ``true_counts``: *by, y, t, n.

    For domains where users x domain reports are too many; bits of different users and elements are
    independent, so the distribution is that of ``aggregate``. Draws are seeded by row key.
    """
    q = flip_rate(epsilon)
    keyed = true_counts.withColumn("key", F.xxhash64(F.lit(f"{seed}|{tag}"), *by, "y"))

    @F.arrow_udf("bigint")
    def drawn(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for t, n, key in batches:
            out = []
            for a, b, k in zip(t.to_pylist(), n.to_pylist(), key.to_pylist()):
                rng = np.random.default_rng(k & (2**63 - 1))
                out.append(int(rng.binomial(a, KEEP_RATE) + rng.binomial(b - a, q)))
            yield pa.array(out, pa.int64())

    summed = keyed.withColumn("ones", drawn("t", "n", "key")).drop("key", "t")
    count = debiased(F.col("ones"), F.col("n"), epsilon)
    return summed.withColumn("est_count", count).withColumn("est_freq", count / F.col("n"))


def drawn_aggregate(values: DataFrame, cells: DataFrame, epsilon: float, seed: int, tag: str, by: list[str]) -> DataFrame:
    """``simulated_aggregate`` of the true ``values`` (*by, value) over all ``cells`` (*by, y): a row a cell, no user x cell.

    Written once: what is made of it reads the rows more than once.
    """
    true = values.groupBy(*by, F.col("value").cast("bigint").alias("y")).agg(F.count("*").alias("t"))
    total = values.groupBy(*by).agg(F.count("*").alias("n"))  # a row a node
    rows = cells.select(*by, F.col("y").cast("bigint").alias("y")).join(true, [*by, "y"], "left").withColumn("t", F.coalesce("t", F.lit(0)))
    rows = rows.join(F.broadcast(total), by) if by else rows.join(F.broadcast(total))
    return Scratch(values.sparkSession, "drawn").save(simulated_aggregate(rows, epsilon, seed, tag, by), tag)


#: Cells of a run; a task expands a run at a time.
RUN = 2**22


def cell_runs(values: DataFrame, domains: DataFrame, seed: int, tag: str, by: list[str]) -> DataFrame:
    """*by, run, first, cells, n, key, held (array of y, t, key): the cells 0..cells-1 of each group of ``domains``
    (*by, cells) in runs of consecutive numbers, with the cells that any of the true ``values`` (*by, value) is in.

    For domains of too many cells to write down: a row a run and an entry a value seen. Written once.
    """
    name = f"{seed}|{tag}"
    true = values.groupBy(*by, F.col("value").cast("bigint").alias("y")).agg(F.count("*").alias("t"))
    keyed = true.withColumn("run", F.floor(F.col("y") / RUN)).withColumn("key", F.xxhash64(F.lit(name), *by, "y"))
    held = keyed.groupBy(*by, "run").agg(F.sort_array(F.collect_list(F.struct("y", "t", "key"))).alias("held"))
    total = values.groupBy(*by).agg(F.count("*").alias("n"))  # a row a node
    runs = domains.join(F.broadcast(total), by).withColumn("run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("cells") - 1) / RUN))))
    first = F.col("run") * RUN
    runs = runs.select(*by, "run", first.alias("first"), F.least(F.lit(RUN), F.col("cells") - first).alias("cells"), "n", F.xxhash64(F.lit(f"{name}|run"), *by, "run").alias("key"))
    empty = F.array().cast("array<struct<y:bigint,t:bigint,key:bigint>>")
    return Scratch(values.sparkSession, "runs").save(runs.join(held, [*by, "run"], "left").withColumn("held", F.coalesce("held", empty)), tag)


def _run_draws(epsilon: float, expand: bool):
    """A function of batches of ``cell_runs``: node_id, ones, n, cells by run, or (``expand``) node_id, y, ones.

    Cells with users are drawn one by one, as by ``simulated_aggregate``. All others have the one law Binomial(n, q):
    how many of a run's cells get each value is drawn from the multinomial law, and the values are dealt to the
    cells by a random permutation. That is the law of independent draws, and both forms agree cell for cell.
    """
    keep, q, step = KEEP_RATE, flip_rate(epsilon), 2**16

    def law(n: int) -> tuple[list[int], list[float]]:
        """The values in falling order of probability, and each one's probability once those before are ruled out."""
        steps = np.log(np.arange(n, 0, -1.0)) - np.log(np.arange(1.0, n + 1)) + np.log(q) - np.log1p(-q)
        p = np.exp(n * np.log1p(-q) + np.concatenate([[0.0], np.cumsum(steps)]))
        order = np.argsort(-p, kind="stable")
        order = order[p[order] > 1e-30]  # rarer than a double tells from 0 beside the others
        rest = np.cumsum(p[order][::-1])[::-1]
        return order.tolist(), np.minimum(p[order] / rest, 1.0).tolist()

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        laws: dict[int, tuple[list[int], list[float]]] = {}
        for row in (r for batch in batches for r in batch.to_pylist()):
            n, counts = row["n"], {}
            if n not in laws:
                laws[n] = law(n)
            values, shares = laws[n]
            rng, left = np.random.default_rng(row["key"] & (2**63 - 1)), row["cells"] - len(row["held"])
            for value, share in zip(values, shares):
                if not left:
                    break
                counts[value] = int(rng.binomial(left, share))
                left -= counts[value]
            held = []
            for one in row["held"]:
                own = np.random.default_rng(one["key"] & (2**63 - 1))
                held.append(int(own.binomial(one["t"], keep) + own.binomial(n - one["t"], q)))
            if not expand:
                for value in held:
                    counts[value] = counts.get(value, 0) + 1
                found = [(value, c) for value, c in counts.items() if c]
                yield pa.RecordBatch.from_pydict({
                    "node_id": pa.array([row["node_id"]] * len(found), pa.int32()), "ones": pa.array([v for v, _ in found], pa.int64()),
                    "n": pa.array([n] * len(found), pa.int64()), "cells": pa.array([c for _, c in found], pa.int64()),
                })
                continue
            ones, at = np.empty(row["cells"], np.int64), np.array([one["y"] - row["first"] for one in row["held"]], np.int64)
            free = np.ones(row["cells"], bool)
            free[at] = False
            ones[at] = held
            ones[free] = rng.permutation(np.repeat(np.array(list(counts), np.int64), list(counts.values())))
            for i in range(0, len(ones), step):
                part = ones[i : i + step]
                yield pa.RecordBatch.from_pydict({
                    "node_id": pa.array(np.full(len(part), row["node_id"], np.int32)), "y": pa.array(np.arange(i, i + len(part), dtype=np.int64) + row["first"]), "ones": pa.array(part),
                })

    return drawn


def _dealt(runs: DataFrame) -> DataFrame:
    """The runs over all tasks, however few bytes they are."""
    return runs.repartition(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")


def run_histogram(runs: DataFrame, epsilon: float) -> DataFrame:
    """node_id, ones, n, cells, est_count, est_freq: how many of a node's cells have each estimate."""
    counted = _dealt(runs).mapInArrow(_run_draws(epsilon, False), "node_id int, ones bigint, n bigint, cells bigint")
    count = debiased(F.col("ones"), F.col("n"), epsilon)
    return counted.groupBy("node_id", "ones", "n").agg(F.sum("cells").alias("cells")).withColumn("est_count", count).withColumn("est_freq", count / F.col("n"))


def run_cells(runs: DataFrame, epsilon: float) -> DataFrame:
    """node_id, y, ones: a row for every cell."""
    return _dealt(runs).mapInArrow(_run_draws(epsilon, True), "node_id int, y bigint, ones bigint")


def smooth_histogram(estimates: DataFrame, column: str, total: Column, by: list[str], mode: str = "clip") -> DataFrame:
    """``smooth`` of estimates that stand for ``cells`` cells each: one that depends on the estimate alone."""
    group, value = Window.partitionBy(*by), F.col(column)
    if mode == "none":
        return estimates
    if mode == "clip":
        at_least = F.greatest(value, F.lit(0.0))
        whole = F.sum(at_least * F.col("cells")).over(group)
        return estimates.withColumn(column, F.when(whole > 0, at_least * total / whole).otherwise(F.lit(0.0)))
    if mode == "normsub":
        down = group.orderBy(F.desc(column))  # a row a value
        upto = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        shift = (F.sum(value * F.col("cells")).over(upto) - total) / F.sum("cells").over(upto)
        ranked = estimates.withColumn("__shift", shift).withColumn("__k", F.row_number().over(down))
        used = F.max(F.when(value > F.col("__shift"), F.struct(F.col("__k").alias("k"), F.col("__shift").alias("s")))).over(group)
        return ranked.withColumn("__used", used).withColumn(column, F.greatest(value - F.col("__used.s"), F.lit(0.0))).drop("__shift", "__k", "__used")
    raise ValueError(f"unknown smoothing {mode!r}")


def smooth(estimates: DataFrame, column: str, total: Column, by: list[str], mode: str = "clip") -> DataFrame:
    """Post-process an estimate in place: ``none``; ``clip`` at 0, then rescale to ``total``; ``normsub``: subtract
    the one constant that, after clipping, gives the total."""
    if mode == "none":
        return estimates
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    if mode == "clip":
        at_least = F.greatest(F.col(column), F.lit(0.0))
        whole = estimates.groupBy(*by).agg(F.sum(at_least).alias("__whole"))  # a row a group
        joined = estimates.join(F.broadcast(whole), by) if by else estimates.join(F.broadcast(whole))
        scaled = F.when(F.col("__whole") > 0, at_least * total / F.col("__whole")).otherwise(F.lit(0.0))
        return joined.select(*[scaled.alias(c) if c == column else F.col(c) for c in estimates.columns])
    if mode == "normsub":
        ordered = group.orderBy(F.desc(column)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        shift = (F.sum(column).over(ordered) - total) / F.row_number().over(group.orderBy(F.desc(column)))
        with_shift = estimates.withColumn("__shift", shift)
        used = F.max(F.when(F.col(column) > F.col("__shift"), F.struct(F.row_number().over(group.orderBy(F.desc(column))).alias("k"), F.col("__shift").alias("s")))).over(group)
        return with_shift.withColumn("__used", used).withColumn(column, F.greatest(F.col(column) - F.col("__used.s"), F.lit(0.0))).drop("__shift", "__used")
    raise ValueError(f"unknown smoothing {mode!r}")


# estimates of the private build


# With ``epsilons`` the estimates below come for each of these report epsilons, in a column ``epsilon``, from single
# reports whose bits are drawn once.


def noisy_histogram(pairs: DataFrame, cohort: DataFrame, domain: int, config: Config, epsilons: Sequence[float] | None = None) -> DataFrame:
    """item, noisy_count over the underlying users: one sampled item each, reported with the report's epsilon."""
    epsilon, seed = config.report_epsilon, config.seed
    under = pairs.join(cohort.where("role = 'underlying'").select("uid"), "uid", "left_semi")
    values = sample_item(under, seed).withColumnRenamed("item", "value")
    if epsilons is not None:
        wide = values.withColumn("y", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(domain - 1).cast("bigint"))))
        made = aggregate_grid(wide, F.col("value") == F.col("y"), uniform(seed, "item_bits", "uid", "y"), epsilons, [])
        return smooth(made, "est_count", F.col("n"), ["epsilon"], config.smooth).select("epsilon", F.col("y").cast("int").alias("item"), F.col("est_count").alias("noisy_count"), "n")
    if config.draws == "aggregate":
        made = drawn_aggregate(values, pairs.sparkSession.range(domain).withColumnRenamed("id", "y"), epsilon, seed, "item_drawn", [])
    else:
        made = aggregate(reports(values, F.lit(domain), epsilon, seed, "item_bits", ["uid"]), epsilon, [])
    return smooth(made, "est_count", F.col("n"), [], config.smooth).select(F.col("y").cast("int").alias("item"), F.col("est_count").alias("noisy_count"), "n")


def node_users(cohort: DataFrame, nodes: DataFrame) -> DataFrame:
    """node_id, uid, pos, block_size: the tree users whose block the node consumes."""
    return cohort.where("role = 'tree'").join(F.broadcast(nodes.select("node_id", "block_id")), "block_id").select("node_id", "uid", "pos", "block_size")


def in_node(pairs: DataFrame, users: DataFrame, node_items: DataFrame, config: Config | None = None) -> DataFrame:
    """node_id, uid, item, local_id: the users' items inside their node. Items of domains with drawn aggregates aren't broadcast."""
    named = node_items if config is not None and config.draws == "aggregate" else F.broadcast(node_items)
    return pairs.join(users.select("node_id", "uid"), "uid").join(named, ["node_id", "item"]).select("node_id", "uid", "item", "local_id")


def pair_values(pairs: DataFrame, users: DataFrame, node_items: DataFrame, sizes: DataFrame, config: Config) -> DataFrame:
    """node_id, uid, size, value: the number of the pair that each of a node's users draws, 0 for none."""
    sampled = sample_pair(in_node(pairs, users, node_items, config), config.seed, "pair_sample", ["node_id", "uid"], "local_id")
    everyone = users.select("node_id", "uid").join(sampled, ["node_id", "uid"], "left").join(F.broadcast(sizes), "node_id")
    return everyone.select("node_id", "uid", "size", pair_id(F.col("a"), F.col("b"), F.col("size")).alias("value"))


def pair_runs(pairs: DataFrame, users: DataFrame, node_items: DataFrame, sizes: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """(runs, histogram) of drawn pair estimates: ``cell_runs``, and node_id, ones, freq, cells, n with the smoothed frequency."""
    values = pair_values(pairs, users, node_items, sizes, config)
    domains = sizes.select("node_id", (_pairs_before(F.col("size") - 1, F.col("size")) + 1).alias("cells"))
    runs = cell_runs(values, domains, config.seed, "pair_drawn", ["node_id"])
    made = smooth_histogram(run_histogram(runs, config.report_epsilon), "est_freq", F.lit(1.0), ["node_id"], config.smooth)
    made = Scratch(pairs.sparkSession, "drawn").save(made, "pair_histogram")
    return runs, made.select("node_id", "ones", F.col("est_freq").alias("freq"), "cells", "n")


def pair_frequencies(pairs: DataFrame, users: DataFrame, node_items: DataFrame, sizes: DataFrame, config: Config, epsilons: Sequence[float] | None = None) -> DataFrame:
    """node_id, a, b (local ids, a < b; null: fewer than two items), freq: co-occurrence inside each node by OUE
    over 1 + K(K-1)/2 categories. Keys are the pairs themselves, found from their numbers without a table of pairs."""
    epsilon, seed, of = config.report_epsilon, config.seed, [] if epsilons is None else ["epsilon"]
    if config.draws == "aggregate" and epsilons is None:
        runs, made = pair_runs(pairs, users, node_items, sizes, config)
        made = run_cells(runs, epsilon).join(F.broadcast(made.select("node_id", "ones", F.col("freq").alias("est_freq"))), ["node_id", "ones"])
    else:
        values = pair_values(pairs, users, node_items, sizes, config)
        every_pair = F.sequence(F.lit(0).cast("bigint"), _pairs_before(F.col("size") - 1, F.col("size")))
        wide = values.select("node_id", "uid", "value", F.explode(every_pair).alias("y"))
        draw = uniform(seed, "pair_bits", "node_id", "uid", "y")
        if epsilons is None:
            made = aggregate(wide.withColumn("bit", reported(F.col("value"), F.col("y"), epsilon, draw)), epsilon, ["node_id"])
        else:
            made = aggregate_grid(wide, F.col("value") == F.col("y"), draw, epsilons, ["node_id"])
        made = smooth(made, "est_freq", F.lit(1.0), [*of, "node_id"], config.smooth)
    made = made.join(F.broadcast(sizes), "node_id")
    a, b = pair_of(F.col("y"), F.col("size"))
    return made.select(*of, "node_id", a.alias("a"), b.alias("b"), F.col("est_freq").alias("freq"))


def cross_node_frequencies(pairs: DataFrame, cohort: DataFrame, leaves: DataFrame, config: Config, epsilons: Sequence[float] | None = None) -> DataFrame:
    """node_i, node_j (i < j), freq > 0: two of the leaves each underlying user touches, reported over the square
    of leaves and "no pair" (index L). ``leaves``: node_id, item, leaf (dense from 0)."""
    of = [] if epsilons is None else ["epsilon"]
    estimates = leaf_pair_estimates(pairs, cohort, leaves, config, epsilons)
    made = smooth(estimates, "est_freq", F.lit(1.0), of, config.smooth)
    named = leaves.select("leaf", "node_id").distinct()
    one, two = (named.select(F.col("leaf").alias(k), F.col("node_id").alias(f"node_{k}")) for k in "ij")
    return made.where((F.col("i") < F.col("j")) & (F.col("est_freq") > 0)).join(F.broadcast(one), "i").join(F.broadcast(two), "j").select(*of, "node_i", "node_j", F.col("est_freq").alias("freq"))


def leaf_pair_estimates(pairs: DataFrame, cohort: DataFrame, leaves: DataFrame, config: Config, epsilons: Sequence[float] | None = None) -> DataFrame:
    """i, j, ones, n, est_count, est_freq over the square of 0..L."""
    epsilon, seed = config.report_epsilon, config.seed
    under = cohort.where("role = 'underlying'").select("uid")
    touched = pairs.join(under, "uid", "left_semi").join(F.broadcast(leaves), "item").select("uid", "leaf").distinct()
    drawn = sample_pair(touched, seed, "node_pair_sample", ["uid"], "leaf")
    count = leaves.select("leaf").distinct().agg(F.count("*").cast("int").alias("l"))
    everyone = under.join(drawn, "uid", "left").join(F.broadcast(count))
    values = everyone.select("uid", "l", F.coalesce("a", "l").alias("vi"), F.coalesce("b", "l").alias("vj"))
    every = F.explode(F.sequence(F.lit(0), F.col("l")))
    if config.draws == "aggregate" and epsilons is None:
        side = F.col("l") + 1
        cells = count.withColumn("y", F.explode(F.sequence(F.lit(0), side * side - 1)))
        made = drawn_aggregate(values.select((F.col("vi") * side + F.col("vj")).alias("value")), cells, epsilon, seed, "node_pair_drawn", []).join(F.broadcast(count))
        return made.withColumn("i", F.expr("y div (l + 1)").cast("int")).withColumn("j", F.expr("y % (l + 1)").cast("int")).drop("y", "l")
    grid = values.withColumn("i", every).withColumn("j", every)
    hit = (F.col("i") == F.col("vi")) & (F.col("j") == F.col("vj"))
    draw = uniform(seed, "node_pair_bits", "uid", "i", "j")
    if epsilons is not None:
        return aggregate_grid(grid, hit, draw, epsilons, [], ["i", "j"])
    bits = grid.withColumn("bit", (draw < F.when(hit, F.lit(KEEP_RATE)).otherwise(F.lit(flip_rate(epsilon)))).cast("int"))
    return aggregate(bits, epsilon, [], ["i", "j"])


def intersection_histogram(pairs: DataFrame, users: DataFrame, node_items: DataFrame, sizes: DataFrame, config: Config, epsilons: Sequence[float] | None = None) -> DataFrame:
    """node_id, k (0..K), freq: how many of the node's items users hold, by direct OUE over the counts; clipped at 0
    and normalised. ``users`` are the node's first half."""
    epsilon, seed = config.report_epsilon, config.seed
    held = in_node(pairs, users, node_items, config).groupBy("node_id", "uid").agg(F.count("*").alias("k"))
    values = users.select("node_id", "uid").join(held, ["node_id", "uid"], "left").join(F.broadcast(sizes), "node_id")
    values = values.select("node_id", "uid", "size", F.coalesce("k", F.lit(0)).alias("value"))
    of = [] if epsilons is None else ["epsilon"]
    if epsilons is not None:
        wide = values.withColumn("y", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size").cast("bigint"))))
        made = aggregate_grid(wide, F.col("value") == F.col("y"), uniform(seed, "size_bits", "node_id", "uid", "y"), epsilons, ["node_id"])
    elif config.draws == "aggregate":
        made = drawn_aggregate(values, sizes.select("node_id", F.explode(F.sequence(F.lit(0), F.col("size"))).alias("y")), epsilon, seed, "size_drawn", ["node_id"])
    else:
        bits = reports(values.withColumn("__d", F.col("size") + 1), F.col("__d"), epsilon, seed, "size_bits", ["node_id", "uid"])
        made = aggregate(bits, epsilon, ["node_id"])
    return smooth(made, "est_freq", F.lit(1.0), [*of, "node_id"], "clip").select(*of, "node_id", F.col("y").cast("int").alias("k"), F.col("est_freq").alias("freq"), "n")


def first_half(users: DataFrame, share: float = 0.5) -> DataFrame:
    return users.where(F.col("pos") <= F.rint(F.col("block_size") * share))


def second_half(users: DataFrame, share: float = 0.5) -> DataFrame:
    return users.where(F.col("pos") > F.rint(F.col("block_size") * share))
