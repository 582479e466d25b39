"""Growing the item partition: split proposals, their error model, level-by-level growth, and static trees.

Node tables hold a row per node (a few hundred at most); everything about users stays distributed and is
computed for all nodes of a level at once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.prng import digest, uniform
from ..storage import Scratch
from . import minhash, oue, tails

TINY = 1e-12


# static trees


@dataclass(frozen=True)
class Node:
    node_id: int
    parent_id: int | None
    depth: int
    lo: int
    hi: int  # items [lo, hi) of the item order


def static_tree(items: int, fanout: int = 2, smallest: int = 50) -> list[Node]:
    """Contiguous chunks of ceil(n / fanout) items, while a node has more than 2 and at least ``smallest``; breadth first."""
    nodes = [Node(0, None, 0, 0, items)]
    at = 0
    while at < len(nodes):
        node = nodes[at]
        n = node.hi - node.lo
        if n > 2 and n >= smallest and n // fanout >= 1:
            step = math.ceil(n / fanout)
            for lo in range(node.lo, node.hi, step):
                nodes.append(Node(len(nodes), node.node_id, node.depth + 1, lo, min(lo + step, node.hi)))
        at += 1
    return nodes


def static_tables(spark: SparkSession, nodes: list[Node], items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, node_items): items are dealt to the ranges by their number; node i consumes block i."""
    parents = {n.parent_id for n in nodes}
    rows = [(n.node_id, n.parent_id, n.depth, n.node_id, n.hi - n.lo, n.node_id not in parents, n.lo, n.hi) for n in nodes]
    table = spark.createDataFrame(rows, "node_id int, parent_id int, depth int, block_id int, size int, is_leaf boolean, lo int, hi int")
    ranged = items.join(F.broadcast(table.select("node_id", "lo", "hi")), (F.col("item") >= F.col("lo")) & (F.col("item") < F.col("hi")))
    return table.drop("lo", "hi"), minhash.local_domain(ranged.select("node_id", "item"))


def guarded(nodes: DataFrame, fanout: int) -> DataFrame:
    """The nodes with ``starts``: where groups of size div fanout items begin, from 1. Fails on a node of fewer items than ``fanout``."""
    step = F.expr(f"size div {int(fanout)}")
    enough = F.assert_true(step >= 1, F.lit("a node needs at least fanout items"))
    last = F.greatest(F.col("size") - 1, F.lit(1)).cast("bigint")
    starts = F.when(enough.isNull(), F.when(F.col("size") > 1, F.sequence(F.lit(1).cast("bigint"), last, step)).otherwise(F.array().cast("array<bigint>")))
    return nodes.withColumn("starts", starts)


def uniform_allocation(nodes: list[Node], users: int) -> dict[int, tuple[int, int]]:
    """node -> (allocated, left for its children): each node takes 1 / (levels below and with it) of what its parent left."""
    height = {n.node_id: 1 for n in nodes}
    for n in reversed(nodes):
        if n.parent_id is not None:
            height[n.parent_id] = max(height[n.parent_id], height[n.node_id] + 1)
    out: dict[int, tuple[int, int]] = {}
    for n in nodes:
        given = users if n.parent_id is None else out[n.parent_id][1]
        own = int(given / height[n.node_id])
        out[n.node_id] = (own, given - own)
    return out


def breadth_first(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("position", F.row_number().over(Window.orderBy("depth", "node_id")))


def spread_blocks(nodes: DataFrame, blocks: int) -> DataFrame:
    """node_id, block_id: blocks no node consumed, dealt round-robin to the leaves in node order."""
    leaves = nodes.where("is_leaf").select("node_id", (F.row_number().over(Window.orderBy("node_id")) - 1).alias("i"))
    used = nodes.select("block_id")
    spare = nodes.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block_id")).join(used, "block_id", "left_anti")
    spare = spare.select("block_id", (F.row_number().over(Window.orderBy("block_id")) - 1).alias("n"))
    counted = leaves.agg(F.count("*").alias("leaves"))
    return spare.join(F.broadcast(counted)).withColumn("i", F.expr("n % leaves").cast("int")).join(F.broadcast(leaves), "i").select("node_id", "block_id")


def merged_histograms(hists: DataFrame) -> DataFrame:
    """node_id, k, freq, n: several histograms of a node, weighted by their users; a missing bin counts as 0.

    ``hists``: node_id, part, k, freq, n.
    """
    totals = hists.select("node_id", "part", "n").distinct().groupBy("node_id").agg(F.sum("n").alias("total"))
    summed = hists.groupBy("node_id", "k").agg(F.sum(F.col("freq") * F.col("n")).alias("s"))
    return summed.join(F.broadcast(totals), "node_id").select("node_id", "k", (F.col("s") / F.col("total")).alias("freq"), F.col("total").alias("n"))


# order of items


def pair_lifts(pair_freq: DataFrame, node_p: DataFrame, sizes: DataFrame, most: int = 1000) -> DataFrame:
    """node_id, a, b, lift, rank (from 1, ascending by lift, a, b) of nodes with 2 to ``most`` items."""
    p = node_p.select("node_id", "local_id", "p")
    one, two = (p.select("node_id", F.col("local_id").alias(k), F.col("p").alias(f"p_{k}")) for k in "ab")
    usable = sizes.where((F.col("size") >= 2) & (F.col("size") <= most)).select("node_id")
    rows = pair_freq.where("a is not null").join(F.broadcast(usable), "node_id").join(F.broadcast(one), ["node_id", "a"]).join(F.broadcast(two), ["node_id", "b"])
    lift = F.greatest(F.col("freq"), F.lit(0.0)) / F.greatest(F.col("p_a") * F.col("p_b"), F.lit(TINY))
    ranked = rows.select("node_id", "a", "b", lift.alias("lift"))
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("node_id").orderBy(F.round("lift", 6), "a", "b")))


def order_from_lifts(lifts: DataFrame) -> DataFrame:
    """node_id, item (local), score, position: each pair gives both ends (pairs - rank) points; most points first."""
    count = F.count("*").over(Window.partitionBy("node_id"))
    points = lifts.withColumn("points", count - (F.col("rank") - 1)).select("node_id", F.explode(F.array("a", "b")).alias("local_id"), "points")
    scored = points.groupBy("node_id", "local_id").agg(F.sum("points").alias("score"))
    return scored.withColumn("position", F.row_number().over(Window.partitionBy("node_id").orderBy(F.desc("score"), "local_id")))


# split proposals


def pmi_weights(pair_freq: DataFrame, node_p: DataFrame) -> DataFrame:
    """node_id, a, b, w = |ln(max(f_ab, tiny) / max(p_a p_b, tiny))|, local ids a < b. Unseen pairs weigh a lot."""
    p = node_p.select("node_id", "local_id", "p")
    one, two = (p.select("node_id", F.col("local_id").alias(k), F.col("p").alias(f"p_{k}")) for k in "ab")
    rows = pair_freq.where("a is not null").join(F.broadcast(one), ["node_id", "a"]).join(F.broadcast(two), ["node_id", "b"])
    w = F.abs(F.log(F.greatest(F.col("freq"), F.lit(TINY)) / F.greatest(F.col("p_a") * F.col("p_b"), F.lit(TINY))))
    return rows.select("node_id", "a", "b", w.alias("w"))


def strengths(weights: DataFrame) -> DataFrame:
    """node_id, local_id, s: an item's weights summed; ``is_start``: the strongest, the first of equals."""
    ends = weights.select("node_id", F.explode(F.array("a", "b")).alias("local_id"), "w")
    summed = ends.groupBy("node_id", "local_id").agg(F.sum("w").alias("s"))
    first = F.row_number().over(Window.partitionBy("node_id").orderBy(F.desc(F.round("s", 6)), "local_id"))
    return summed.withColumn("is_start", first == 1)


def chain_order(weights: np.ndarray) -> list[int]:
    """Greedy chain over a symmetric matrix: from the strongest item to the unvisited neighbour of largest weight; to
    the strongest unvisited item where no weight is positive. First index on ties."""
    n = len(weights)
    strength = weights.sum(axis=1)
    left = np.ones(n, bool)
    at = int(np.argmax(strength))
    order = [at]
    left[at] = False
    for _ in range(n - 1):
        row = np.where(left, weights[at], -np.inf)
        best = int(np.argmax(row))
        if row[best] <= 0:
            best = int(np.argmax(np.where(left, strength, -np.inf)))
        order.append(best)
        left[best] = False
        at = best
    return order


def chains(weights: DataFrame, sizes: DataFrame) -> DataFrame:
    """node_id, local_id, position (from 0). The chain is sequential, so a node is one group: its K x K weights,
    bounded by the item domain."""

    def one_node(frame: pd.DataFrame) -> pd.DataFrame:
        n = int(frame["size"].iloc[0])
        matrix = np.zeros((n, n))
        known = frame.dropna(subset=["a"])
        a, b = known["a"].to_numpy(int), known["b"].to_numpy(int)
        matrix[a, b] = matrix[b, a] = known["w"].to_numpy(float)
        order = chain_order(np.round(matrix, 9))
        return pd.DataFrame({"node_id": frame["node_id"].iloc[0], "local_id": order, "position": range(n)})

    rows = sizes.select("node_id", "size").join(weights, "node_id", "left")
    return rows.groupBy("node_id").applyInPandas(one_node, "node_id int, local_id int, position int")


def cut_signatures(chain: DataFrame, config: Config, least_rank: bool = True) -> DataFrame:
    """node_id, b, side (A: positions under b, B: the rest), ell, target: signatures of every prefix and suffix by
    running minima. ``least_rank=False`` takes the smallest local id instead of the least rank (all hashes alike)."""
    key = minhash.rank_of(config.seed, "ell", "local_id") if least_rank else F.lpad(F.col("local_id").cast("string"), 10, "0")
    wide = chain.withColumn("ell", F.explode(F.sequence(F.lit(0), F.lit(config.hashes - 1)))).withColumn("m", F.struct(key.alias("r"), "local_id"))
    forward = Window.partitionBy("node_id", "ell").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    backward = Window.partitionBy("node_id", "ell").orderBy(F.desc("position")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prefix = wide.select("node_id", (F.col("position") + 1).alias("b"), F.lit("A").alias("side"), "ell", F.min("m").over(forward)["local_id"].alias("target"))
    suffix = wide.select("node_id", F.col("position").alias("b"), F.lit("B").alias("side"), "ell", F.min("m").over(backward)["local_id"].alias("target"))
    return prefix.unionByName(suffix)


def empty_shares(winners: DataFrame, signatures: DataFrame, sizes: DataFrame, config: Config) -> DataFrame:
    """node_id, b, side, p0: share of reporting users whose similarity to the side rounds to no item."""
    near = minhash.similarities(winners, signatures, config, ["node_id", "b", "side"]).join(F.broadcast(sizes), "node_id")
    count = F.when(F.col("side") == "A", F.col("b")).otherwise(F.col("size") - F.col("b"))
    return near.groupBy("node_id", "b", "side").agg(F.avg((F.rint(F.col("j") * count) <= 0).cast("double")).alias("p0"))


def mutual_information(p0a: Column, p0b: Column, p00: Column) -> Column:
    """Of the 2 x 2 table "side A empty" x "side B empty"; cells are clipped and renormalised, margins kept; terms
    with a vanishing factor are skipped."""
    p01, p10 = F.greatest(F.lit(0.0), p0a - p00), F.greatest(F.lit(0.0), p0b - p00)
    p11 = F.greatest(F.lit(0.0), 1 - p00 - p01 - p10)
    whole = p00 + p01 + p10 + p11
    total = F.lit(0.0)
    for joint, x, y in ((p00, p0a, p0b), (p01, p0a, 1 - p0b), (p10, 1 - p0a, p0b), (p11, 1 - p0a, 1 - p0b)):
        cell = joint / whole
        total = total + F.when((cell > TINY) & (x > TINY) & (y > TINY), cell * F.log(cell / (x * y))).otherwise(F.lit(0.0))
    return total


def cuts(shares: DataFrame, hist: DataFrame, sizes: DataFrame, config: Config) -> DataFrame:
    """node_id, b, mi: the cut of least mutual information with both sides of ``min_child`` items at least; the first of equals.

    ``hist``: the node's MinHash histogram; its bin 0 is the share of users empty on both sides.
    """
    pivoted = shares.groupBy("node_id", "b").agg(F.max(F.when(F.col("side") == "A", F.col("p0"))).alias("p0a"), F.max(F.when(F.col("side") == "B", F.col("p0"))).alias("p0b"))
    zero = hist.where("k = 0").select("node_id", F.col("freq").alias("p00"))
    rows = pivoted.join(F.broadcast(sizes), "node_id").join(F.broadcast(zero), "node_id", "left").where((F.col("b") >= config.min_child) & (F.col("b") <= F.col("size") - config.min_child))
    mi = F.round(mutual_information(F.col("p0a"), F.col("p0b"), F.coalesce("p00", F.lit(0.0))), 9)
    return rows.withColumn("mi", mi).groupBy("node_id").agg(F.min(F.struct("mi", "b")).alias("m")).select("node_id", "m.b", "m.mi")


def random_cuts(node_items: DataFrame, sizes: DataFrame, config: Config) -> DataFrame:
    """node_id, item, side: items in hash order, cut at a uniform place that leaves ``min_child`` on both sides."""
    order = F.row_number().over(Window.partitionBy("node_id").orderBy(digest(config.seed, "random_split", "node_id", "item")))
    room = F.col("size") - 2 * config.min_child + 1
    at = config.min_child + F.floor(uniform(config.seed, "random_cut", "node_id") * room)
    rows = node_items.select("node_id", "item").withColumn("rn", order).join(F.broadcast(sizes), "node_id").where(room > 1)  # a node of twice the least size has no choice and stays
    return rows.select("node_id", "item", F.when(F.col("rn") <= at, "A").otherwise("B").alias("side"))


def split_samples(node_items: DataFrame, sizes: DataFrame, config: Config) -> DataFrame:
    """node_id, sample, threshold, item: random queries over a node's items. c items (3 to min(size, 500)), threshold 2
    where c is 3, else 2 to c - 1. Nodes of fewer than 3 items have none."""
    drawn = sizes.where("size >= 3").withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(config.samples - 1))))
    top = F.least("size", F.lit(500))
    drawn = drawn.withColumn("c", (3 + F.floor(uniform(config.seed, "split_size", "node_id", "sample") * (top - 2))).cast("int"))
    t = F.when(F.col("c") == 3, F.lit(2)).otherwise((2 + F.floor(uniform(config.seed, "split_threshold", "node_id", "sample") * (F.col("c") - 2))).cast("int"))
    drawn = drawn.withColumn("threshold", t)
    order = F.row_number().over(Window.partitionBy("node_id", "sample").orderBy(digest(config.seed, "split_items", "node_id", "sample", "item")))
    rows = node_items.select("node_id", "item").join(F.broadcast(drawn.select("node_id", "sample", "c", "threshold")), "node_id").withColumn("rn", order)
    return rows.where(F.col("rn") <= F.col("c")).select("node_id", "sample", "threshold", "item")


def split_errors(samples: DataFrame, sides: DataFrame, probabilities: DataFrame, pair_items: DataFrame, groups: int, users: int, config: Config) -> DataFrame:
    """node_id, err_no, err_split: mean error of the sampled queries without and with the split.

    ``sides``: node_id, item, side; ``pair_items``: node_id, item_a, item_b, freq; ``groups``: nodes that share the users.
    """
    keys = ["node_id", "sample"]
    pairs = pair_items.join(F.broadcast(samples.select(*keys).distinct()), "node_id")
    whole = tails.pair_tail(samples, probabilities, pairs, keys).select(*keys, F.col("tail").alias("pt"))
    parent = tails.independent_tail(samples, probabilities, keys).select(*keys, F.pow("tail", 2).alias("own"))
    part = samples.join(F.broadcast(sides), ["node_id", "item"])
    counted = part.withColumn("threshold", F.least("threshold", F.count("*").over(Window.partitionBy(*keys, "side")).cast("int")))
    child = tails.independent_tail(counted, probabilities, [*keys, "side"]).groupBy(*keys).agg(F.avg(F.pow("tail", 2)).alias("children"))
    rows = whole.join(parent, keys).join(child, keys)
    error = lambda g: tails.sampling_mse(tails.clip01(F.col("pt")), F.lit(float(g)), F.lit(float(users)), config.hash_epsilon)
    return rows.groupBy("node_id").agg(F.avg(error(groups) + F.col("own")).alias("err_no"), F.avg(error(groups + 1) + F.col("children")).alias("err_split"))


# growth


@dataclass
class Build:
    """What a private build leaves behind; node tables are small, all made of reports."""

    config: Config
    users: int
    underlying: int
    hist: DataFrame  # item, noisy_count, n
    nodes: DataFrame  # node_id, parent_id, depth, block_id, size, is_leaf
    node_items: DataFrame  # node_id, item, local_id
    sizes: DataFrame  # node_id, size
    pair_freq: DataFrame  # node_id, a, b, freq (local ids)
    oue_hist: DataFrame  # node_id, k, freq, n
    minhash_hist: DataFrame  # node_id, k, freq, n
    winners: DataFrame  # node_id, uid, ell, winner
    bins: DataFrame  # node_id, uid, j, k
    cross: DataFrame  # node_i, node_j, freq


def node_probabilities(node_items: DataFrame, probabilities: DataFrame) -> DataFrame:
    return node_items.join(F.broadcast(probabilities), "item", "left").withColumn("p", F.coalesce("p", F.lit(0.0)))


def estimate_nodes(pairs: DataFrame, cohort: DataFrame, nodes: DataFrame, node_items: DataFrame, config: Config) -> dict[str, DataFrame]:
    """All estimates of the given nodes: pairs from the whole block, sizes from its first half, MinHash from the second."""
    sizes = minhash.node_sizes(node_items)
    users = oue.node_users(cohort, nodes)
    second = oue.second_half(users, config.dual_split)
    winners = minhash.node_signatures(pairs, second, node_items, config)
    full = minhash.set_signatures(node_items, ["node_id"], config)
    bins = minhash.user_bins(winners, full, sizes, config)
    return {
        "sizes": sizes,
        "pair_freq": oue.pair_frequencies(pairs, users, node_items, sizes, config),
        "oue_hist": oue.intersection_histogram(pairs, oue.first_half(users, config.dual_split), node_items, sizes, config),
        "winners": winners,
        "bins": bins,
        "minhash_hist": minhash.bin_histogram(bins),
    }


def proposals(estimates: dict[str, DataFrame], node_items: DataFrame, probabilities: DataFrame, config: Config) -> DataFrame:
    """node_id, item, side of the proposed split of each node that has room for two children."""
    node_p = node_probabilities(node_items, probabilities)
    chain = chains(pmi_weights(estimates["pair_freq"], node_p), estimates["sizes"])
    shares = empty_shares(estimates["winners"], cut_signatures(chain, config), estimates["sizes"], config)
    best = cuts(shares, estimates["minhash_hist"], estimates["sizes"], config)
    placed = chain.join(F.broadcast(best.select("node_id", "b")), "node_id").join(F.broadcast(node_items), ["node_id", "local_id"])
    return placed.select("node_id", "item", F.when(F.col("position") < F.col("b"), "A").otherwise("B").alias("side"))


def grow(pairs: DataFrame, items: DataFrame, config: Config) -> Build:
    """Build the partition, a level at a time.

    A node is split if its proposal's error isn't larger than its own and it is above ``max_depth``; it needs
    a block of users, and nodes that would get none are not made. Small tables (a row per node or item) come
    to the driver once a level; tables of users and of pairs of items stay in the cluster, written once.
    """
    spark = pairs.sparkSession
    domain = items.count()
    users = pairs.select("uid").distinct()
    scratch = Scratch(spark, "growth")
    pairs = scratch.save(pairs, "pairs")
    cohort = scratch.save(oue.cohorts(users, config.alpha, config.blocks, config.seed), "cohort")
    total = cohort.count()
    underlying = math.floor(total * config.alpha)
    hist = oue.noisy_histogram(pairs, cohort, domain, config)
    hist = spark.createDataFrame(hist.toPandas())  # a row per item
    probabilities = tails.item_probabilities(hist)

    node_schema = "node_id int, parent_id int, depth int, block_id int, size int, is_leaf boolean"
    item_schema = "node_id int, item int, local_id int"
    known = sorted(r["item"] for r in items.select("item").collect())
    nodes: list[list] = [[0, None, 0, 0, len(known), True]]
    members: dict[int, list[int]] = {0: known}
    level, pair_rows = [0], []
    while level:
        level_nodes = spark.createDataFrame([nodes[n] for n in level], node_schema)
        level_items = spark.createDataFrame([(n, x, i) for n in level for i, x in enumerate(members[n])], item_schema)
        depth = nodes[level[0]][2]
        estimates = estimate_nodes(pairs, cohort, level_nodes, level_items, config)
        # a row for each pair of a node's items: they stay in the cluster
        estimates["pair_freq"] = scratch.save(estimates["pair_freq"], "pairs")
        pair_rows.append(estimates["pair_freq"])
        wide = [n for n in level if len(members[n]) >= 2 * config.min_child]
        following: list[int] = []
        if depth < config.max_depth and wide and len(nodes) < config.blocks:
            proposed = spark.createDataFrame(proposals(estimates, level_items, probabilities, config).toPandas(), "node_id int, item int, side string")
            samples = split_samples(level_items, estimates["sizes"], config)
            local = level_items.select("node_id", "item", "local_id")
            one, two = (local.select("node_id", F.col("item").alias(f"item_{k}"), F.col("local_id").alias(k)) for k in "ab")
            pair_items = estimates["pair_freq"].where("a is not null").join(F.broadcast(one), ["node_id", "a"]).join(F.broadcast(two), ["node_id", "b"])
            errors = split_errors(samples, proposed, probabilities, pair_items, max(1, len(nodes) - 1), total, config)
            better = {r["node_id"] for r in errors.collect() if r["err_split"] <= r["err_no"]}
            sides: dict[tuple[int, str], list[int]] = {}
            for r in proposed.collect():
                sides.setdefault((r["node_id"], r["side"]), []).append(r["item"])
            for n in level:
                if n in better and (n, "A") in sides and len(nodes) + 2 <= config.blocks:
                    nodes[n][5] = False
                    for side in "AB":
                        made = len(nodes)
                        nodes.append([made, n, depth + 1, made, len(sides[n, side]), True])
                        members[made] = sorted(sides[n, side])
                        following.append(made)
        level = following
    node_table = spark.createDataFrame(nodes, node_schema)
    item_table = spark.createDataFrame([(n, x, i) for n, m in members.items() for i, x in enumerate(m)], item_schema)
    estimates = estimate_nodes(pairs, cohort, node_table, item_table, config)
    pair_freq = pair_rows[0]
    for more in pair_rows[1:]:
        pair_freq = pair_freq.unionByName(more)
    leaf = F.row_number().over(Window.orderBy("node_id")) - 1
    leaves = item_table.join(F.broadcast(node_table.where("is_leaf").select("node_id", leaf.alias("leaf"))), "node_id").select("node_id", "item", "leaf")
    return Build(
        config, total, underlying, hist, node_table, item_table, estimates["sizes"], pair_freq,
        spark.createDataFrame(estimates["oue_hist"].toPandas()), spark.createDataFrame(estimates["minhash_hist"].toPandas()),
        scratch.save(estimates["winners"], "winners"), scratch.save(estimates["bins"], "bins"),
        scratch.save(oue.cross_node_frequencies(pairs, cohort, leaves, config), "cross"),
    )
