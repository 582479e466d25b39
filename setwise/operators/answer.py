"""Answering a batch of queries from a build: node selection, full and partial components, their combination."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mathx import clip01
from ..storage import Scratch
from . import minhash, tails
from .tree import Build

INFINITE = float("inf")


def ancestors(nodes: DataFrame, depth: int) -> DataFrame:
    """node_id, ancestor_id for every proper ancestor: ``depth`` joins of a table with a row per node."""
    step = nodes.where("parent_id is not null").select("node_id", F.col("parent_id").alias("ancestor_id"))
    up = step.select(F.col("node_id").alias("ancestor_id"), F.col("ancestor_id").alias("above"))
    out, last = step, step
    for _ in range(depth - 1):
        last = last.join(F.broadcast(up), "ancestor_id").select("node_id", F.col("above").alias("ancestor_id"))
        out = out.unionByName(last)
    return out


def query_nodes(queries: DataFrame, node_items: DataFrame, nodes: DataFrame) -> DataFrame:
    """qid, node_id, threshold, asked (query size), r (items of the query in the node), depth, size."""
    asked = queries.select("qid", "threshold", F.size(F.array_distinct("items")).alias("asked"), F.explode(F.array_distinct("items")).alias("item"))
    joined = asked.join(F.broadcast(node_items.select("node_id", "item")), "item")
    return joined.groupBy("qid", "node_id", "threshold", "asked").agg(F.count("*").cast("int").alias("r")).join(F.broadcast(nodes.select("node_id", "depth", "size", "parent_id")), "node_id")


def select_nodes(queries: DataFrame, node_items: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """qid, node_id, role: ``full`` for the deepest node that covers the query (the first of equals), ``partial`` for
    nodes that hold at least the threshold of its items, but neither cover it nor are the root, and have no
    such descendant. Nodes nest, so this is what picking disjoint nodes deepest first gives.
    """
    shared = query_nodes(queries, node_items, nodes)
    full = shared.where("r = asked").groupBy("qid").agg(F.max(F.struct("depth", (-F.col("node_id")).alias("n"))).alias("m")).select("qid", (-F.col("m.n")).cast("int").alias("node_id"), F.lit("full").alias("role"))
    fit = shared.where("r >= threshold and r < asked and parent_id is not null").select("qid", "node_id")
    above = fit.join(F.broadcast(ancestors(nodes, depth)), "node_id").select("qid", F.col("ancestor_id").alias("node_id")).distinct()
    return full.unionByName(fit.join(above, ["qid", "node_id"], "left_anti").withColumn("role", F.lit("partial")))


def classify(r: Column, asked: Column, size: Column, threshold: Column) -> Column:
    """-1 below the threshold, 0 equal sets, 2 the node covers the query, 1 partial."""
    return F.when(r < threshold, -1).when((r == asked) & (r == size), 0).when(r == asked, 2).otherwise(1)


def combine(f_one: Column, v_one: Column, f_two: Column, v_two: Column) -> tuple[Column, Column]:
    """Inverse-variance mean and its variance; the other estimate alone where a variance isn't finite and positive."""
    bad = lambda v: v.isNull() | F.isnan(v) | (v <= 0) | (v == INFINITE)
    both = v_one + v_two
    f = F.when(bad(v_one), f_two).when(bad(v_two), f_one).otherwise((v_two * f_one + v_one * f_two) / both)
    v = F.when(bad(v_one), v_two).when(bad(v_two), v_one).otherwise(v_one * v_two / both)
    return f, v


def query_alpha(build: Build, asked: DataFrame) -> DataFrame:
    """node_id, qid, k, alpha: MinHash tails blended with Gaussian ones where ``alpha_eta`` asks for it.

    ``asked``: node_id, qid, threshold, item. Signatures are made of the query's items inside the node.
    """
    config = build.config
    local = asked.join(F.broadcast(build.node_items), ["node_id", "item"])
    targets = minhash.set_signatures(local.select("node_id", "qid", "local_id"), ["node_id", "qid"], config)
    counted = asked.groupBy("node_id", "qid", "threshold").agg(F.count("*").alias("c"))
    hashed = tails.alpha_minhash(build.winners, build.bins, targets, counted, config)
    if config.alpha_eta >= 1:
        return hashed
    share = tails.query_share(asked.select("node_id", "qid", "item"), build.node_items, tails.item_probabilities(build.hist), pair_items(build).join(counted.select("node_id", "qid"), "node_id"))
    grid = counted.join(share, ["node_id", "qid"]).join(F.broadcast(build.sizes), "node_id").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("size"))))
    gauss = grid.select("node_id", "qid", "k", tails.alpha_gauss(F.col("k"), F.col("w"), F.col("rho"), F.col("threshold")).alias("g"))
    return gauss.join(hashed, ["node_id", "qid", "k"], "left").select("node_id", "qid", "k", tails.blended_alpha(F.col("g"), F.coalesce("alpha", F.lit(0.0)), config.alpha_eta).alias("alpha"))


def pair_items(build: Build) -> DataFrame:
    """node_id, item_a < item_b, freq. A row for each pair of a node's items: never broadcast."""
    local = build.node_items.select("node_id", "item", "local_id")
    one, two = (local.select("node_id", F.col("item").alias(f"item_{k}"), F.col("local_id").alias(k)) for k in "ab")
    return build.pair_freq.where("a is not null").join(F.broadcast(one), ["node_id", "a"]).join(F.broadcast(two), ["node_id", "b"]).select("node_id", "item_a", "item_b", "freq")


def asked_pairs(asked: DataFrame, build: Build) -> DataFrame:
    """qid, node_id, item_a < item_b, freq of the pairs that a query asks for inside a node: few of the node's pairs."""
    one, two = (asked.select("qid", "node_id", F.col("item").alias(f"item_{k}")) for k in "ab")
    return one.join(two, ["qid", "node_id"]).where("item_a < item_b").join(pair_items(build), ["node_id", "item_a", "item_b"]).select("qid", "node_id", "item_a", "item_b", "freq")


def full_component(build: Build, asked: DataFrame, alpha: DataFrame) -> DataFrame:
    """node_id, qid, f, var: the node's two histograms through alpha, combined by inverse variance."""
    one = tails.mixed(build.minhash_hist, alpha).select("node_id", "qid", F.col("f").alias("f_mh"), F.col("var").alias("v_mh"))
    counted = build.oue_hist.groupBy("node_id").agg(F.max("n").alias("n_oue"))
    two = tails.mixed(build.oue_hist, alpha).select("node_id", "qid", F.col("f").alias("f_oue"))
    rows = asked.select("node_id", "qid").distinct().join(one, ["node_id", "qid"], "left").join(two, ["node_id", "qid"], "left").join(F.broadcast(counted), "node_id", "left")
    v_oue = tails.oue_variance(F.coalesce("n_oue", F.lit(0)), build.config.report_epsilon)
    f, v = combine(F.coalesce("f_mh", F.lit(0.0)), F.coalesce("v_mh", F.lit(INFINITE)), F.coalesce("f_oue", F.lit(0.0)), v_oue)
    return rows.select("node_id", "qid", f.alias("f"), v.alias("var"))


def hybrid_histogram(build: Build, asked: DataFrame, alpha: DataFrame) -> DataFrame:
    """node_id, qid, k, freq, n: both histograms of a partial node, weighted by the other's variance, normalised.

    ``n`` is the number of MinHash users.
    """
    variance = tails.mixed(build.minhash_hist, alpha).select("node_id", "qid", F.col("var").alias("v_mh"))
    counted = build.oue_hist.groupBy("node_id").agg(F.max("n").alias("n_oue")).join(build.minhash_hist.groupBy("node_id").agg(F.max("n").alias("n")), "node_id")
    v_oue = tails.oue_variance(F.col("n_oue"), build.config.report_epsilon)
    # a variance that says nothing leaves the direct histogram alone
    usable = F.col("v_mh").isNotNull() & (F.col("v_mh") > 0)
    weight = F.when(usable, v_oue / (v_oue + F.col("v_mh"))).otherwise(F.lit(0.0))
    weights = asked.select("node_id", "qid").distinct().join(variance, ["node_id", "qid"], "left").join(F.broadcast(counted), "node_id").select("node_id", "qid", "n", weight.alias("w"))
    bins = build.oue_hist.select("node_id", "k", F.col("freq").alias("o")).join(build.minhash_hist.select("node_id", "k", F.col("freq").alias("m")), ["node_id", "k"], "full")
    mixed = weights.join(F.broadcast(bins), "node_id").select("node_id", "qid", "k", F.greatest(F.lit(0.0), F.col("w") * F.coalesce("m", F.lit(0.0)) + (1 - F.col("w")) * F.coalesce("o", F.lit(0.0))).alias("freq"), "n")
    return tails.normalised(mixed, ["node_id", "qid"])


def cross_pairs(asked: DataFrame, cross: DataFrame, probabilities: DataFrame) -> DataFrame:
    """qid, node_u < node_v, item_a, item_b, freq: a pair of nodes' co-frequency dealt to item pairs in proportion to
    the items' probabilities in either part (uniformly where they vanish)."""
    known = asked.join(F.broadcast(probabilities), "item", "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    part = Window.partitionBy("qid", "node_id")
    whole = F.sum("p").over(part)
    shared = known.withColumn("w", F.when(whole > 0, F.col("p") / whole).otherwise(1 / F.count("*").over(part)))
    one, two = (shared.select("qid", F.col("node_id").alias(f"node_{k}"), F.col("item").alias(f"item_{k}"), F.col("w").alias(f"w_{k}")) for k in "uv")
    both = one.join(two, "qid").where("node_u < node_v").join(F.broadcast(cross.select(F.col("node_i").alias("node_u"), F.col("node_j").alias("node_v"), F.col("freq").alias("p_uv"))), ["node_u", "node_v"])
    return both.select("qid", "node_u", "node_v", "p_uv", F.least("item_u", "item_v").alias("item_a"), F.greatest("item_u", "item_v").alias("item_b"), (F.col("p_uv") * F.col("w_u") * F.col("w_v")).alias("freq"))


def global_pairs(inside: DataFrame, crossed: DataFrame) -> DataFrame:
    """qid, item_a, item_b, freq: the asked pairs inside the partial nodes and across them."""
    columns = ["qid", "item_a", "item_b", "freq"]
    return inside.select(*columns).unionByName(crossed.select(*columns)).groupBy("qid", "item_a", "item_b").agg(F.sum("freq").alias("freq"))


def partial_component(build: Build, asked: DataFrame, alpha: DataFrame) -> DataFrame:
    """qid, f, var of queries with partial nodes. ``asked``: node_id, qid, threshold, item of those nodes."""
    probabilities = tails.item_probabilities(build.hist)
    inner = tails.mixed(hybrid_histogram(build, asked, alpha), alpha)
    inner = asked.select("node_id", "qid").distinct().join(inner, ["node_id", "qid"], "left")
    intra = inner.groupBy("qid").agg(F.sum(F.coalesce("f", F.lit(0.0))).alias("f_intra"), F.sum(F.coalesce("var", F.lit(0.0))).alias("v_intra"))

    crossed = cross_pairs(asked, build.cross, probabilities)
    within = asked_pairs(asked, build)
    couples = crossed.select("qid", "node_u", "node_v", "p_uv").distinct()
    # a row for either node of a couple, so that what belongs to them is found by its key
    either = couples.withColumn("node_id", F.explode(F.array("node_u", "node_v")))
    union = either.join(asked, ["qid", "node_id"]).select("qid", "node_u", "node_v", "p_uv", "threshold", "item")
    inside = either.join(within, ["qid", "node_id"]).select("qid", "node_u", "node_v", "item_a", "item_b", "freq")
    pairs = inside.unionByName(crossed.select(*inside.columns)).groupBy("qid", "node_u", "node_v", "item_a", "item_b").agg(F.sum("freq").alias("freq"))
    keys = ["qid", "node_u", "node_v"]
    enough = union.groupBy(*keys, "threshold", "p_uv").agg(F.count("*").alias("n")).where("n >= threshold").select(*keys, "p_uv")
    both = tails.pair_tail(union.select(*keys, "threshold", "item"), probabilities, pairs, keys).join(enough, keys)
    slope = F.col("tail") / F.greatest("p_uv", F.lit(1e-9))
    cross = both.groupBy("qid").agg(F.sum(clip01(F.col("tail"))).alias("f_cross"), F.sum(slope * slope * F.col("p_uv") * (1 - F.col("p_uv")) / float(max(1, build.users))).alias("v_cross"))

    best = tails.pair_tail(asked.select("qid", "threshold", "item"), probabilities, global_pairs(within, crossed), ["qid"]).select("qid", clip01(F.col("tail")).alias("best"))
    rows = intra.join(cross, "qid", "left").join(best, "qid", "left").withColumn("mean", F.col("f_intra") + F.coalesce("f_cross", F.lit(0.0)))
    f0 = F.greatest(F.lit(0.0), F.coalesce("best", F.lit(0.0)) - F.col("mean"))
    variance = F.col("v_intra") + F.coalesce("v_cross", F.lit(0.0)) + f0 * (1 - f0) / float(max(1, build.users))
    return rows.select("qid", clip01(F.col("mean") + f0).alias("f"), F.when(variance <= 0, F.lit(1e-12)).otherwise(variance).alias("var"))


def answers(build: Build, queries: DataFrame) -> DataFrame:
    """qid, f_full, var_full, f_partial, var_partial, f_hat for a whole batch.

    Thresholds up to 0 give 1; an empty query with a threshold gives 0; unknown items count as never held.
    """
    scratch = Scratch(queries.sparkSession, "answers")
    selected = select_nodes(queries, build.node_items, build.nodes, max(1, build.config.max_depth))
    asked = queries.select("qid", "threshold", F.explode(F.array_distinct("items")).alias("item"))
    per_node = selected.join(asked, "qid").join(F.broadcast(build.node_items.select("node_id", "item")), ["node_id", "item"]).select("role", "node_id", "qid", "threshold", "item")
    per_node = scratch.save(per_node, "asked")
    alpha = scratch.save(query_alpha(build, per_node.drop("role")), "alpha")
    full_asked, partial_asked = (per_node.where(F.col("role") == r).drop("role") for r in ("full", "partial"))
    full = full_component(build, full_asked, alpha).select("qid", F.col("f").alias("f_full"), F.col("var").alias("var_full"))
    partial = partial_component(build, partial_asked, alpha).select("qid", F.col("f").alias("f_partial"), F.col("var").alias("var_partial"))
    rows = queries.select("qid", "threshold").join(full, "qid", "left").join(partial, "qid", "left")
    f, _ = combine(F.coalesce("f_full", F.lit(0.0)), F.coalesce("var_full", F.lit(INFINITE)), F.coalesce("f_partial", F.col("f_full"), F.lit(0.0)), F.coalesce("var_partial", F.lit(INFINITE)))
    return rows.select("qid", "f_full", "var_full", "f_partial", "var_partial", F.when(F.col("threshold") <= 0, F.lit(1.0)).otherwise(clip01(f)).alias("f_hat"))


def spent_epsilon(build: Build) -> float:
    """What any one user has spent over both of its reports."""
    return 2 * build.config.report_epsilon if math.isfinite(build.config.report_epsilon) else INFINITE
