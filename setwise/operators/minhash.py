"""MinHash with named winners: a signature slot holds the item whose hash rank is least, not the rank."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import KEEP_RATE, Config, flip_rate
from ..functions.mathx import clip01
from ..functions.prng import digest, uniform
from .oue import in_node


def rank_of(seed: int, ell: Column | str | int, item: Column | str) -> Column:
    """The item's place under permutation ``ell``, as a sortable digest: no table of ranks is built."""
    return digest(seed, "perm", ell, item)


def rank_table(items: DataFrame, hashes: int, seed: int) -> DataFrame:
    """ell, item, rank (from 0): the permutations spelled out, for small domains."""
    wide = items.select("item", F.explode(F.sequence(F.lit(0), F.lit(hashes - 1))).alias("ell"))
    return wide.select("ell", "item", (F.row_number().over(Window.partitionBy("ell").orderBy(rank_of(seed, "ell", "item"), "item")) - 1).alias("rank"))


def signatures(things: DataFrame, by: list[str], hashes: int, seed: int, item: str = "item") -> DataFrame:
    """*by, ell, winner for every hash function; groups without items don't appear."""
    wide = things.select(*by, item, F.explode(F.sequence(F.lit(0), F.lit(hashes - 1))).alias("ell"))
    return wide.groupBy(*by, "ell").agg(F.min_by(item, rank_of(seed, "ell", item)).alias("winner"))


def batch_signatures(things: DataFrame, by: list[str], hashes: int, seed: int, item: str = "item") -> DataFrame:
    """``signatures`` of very many groups of whole-number items, each a set that fits a row: groups are shuffled and
    sorted as sets, and only the result has a row a hash function.

    The digests of a batch's distinct items are taken once; a winner is the item of least rank among them.
    """
    cached = 2**21  # ranks kept from batch to batch

    @F.arrow_udf("array<bigint>")
    def winners(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, ranks, order = np.empty(0, np.int64), None, None
        for sets in batches:
            flat, sizes = sets.flatten().to_numpy(zero_copy_only=False), sets.value_lengths().to_numpy(zero_copy_only=False)
            if not len(sizes):
                yield pa.array([], pa.list_(pa.int64()))
                continue
            seen = np.unique(flat)
            if not np.isin(seen, known).all():
                both = np.union1d(seen, known)
                known = both if len(both) * hashes <= cached else seen
                ranks, order = np.empty((hashes, len(known)), np.int32), np.empty((hashes, len(known)), np.int32)
                for ell in range(hashes):
                    digests = np.array([hashlib.md5(f"{seed}|perm|{ell}|{i}".encode()).digest() for i in known.tolist()], "S16")
                    order[ell] = np.argsort(digests)
                    ranks[ell, order[ell]] = np.arange(len(known), dtype=np.int32)
            at, starts = np.searchsorted(known, flat), np.cumsum(sizes) - sizes
            out = np.empty((len(sizes), hashes), np.int64)
            for ell in range(hashes):
                out[:, ell] = known[order[ell][np.minimum.reduceat(ranks[ell][at], starts)]]
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, hashes, dtype=np.int32)), pa.array(out.ravel()))

    kind = things.schema[item].dataType
    sets = things.where(F.col(item).isNotNull()).groupBy(*by).agg(F.collect_set(F.col(item).cast("bigint")).alias("__items"))
    return sets.select(*by, winners("__items").alias("__won")).select(*by, F.posexplode("__won").alias("ell", "winner")).withColumn("winner", F.col("winner").cast(kind))


def signature_array(items: Column, hashes: int, seed: int) -> Column:
    """The whole signature of an array of items in one row; -1 in every slot of an empty set."""
    slot = lambda ell: F.array_min(F.transform(items, lambda x: F.struct(rank_of(seed, ell, x).alias("r"), x.alias("i"))))["i"]
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda ell: F.coalesce(slot(ell), F.lit(-1)))


def hashed_output(seed: int, ell: Column | str, item: Column | str, size: int) -> Column:
    """A winner mapped to 0..size-1 by a keyed hash."""
    return F.pmod(F.conv(F.substring(digest(seed, "out", ell, item), 1, 8), 16, 10).cast("bigint"), F.lit(size))


def hashed_output_blake(things: DataFrame, seed: int, size: int) -> DataFrame:
    """The same with keyed blake2b, which has no column function: ``things`` has ell, item; adds ``out``."""

    @F.arrow_udf("bigint")
    def mapped(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ell, item in batches:
            digests = [hashlib.blake2b(str(i).encode(), digest_size=8, key=f"{seed}|{e}".encode()).digest() for e, i in zip(ell.to_pylist(), item.to_pylist())]
            yield pa.array([int.from_bytes(d, "big") % size for d in digests], pa.int64())

    return things.withColumn("out", mapped("ell", "item"))


def chosen_hashes(users: DataFrame, config: Config) -> DataFrame:
    """node_id, uid, choice, ell: the hash functions each user reports on, those with the least digests, numbered from 0.

    A user draws ``hash_choices`` distinct numbers; only these signatures are ever computed.
    """
    order = F.transform(F.sequence(F.lit(0), F.lit(config.hashes - 1)), lambda e: F.struct(digest(config.seed, "hash_choice", "node_id", "uid", e).alias("d"), e.alias("e")))
    picked = F.slice(F.array_sort(order), 1, config.hash_choices)
    return users.select("node_id", "uid", F.posexplode(F.transform(picked, lambda x: x["e"])).alias("choice", "ell"))


def localized(pairs: DataFrame, users: DataFrame, node_items: DataFrame, sizes: DataFrame) -> DataFrame:
    """node_id, uid, local_id: the users' sets in their node's numbering, all outside items as one id K."""
    own = pairs.join(users.select("node_id", "uid"), "uid").join(F.broadcast(node_items), ["node_id", "item"], "left")
    return own.join(F.broadcast(sizes), "node_id").select("node_id", "uid", F.coalesce("local_id", "size").alias("local_id")).distinct()


def node_signatures(pairs: DataFrame, users: DataFrame, node_items: DataFrame, config: Config) -> DataFrame:
    """node_id, uid, choice, ell, winner (local id) at the chosen hashes; users without an item of the node don't report.

    Winners are taken among the node's items. Fewer choices are the first of more: those of a smaller epsilon are here too.
    """
    inside = in_node(pairs, users, node_items).select("node_id", "uid", "local_id")
    wide = inside.join(chosen_hashes(users, config), ["node_id", "uid"])
    return wide.groupBy("node_id", "uid", "choice", "ell").agg(F.min_by("local_id", rank_of(config.seed, "ell", "local_id")).alias("winner"))


def set_signatures(sets: DataFrame, by: list[str], config: Config) -> DataFrame:
    """*by, ell, target: full signatures of item sets given by local_id (a node's or a query's)."""
    return signatures(sets, by, config.hashes, config.seed, "local_id").withColumnRenamed("winner", "target")


def report_bit(config: Config, y: Column | str) -> Column:
    """The bit of a user's report at element ``y``; only elements that are asked for are ever drawn."""
    draw = uniform(config.seed, "hash_bits", "node_id", "uid", "ell", y)
    target = F.col(y) if isinstance(y, str) else y
    return (draw < F.when(F.col("winner") == target, F.lit(KEEP_RATE)).otherwise(F.lit(flip_rate(config.hash_epsilon)))).cast("int")


def jaccard(matches: Column, trials: Column, config: Config) -> Column:
    """Similarity from a match rate, debiased and clipped."""
    q = flip_rate(config.hash_epsilon)
    return clip01((matches / trials - q) / (KEEP_RATE - q))


def similarities(winners: DataFrame, targets: DataFrame, config: Config, by: list[str]) -> DataFrame:
    """*by, uid, matches, trials, j: each reporting user's similarity to the sets of ``targets`` (*by, ell, target)."""
    joined = winners.join(targets, [*[c for c in by if c in winners.columns], "ell"])
    counted = joined.withColumn("bit", report_bit(config, "target")).groupBy(*by, "uid").agg(F.sum("bit").alias("matches"), F.count("*").alias("trials"))
    return counted.withColumn("j", jaccard(F.col("matches"), F.col("trials"), config))


def user_bins(winners: DataFrame, full: DataFrame, sizes: DataFrame, config: Config) -> DataFrame:
    """node_id, uid, j, k: the similarity to the whole node as a number of shared items, half-even."""
    near = similarities(winners, full, config, ["node_id"]).join(F.broadcast(sizes), "node_id")
    k = F.least(F.greatest(F.rint(F.col("j") * F.col("size")), F.lit(0.0)), F.col("size")).cast("int")
    return near.select("node_id", "uid", "j", k.alias("k"))


def bin_histogram(bins: DataFrame) -> DataFrame:
    """node_id, k, freq, n over the reporting users; bins nobody fell into are left out."""
    counted = bins.groupBy("node_id", "k").agg(F.count("*").alias("c"))
    return counted.withColumn("n", F.sum("c").over(Window.partitionBy("node_id"))).select("node_id", "k", (F.col("c") / F.col("n")).alias("freq"), "n")


def mean_jaccard(winners: DataFrame, targets: DataFrame, config: Config, by: list[str]) -> DataFrame:
    """*by, mean_j over users with at least one trial."""
    return similarities(winners, targets, config, by).groupBy(*by).agg(F.avg("j").alias("mean_j"))


# a node's own numbering


def prefix_order(node_items: DataFrame, hist: DataFrame) -> DataFrame:
    """node_id, item, position (from 1) by falling noisy count, then item. Prefix k is the rows up to k: none is built."""
    known = node_items.select("node_id", "item").join(F.broadcast(hist.select("item", "noisy_count")), "item", "left")
    order = Window.partitionBy("node_id").orderBy(F.desc(F.coalesce("noisy_count", F.lit(0.0))), "item")
    return known.select("node_id", "item", F.row_number().over(order).alias("position"))


def local_domain(node_items: DataFrame) -> DataFrame:
    """node_id, item, local_id: items numbered from 0 in item order inside each node."""
    return node_items.select("node_id", "item", (F.row_number().over(Window.partitionBy("node_id").orderBy("item")) - 1).alias("local_id"))


def node_sizes(node_items: DataFrame) -> DataFrame:
    return node_items.groupBy("node_id").agg(F.count("*").cast("int").alias("size"))
