"""Operator 4, exact dedup by deterministic block naming. DataFrame operations only.

A normalised text is cut into blocks of ``BLOCK`` characters. The distinct blocks are sorted by (64-bit
hash, content) over all partitions and numbered, so equal blocks get one integer name; then the names of
adjacent pairs are sorted and named the same way, again and again, until each text has one name. Texts that
need the same number of rounds have equal names exactly when they are equal.

Contents are compared wherever hashes tie, so names never collide. Almost every hash has one content, which
the first pass establishes; blocks of such hashes are named by their hash alone, the others by (hash,
content). The full texts are therefore shuffled once, after the map-side combine that already drops repeats.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, partitions, text_or_empty

#: Characters of a block.
BLOCK = 4096

Hash = Callable[..., Column]


def _blocks(text: Column, size: int) -> Column:
    """The text's consecutive blocks, found in one pass; the empty text is one empty block."""
    return F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % size), F.lit(0)))


def _numbered(scratch: Scratch, distinct: DataFrame, order: list[str], name: Column) -> DataFrame:
    """The rows sorted over all partitions, with ``name`` computed from ``__n``, which rises in that order."""
    ranged = distinct.repartitionByRange(partitions(scratch.spark), *order).sortWithinPartitions(*order)
    return scratch.save(ranged.withColumn("__n", F.monotonically_increasing_id()).withColumn("name", name).drop("__n"), "sorted")


def block_identities(scratch: Scratch, rows: DataFrame, text: str, keep: list[str], size: int = BLOCK, hash_of: Hash = F.xxhash64) -> DataFrame:
    """One row per row of ``rows``: ``*keep, rounds, name``; two texts are equal exactly when (rounds, name) are.

    ``rows`` is read twice: for the distinct blocks, and for the rows themselves, which are numbered in that
    second reading only and written at once, along with the contents of tied blocks. So nothing depends on
    both readings splitting the input alike.
    """
    cut = lambda df, *more: df.select(*more, F.posexplode(_blocks(F.col(text), size)).alias("__at", "__block")).withColumn("__hash", hash_of(F.col("__block")))
    # the shuffle is by hash and content: copies of a block fall away before it, and after it only hashes are kept
    distinct = cut(rows).select("__hash", "__block").distinct().select("__hash")
    contents = scratch.save(distinct, "blocks")
    # written, so that the join below deals out both sides and a hot block's rows can be split
    hashes = scratch.save(contents.groupBy("__hash").agg(F.count("*").alias("contents")), "hashes")
    names = _numbered(scratch, hashes.where("contents = 1").select("__hash"), ["__hash"], F.col("__n"))
    tied = scratch.save(hashes.where("contents > 1").select("__hash"), "tied")

    each = cut(rows.withColumn("__row", F.monotonically_increasing_id()), "__row", *keep)
    each = each.select("__row", "__at", "__hash", "__block", *[F.when(F.col("__at") == 0, F.col(c)).alias(c) for c in keep])
    any_tied = bool(tied.take(1))
    if any_tied:  # several contents under one hash: those blocks' contents stay with their rows
        each = each.join(tied.withColumn("__tied", F.lit(True)), "__hash", "left").withColumn("__block", F.when(F.col("__tied"), F.col("__block"))).drop("__tied")
    else:
        each = each.drop("__block")
    slim = scratch.save(each, "rows")
    level = slim.select("__row", "__at", "__hash").join(names, "__hash").select("__row", "__at", "name")
    if any_tied:  # named by content, below zero
        tied_rows = slim.where("__block is not null").select("__row", "__at", "__hash", "__block")
        own = _numbered(scratch, tied_rows.select("__hash", "__block").distinct(), ["__hash", "__block"], -1 - F.col("__n"))
        level = level.unionByName(tied_rows.join(own, ["__hash", "__block"]).select("__row", "__at", "name"))
    level = scratch.save(level, "names-0")
    scratch.drop(contents, hashes, names, tied)

    finished, rounds = [], 0
    while True:
        longer = level.where(F.col("__at") == 1).select("__row")
        if not longer.take(1):
            finished.append(level.select("__row", F.lit(rounds).alias("rounds"), "name"))
            break
        # a text is finished in the round that leaves it one name: only block 0 is there
        sizes = level.groupBy("__row").agg(F.max("__at").alias("last"), F.max(F.when(F.col("__at") == 0, F.col("name"))).alias("name"))
        finished.append(scratch.save(sizes.where("last = 0").select("__row", F.lit(rounds).alias("rounds"), "name"), "finished"))
        going = level.join(longer, "__row", "left_semi")
        half = F.shiftright("__at", 1).alias("__at")
        pairs = going.groupBy("__row", half).agg(
            F.max(F.when(F.col("__at") % 2 == 0, F.col("name"))).alias("left"), F.max(F.when(F.col("__at") % 2 == 1, F.col("name"))).alias("right")
        )
        pairs = scratch.save(pairs.withColumn("paired", F.col("right").isNotNull()).withColumn("right", F.coalesce("right", F.lit(0))), "pairs")
        named = _numbered(scratch, pairs.select("left", "right", "paired").distinct(), ["left", "right", "paired"], F.col("__n"))
        done, level = level, scratch.save(pairs.join(named, ["left", "right", "paired"]).select("__row", "__at", "name"), "names")
        scratch.drop(done, pairs, named)
        rounds += 1
    done = finished[0]
    for f in finished[1:]:
        done = done.unionByName(f)
    return slim.where(F.col("__at") == 0).select("__row", *keep).join(done, "__row").drop("__row")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = BLOCK, hash_of: Hash = F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty; equal means identical after lower-casing A-Z. The largest doc_id of a group
    stays; null ids rank below all others (a group of null ids keeps them all, with a null keep_id), and rows
    that repeat the largest id are all kept, as nothing tells them apart. Very long texts take more rounds.
    An empty table gives no rows; further columns are ignored.
    """
    # the lower-cased text is computed once below the explode
    normal = docs.select(F.col(doc_id).alias("doc_id"), ascii_lower(text_or_empty(text)).alias("__text"))
    rows = normal.withColumn("text_sha256", F.unhex(F.sha2(F.col("__text"), 256)))
    working, scratch = Scratch(docs.sparkSession, "naming"), Scratch(docs.sparkSession, "exact-groups")
    named = scratch.save(block_identities(working, rows, "__text", ["doc_id", "text_sha256"], size, hash_of), "identities")
    working.clear()
    groups = scratch.save(named.groupBy("rounds", "name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    out = named.join(groups, ["rounds", "name"])
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("text_sha256")).alias("text_sha256"))
