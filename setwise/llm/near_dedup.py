"""Operator 5, near-dedup by MinHash bands and odd sketches.

1. Every text gives its set of 5-word shingles, a fingerprint of the set and 60 MinHash bands. Texts with equal
   sets form one class; from here on classes count, so copies cost nothing more.
2. Classes that share a band are candidates. Each is first compared with one leader of its bucket; large buckets
   that this leaves open get further leaders, drawn by hash. That links most of a group at linear cost.
3. Candidates are judged by odd sketches: parity bitmaps of the classes' MinHash samples (here the whole sets, with
   at least a bit a shingle), whose XOR population count estimates the sets' difference. It never exceeds it, so
   a count of over a seventh of both sizes rules a link out for certain. All others are confirmed on full sets.
4. Links give components. What is still open are pairs of one bucket in different components: these are
   joined with the sketch comparison as the join's condition, confirmed, and the components are finished.
   The join is by bucket and size class (a link's sizes are within 4/3), and large buckets are laid out in tiles, so
   that no task has more than a tile of pairs.

So a bucket of near copies costs about its size, and no pair that shares a band is left unjudged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles as sh
from .common import Scratch, bound_batches
from .components import components

#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Rounds of further leaders, for buckets of so many members, while so many pairs of members are open in all: fewer
#: are compared faster than a round takes. Results don't depend on these.
LEADER_ROUNDS, LEADER_SIZE, LEADER_PAIRS = 2, 64, 1_000_000_000
#: Members of a bucket on a side of a tile, and the logarithm of a size class (a hair over a link's most).
TILE, SIZE_STEP = 4000, math.log(100 / PERCENT) * 1.0001

_NARROW = [f"f{i}" for i in range(sh.BITS // 64)]
#: Levels 0 and 1 are compared on ``f*`` (level 1 folded) unless both are 1; others on ``wide`` and its fold, ``half``.
SKETCH = ["n", "level", *_NARROW]
WIDE = ["wide", "half"]


def _keyed(docs: DataFrame, *more: str | Column) -> DataFrame:
    """Two hashes that find a row again in a second reading: of row and text, and of the text."""
    return docs.select(F.xxhash64("text", "doc_id").alias("row_key"), F.hash("text").alias("text_key"), *more)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, text_key, n_shingles, fingerprint, bands of each row (no bands for an empty set)."""
    bound_batches(docs.sparkSession)

    @F.arrow_udf("struct<n:bigint,fingerprint:binary,bands:array<bigint>>")
    def signed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            n, prints, bands = [], [], []
            for text in batch:
                s = sh.shingle_set(text.as_py())
                n.append(len(s))
                prints.append(sh.fingerprint(s) if len(s) else None)
                bands.append(sh.band_hashes(s) if len(s) else None)
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["n", "fingerprint", "bands"])

    made = _keyed(docs, "doc_id", signed("text").alias("s"))
    return made.select("doc_id", "row_key", "text_key", F.col("s.n").alias("n_shingles"), F.col("s.fingerprint").alias("fingerprint"), F.col("s.bands").alias("bands"))


_FIELDS = [*[(c, pa.int64()) for c in SKETCH], *[(c, pa.list_(pa.int64())) for c in [*WIDE, "shingles"]]]
_MEMBER_DDL = "struct<" + ",".join([*[f"{c}:bigint" for c in SKETCH], *[f"{c}:array<bigint>" for c in [*WIDE, "shingles"]]]) + ">"


def _member(shingles: np.ndarray) -> list:
    level = sh.level_of(len(shingles))
    sketch = sh.odd_sketch(shingles, level)
    half = sh.folded(sketch) if level else None
    narrow = (sketch if level == 0 else half).tolist() if level < 2 else [0] * len(_NARROW)
    return [len(shingles), level, *narrow, sketch if level else None, half, shingles.view(np.int64)]


def members(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """Sketches and full sets of the classes in ``needed`` (row_key, text_key, cid, fingerprint), one row a class, and
    rows of nulls for others that have the same keys."""

    @F.arrow_udf(_MEMBER_DDL)
    def sketched(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for prints, texts in batches:
            columns: list[list] = [[] for _ in _FIELDS]
            for expected, text in zip(prints.to_pylist(), texts):
                s = sh.shingle_set(text.as_py())
                same = sh.fingerprint(s) == expected  # else another row with the same keys
                for column, value in zip(columns, _member(s) if same else [None] * len(_FIELDS)):
                    column.append(value)
            yield pa.StructArray.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, _FIELDS)], names=[n for n, _ in _FIELDS])

    # rows that repeat as a whole share their keys: one of them is enough
    # merged at every size: the needed rows grow with the input
    once = _keyed(docs, "text").join(needed.hint("merge"), ["row_key", "text_key"]).groupBy("row_key", "text_key", "cid", "fingerprint").agg(F.first("text").alias("text"))
    return once.select("cid", sketched("fingerprint", "text").alias("m")).select("cid", "m.*")


def _narrow_flips(a: str, b: str) -> Column:
    flips = [F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}"))) for c in _NARROW]
    return sum(flips[1:], flips[0])


def _wide_flips(a: str, b: str) -> Column:
    """The side of the higher level is folded."""
    la, lb = F.col(f"{a}level"), F.col(f"{b}level")
    x = F.when(la <= lb, F.col(f"{a}wide")).otherwise(F.col(f"{a}half"))
    y = F.when(lb <= la, F.col(f"{b}wide")).otherwise(F.col(f"{b}half"))
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, v: n + v)


def similar_enough(a: str, b: str, flips: Column) -> Column:
    """Whether sizes and sketches allow a link; ``a``, ``b``: prefixes of the two sides' columns. Rules out no link:
    of a link the difference is at most (100 - p) / (100 + p) of both sizes, and the flips are fewer still."""
    na, nb = F.col(f"{a}n"), F.col(f"{b}n")
    return (F.lit(100) * F.least(na, nb) >= F.lit(PERCENT) * F.greatest(na, nb)) & ((100 + PERCENT) * flips <= (100 - PERCENT) * (na + nb))


def _is_narrow(a: str, b: str) -> Column:
    return F.col(f"{a}level") + F.col(f"{b}level") <= 1


def _sided(sketches: DataFrame, side: str, key: str) -> DataFrame:
    return sketches.select(F.col("cid").alias(key), *[F.col(c).alias(f"{side}{c}") for c in [*SKETCH, *WIDE]])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one, two = (sets.select(F.col("cid").alias(k), F.col("shingles").alias(f"set_{k}")) for k in "ab")
    both = pairs.join(one, "a").join(two, "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(100 * shared >= PERCENT * (F.size("set_a") + F.size("set_b") - shared)).select("a", "b")


def _star_links(scratch: Scratch, stars: DataFrame, sketches: DataFrame, sets: DataFrame) -> DataFrame:
    """The confirmed links among pairs (a, b) of members and leaders."""
    flips = F.when(_is_narrow("a_", "b_"), _narrow_flips("a_", "b_")).otherwise(_wide_flips("a_", "b_"))
    both = stars.distinct().join(_sided(sketches, "a_", "a"), "a").join(_sided(sketches, "b_", "b"), "b")
    judged = scratch.save(both.where(similar_enough("a_", "b_", flips)).select("a", "b"), "star-pairs")
    links = scratch.save(confirmed(judged, sets), "star-links")
    scratch.drop(judged)
    return links


def _open_pairs(left: DataFrame, columns: list[str], enough: Column) -> DataFrame:
    """Pairs (a, b) of one bucket and different components that ``enough`` lets through, each from its first open bucket.

    ``left``: bucket, tiles, cid, component, size_class, bands, *columns. A member of tile i meets tile j in the cell
    (i, j), and the sizes a link allows lie in the same or the next size class.
    """
    tile, every = F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int"), F.sequence(F.lit(0), (F.col("tiles") - 1).cast("int"))
    one = left.withColumn("ta", tile).withColumn("tb", F.explode(every))
    one = one.select("bucket", "size_class", "ta", "tb", F.col("cid").alias("a"), F.col("component").alias("ca"), *[F.col(c).alias(f"a_{c}") for c in columns])
    two = left.withColumn("tb", tile).withColumn("ta", F.explode(every)).withColumn("size_class", F.explode(F.array(*[F.col("size_class") + i for i in (-1, 0, 1)])))
    two = two.select("bucket", "size_class", "ta", "tb", F.col("cid").alias("b"), F.col("component").alias("cb"), *[F.col(c).alias(f"b_{c}") for c in columns])
    two = two.select(*[F.col(c).alias(f"r_{c}") if c in ("bucket", "size_class", "ta", "tb") else c for c in two.columns])
    same = [F.col(c) == F.col(f"r_{c}") for c in ("bucket", "size_class", "ta", "tb")]
    # every bucket that two components share is open, so the first shared one can speak for the pair
    first = F.element_at(F.filter(F.zip_with("a_bands", "b_bands", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull()), 1)
    passed = one.join(two, same[0] & same[1] & same[2] & same[3] & (F.col("ca") < F.col("cb")) & enough)
    return passed.where(first == F.col("bucket")).select("a", "b")


def near_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text), with row_key and text_key.

    A component is named by its smallest doc_id; kept: the row's doc_id is that. Null and empty texts have
    an empty set and are linked with nothing. Null doc_ids rank after all others: a component of null ids
    alone has a null name and its rows are kept. Rows that repeat a doc_id count as rows of their own. Very
    long texts are compared on all their shingles; ties with the threshold are links; an empty table gives no
    rows; extra columns are ignored. ``docs`` is read twice, so it should be a scan or a written table.
    """
    spark = docs.sparkSession
    scratch, result = Scratch(spark, "near"), Scratch(spark, "near-result")
    signed = result.save(signatures(docs), "signatures")
    classes = signed.where("n_shingles > 0").groupBy("fingerprint").agg(
        F.min("doc_id").alias("first_doc"), F.min(F.struct("row_key", "text_key")).alias("row"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n")
    )
    classes = scratch.save(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    banded = classes.select("cid", F.explode("bands").alias("bucket"))
    shared = scratch.save(banded.groupBy("bucket").agg(F.min("cid").alias("head"), F.count("*").alias("size")).where("size > 1").select("bucket", "head"), "buckets")
    inside = scratch.save(banded.join(shared, "bucket"), "inside")
    needed = classes.select("cid", "fingerprint", "row.row_key", "row.text_key").join(inside.select("cid").distinct(), "cid")
    sets = scratch.save(members(docs, needed), "members").where("n is not null")
    sketches = sets.select("cid", *SKETCH, *WIDE)

    links = _star_links(scratch, inside.where("cid <> head").select(F.col("cid").alias("a"), F.col("head").alias("b")), sketches, sets)
    found = scratch.save(components(links), "components")
    for turn in range(LEADER_ROUNDS + 1):
        labelled = inside.select("bucket", "cid").join(found.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        labelled = scratch.save(labelled, "labelled")
        parts = labelled.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.min_by("cid", F.xxhash64("cid", F.lit(turn))).alias("cid"))
        by_bucket = parts.groupBy("bucket").agg(
            F.count("*").alias("parts"), F.sum("n").alias("size"), F.sum(F.col("n") * F.col("n").cast("double")).alias("squares"),
            F.min_by(F.struct("cid", "component"), F.xxhash64("cid", F.lit(turn))).alias("leader"),
        )
        still_open = scratch.save(by_bucket.where("parts > 1"), "open")
        large = still_open.where(F.col("size") >= LEADER_SIZE)
        pairs = large.agg(F.sum((F.col("size").cast("double") * F.col("size") - F.col("squares")) / 2)).first()[0]
        if turn == LEADER_ROUNDS or (pairs or 0) < LEADER_PAIRS:
            break
        led = labelled.join(large, "bucket").where("component <> leader.component")
        more = _star_links(scratch, led.select(F.col("cid").alias("a"), F.col("leader.cid").alias("b")), sketches, sets)
        if not more.take(1):
            continue
        found = scratch.save(components(_joined(found, more)), "components")

    tiles = F.ceil(F.col("size") / F.lit(TILE)).cast("int").alias("tiles")
    left = labelled.join(still_open.select("bucket", tiles), "bucket").join(sketches, "cid").join(classes.select("cid", "bands"), "cid")
    left = scratch.save(left.withColumn("size_class", F.floor(F.log("n") / F.lit(SIZE_STEP)).cast("int")), "open-members")
    rest = _open_pairs(left.where("level <= 1"), [*SKETCH, "bands"], similar_enough("a_", "b_", _narrow_flips("a_", "b_")) & _is_narrow("a_", "b_"))
    long = left.where("level >= 1")
    if long.take(1):
        rest = rest.unionByName(_open_pairs(long, ["n", "level", *WIDE, "bands"], similar_enough("a_", "b_", _wide_flips("a_", "b_"))))
    rest = scratch.save(rest, "rest-pairs")
    more = scratch.save(confirmed(rest, sets), "rest-links")
    if more.take(1):
        found = scratch.save(components(_joined(found, more)), "components")

    placed = classes.select("cid", "fingerprint", "first_doc").join(found.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    placed = scratch.save(placed, "placed")
    named = scratch.save(placed.groupBy("component").agg(F.min("first_doc").alias("component_id")), "named")
    of_class = result.save(placed.select("fingerprint", "component").join(named, "component").select("fingerprint", "component_id"), "of-class")
    scratch.clear()
    out = signed.select("doc_id", "row_key", "text_key", "n_shingles", "fingerprint").join(of_class, "fingerprint", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "row_key", "text_key", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    return found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)


def near_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each component stays; columns unchanged.

    Rows that repeat a kept row as a whole stay with it; of a component of null doc_ids alone every row stays.
    """
    columns = docs.columns
    found = near_components(docs.select("doc_id", "text"))
    gone = found.where(~F.col("kept")).select("row_key", "text_key").distinct()
    # the row travels as one struct, so that no column of its own can clash with the keys
    left = _keyed(docs, F.struct(*columns).alias("whole_row")).join(gone.hint("merge"), ["row_key", "text_key"], "left_anti")
    return left.select("whole_row.*")
