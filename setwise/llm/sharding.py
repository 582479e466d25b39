"""Operator 3, sharding by k-d tree partitioning. DataFrame and SQL operations only.

Points are groups of rows that stay together (equal texts), placed by their metadata. A node is split at the
weighted median along the dimension in which it is widest, until every leaf holds about the target bytes. Of
a node for k shards, floor(k/2)/k of the bytes go left, so that any number of leaves comes out even.

The medians of all nodes of a level come from histograms that merge by aggregation. The first pass has a bin per
node, dimension and interval, which tells widths, weights and each median's bin; that bin becomes the next
pass's window, until it is narrow enough. Where many points share the median's value, the search goes on in
their tie breakers. A pass reads slim columns and shuffles only bins; points are written again, each where it
was, once a level, with their new node.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions, text_or_empty

#: Bytes that a row costs beside its text.
ROW_OVERHEAD = 16
#: Bins of a histogram, and the share of a leaf's bytes up to which the median's bin is narrowed.
BINS, PRECISION = 4096, 1 / 64
#: A group over this share of a leaf's bytes is several points, next to each other in every dimension.
GROUP_SHARE = 1 / 32

#: Tie breakers are whole numbers under 2^53, exact as doubles: 33 bits of the group's hash, 20 of the point's number.
_TIE_BITS, _NUMBER_BITS = 53, 20


def hashed_position(value: Column) -> Column:
    """A categorical value as a point of [0, 1): equal values share it; null is -1."""
    return F.when(value.isNull(), F.lit(-1.0)).otherwise(F.pmod(F.xxhash64(value), F.lit(1 << 20)) / float(1 << 20))


def _local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of numbers as a table."""
    names = ", ".join(c.split()[0] for c in schema.split(", "))
    text = lambda x: f"{x!r}D" if isinstance(x, float) else str(x).lower()
    values = ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)
    return spark.sql(f"select {', '.join(f'cast({c.split()[0]} as {c.split()[1]}) as {c.split()[0]}' for c in schema.split(', '))} from values {values} as t({names})")


#: What is known of a bin.
_BIN = "sum(w) as w, count(*) as n, min(x) as low, max(x) as high"


def _first_pass(points: DataFrame, dimensions: list[str], ends: list[tuple[float, float]], nodes: dict[int, int]) -> dict[int, list]:
    """node -> a row for each dimension: low and high of the node, and the bin that holds the goal."""
    shares = _local(points.sparkSession, [(n, k // 2, k) for n, k in nodes.items()], "node int, half int, leaves int")
    spread = ", ".join(f"struct({i + 1} as dim, cast({d} as double) as x, {lo!r}D as lo, {hi - lo!r}D as extent)" for i, (d, (lo, hi)) in enumerate(zip(dimensions, ends)))
    each = points.selectExpr("first", "w", f"inline(array({spread}))").withColumn("bin", F.expr(f"least({BINS - 1}, floor((x - lo) / extent * {BINS}))"))
    bins = each.groupBy("first", "dim", "bin").agg(*[F.expr(c) for c in _BIN.split(", ")])
    node = "partition by first, dim"  # BINS rows of a node and dimension
    bins = bins.selectExpr(
        "*", f"min(low) over ({node}) as lo", f"max(high) over ({node}) as hi", f"sum(w) over ({node}) as total",
        f"coalesce(sum(w) over ({node} order by bin rows between unbounded preceding and 1 preceding), 0) as before",
    )
    hit = bins.join(F.broadcast(shares), F.col("first") == F.col("node")).withColumn("goal", F.expr("total * half / leaves"))
    out: dict[int, list] = {}
    for r in hit.where("before <= goal and goal < before + w").collect():  # a row a node and dimension
        out.setdefault(r["node"], []).append(r)
    return {n: sorted(rows, key=lambda r: r["dim"]) for n, rows in out.items()}


def _next_pass(points: DataFrame, dimensions: list[str], windows: dict[int, tuple]) -> list:
    """For each window (dim, by tie, value, lo, hi, bytes before it, goal) its bin that holds the goal."""
    table = _local(points.sparkSession, [(n, *w) for n, w in windows.items()], "node int, dim int, by_tie boolean, value double, lo double, hi double, base bigint, goal double")
    value = f"element_at(array({', '.join(f'cast({d} as double)' for d in dimensions)}), dim)"
    inside = points.join(F.broadcast(table), F.col("first") == F.col("node")).withColumn("v", F.expr(value)).withColumn("x", F.expr("if(by_tie, cast(tie as double), v)"))
    inside = inside.where("x between lo and hi and (not by_tie or v = value)")
    inside = inside.withColumn("bin", F.expr(f"if(hi > lo, least({BINS - 1}, floor((x - lo) / (hi - lo) * {BINS})), 0)"))
    bins = inside.groupBy("node", "bin").agg(*[F.expr(c) for c in _BIN.split(", ")], F.first("base").alias("base"), F.first("goal").alias("goal"))
    before = "base + coalesce(sum(w) over (partition by node order by bin rows between unbounded preceding and 1 preceding), 0)"
    hit = bins.withColumn("before", F.expr(before)).where("before <= goal and goal < before + w").collect()  # a row a node
    if len(hit) < len(windows):
        raise RuntimeError("the points changed between two passes")
    return hit


def _medians(points: DataFrame, dimensions: list[str], ends: list[tuple[float, float]], nodes: dict[int, int], leaf: float, precision: float) -> dict[int, tuple[int, float, int]]:
    """node -> (dim, cut, tie_cut) along the node's widest dimension; nodes without points have none."""
    found, windows = {}, {}

    def narrow(node: int, dim: int, by_tie: bool, value: float, r) -> None:
        if r["n"] == 1 or (by_tie and r["low"] == r["high"]) or r["w"] <= precision * leaf:
            # the bin goes left as a whole if most of it lies before the goal
            edge = r["high"] if r["goal"] - r["before"] >= r["w"] / 2 else math.nextafter(r["low"], -math.inf)
            found[node] = (dim, value, math.floor(edge)) if by_tie else (dim, edge, 1 << _TIE_BITS)
        elif not by_tie and r["low"] == r["high"]:
            windows[node] = dim, True, r["low"], 0.0, float(1 << _TIE_BITS), r["before"], r["goal"]
        else:
            windows[node] = dim, by_tie, value, r["low"], r["high"], r["before"], r["goal"]

    for node, rows in _first_pass(points, dimensions, ends, nodes).items():
        width = [(r["hi"] - r["lo"]) / (hi - lo) for r, (lo, hi) in zip(rows, ends)]
        widest = width.index(max(width))
        narrow(node, widest + 1, False, 0.0, rows[widest])
    while windows:
        now, windows = windows, {}
        for r in _next_pass(points, dimensions, now):
            narrow(r["node"], now[r["node"]][0], now[r["node"]][1], now[r["node"]][2], r)
    return found


def _split(points: DataFrame, dimensions: list[str], cuts: list[tuple]) -> DataFrame:
    """The points with their node a level further down. ``cuts``: node, dim, cut, tie_cut, shards on the left."""
    table = _local(points.sparkSession, cuts, "node int, dim int, cut double, tie_cut bigint, half int")
    value = f"element_at(array({', '.join(f'cast({d} as double)' for d in dimensions)}), dim)"
    placed = points.join(F.broadcast(table), F.col("first") == F.col("node"), "left").withColumn("v", F.expr(value))
    first = F.expr("if(node is null or v < cut or (v = cut and tie <= tie_cut), first, first + half)")
    return placed.withColumn("first", first).select(*points.columns)


def _points(scratch: Scratch, base: DataFrame, dimensions: list[str], most: float) -> tuple[DataFrame, DataFrame]:
    """(points, heavy): a point per group, or ceil(bytes / most) of a heavier one, whose rows are dealt by row number."""
    least = [F.min(d).alias(d) for d in dimensions]
    groups = scratch.save(base.groupBy("__group").agg(F.sum("__w").alias("w"), *least), "groups")
    tie = lambda number: F.shiftleft(F.shiftrightunsigned(F.xxhash64("__group"), 64 - _TIE_BITS + _NUMBER_BITS), _NUMBER_BITS) + number
    # fewer than the whole table's bytes / most of them: shards / GROUP_SHARE rows
    heavy = scratch.save(groups.where(F.col("w") > most).withColumn("numbers", F.ceil(F.col("w") / F.lit(most)).cast("int")), "heavy")
    dealt = base.join(F.broadcast(heavy.select("__group", "numbers")), "__group").groupBy("__group", _number().alias("number")).agg(F.sum("__w").alias("w"))
    several = dealt.join(F.broadcast(heavy.drop("w", "numbers")), "__group")
    one = groups.where(F.col("w") <= most).withColumn("number", F.lit(0))
    columns = ["__group", "number", *dimensions, "w"]
    return scratch.save(one.select(*columns).unionByName(several.select(*columns)).withColumn("tie", tie(F.col("number"))).withColumn("first", F.lit(0)), "points"), heavy


def _number() -> Column:
    """The point of its group that a row belongs to."""
    return F.coalesce(F.pmod(F.xxhash64("__row"), F.col("numbers")), F.lit(0)).cast("int")


def kd_shards(
    rows: DataFrame, dimensions: list[str], weight: str, group: str, ties: list[str],
    shards: int | None = None, target_bytes: int | None = None, precision: float = PRECISION,
) -> DataFrame:
    """Add ``shard`` (0 to n-1) and ``slot`` (gapless from 0 in each shard) to ``rows``.

    ``dimensions`` are numeric columns without nulls; their widths are compared relative to the whole table's.
    Rows with one ``group`` (a long) stay in one shard, unless a median falls inside a group of more than
    GROUP_SHARE of a leaf: at most one group a cut. ``ties`` order a shard's rows. Give ``shards``, or
    ``target_bytes`` of a leaf. An empty table gives no rows.
    """
    spark = rows.sparkSession
    scratch, result = Scratch(spark, "kd"), Scratch(spark, "kd-result")
    named = rows.withColumn("__row", F.monotonically_increasing_id()).withColumn("__group", F.col(group)).withColumn("__w", F.col(weight).cast("long"))
    base = scratch.save(named, "rows")
    ends = [f(d).cast("double").alias(f"{k}_{i}") for i, d in enumerate(dimensions) for k, f in (("lo", F.min), ("hi", F.max))]
    whole = base.agg(F.sum("__w").alias("w"), *ends).first()
    if whole["w"] is None:
        return rows.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long"))
    if shards is None:
        shards = max(1, math.ceil(whole["w"] / target_bytes))
    leaf = whole["w"] / shards
    # of a dimension without extent every point is in bin 0
    extents = [(lo, hi if hi > lo else lo + 1.0) for lo, hi in ((whole[f"lo_{i}"], whole[f"hi_{i}"]) for i in range(len(dimensions)))]
    points, heavy = _points(scratch, base, dimensions, max(1.0, GROUP_SHARE * leaf))

    # a node is the shards [first, first + leaves)
    nodes = {0: shards} if shards > 1 else {}
    while nodes:
        cuts = _medians(points, dimensions, extents, nodes, leaf, precision)
        before, points = points, scratch.save(_split(points, dimensions, [(n, *c, nodes[n] // 2) for n, c in sorted(cuts.items())]), "points")
        scratch.drop(before)
        halves = [h for n in cuts for h in ((n, nodes[n] // 2), (n + nodes[n] // 2, nodes[n] - nodes[n] // 2))]
        nodes = {n: k for n, k in halves if k > 1}

    shard_of = points.select(F.col("__group").alias("g"), "number", F.col("first").alias("shard"))
    numbered = base.join(F.broadcast(heavy.select("__group", "numbers")), "__group", "left").withColumn("__number", _number())
    dealt = numbered.join(shard_of, (F.col("__group") == F.col("g")) & (F.col("__number") == F.col("number")))
    dealt = scratch.save(dealt.select(*rows.columns, "__row", "shard"), "dealt")
    order = ["shard", *ties, "__row"]
    sorted_ = dealt.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    final = result.save(sorted_.drop("__row"), "sorted")
    scratch.clear()
    # a row for each shard in a partition, partitions + shards at most as ranges follow each other
    pid, at = F.shiftright("__id", 33).alias("pid"), F.col("__id").bitwiseAND((1 << 33) - 1)
    parts = final.groupBy("shard", pid).agg(F.count("*").alias("n"), F.min(at).alias("start"))
    earlier = Window.partitionBy("shard").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    shifts = result.save(parts.select("shard", "pid", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("start")).alias("shift")), "shifts")
    return final.withColumn("pid", pid).join(F.broadcast(shifts), ["shard", "pid"]).select(*rows.columns, "shard", (at + F.col("shift")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int | None = 40, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, and the metadata the tree splits on.

    Size is the text's UTF-8 bytes (null: none) plus 16. Dimensions: log2 of the size, source and lang as
    hashed positions (null before all others); a group of equal texts stands at the least of its rows'. Equal
    texts share a shard, unless a median falls inside a group of more than 1/32 of a shard: at most one group
    for each of the 39 cuts. Null and empty texts are equal. Null and repeated doc_ids are rows like any
    other; a very long text is one row, so its shard exceeds the others by up to its size.
    """
    text = text_or_empty("text")
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        hashed_position(F.col("source")).alias("source_at"),
        hashed_position(F.col("lang")).alias("lang_at"),
    ).withColumn("size_at", F.log2(F.col("size").cast("double")))
    done = kd_shards(rows, ["size_at", "source_at", "lang_at"], "size", "text_hash", ["text_crc32", "doc_id"], shards, target_bytes)
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "size_at", "source_at", "lang_at")
