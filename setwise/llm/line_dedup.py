"""Operator 2, line dedup by distinct-site spread. DataFrame operations only.

Each line's hash gets a HyperLogLog sketch of the sites it occurs on, merged by aggregation. Lines clearly
above ``min_sites`` are boilerplate, lines clearly below are not; those near the threshold get an exact
distinct count. Boilerplate lines are then taken out of every text, whatever their share of it. The pipeline
alone gives a text back that has no line of its own: such a text is a copy, which near-dedup judges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Distinct sites from which a line is boilerplate.
MIN_SITES = 10
#: log2 of the sketches' buckets; their relative standard error follows from it.
SKETCH_LG_K = 12
#: Standard errors around the threshold inside which sites are counted exactly.
NEAR_ERRORS = 4.0
#: Fixed value: characters trimmed from a line's ends before it is compared.
EDGE = " \t\r\x0b\x0c"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(EDGE))


def _hash(line: Column) -> Column:
    return F.xxhash64(_trimmed(line))


def _line_hashes(text: Column) -> Column:
    """Hashes of the lines that aren't blank."""
    return F.transform(F.filter(_lines(text), lambda x: _trimmed(x) != ""), _hash)


def _key(row: Column, text: str) -> Column:
    """Finds a row's boilerplate again. That depends on the text alone: should two texts have one key, both get
    the union of lines that are boilerplate anyway, which changes neither."""
    known = row[text]
    return F.xxhash64(known, F.char_length(known))


def boilerplate_lines(lines: DataFrame, min_sites: int, scratch: Scratch) -> DataFrame:
    """Hashes of the lines on ``min_sites`` sites or more, as the column ``line``. A null site counts for none.

    ``lines``: site, hashes (of one text).
    """
    each = lines.select("site", F.explode(F.array_distinct("hashes")).alias("line"))
    sketches = each.groupBy("line").agg(F.hll_sketch_agg(F.col("site"), F.lit(SKETCH_LG_K)).alias("sketch"))
    spread = sketches.select("line", F.hll_sketch_estimate("sketch").alias("sites"))
    error = NEAR_ERRORS * 1.04 / (1 << SKETCH_LG_K) ** 0.5
    low, high = min_sites * (1 - error) - 1, min_sites * (1 + error) + 1
    candidates = scratch.save(spread.where(F.col("sites") > low), "candidates")
    near = candidates.where(F.col("sites") <= high).select("line")
    exact = each.join(near, "line").groupBy("line").agg(F.count_distinct("site").alias("sites")).where(F.col("sites") >= min_sites)
    return scratch.save(candidates.where(F.col("sites") > high).select("line").unionByName(exact.select("line")), "boilerplate")


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, text: str = "text", site: str = "source", into: str = "lines") -> DataFrame:
    """Add the struct column ``into``: n_lines, n_shared (long), none_own, text (without boilerplate).

    Every boilerplate line goes from every text; blank lines stay. none_own: the text has lines that aren't
    blank, and all are boilerplate. Null texts stay null with no lines; empty texts have no line that counts.
    Ties don't arise: a line goes everywhere or nowhere. Repeated rows and copies are treated alike, null ids
    too. Other columns pass through whatever their names (a row travels as one struct); one already called
    ``into`` is replaced. Very long texts and lines are read whole.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    rows = docs.select(F.struct(*docs.columns).alias("r"))
    # lines are split and hashed once into a slim table, 8 bytes a line; all counting reads that
    hashed = rows.select(F.col("r")[site].alias("site"), _key(F.col("r"), text).alias("key"), _line_hashes(F.col("r")[text]).alias("hashes"))
    hashed = scratch.save(hashed.where(F.size("hashes") > 0), "hashes")
    shared = boilerplate_lines(hashed, min_sites, scratch)
    found = hashed.select("key", F.explode(F.array_distinct("hashes")).alias("line"))
    hits = scratch.save(found.join(shared, "line").groupBy("key").agg(F.collect_set("line").alias("shared")), "hits")
    # merged at every size: the hits grow with the input
    joined = rows.withColumn("key", _key(F.col("r"), text)).join(hits.hint("merge"), "key", "left")
    lines = _lines(F.col("r")[text])
    is_shared = lambda x: (_trimmed(x) != "") & F.array_contains(F.col("shared"), _hash(x))
    n_lines = F.coalesce(F.size(F.filter(lines, lambda x: _trimmed(x) != "")), F.lit(0)).cast("long")
    own = F.when(F.col("shared").isNotNull(), F.filter(lines, lambda x: ~is_shared(x)))
    out = joined.withColumn("n_lines", F.when(F.col("r")[text].isNull(), F.lit(0).cast("long")).otherwise(n_lines)).withColumn("own", own)
    n_shared = F.when(F.col("own").isNull(), F.lit(0)).otherwise(F.size(lines) - F.size("own")).cast("long")
    result = F.struct(
        "n_lines", n_shared.alias("n_shared"), ((F.col("n_lines") > 0) & (n_shared == F.col("n_lines"))).alias("none_own"),
        F.when(F.col("own").isNull(), F.col("r")[text]).otherwise(F.array_join("own", "\n")).alias("text"),
    )
    return out.select(*[F.col("r")[c].alias(c) for c in docs.columns if c != into], result.alias(into))


def line_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: boilerplate lines go from the texts, whatever their share; every row stays. A text without a
    line of its own keeps its lines: it is a copy, and emptied copies would be alike to near-dedup, which judges
    it next. Columns unchanged; n_chars follows the text where that changes."""
    done = remove_boilerplate(docs, into="__lines")
    changed = (F.col("__lines.n_shared") > 0) & ~F.col("__lines.none_own")
    new = {"text": F.when(changed, F.col("__lines.text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.char_length("__lines.text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars"))
    return done.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])
