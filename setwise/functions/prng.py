"""Counter-based randomness: a draw is a hash of seed, purpose and row keys, so it survives any partitioning.

It simulates; with a known seed it hides nothing and is no privacy mechanism.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ColumnLike = Column | str | int


def _column(x: ColumnLike) -> Column:
    return F.lit(x) if isinstance(x, int) else F.col(x) if isinstance(x, str) else x


def digest(seed: int, tag: str, *keys: ColumnLike) -> Column:
    """Hex md5 that orders rows at random; one tag per purpose."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(tag), *[_column(k).cast("string") for k in keys]))


def uniform(seed: int, tag: str, *keys: ColumnLike) -> Column:
    """A uniform draw from [0, 1)."""
    return F.conv(F.substring(digest(seed, tag, *keys), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def digest_sql(seed: int, tag: str, *keys: str) -> str:
    """DuckDB twin of ``digest``."""
    return f"md5(concat_ws('|', '{seed}', '{tag}'{''.join(f', {k}' for k in keys)}))"


def uniform_sql(seed: int, tag: str, *keys: str) -> str:
    """DuckDB twin of ``uniform``."""
    return f"(('0x' || substr({digest_sql(seed, tag, *keys)}, 1, 8))::bigint / 4294967296e0)"


def hash_rank(df: DataFrame, digest_column: str, tie: str, into: str = "rank", digits: int = 3) -> DataFrame:
    """Position (from 1) in the order of a hex digest over the whole table.

    The first digits cut the order into 16^digits ranges of about equal size; ranks are counted inside a
    range and shifted by the sizes of those before: no sort in one task.
    """
    cut = df.withColumn("__range", F.substring(digest_column, 1, digits))
    sizes = cut.groupBy("__range").agg(F.count("*").alias("__n"))
    # 16^digits rows at most
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(digest_column, tie))
    ranked = cut.withColumn("__within", within).join(F.broadcast(before.drop("__n")), "__range")
    return ranked.withColumn(into, F.col("__before") + F.col("__within")).drop("__range", "__within", "__before")
