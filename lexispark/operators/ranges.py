"""Ordered work in parts of like size: ranges cut at the quantiles of an integer key, never by its values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one range.
PART_ROWS = 100_000
#: Ranges at most; beyond it they grow with the table.
MOST_PARTS = 65_536


def range_bounds(df: DataFrame, key: str, part_rows: int = PART_ROWS) -> list[int]:
    """Keys that cut the rows into ranges of about ``part_rows``: one scan of the key alone, merged from sketches.

    At most MOST_PARTS - 1 numbers reach the driver; none for tables of one range. Null keys don't count. Rows of one
    key are never parted.
    """
    known = df.select(F.col(key).cast("long").alias("k")).where("k IS NOT NULL")
    n = known.count()
    parts = min(MOST_PARTS, -(-n // part_rows))
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    cuts = known.agg(F.percentile_approx("k", shares, 20 * parts).alias("q")).first().q
    return sorted(set(cuts))


def range_part(key: Column, bounds: list[int]) -> Column:
    """The number of bounds below the key: a search by halves in an array literal, no join."""
    if not bounds:
        return F.lit(0)
    table = F.array(*[F.lit(b).cast("long") for b in bounds]) if len(bounds) < 64 else F.from_json(F.lit(str(bounds)), "array<bigint>")
    step = 1 << (len(bounds).bit_length() - 1)
    steps = []
    while step:
        steps.append(step)
        step >>= 1
    forward = lambda at, s: F.when((at + s <= len(bounds)) & (F.get(table, at + s - 1) < key), at + s).otherwise(at)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), forward)


def ranked(df: DataFrame, part: str, order: list[Column], place: str) -> DataFrame:
    """The rows with ``place`` (from 1) in the order of ``part``, then ``order``: parts are ranked on their own and offset by one row per part.

    The part numbers must rise with the order; there are few of them, so their table is broadcast.
    """
    sizes = df.groupBy(part).agg(F.count(F.lit(1)).alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(part, before.alias("__before"))
    rank = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return df.join(F.broadcast(offsets), part).withColumn(place, F.col("__before") + rank).drop("__before")
