"""Joins and lookups that hold when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds at least 1/HOT_PARTS of all rows; there are at most HOT_PARTS of them.
HOT_PARTS = 1000


def hot_keys(counts: DataFrame, key: str, count: str, parts: int = HOT_PARTS) -> DataFrame:
    """Keys that own at least 1/``parts`` of the summed ``count``: never more than ``parts`` rows.

    The bound is arithmetic (their counts sum to at most the total), so the result may be broadcast.
    """
    total = counts.agg(F.sum(count).alias("__total"))
    return counts.join(F.broadcast(total), F.col(count) * F.lit(parts) >= F.col("__total")).select(key, count)


def salts_of(values: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """(keys, __salts) of the keys that own at least 1/HOT_PARTS of the summed ``weight``: share times HOT_PARTS, rounded up."""
    total = values.agg(F.sum(weight).alias("__total"))
    salts = F.greatest(F.ceil(F.col(weight) * F.lit(HOT_PARTS) / F.col("__total")).cast("int"), F.lit(1))
    return values.join(F.broadcast(total), F.col(weight) * F.lit(HOT_PARTS) >= F.col("__total")).select(*keys, salts.alias("__salts"))


def hot_table(values: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """salts_of as a local table (at most HOT_PARTS rows by arithmetic), for a query that needs it in several joins."""
    found = salts_of(values, keys, weight)
    return values.sparkSession.createDataFrame(found.collect(), found.schema)


def lookup_join(rows: DataFrame, values: DataFrame, key: str | Sequence[str], weight: str | None = None, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """Join ``rows`` to ``values`` (one row per ``key``) without sending a hot key to one task.

    ``values.weight`` says how often a key is expected among the rows (or ``hot``, as salts_of gives it). A key that owns a
    share of the weight is parted into as many salts (share times HOT_PARTS, rounded up): its rows take one by a hash of their
    other columns, its value is repeated for all, so at most 2 * HOT_PARTS rows are added. Each side is read and shuffled once. The
    table of hot keys has at most HOT_PARTS rows and is broadcast. how is 'inner' or 'left'; null keys match
    nothing. Joins on arrays are led by a hash of them, so that sorting compares numbers.
    """
    keys = [key] if isinstance(key, str) else list(key)
    hot = F.broadcast(salts_of(values, keys, weight) if hot is None else hot)
    own = [F.col(f"`{c}`") for c in rows.columns if c not in keys]
    salted = rows.join(hot, keys, "left").withColumn("__salt", F.when(F.col("__salts") > 1, F.pmod(F.xxhash64(F.lit(7), *own), F.col("__salts"))).otherwise(0).cast("int"))
    spread = values.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)))
    lead = [c for c, kind in values.dtypes if c in keys and kind.startswith("array")]
    on = [*keys, "__salt"]
    if lead:
        salted, spread = salted.withColumn("__h", F.xxhash64(*lead)), spread.withColumn("__h", F.xxhash64(*lead))
        on = ["__h", *on]
    return salted.drop("__salts").join(spread.drop("__salts"), on, how).drop("__salt", "__h")


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], right_id: str, rows_per_salt: int = 20_000, parts: int = HOT_PARTS) -> DataFrame:
    """Inner equi-join in which a hot key of the right side is split into salts.

    A key is hot when it holds more than ``rows_per_salt`` right rows and more than 1/``parts`` of all of them, so
    there are at most ``parts`` hot keys and their table is broadcast; it has one salt per that many rows. The
    right row takes the salt of its id, the left row is repeated once per salt; other keys have one salt. Each
    side is shuffled once.
    """
    keys = list(keys)
    counts = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("__total"))
    each = F.greatest(F.lit(rows_per_salt).cast("double"), F.col("__total") / F.lit(parts))
    salts = F.broadcast(counts.crossJoin(F.broadcast(total)).where(F.col("__n") > each).select(*keys, F.ceil(F.col("__n") / each).cast("int").alias("__salts")))
    left2 = left.join(salts, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    right2 = (
        right.join(salts, keys, "left")
        .withColumn("__salt", F.pmod(F.xxhash64(right_id), F.coalesce("__salts", F.lit(1)).cast("bigint")).cast("int"))
        .drop("__salts")
    )
    return left2.join(right2, [*keys, "__salt"], "inner").drop("__salt")
