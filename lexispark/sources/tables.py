"""Table access: one parquet per table, and 'delivered twice counts once'."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows of a table that is read in fewer tasks than there are cores (a small file), dealt out to all cores.

    Larger tables come in more tasks than cores and stay where they are read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def latest_once(df: DataFrame, keys: Sequence[str], latest: Sequence[str]) -> DataFrame:
    """One row per key: the one delivered last.

    Of rows with equal ``latest`` columns the one with the greatest remaining columns wins, so
    the choice does not depend on partitioning. Rows with a null key can't be known as copies: they collapse
    only if they are equal in every column. Empty input gives empty output. The
    rank filter is pushed below the shuffle (WindowGroupLimit), so copies collapse map-side.
    """
    name = "__rank_of_delivery"
    others = [c for c, kind in df.dtypes if c not in keys and c not in latest and not kind.startswith("map")]
    order = [F.col(c).desc_nulls_last() for c in [*latest, *others]]
    unknown = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    own = F.when(unknown, F.xxhash64(*[F.col(c) for c in [*keys, *latest, *others]]))
    window = Window.partitionBy(*keys, own).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) == 1).drop(name)


#: Bits of the table of suspects in latest_once_wide.
SUSPECT_BITS = 1 << 22


def latest_once_wide(df: DataFrame, keys: Sequence[str], latest: Sequence[str]) -> DataFrame:
    """latest_once for wide rows of which few are delivered more than once: texts stay where they are read.

    The keys alone are counted first. Those seen more than once mark a bitmap of fixed size (at most
    SUSPECT_BITS/64 rows, broadcast whatever the table's size); rows outside it are known to be
    single and pass through, the others go through latest_once. A full bitmap would only send more rows there.
    """
    bit = F.pmod(F.xxhash64(*keys), F.lit(SUSPECT_BITS))
    word = (bit / 64).cast("int")
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1)
    table = repeated.select(word.alias("__word"), bit.alias("__bit")).groupBy("__word").agg(F.bit_or(F.expr("shiftleft(1L, cast(__bit % 64 as int))")).alias("__bits"))
    marked = df.withColumn("__word", word).withColumn("__bit", bit).join(F.broadcast(table), "__word", "left")
    suspect = F.coalesce(F.expr("(shiftrightunsigned(__bits, cast(__bit % 64 as int)) & 1L) = 1L"), F.lit(False))
    single = marked.where(~suspect).select(*df.columns)
    return single.unionByName(latest_once(marked.where(suspect).select(*df.columns), keys, latest))
