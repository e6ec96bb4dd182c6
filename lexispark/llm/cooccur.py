"""Items that appear together: basket collapsing and association scores."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.operators.skew import lookup_join
from lexispark.session import checkpointed, stored

#: Items of a basket are paired block by block, so a large basket becomes many small rows.
BLOCK = 64
#: Baskets of more useful items than this are looked up, not enumerated, where they are too few to make a pair count.
GIANT = 512


def baskets(df: DataFrame, record: str, items: list[str]) -> DataFrame:
    """(record, item) once each. Rows without a record, and null items, are left out."""
    words = df.where(F.col(record).isNotNull()).select(F.col(record).alias("rec"), F.explode(F.array(*items)).alias("item"))
    return words.where(F.col("item").isNotNull()).distinct()


def collapsed(members: DataFrame) -> DataFrame:
    """(rec, n, weight): one record of every kind of basket, its size, and how many records have the same items.

    Baskets are compared by their size and 128 bits of hash that don't depend on order, summed up from their rows, so no
    basket of any size is gathered for that. ``members``: rec, item, once each.
    """
    digest = [F.bit_xor(F.xxhash64("item")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "item")).alias("b")]
    kinds = members.groupBy("rec").agg(F.count(F.lit(1)).alias("n"), *digest).where("n > 1")
    return kinds.groupBy("n", "a", "b").agg(F.min("rec").alias("rec"), F.count(F.lit(1)).alias("weight")).select("rec", "n", "weight")


def _enumerated(members: DataFrame) -> DataFrame:
    """(word_lo, word_hi, n_both) of the pairs of all baskets. ``members``: rec, item, n, weight.

    The items of a basket fall into blocks of about BLOCK by hash, and two blocks meet in a tile: a basket of one block is one tile, a
    larger one many small ones, wherever its record would have put it. Pairs are summed map-side.
    """
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    own = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("item"), F.col("blocks").cast("long")).cast("int"))
    placed = own.select("rec", "item", "weight", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tile = placed.repartition("rec", F.least("own", "other"), F.greatest("own", "other")).groupBy("rec", "weight", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")).agg(
        F.sort_array(F.collect_list(F.when(F.col("own") <= F.col("other"), F.col("item")))).alias("left"), F.collect_list(F.when(F.col("own") > F.col("other"), F.col("item"))).alias("right")
    )
    first = tile.select("weight", "a", "b", "left", "right", F.posexplode("left").alias("i", "x"))
    rest = F.when(F.col("a") == F.col("b"), F.slice("left", F.col("i") + 2, F.size("left"))).otherwise(F.col("right"))
    pairs = first.select("weight", "x", F.explode(rest).alias("y"))
    return pairs.groupBy(F.least("x", "y").alias("word_lo"), F.greatest("x", "y").alias("word_hi")).agg(F.sum("weight").alias("n_both"))


def _with_giants(counted: DataFrame, giants: DataFrame, missing: int) -> DataFrame:
    """Pair counts of the other baskets with those of the giant ones added, for pairs that lack at most ``missing``.

    ``giants``: rec, item, n, weight. A pair that counts stands in min_together less all giants of the other baskets at least,
    so only those candidates are looked up among the giants' items, and no pair is ever enumerated there.
    """
    lo, hi = giants.select("rec", "weight", F.col("item").alias("word_lo")), giants.select("rec", F.col("item").alias("word_hi"))
    candidates = counted.where(F.col("n_both") >= missing)
    met = candidates.join(lo, "word_lo").join(hi, ["rec", "word_hi"]).groupBy("word_lo", "word_hi").agg(F.sum("weight").alias("more"))
    return candidates.join(met, ["word_lo", "word_hi"], "left").select("word_lo", "word_hi", (F.col("n_both") + F.coalesce("more", F.lit(0))).alias("n_both"))


def pair_scores(df: DataFrame, record: str, items: list[str], min_together: int = 8, min_pmi: float = 2.0) -> DataFrame:
    """Pairs lo < hi that share at least ``min_together`` records with ln lift >= ``min_pmi``.

    Columns: word_lo, word_hi, n_lo, n_hi, n_both, n_records, pmi, lift, conviction (of lo => hi; null where
    lo never comes without hi). A record counts if it has an id, even if all its items are
    null; repeated rows count once. Empty input gives no rows.

    Every item is first held against two bounds no pair can beat: n(x,y) <= n(x), and
    n(x,y)·N/(n(x)·n(y)) <= N/max(n(x), n(y)); items below min_together or above N·e^-min_pmi records therefore
    leave the baskets without changing the result. Equal baskets of any size collapse to one with a weight (see collapsed); its
    pairs are enumerated once, as numbers in tiles of about 64 x 64 items, and summed map-side. A few baskets of more
    than GIANT items (fewer than min_together records) are looked up instead: see _with_giants.
    """
    member = stored(baskets(df, record, items))
    n_records = df.where(F.col(record).isNotNull()).select(record).distinct().agg(F.count(F.lit(1)).alias("n_records"))
    counts = member.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    useful = counts.join(F.broadcast(n_records), (F.col("n") >= min_together) & (F.col("n") <= F.col("n_records") * F.lit(math.exp(-min_pmi)) * F.lit(1 + 1e-9)))
    useful = checkpointed(useful.select("item", "n", F.monotonically_increasing_id().alias("id")))  # numbers are fixed by the checkpoint
    kept = stored(lookup_join(member, useful, "item", "n").select("rec", F.col("id").alias("item")))
    kinds = stored(collapsed(kept))
    in_giants = kinds.where(F.col("n") > GIANT).agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    # giants that can't make a pair count on their own are looked up; all other baskets, of any size, are enumerated
    looked_up = 0 < in_giants < min_together
    counted = _enumerated(kept.join(kinds.where(F.col("n") <= GIANT) if looked_up else kinds, "rec"))
    if looked_up:
        counted = _with_giants(counted, kept.join(kinds.where(F.col("n") > GIANT), "rec"), min_together - in_giants)
    pairs = counted.where(F.col("n_both") >= min_together)
    side = lambda s: useful.select(F.col("id").alias(f"word_{s}"), F.struct(F.col("item").alias("w"), "n").alias(s))
    named = pairs.join(side("lo"), "word_lo").join(side("hi"), "word_hi").select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi"), "n_both")
    flat = named.select(F.col("lo.w").alias("word_lo"), F.col("hi.w").alias("word_hi"), F.col("lo.n").alias("n_lo"), F.col("hi.n").alias("n_hi"), "n_both")
    lift = F.col("n_both") * F.col("n_records") / (F.col("n_lo").cast("double") * F.col("n_hi"))
    return (
        flat.crossJoin(F.broadcast(n_records))
        .withColumn("lift", lift)
        .withColumn("pmi", F.ln("lift"))
        .where(F.col("pmi") >= min_pmi)
        .withColumn("conviction", F.try_divide((F.lit(1.0) - F.col("n_hi") / F.col("n_records")), (F.lit(1.0) - F.col("n_both") / F.col("n_lo"))))
        .select("word_lo", "word_hi", "n_lo", "n_hi", "n_both", "n_records", "pmi", "lift", "conviction")
    )
