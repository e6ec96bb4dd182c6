"""Naive Bayes, splits, folds and classification reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions.text import has_exclaim, has_number, has_url, message_tokens, ngrams
from lexispark.operators.ranges import PART_ROWS, range_bounds, range_part, ranked
from lexispark.operators.skew import lookup_join

FLAGS = ("has_url", "has_number", "has_exclaim")


def message_features(docs: DataFrame, text: str) -> DataFrame:
    """The rows with has_url, has_number, has_exclaim and the lower-case bigrams of their tokens."""
    tokens = F.transform(message_tokens(F.col(text)), F.lower)
    flags = {"has_url": has_url, "has_number": has_number, "has_exclaim": has_exclaim}
    return docs.withColumns({name: F.coalesce(f(F.col(text)), F.lit(0)) for name, f in flags.items()}).withColumn("bigrams", ngrams(tokens, 2))


def class_counts(docs: DataFrame, label: str) -> DataFrame:
    """(label, docs, prior, has_url, has_number, has_exclaim) of featured documents; rows without a label don't count."""
    known = docs.where(F.col(label).isNotNull())
    n = known.agg(F.count(F.lit(1)).alias("n"))
    sums = known.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("docs"), *[F.sum(f).alias(f) for f in FLAGS])
    return sums.crossJoin(F.broadcast(n)).select("label", "docs", (F.col("docs") / F.col("n")).alias("prior"), *FLAGS)


def flag_probabilities(classes: DataFrame, k: float = 0.3) -> DataFrame:
    """(label, feature, p): (c + k) / (docs + 2k) that the flag is set."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), ((F.col(f) + F.lit(k)) / (F.col("docs") + F.lit(2 * k))).alias("p")) for f in FLAGS])
    return classes.select("label", F.explode(pairs).alias("x")).select("label", "x.feature", "x.p")


def feature_counts(docs: DataFrame, label: str, features: Column) -> DataFrame:
    """(label, feature, cnt) of array features, with multiplicity."""
    return docs.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.explode(features).alias("feature")).groupBy("label", "feature").agg(F.count(F.lit(1)).alias("cnt"))


def feature_probabilities(counts: DataFrame, k: float) -> DataFrame:
    """(label, feature, cnt, p): (c + k) / (T + k·V), T the features of the label, V the different features of all labels."""
    totals = counts.groupBy("label").agg(F.sum("cnt").alias("total"))
    v = counts.select("feature").distinct().agg(F.count(F.lit(1)).alias("v"))
    return counts.join(F.broadcast(totals), "label").crossJoin(F.broadcast(v)).select("label", "feature", "cnt", ((F.col("cnt") + F.lit(k)) / (F.col("total") + F.lit(k) * F.col("v"))).alias("p"))


def nb_scores(docs: DataFrame, key: str, features: Column, counts: DataFrame, classes: DataFrame, k: float, flags: bool, skip_unknown: bool) -> DataFrame:
    """(key, label, score): ln prior + flag terms + the summed ln p of all features, unknown ones smoothed or skipped.

    Labels are few and broadcast; features meet their counts in one join on the feature, whose counts per label travel
    as one map; frequent features are parted (see lookup_join). ``classes`` comes from class_counts.
    """
    totals = counts.groupBy("label").agg(F.sum("cnt").alias("total"))
    v = counts.select("feature").distinct().agg(F.count(F.lit(1)).alias("v"))
    known = classes.join(F.broadcast(totals), "label", "left").crossJoin(F.broadcast(v)).withColumn("total", F.coalesce("total", F.lit(0)))
    per_feature = counts.groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("label", "cnt"))).alias("m"), F.sum("cnt").alias("w"))
    rows = docs.select(key, F.explode(features).alias("feature")).groupBy(key, "feature").agg(F.count(F.lit(1)).alias("times"))
    met = lookup_join(rows, per_feature, "feature", "w", "inner" if skip_unknown else "left")
    p = (F.coalesce(F.element_at("m", F.col("label")), F.lit(0)) + F.lit(k)) / (F.col("total") + F.lit(k) * F.col("v"))
    sums = met.crossJoin(F.broadcast(known.select("label", "total", "v"))).groupBy(key, "label").agg(F.sum(F.col("times") * F.ln(p)).alias("s"))
    own = docs.select(key, *[F.col(f).alias(f"d_{f}") for f in FLAGS] if flags else [])
    base = own.crossJoin(F.broadcast(known)).join(sums, [key, "label"], "left")
    score = F.ln("prior") + F.coalesce("s", F.lit(0.0))
    if flags:
        for f in FLAGS:
            on = (F.col(f) + F.lit(k)) / (F.col("docs") + F.lit(2 * k))
            score = score + F.ln(F.when(F.col(f"d_{f}") == 1, on).otherwise(1 - on))
    return base.select(key, "label", score.alias("score"))


def best_label(scores: DataFrame, key: str) -> DataFrame:
    """(key, predicted, score): the label of highest score (to 9 places), of equal ones the smaller."""
    ranked = Window.partitionBy(key).orderBy(F.round("score", 9).desc(), F.col("label").asc())
    return scores.withColumn("r", F.row_number().over(ranked)).where("r = 1").select(key, F.col("label").alias("predicted"), "score")


def position(df: DataFrame, order: list[Column]) -> DataFrame:
    """The rows with ``place`` (from 1) in a total order, without one window over all rows.

    Rows are cut into 65,536 parts by the first four digits of the first order column, which must be an evenly spread
    hexadecimal string (a digest); each part is ranked on its own, and the part sizes give the offsets.
    """
    part = F.conv(F.substring(order[0], 1, 4), 16, 10).cast("int")
    return ranked(df.withColumn("__part", part), "__part", order, "place").drop("__part")


def _shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    return position(df, [F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string"))), F.col(key)])


def split_by_ratio(df: DataFrame, key: str, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """The rows with ``part``: train, val or test in a seeded order; sizes are whole parts of the row count."""
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    rows = _shuffled(df, key, seed).crossJoin(F.broadcast(n))
    a, b = F.floor(F.col("__n") * F.lit(train)), F.floor(F.col("__n") * F.lit(val))
    return rows.withColumn("part", F.when(F.col("place") <= a, "train").when(F.col("place") <= a + b, "val").otherwise("test")).drop("place", "__n")


def split_by_count(df: DataFrame, key: str, held_out: int = 1000, seed: int = 42) -> DataFrame:
    """The rows with ``part``: test and val of min(held_out, n/3) rows each, the rest train."""
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    rows = _shuffled(df, key, seed).crossJoin(F.broadcast(n))
    size = F.least(F.lit(held_out).cast("long"), F.floor(F.col("__n") / 3))
    return rows.withColumn("part", F.when(F.col("place") <= size, "test").when(F.col("place") <= 2 * size, "val").otherwise("train")).drop("place", "__n")


def k_folds(df: DataFrame, key: str, k: int = 3, part_rows: int = PART_ROWS) -> DataFrame:
    """(key, fold): contiguous folds of n/k rows in key order, the last takes the rest.

    Places come from ranges at the quantiles of the integer key, ranked on their own and offset by one row per range.
    """
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    marked = df.select(key).withColumn("__part", range_part(F.col(key), range_bounds(df, key, part_rows)))
    placed = ranked(marked, "__part", [F.col(key)], "__place")
    size = F.greatest(F.floor(F.col("__n") / k), F.lit(1))
    return placed.crossJoin(F.broadcast(n)).select(key, F.least(F.floor((F.col("__place") - 1) / size), F.lit(k - 1)).cast("int").alias("fold"))


def classification_report(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: accuracy and macro precision, recall and F1 over the labels present in the truth."""
    cells = rows.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    of_truth = cells.groupBy(F.col("t").alias("label")).agg(F.sum("n").alias("actual"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    of_guess = cells.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("guessed"))
    j = of_truth.join(of_guess, "label", "left").withColumn("guessed", F.coalesce("guessed", F.lit(0)))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    precision, recall = zero(F.try_divide(F.col("tp").cast("double"), F.col("guessed"))), zero(F.try_divide(F.col("tp").cast("double"), F.col("actual")))
    f1 = zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    j = j.withColumn("precision", precision).withColumn("recall", recall).withColumn("f1", f1)
    r = lambda x, name: F.round(x, 6).alias(name)
    return j.agg(r(zero(F.try_divide(F.sum("tp").cast("double"), F.sum("actual"))), "accuracy"), r(F.avg("precision"), "macro_precision"), r(F.avg("recall"), "macro_recall"), r(F.avg("f1"), "macro_f1"))
