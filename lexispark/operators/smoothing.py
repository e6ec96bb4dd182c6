"""Additive, Good-Turing and interpolated n-gram models, and sentence scores in log space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.operators.ngrams import digest
from lexispark.operators.skew import hot_table, lookup_join

#: ln of the smallest positive double: a product below it would be 0.
UNDERFLOW = -745.0


def totals(counts: DataFrame) -> DataFrame:
    """(n, total, types, vocab) per order; vocab is the number of unigram types. As many rows as orders, from one scan."""
    per = counts.groupBy("n").agg(F.sum("cnt").alias("total"), F.count(F.lit(1)).alias("types"))
    return per.withColumn("vocab", F.coalesce(F.max(F.when(F.col("n") == 1, F.col("types"))).over(_orders()), F.lit(0)))


def _orders():
    """All rows of a table with one row per order."""
    return Window.partitionBy(F.lit(0))


METHODS = ("add_one", "add_k", "token_type")


def additive_wide(counts: DataFrame, k: float = 0.5) -> DataFrame:
    """(n, gram, cnt, add_one, add_k, token_type): joint probabilities of the n-grams seen, no shuffle of the n-grams.

    The vocabulary is the one of tokens for every order.
    """
    c = counts.join(F.broadcast(totals(counts)), "n")
    return c.select(
        "n", "gram", "cnt",
        ((F.col("cnt") + 1) / (F.col("total") + F.col("vocab"))).alias("add_one"),
        ((F.col("cnt") + F.lit(k)) / (F.col("total") + F.lit(k) * F.col("vocab"))).alias("add_k"),
        (F.lit(1.0) / F.col("types")).alias("token_type"),
    )


def additive(counts: DataFrame, k: float = 0.5) -> DataFrame:
    """(n, gram, cnt, method, p): additive_wide with a row per method."""
    methods = F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("p")) for m in METHODS])
    return additive_wide(counts, k).select("n", "gram", "cnt", F.explode(methods).alias("x")).select("n", "gram", "cnt", "x.method", "x.p")


def summary_report(counts: DataFrame) -> DataFrame:
    """(n, tokens, total_unique_ngrams, vocab_size, techniques): what was counted and smoothed, a row per order."""
    techniques = F.array(*[F.lit(m) for m in METHODS])
    return totals(counts).select("n", F.col("total").alias("tokens"), F.col("types").alias("total_unique_ngrams"), F.col("vocab").alias("vocab_size"), F.array_join(techniques, ", ").alias("techniques"))


def select_model(smoothed: DataFrame, n: int, method: str) -> DataFrame:
    """The table of one order and method; unknown names are an error, not an empty table."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    if n not in (1, 2, 3, 4):
        raise ValueError(f"unknown order {n}")
    return smoothed.where((F.col("n") == n) & (F.col("method") == method))


def sentence_grams(sentences: DataFrame, key: str, tokens: str, orders: list[int]) -> DataFrame:
    """(key, n, place, gram) inside every sentence, cut from windows of the longest order."""
    at = F.sequence(F.lit(1), F.size(tokens))
    windows = sentences.where(F.size(tokens) >= min(orders)).select(key, F.posexplode(F.transform(at, lambda i: F.slice(tokens, i, F.lit(max(orders))))).alias("place", "w"))
    cells = F.array(*[F.when(F.size("w") >= n, F.struct(F.lit(n).alias("n"), F.slice("w", 1, n).alias("gram"))) for n in orders])
    return windows.select(key, "place", F.explode(cells).alias("x")).where("x IS NOT NULL").select(key, "x.n", "place", "x.gram")


def score_sentences(sentences: DataFrame, key: str, tokens: str, model: DataFrame, orders: list[int], values: dict[str, Column], short: float | None = None, hot: DataFrame | None = None) -> DataFrame:
    """(key, n, token_count, grams, one ln p per value) of every sentence with tokens and every order.

    ``model`` (n, gram, ...) meets the n-grams in one left join by digests of 128 bits; each of ``values`` is the probability of
    one n-gram, as an expression of the model's columns (null for n-grams not in it), and is multiplied over the sentence. A sentence
    shorter than n has ln ``short``, or null (probability 0) without it. ``hot`` (see gram_salts) parts frequent n-grams.
    """
    filled = sentences.where(F.size(tokens) > 0)
    rows = _looked_up(sentence_grams(filled, key, tokens, orders).select(key, "n", "gram"), model, hot)
    sums = rows.groupBy(key, "n").agg(F.count(F.lit(1)).alias("grams"), *[F.sum(F.ln(p)).alias(name) for name, p in values.items()])
    # sentences shorter than n have no n-gram: they are known without a join
    size = F.size(tokens)
    lacking = filled.select(key, size.alias("token_count"), F.explode(F.filter(F.array(*[F.lit(n) for n in orders]), lambda n: n > size)).alias("n"))
    none = F.lit(None).cast("double") if short is None else F.ln(F.lit(short))
    first = F.col("n") + F.col("grams") - 1
    whole = sums.select(key, "n", first.cast("int").alias("token_count"), "grams", *values)
    return whole.unionByName(lacking.select(key, "n", "token_count", F.lit(0).cast("long").alias("grams"), *[none.alias(v) for v in values]))


def gram_salts(counts: DataFrame) -> DataFrame:
    """The salts of frequent n-grams (see skew.lookup_join) by their digests."""
    return hot_table(counts.select(*digest("gram", "k"), "cnt"), ["ka", "kb"], "cnt")


def _looked_up(rows: DataFrame, model: DataFrame, hot: DataFrame | None) -> DataFrame:
    """The rows (n, gram, ...) with the columns of the model's n-gram, or nulls; only digests of the n-grams travel."""
    hashed = lambda df: df.select(*[c for c in df.columns if c != "gram"], *digest("gram", "k"))
    left, right = hashed(rows), hashed(model).drop("n")
    return left.join(right, ["ka", "kb"], "left") if hot is None else lookup_join(left, right, ["ka", "kb"], how="left", hot=hot)


def good_turing_counts(nc: DataFrame, threshold: int = 100) -> DataFrame:
    """(n, cnt, nc, c_star): (c+1)·N(c+1)/N(c) up to the threshold where N(c+1) > 0, else c itself."""
    following = nc.select("n", (F.col("cnt") - 1).alias("cnt"), F.col("nc").alias("next_nc"))
    star = F.when((F.col("cnt") <= threshold) & F.col("next_nc").isNotNull(), (F.col("cnt") + 1) * F.col("next_nc") / F.col("nc")).otherwise(F.col("cnt").cast("double"))
    return nc.join(following, ["n", "cnt"], "left").select("n", "cnt", "nc", star.alias("c_star"))


def good_turing_unseen(nc: DataFrame) -> DataFrame:
    """(n, total, types, vocab, c_zero, p_unseen): N1/types shared by max(1, V^n - types) unseen n-grams. ``nc``: n, cnt, nc."""
    n1 = F.max(F.when(F.col("cnt") == 1, F.col("nc")))
    t = nc.groupBy("n").agg(F.sum(F.col("cnt") * F.col("nc")).alias("total"), F.sum("nc").alias("types"), n1.alias("n1"))
    t = t.withColumn("vocab", F.coalesce(F.max(F.when(F.col("n") == 1, F.col("types"))).over(_orders()), F.lit(0)))
    ones = F.coalesce(F.col("n1"), F.lit(1)).cast("double")
    free = F.greatest(F.lit(1.0), F.pow(F.col("vocab").cast("double"), F.col("n")) - F.col("types"))
    return t.select("n", "total", "types", "vocab", (ones / F.col("types")).alias("c_zero"), (ones / (F.col("types") * free)).alias("p_unseen"))


def good_turing(counts: DataFrame, threshold: int = 100) -> tuple[DataFrame, DataFrame]:
    """(model, unseen): n, gram, cnt, p = c*/total; and the row of good_turing_unseen per order.

    Counts above the threshold keep their value, so the table that is looked up has at most ``threshold`` rows per order
    and is broadcast: the many n-grams seen once never meet in one task.
    """
    nc = counts.groupBy("n", "cnt").agg(F.count(F.lit(1)).alias("nc"))
    unseen = good_turing_unseen(nc)
    low = F.broadcast(good_turing_counts(nc, threshold).where(F.col("cnt") <= threshold).drop("nc"))
    star = F.coalesce(F.col("c_star"), F.col("cnt").cast("double"))
    model = counts.join(low, ["n", "cnt"], "left").join(F.broadcast(unseen.select("n", "total")), "n").select("n", "gram", "cnt", (star / F.col("total")).alias("p"))
    return model, unseen


def good_turing_table(counts: DataFrame, rows: int = 99) -> DataFrame:
    """(n, cnt, nc, c_star): the row of unseen n-grams (cnt 0, no nc), then the ``rows`` smallest counts of each order."""
    nc = counts.groupBy("n", "cnt").agg(F.count(F.lit(1)).alias("nc"))
    place = F.row_number().over(Window.partitionBy("n").orderBy("cnt"))
    seen = good_turing_counts(nc).withColumn("place", place).where(F.col("place") <= rows).drop("place")
    zero = good_turing_unseen(nc).select("n", F.lit(0).cast("long").alias("cnt"), F.lit(None).cast("long").alias("nc"), F.col("c_zero").alias("c_star"))
    return zero.unionByName(seen)


def perplexity(scores: DataFrame, by: str = "n") -> DataFrame:
    """(by, sentences, valid, avg_log_p, perplexity): exp of minus the mean ln p per sentence, to 7 digits.

    Sentences whose product underflows or is 0 (null) are left out of the mean. A mean below -709 has infinite perplexity.
    """
    ok = F.when(F.col("log_p") >= UNDERFLOW, F.col("log_p"))
    means = scores.groupBy(by).agg(F.count(F.lit(1)).alias("sentences"), F.count(ok).alias("valid"), F.avg(ok).alias("avg_log_p"))
    return means.withColumn("perplexity", significant(F.exp(-F.col("avg_log_p"))))


def significant(x: Column, digits: int = 6) -> Column:
    """The number to ``digits`` + 1 significant digits."""
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}e", x).cast("double"))


def quad_probabilities(sentences: DataFrame, key: str, tokens: str, model: DataFrame, unseen: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """(key, place, p1..p4) of every 4-gram: the probabilities of its last 1, 2, 3 and 4 words. Short sentences have none."""
    quads = sentence_grams(sentences, key, tokens, [4]).select(key, "place", "gram")
    ends = F.array(*[F.struct(F.lit(n).alias("n"), F.slice("gram", 5 - n, n).alias("gram")) for n in (1, 2, 3, 4)])
    met = _looked_up(quads.select(key, "place", F.explode(ends).alias("x")).select(key, "place", "x.n", "x.gram"), model.select("n", "gram", "p"), hot)
    p = F.coalesce("p", "p_unseen")
    scored = met.join(F.broadcast(unseen.select("n", "p_unseen")), "n")
    return scored.groupBy(key, "place").agg(*[F.max(F.when(F.col("n") == i, p)).alias(f"p{i}") for i in (1, 2, 3, 4)])


def optimise_lambdas(quads: DataFrame, iterations: int = 10) -> list[tuple[float, ...]]:
    """Interpolation weights after every step of expectation-maximisation, from 1/4 each.

    ``quads`` (p1..p4) should be checkpointed: each step is one pass that sends back a single row of four sums. Rows
    whose mixed probability is 0 are passed over; without rows the weights stay.
    """
    weights, trail = (0.25,) * 4, []
    for _ in range(iterations):
        mixed = sum((F.lit(w) * F.col(f"p{i + 1}") for i, w in enumerate(weights)), F.lit(0.0))
        sums = quads.withColumn("m", mixed).where("m > 0").agg(*[F.sum(F.lit(w) * F.col(f"p{i + 1}") / F.col("m")).alias(f"s{i}") for i, w in enumerate(weights)]).first()
        total = sum(x or 0.0 for x in sums)
        if total > 0:
            weights = tuple((x or 0.0) / total for x in sums)
        trail.append(weights)
    return trail


def interpolated(weights: tuple[float, ...]) -> Column:
    """The mixed probability of a 4-gram from p1..p4."""
    return sum((F.lit(w) * F.col(f"p{i + 1}") for i, w in enumerate(weights)), F.lit(0.0))


def lambda_analysis(weights: tuple[float, ...]) -> dict[str, float]:
    """Shares in percent, the strongest order and the entropy of the weights."""
    import math

    best = max(range(4), key=lambda i: weights[i])
    return {**{f"share_{i + 1}": 100 * w for i, w in enumerate(weights)}, "strongest": best + 1, "entropy": -sum(w * math.log(w + 1e-10) for w in weights if w > 0)}


def compare_models(results: DataFrame, mixture: str = "mixed") -> DataFrame:
    """(model, sentences, valid, avg_log_p, perplexity, best, improvement) from perplexity(by='model').

    best is the single model of least perplexity (of equal ones the smaller name); improvement, in the mixture's row
    only, is by how many percent the mixture's perplexity is below that. Models without a valid sentence can't be best.
    """
    single = results.where((F.col("model") != mixture) & F.col("avg_log_p").isNotNull())
    top = single.agg(F.max("avg_log_p").alias("top"), F.min(F.struct((-F.col("avg_log_p")).alias("k"), "model"))["model"].alias("best"))
    gain = F.when(F.col("model") == mixture, F.lit(100.0) * (F.lit(1.0) - F.exp(F.col("top") - F.col("avg_log_p"))))
    return results.crossJoin(F.broadcast(top)).select("model", "sentences", "valid", "avg_log_p", "perplexity", "best", gain.alias("improvement"))
