"""Back-off models: Katz with Good-Turing discounts, and Kneser-Ney, scored by one join for all orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.operators.ngrams import digest, join_grams
from lexispark.operators.skew import hot_table, lookup_join


def katz_discounts(counts: DataFrame, threshold: int = 5) -> DataFrame:
    """(n, gram, cnt, discounted) of orders 2 and up: (c+1)·N(c+1)/N(c), or c - 0.5 where N(c+1) is 0; above the threshold c.

    The look-up table has at most ``threshold`` rows per order and is broadcast.
    """
    nc = counts.groupBy("n", "cnt").agg(F.count(F.lit(1)).alias("nc"))
    following = nc.select("n", (F.col("cnt") - 1).alias("cnt"), F.col("nc").alias("next_nc"))
    d = F.when(F.col("next_nc").isNotNull(), (F.col("cnt") + 1) * (F.col("next_nc") / F.col("nc"))).otherwise(F.greatest(F.col("cnt") - 0.5, F.lit(0.0)))
    table = F.broadcast(nc.where(F.col("cnt") <= threshold).join(following, ["n", "cnt"], "left").select("n", "cnt", d.alias("low")))
    return counts.where("n > 1").join(table, ["n", "cnt"], "left").select("n", "gram", "cnt", F.coalesce(F.col("low"), F.col("cnt").cast("double")).alias("discounted"))


def _with_history(rows: DataFrame) -> DataFrame:
    """The n-grams of order 2 and more with their history, and digests of both: joins and sums below move numbers, not texts."""
    history = F.slice("gram", F.lit(1), F.col("n") - 1)
    return rows.select("*", history.alias("history"), *digest("gram", "g"), *digest(history, "h"))


def _katz(counts: DataFrame, threshold: int, textbook: bool) -> tuple[DataFrame, DataFrame]:
    total = counts.where("n = 1").agg(F.sum("cnt").alias("total"))
    ones = counts.where("n = 1").crossJoin(F.broadcast(total)).select("n", "gram", *digest("gram", "g"), (F.col("cnt") / F.greatest("total", F.lit(1))).alias("p"))
    rows = _with_history(katz_discounts(counts, threshold))
    base = F.sum("cnt" if textbook else "discounted").cast("double")
    sums = rows.groupBy("ha", "hb", "n").agg(base.alias("base"), F.sum("discounted").alias("mass"), F.first("history").alias("history"))
    p = F.when(F.col("base") > 0, F.col("discounted") / F.col("base")).otherwise(0.0)
    more = rows.drop("history").join(sums.select("ha", "hb", "n", "base"), ["ha", "hb", "n"]).select("n", "gram", "ga", "gb", p.alias("p"))
    seen = F.when(F.col("base") > 0, F.col("mass") / F.col("base")).otherwise(0.0)
    return ones.unionByName(more), sums.select("n", "history", "ha", "hb", F.round(F.greatest(F.lit(1.0) - seen, F.lit(0.0)), 12).alias("alpha"))


def katz_model(counts: DataFrame, threshold: int = 5, textbook: bool = False) -> tuple[DataFrame, DataFrame]:
    """(model, alphas): n, gram, p and n, history, alpha.

    Unigrams are relative frequencies. Higher orders divide the discounted count by the sum of discounted counts of the
    history, which leaves no mass for back-off (alpha is 0 for every seen history); with ``textbook``
    they divide by the history's count, so the discounted mass does reach the lower order. Histories never
    seen have no row and count as alpha 1. alpha is rounded to 12 places.
    """
    model, alphas = _katz(counts, threshold, textbook)
    return model.select("n", "gram", "p"), alphas.select("n", "history", "alpha")


def katz_entries(counts: DataFrame, threshold: int = 5, textbook: bool = False) -> DataFrame:
    """The model and its weights as score_ngrams looks them up."""
    return _numbers(*_katz(counts, threshold, textbook))


def _numbers(model: DataFrame, alphas: DataFrame) -> DataFrame:
    """(back, ka, kb, v): probabilities of n-grams and, where back, weights of histories, by their digests."""
    p = model.select(F.lit(False).alias("back"), F.col("ga").alias("ka"), F.col("gb").alias("kb"), F.col("p").alias("v"))
    return p.unionByName(alphas.select(F.lit(True).alias("back"), F.col("ha").alias("ka"), F.col("hb").alias("kb"), F.col("alpha").alias("v")))


def entries_of(model: DataFrame, alphas: DataFrame) -> DataFrame:
    """The same for tables n, gram, p and n, history, alpha."""
    return _numbers(model.select("*", *digest("gram", "g")), alphas.select("*", *digest("history", "h")))


def kn_discounts(counts: DataFrame) -> DataFrame:
    """(n, d): n1/(n1 + 2·n2) held between 0.5 and 0.95; 0.75 where n1 or n2 is 0. One row per order."""
    c = counts.groupBy("n").agg(F.count_if(F.col("cnt") == 1).alias("n1"), F.count_if(F.col("cnt") == 2).alias("n2"))
    d = F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.least(F.lit(0.95), F.greatest(F.lit(0.5), F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))))).otherwise(0.75)
    return c.select("n", d.alias("d"))


def _kn(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    contexts = counts.where("n = 2").groupBy(F.element_at("gram", 2).alias("w")).agg(F.count(F.lit(1)).alias("contexts"))
    total = contexts.agg(F.sum("contexts").alias("total"))
    word = F.array("w")
    ones = contexts.crossJoin(F.broadcast(total)).select(F.lit(1).alias("n"), word.alias("gram"), *digest(word, "g"), (F.col("contexts") / F.col("total")).alias("p"))
    rows = _with_history(counts.where("n > 1"))
    sums = rows.groupBy("ha", "hb", "n").agg(F.sum("cnt").alias("total"), F.count(F.lit(1)).alias("continuations"), F.first("history").alias("history"))
    discounts = F.broadcast(kn_discounts(counts))
    p = F.greatest(F.col("cnt") - F.col("d"), F.lit(0.0)) / F.col("total")
    higher = rows.drop("history").join(sums.select("ha", "hb", "n", "total"), ["ha", "hb", "n"]).join(discounts, "n").select("n", "gram", "ga", "gb", p.alias("p"))
    return ones.unionByName(higher), sums.join(discounts, "n").select("n", "history", "ha", "hb", (F.col("d") * F.col("continuations") / F.col("total")).alias("alpha"))


def kn_model(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(model, alphas): unigrams by their share of bigram contexts, higher orders max(c - D, 0) / C(history).

    No lower order is mixed into seen n-grams. alpha(history) = D·(different continuations)/C(history).
    """
    model, alphas = _kn(counts)
    return model.select("n", "gram", "p"), alphas.select("n", "history", "alpha")


def kn_entries(counts: DataFrame) -> DataFrame:
    """The model and its weights as score_ngrams looks them up."""
    return _numbers(*_kn(counts))


def word_salts(counts: DataFrame) -> DataFrame:
    """The salts of frequent words (see lookup_join), as n-grams and as histories."""
    words = counts.where("n = 1").select(*digest("gram", "k"), "cnt")
    return hot_table(words, ["ka", "kb"], "cnt").withColumn("back", F.explode(F.array(F.lit(True), F.lit(False))))


def score_ngrams(asked: DataFrame, gram: str, entries: DataFrame, vocab: int, max_n: int, hot: DataFrame | None = None) -> DataFrame:
    """(gram, p) of distinct n-grams: the last max_n words looked up, else alpha(history) times the score of the shorter n-gram.

    Every n-gram asks once for all its endings and for their histories, by digests of 128 bits; one join with the model and the
    weights (``entries``) answers, and one aggregation per n-gram takes the longest ending seen. ``hot`` (word_salts) parts the
    words that very many n-grams share. An unseen unigram has 1/(1000·vocab). Empty and null n-grams don't come out.
    """
    known = asked.select(F.col(gram).alias("g")).where(F.size("g") > 0)
    ends = F.transform(F.sequence(F.lit(1), F.least(F.size("g"), F.lit(max_n))), lambda i: F.slice("g", -i, i))
    ask = lambda e, back, key: F.struct(F.size(e).alias("n"), F.lit(back).alias("back"), *digest(key, "k"))
    pairs = F.concat(F.transform(ends, lambda e: ask(e, False, e)), F.transform(F.filter(ends, lambda e: F.size(e) > 1), lambda e: ask(e, True, F.slice(e, F.lit(1), F.size(e) - 1))))
    wanted = known.select("g", F.explode(pairs).alias("x")).select("g", "x.n", "x.back", "x.ka", "x.kb")
    on = ["back", "ka", "kb"]
    met = wanted.join(entries, on, "left") if hot is None else lookup_join(wanted, entries, on, how="left", hot=hot)
    of = lambda i, back: F.max(F.when((F.col("n") == i) & (F.col("back") == F.lit(back)), F.col("v")))
    cells = [of(i, False).alias(f"p{i}") for i in range(1, max_n + 1)] + [of(i, True).alias(f"a{i}") for i in range(2, max_n + 1)]
    score = F.coalesce("p1", F.lit(1.0 / max(1, 1000 * vocab)))
    for i in range(2, max_n + 1):
        score = F.when(F.size("g") >= i, F.coalesce(f"p{i}", F.coalesce(f"a{i}", F.lit(1.0)) * score)).otherwise(score)
    return met.groupBy("g").agg(*cells).select(F.col("g").alias(gram), score.alias("p"))


def backoff_score(queries: DataFrame, gram: str, model: DataFrame, alphas: DataFrame, vocab: int, max_n: int, hot: DataFrame | None = None) -> DataFrame:
    """The queries with ``p`` (see score_ngrams): distinct n-grams are scored once. Empty or null n-grams have null."""
    scored = score_ngrams(queries.select(gram).distinct(), gram, entries_of(model, alphas), vocab, max_n, hot)
    return join_grams(queries, scored, [gram], "left")
