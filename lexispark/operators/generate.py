"""Text generation from back-off models: a driver loop over few contexts, each step scored over the whole vocabulary."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark.operators.continuations import END, START, Continuations


def _factors(contexts: list[tuple[str, ...]], alphas: DataFrame, max_n: int) -> list[tuple[list[str], int, list[str], float]]:
    """(context, n, ending of n-1 words, product of the back-off weights of all longer endings).

    One look-up of the endings of the contexts; at most contexts · (max_n - 1) rows come back.
    """
    spark = alphas.sparkSession
    endings = {c: [c[len(c) - k :] for k in range(min(len(c), max_n - 1) + 1)] for c in contexts}
    asked = sorted({e for es in endings.values() for e in es if e})
    known: dict[tuple[str, ...], float] = {}
    if asked:
        table = spark.createDataFrame([(list(e),) for e in asked], "history array<string>")
        known = {tuple(r.history): r.alpha for r in alphas.join(F.broadcast(table), "history").select("history", "alpha").collect()}
    out = []
    for c, es in endings.items():
        factor = 1.0
        for e in reversed(es):
            out.append((list(c), len(e) + 1, list(e), factor))
            factor *= known.get(e, 1.0)
    return out


def next_word_probs(contexts: list[tuple[str, ...]], words: DataFrame, model: DataFrame, alphas: DataFrame, vocab: int, max_n: int) -> DataFrame:
    """(context, word, p): every word of the vocabulary and the end sign after every context, normalised.

    ``words`` has one column ``word``. Where all scores are 0 the words are equally likely. A word takes its
    probability from the longest ending of the context it was seen after, times the back-off weights of the longer
    endings; so one pass over the model, met by the few endings of the contexts (a beam: broadcast),
    scores the whole vocabulary. Nothing of the vocabulary is collected.
    """
    spark = words.sparkSession
    factors = F.broadcast(spark.createDataFrame(_factors(contexts, alphas, max_n), "context array<string>, n int, history array<string>, factor double"))
    seen = model.select("n", F.slice("gram", F.lit(1), F.col("n") - 1).alias("history"), F.element_at("gram", -1).alias("word"), "p").join(factors, ["n", "history"])
    options = words.select("word").union(spark.createDataFrame([(END,)], "word string"))
    floor = F.broadcast(factors.where("n = 1").select("context", (F.col("factor") * F.lit(1.0 / max(1, 1000 * vocab))).alias("p")))
    rows = options.crossJoin(floor).select("context", "word", F.lit(0).alias("n"), "p").unionByName(seen.select("context", "word", "n", (F.col("p") * F.col("factor")).alias("p")))
    scored = rows.where(F.col("word") != START).groupBy("context", "word").agg(F.max_by("p", "n").alias("p"))
    totals = scored.groupBy("context").agg(F.sum("p").alias("s"), F.count(F.lit(1)).alias("k"))
    p = F.when(F.col("s") > 0, F.col("p") / F.col("s")).otherwise(F.lit(1.0) / F.col("k"))
    return scored.join(F.broadcast(totals), "context").select("context", "word", p.alias("p"))


def _best(contexts: list[tuple[str, ...]], k: int, words, model, alphas, vocab, max_n, zeros: bool = False) -> dict[tuple[str, ...], list[tuple[str, float]]]:
    """The k best next words per context: k rows per context reach the driver. Without ``zeros`` words of p = 0 may be missing.

    ``model`` may be Continuations, which answers from counts and makes a model only for contexts it can't decide.
    """
    if isinstance(model, Continuations):
        whole = lambda cs: _best(cs, k, *model.whole, max_n)
        return whole(contexts) if zeros else model.best(contexts, k, whole)
    ranked = Window.partitionBy("context").orderBy(F.col("p").desc(), F.col("word").asc())
    rows = next_word_probs(contexts, words, model, alphas, vocab, max_n).withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= k)
    out: dict[tuple[str, ...], list[tuple[str, float]]] = {c: [] for c in contexts}
    for r in sorted(rows.collect(), key=lambda r: r.r):
        out[tuple(r.context)].append((r.word, r.p))
    return out


def greedy(words: DataFrame, model: DataFrame, alphas: DataFrame, vocab: int, max_n: int, max_length: int = 15, min_length: int = 3) -> list[str]:
    """The likeliest word at every step, of equal ones the smaller; the end sign stops once min_length words stand."""
    text: list[str] = []
    keep = max(1, max_n - 1)
    while len(text) < max_length:
        best = _best([tuple(text[-keep:])], 2, words, model, alphas, vocab, max_n)[tuple(text[-keep:])]
        if best and best[0][0] == END:
            if len(text) >= min_length:
                break
            if len(best) < 2:
                best = _best([tuple(text[-keep:])], 2, words, model, alphas, vocab, max_n, zeros=True)[tuple(text[-keep:])]
            best = best[1:]
        if not best:
            break
        text.append(best[0][0])
    return text


def beam(words: DataFrame, model: DataFrame, alphas: DataFrame, vocab: int, max_n: int, max_length: int = 15, width: int = 20) -> list[str]:
    """The text of highest summed ln p that ended, else the best unfinished one; each depth is one scoring join."""
    keep = max(1, max_n - 1)
    live: list[tuple[float, list[str]]] = [(0.0, [])]
    ended: list[tuple[float, list[str]]] = []
    for _ in range(max_length):
        contexts = sorted({tuple(t[-keep:]) for _, t in live})
        best = _best(contexts, width, words, model, alphas, vocab, max_n)
        grown = []
        for score, text in live:
            for word, p in best[tuple(text[-keep:])]:
                if p > 0:
                    (ended if word == END else grown).append((score + math.log(p), text if word == END else [*text, word]))
        live = sorted(grown, key=lambda x: (-x[0], x[1]))[:width]
        if not live:
            break
    pool = ended or live
    return min(pool, key=lambda x: (-x[0], x[1]))[1] if pool else []


def copies(spark, text: list[str], n: int = 100) -> DataFrame:
    """(number, sentence): the same text n times."""
    return spark.range(n).select(F.col("id").alias("number"), F.lit(" ".join(text)).alias("sentence"))
