"""Frequency analysis over token arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frequency(tokens: DataFrame, column: str = "token") -> DataFrame:
    """(token, cnt): one shuffle, counted map-side first. Null tokens are counted as one key."""
    return tokens.groupBy(column).agg(F.count(F.lit(1)).alias("cnt"))


def stop_words(freq: DataFrame, threshold: int) -> DataFrame:
    """Tokens counted at least ``threshold`` times."""
    return freq.where(F.col("cnt") >= threshold)


def without_stop_words(freq: DataFrame, threshold: int) -> DataFrame:
    """Tokens below the threshold: the count decides, so no join is needed."""
    return freq.where(F.col("cnt") < threshold)


def top_frequent(freq: DataFrame, n: int) -> DataFrame:
    """The n most frequent tokens; of equal counts the smaller token. Each task keeps n rows, no full sort."""
    return freq.orderBy(F.col("cnt").desc(), F.col("token").asc()).limit(n)


def corpus_stats(docs: DataFrame, sentences: Column, words) -> DataFrame:
    """One row: paragraphs, sentences, words, distinct words, words per sentence, type/token ratio; zeros where empty.

    ``words`` maps a sentence column to its token array. Sentences without words, and texts without
    sentences, don't count. Distinct words are counted through a shuffle by word, never in one set.
    """
    split = docs.select(F.filter(F.transform(sentences, words), lambda w: F.size(w) > 0).alias("s"))
    sizes = split.where(F.size("s") > 0).agg(
        F.count(F.lit(1)).alias("paragraphs"), F.coalesce(F.sum(F.size("s").cast("long")), F.lit(0)).alias("sentences"), F.coalesce(F.sum(F.size(F.flatten("s")).cast("long")), F.lit(0)).alias("words")
    )
    types = split.select(F.explode(F.flatten("s")).alias("w")).distinct().agg(F.count(F.lit(1)).alias("unique_words"))
    joined = sizes.crossJoin(F.broadcast(types))
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0)), 6)
    return joined.select("paragraphs", "sentences", "words", "unique_words", ratio("words", "sentences").alias("avg_sentence_length"), ratio("unique_words", "words").alias("type_token_ratio"))
