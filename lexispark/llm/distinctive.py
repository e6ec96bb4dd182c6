"""How distinctive a term is of its record: smoothed relative entropy, or smoothed idf."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions.text import let
from lexispark.operators.skew import lookup_join

#: Fixed value: the characters of Unicode's White_Space property.
WHITE_SPACE = "[\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


def white_space_words(text: str) -> Column:
    """The words of a text as stored, parted by Unicode white space; null has none."""
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), WHITE_SPACE), lambda x: x != "")


def word_entries(df: DataFrame, key: str, words: str) -> DataFrame:
    """(rec_id, term, weight, size): every word of a record's array with its occurrences, and the words of the record."""
    rows = df.select(F.col(key).alias("rec_id"), F.size(words).alias("size"), F.explode(words).alias("term"))
    return rows.groupBy("rec_id", "size", "term").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def word_corpus(df: DataFrame, words: str) -> DataFrame:
    """(term, df, cf) over all word arrays, one shuffle: words are sorted within their record, so the first of a kind is seen in place."""
    ordered = df.select(F.array_sort(words).alias("w"))
    flagged = let(F.col("w"), lambda w: F.transform(w, lambda x, i: F.struct(x.alias("term"), F.when((i > 0) & (F.get(w, i - 1) == x), 0).otherwise(1).alias("new"))))
    return ordered.select(F.explode(flagged).alias("x")).groupBy(F.col("x.term").alias("term")).agg(F.sum("x.new").alias("df"), F.count(F.lit(1)).cast("double").alias("cf"))


def corpus_terms(entries: DataFrame) -> DataFrame:
    """(term, df, cf): records that hold the term, and its summed weight."""
    return entries.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("weight").alias("cf"))


def distinctive_terms(
    entries: DataFrame, corpus: DataFrame, records: DataFrame, n: int, scoring: str = "divergence", mu: float = 100.0, min_df: int = 1, share_of_record: bool = True
) -> DataFrame:
    """(rec_id, term, score): the ``n`` terms of highest score per record; of equal scores the smaller term.

    ``entries``: rec_id, term, weight, size of the records to score, one row per record and term. ``corpus``:
    corpus_terms of all records. ``records``: one row with n_records (non-empty ones) and mass (summed weight).
    Records without terms, and null terms, don't come out.

    scoring='divergence': the term's part p·ln(p/q) of the relative entropy between the record's
    Dirichlet-smoothed distribution p = (weight + mu·q) / (size + mu) and the collection's q = cf/mass;
    terms in fewer than ``min_df`` records never rank.
    scoring='idf': weight (over size, if share_of_record) times ln((N+1)/(df+1)) + 1.

    Term statistics meet the entries in a join that serves the most frequent terms (at most 1000) from a
    broadcast, so a term that is in every record doesn't end up in one task.
    """
    joined = lookup_join(entries.where(F.col("term").isNotNull()), corpus.where(F.col("df") >= min_df), "term", "df").crossJoin(F.broadcast(records))
    if scoring == "divergence":
        q = F.col("cf") / F.col("mass")
        p = (F.col("weight") + F.lit(mu) * q) / (F.col("size") + F.lit(mu))
        score = p * F.ln(p / q)
    elif scoring == "idf":
        weight = F.col("weight") / F.col("size") if share_of_record else F.col("weight")
        score = weight * (F.ln((F.col("n_records") + 1) / (F.col("df") + 1)) + 1)
    else:
        raise ValueError(f"unknown scoring {scoring!r}: 'divergence' or 'idf'")
    best = Window.partitionBy("rec_id").orderBy(F.col("score").desc(), F.col("term").asc())
    return joined.select("rec_id", "term", score.alias("score")).withColumn("place", F.row_number().over(best)).where(F.col("place") <= n)


def collection_size(sizes: DataFrame) -> DataFrame:
    """(n_records, mass) of the non-empty records, from one row per record with its ``size``."""
    return sizes.where("size > 0").agg(F.count(F.lit(1)).alias("n_records"), F.coalesce(F.sum("size"), F.lit(0)).cast("double").alias("mass"))
