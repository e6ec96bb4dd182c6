"""PMI, tf-idf and cosine neighbours over long (doc, term, value) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark.operators.blocks import BLOCK_ENTRIES, in_blocks, moments, nearest
from lexispark.operators.ranges import PART_ROWS, range_bounds, range_part, ranked
from lexispark.operators.skew import lookup_join
from lexispark.session import stored


def bigram_pmi(pairs: DataFrame, unigrams: DataFrame, bigrams: DataFrame) -> DataFrame:
    """pairs (w1, w2, ...) with counts and pmi = ln((c12/N2) / ((c1/N1)(c2/N1))); null where a count is missing or 0.

    unigrams: word, cnt. bigrams: w1, w2, cnt. The counts meet the pairs in three shuffled joins that part frequent words.
    """
    n1 = unigrams.agg(F.sum("cnt").alias("n1"))
    n2 = bigrams.agg(F.sum("cnt").alias("n2"))
    c = lambda s: unigrams.select(F.col("word").alias(f"w{s}"), F.col("cnt").alias(f"c{s}"))
    counted = lookup_join(pairs, bigrams.select("w1", "w2", F.col("cnt").alias("c12")), ["w1", "w2"], "c12", "left")
    joined = lookup_join(lookup_join(counted, c(1), "w1", "c1", "left"), c(2), "w2", "c2", "left")
    full = joined.crossJoin(F.broadcast(n1)).crossJoin(F.broadcast(n2))
    ratio = (F.col("c12") / F.col("n2")) / ((F.col("c1") / F.col("n1")) * (F.col("c2") / F.col("n1")))
    known = (F.col("c12") > 0) & (F.col("c1") > 0) & (F.col("c2") > 0)
    zero = lambda x: F.coalesce(x, F.lit(0))
    return full.select(*pairs.columns, zero("c12").alias("bigram_count"), zero("c1").alias("word1_count"), zero("c2").alias("word2_count"), F.when(known, F.ln(ratio)).alias("pmi"))


def term_frequency(docs: DataFrame, key: str, tokens: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """(key, term, tf): count over all tokens of the document; terms outside ``vocabulary`` (term) are left out afterwards."""
    rows = docs.select(key, F.size(tokens).alias("len"), F.explode(tokens).alias("term"))
    tf = rows.groupBy(key, "len", "term").agg(F.count(F.lit(1)).alias("c")).select(key, "term", (F.col("c") / F.col("len")).alias("tf"))
    return tf if vocabulary is None else tf.join(vocabulary.select("term"), "term", "left_semi").select(key, "term", "tf")


def inverse_document_frequency(tf: DataFrame, documents: DataFrame) -> DataFrame:
    """(term, df, idf): ln((N+1)/(df+1)) + 1. ``documents`` is one row with n."""
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(documents)).select("term", "df", (F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def tf_idf(tf: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """(key, term, value); terms without an idf drop out. idf: term, df, idf."""
    met = lookup_join(tf.select(key, "term", "tf"), idf.select("term", "idf", "df"), "term", "df")
    return met.select(key, "term", (F.col("tf") * F.col("idf")).alias("value"))


def first_seen_vocabulary(docs: DataFrame, key: str, tokens: str, part_rows: int = PART_ROWS) -> DataFrame:
    """(term, term_id): ids in the order in which terms first appear.

    Terms are ranked within ranges cut at the quantiles of the key, and ranges are offset by the running number of terms, so no
    window holds all terms, however the keys are spread.
    """
    first = docs.select(key, F.posexplode(tokens).alias("pos", "term")).groupBy("term").agg(F.min(F.struct(F.col(key).alias("k"), "pos")).alias("at"))
    parted = first.withColumn("part", range_part(F.col("at.k"), range_bounds(docs, key, part_rows)))
    return ranked(parted, "part", [F.col("at")], "place").select("term", (F.col("place") - 1).alias("term_id"))


def normalised(vectors: DataFrame, key: str) -> DataFrame:
    """(key, term, value) scaled by sqrt(sum of squares + 1e-12)."""
    norms = vectors.groupBy(key).agg(F.sqrt(F.sum(F.col("value") * F.col("value")) + F.lit(1e-12)).alias("norm"))
    return vectors.join(norms, key).select(key, "term", (F.col("value") / F.col("norm")).alias("value"))


def cosine_neighbours(
    queries: DataFrame, base: DataFrame, k: int = 5, align: bool = False, exclude_self: bool = False, fill: DataFrame | None = None,
    vocabulary: DataFrame | None = None, asked: DataFrame | None = None, block_entries: int = BLOCK_ENTRIES,
) -> DataFrame:
    """(query, neighbour, score, place): the k most similar documents; of equal (rounded) scores the smaller id.

    Both sides are (id, term, value). align=True first drops, on the base side, every term outside ``vocabulary`` (term),
    which changes the norms. It has the terms of all rows the queries are taken from; without it, those of the queries. exclude_self leaves out the query itself and scores of 0. ``fill`` (ids
    of base documents) completes the queries (``asked``: id, also those without terms) that have fewer than k
    overlapping documents by zero scores in id order: the first 2k ids are enough for that.

    Blocks of queries meet blocks of documents (see blocks.in_blocks); each pair of blocks sends on k rows a query.
    """
    if align:
        used = queries if vocabulary is None else vocabulary
        base = base.join(used.select("term").distinct(), "term", "left_semi")
        queries = queries.join(base.select("term").distinct(), "term", "left_semi")
    found = in_blocks(queries, base, nearest(k, exclude_self), "query long, neighbour long, score double", block_entries)
    ranked = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("neighbour").asc())
    best = found.withColumn("score", F.round("score", 6)).withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= k)
    if fill is not None and not exclude_self:
        best = stored(best)
        spare = fill.select(F.col("id").alias("neighbour")).orderBy("neighbour").limit(2 * k)
        known = (queries if asked is None else asked).select(F.col("id").alias("query")).distinct()
        zeros = known.crossJoin(F.broadcast(spare)).join(best.select("query", "neighbour"), ["query", "neighbour"], "left_anti")
        both = best.drop("place").unionByName(zeros.withColumn("score", F.lit(0.0)))
        best = both.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= k)
    return best


def similarity_moments(queries: DataFrame, base: DataFrame, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """One row over the pairs with a common term: how many (k), the sums of cosines and squares, the greatest and the least."""
    made = in_blocks(queries, base, moments, "k long, s1 double, s2 double, hi double, lo double", block_entries)
    return made.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("k"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.max("hi").alias("hi"), F.min("lo").alias("lo"))


def similarity_statistics(queries: DataFrame, base: DataFrame, n_queries: DataFrame, n_base: DataFrame, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """One row: mean, population deviation, greatest and least cosine over all query-document pairs, zeros included.

    Pairs are made and summed in blocks; those without a common term enter through the counts of both sides.
    """
    sums = similarity_moments(queries, base, block_entries)
    pairs = (F.col("nq") * F.col("nb")).cast("double")
    mean = F.try_divide(F.coalesce(F.col("s1"), F.lit(0.0)), pairs)
    out = sums.crossJoin(F.broadcast(n_queries.select(F.col("n").alias("nq")))).crossJoin(F.broadcast(n_base.select(F.col("n").alias("nb"))))
    return out.select(
        mean.alias("mean"),
        F.sqrt(F.greatest(F.try_divide(F.coalesce(F.col("s2"), F.lit(0.0)), pairs) - mean * mean, F.lit(0.0))).alias("std"),
        F.coalesce(F.greatest("hi", F.when(F.col("k") < pairs, 0.0)), F.lit(0.0)).alias("max"),
        F.coalesce(F.least("lo", F.when(F.col("k") < pairs, 0.0)), F.lit(0.0)).alias("min"),
    )
