"""Queries: PMI, tf-idf and cosine neighbours over the passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions.text import ngrams as gram_arrays
from lexispark.monitor import memory_usage, watched
from lexispark.operators import vectors as V
from lexispark.plans.language_models import _APP, _G, kept_counts, passages, rounded
from lexispark.plans.registry import query
from lexispark.session import stored

#: Searches take every row whose id is divisible by this as a query, against all rows.
EVERY = 50

_PMI = f"""{_G}, pr AS (SELECT sent_id, i AS pos, toks[i + 1] AS w1, toks[i + 2] AS w2 FROM app, unnest(range(greatest(0, len(toks) - 1))) AS u(i) WHERE split_name = 'test'),
 n1 AS (SELECT sum(cnt) AS n FROM g WHERE n = 1), n2 AS (SELECT sum(cnt) AS n FROM g WHERE n = 2),
 pm AS (SELECT sent_id, pos, w1, w2, coalesce(b.cnt, 0) AS bigram_count, coalesce(x.cnt, 0) AS word1_count, coalesce(y.cnt, 0) AS word2_count,
  CASE WHEN b.cnt > 0 AND x.cnt > 0 AND y.cnt > 0 THEN ln((b.cnt / n2.n::DOUBLE) / ((x.cnt / n1.n::DOUBLE) * (y.cnt / n1.n::DOUBLE))) END AS pmi
  FROM pr CROSS JOIN n1 CROSS JOIN n2 LEFT JOIN g b ON b.gram = [w1, w2] LEFT JOIN g x ON x.gram = [w1] LEFT JOIN g y ON y.gram = [w2])"""


def passage_bigrams(rows: DataFrame) -> DataFrame:
    """(sent_id, pos, w1, w2) inside each passage, with repetitions."""
    return rows.select("sent_id", F.posexplode(gram_arrays(F.col("toks"), 2)).alias("pos", "g")).select("sent_id", "pos", F.element_at("g", 1).alias("w1"), F.element_at("g", 2).alias("w2"))


def _pmi(spark: SparkSession, d: str) -> DataFrame:
    c = kept_counts(spark, d)
    ones = c.where("n = 1").select(F.element_at("gram", 1).alias("word"), "cnt")
    twos = c.where("n = 2").select(F.element_at("gram", 1).alias("w1"), F.element_at("gram", 2).alias("w2"), "cnt")
    return V.bigram_pmi(passage_bigrams(passages(spark, d).where("split_name = 'test'")), ones, twos)


@query(f"{_PMI} SELECT sent_id, pos, w1, w2, bigram_count, word1_count, word2_count, round(pmi, 6) AS pmi FROM pm")
def pmi(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_pmi(spark, d), "pmi", places=6)


@query(f"{_PMI} SELECT DISTINCT w1, w2, bigram_count, round(pmi, 6) AS pmi FROM pm WHERE pmi IS NOT NULL ORDER BY pmi DESC, w1, w2 LIMIT 20")
def pmi_top(spark: SparkSession, d: str) -> DataFrame:
    rows = rounded(_pmi(spark, d).where("pmi IS NOT NULL"), "pmi", places=6).select("w1", "w2", "bigram_count", "pmi").distinct()
    return rows.orderBy(F.col("pmi").desc(), "w1", "w2").limit(20)


_TFIDF = f"""WITH {_APP}, ne AS (SELECT * FROM app WHERE len(toks) > 0),
 tk AS (SELECT sent_id, split_name, len(toks) AS len, unnest(toks) AS term FROM ne),
 voc AS (SELECT DISTINCT term FROM tk WHERE split_name = 'train'),
 tf AS (SELECT sent_id, split_name, term, count(*) / len::DOUBLE AS tf FROM tk JOIN voc USING (term) GROUP BY sent_id, split_name, term, len),
 nd AS (SELECT count(*) AS n FROM ne WHERE split_name = 'train'),
 idf AS (SELECT term, count(*) AS df, ln((any_value(nd.n) + 1) / (count(*) + 1)::DOUBLE) + 1 AS idf FROM tf CROSS JOIN nd WHERE split_name = 'train' GROUP BY term),
 ti AS (SELECT sent_id, split_name, term, tf * idf AS value FROM tf JOIN idf USING (term))"""


def _passages(spark: SparkSession, d: str) -> DataFrame:
    return passages(spark, d).where(F.size("toks") > 0)


def term_frequencies(rows: DataFrame) -> DataFrame:
    """(sent_id, split_name, term, tf) over the vocabulary of the train split."""
    key = rows.select(F.struct("sent_id", "split_name").alias("key"), "toks")
    vocabulary = rows.where("split_name = 'train'").select(F.explode("toks").alias("term")).distinct()
    return V.term_frequency(key, "key", "toks", vocabulary).select("key.sent_id", "key.split_name", "term", "tf")


def tf_idf(spark: SparkSession, d: str) -> DataFrame:
    """(sent_id, split_name, term, value); the vocabulary and the document frequencies are those of the train split."""
    rows = _passages(spark, d)
    keyed = V.term_frequency(rows.select(F.struct("sent_id", "split_name").alias("key"), "toks"), "key", "toks")
    train = rows.where("split_name = 'train'")
    n = train.agg(F.count(F.lit(1)).alias("n"))
    idf = V.inverse_document_frequency(V.term_frequency(train, "sent_id", "toks"), n)
    return V.tf_idf(keyed, idf, "key").select("key.sent_id", "key.split_name", "term", "value")


@query(f"{_TFIDF} SELECT sent_id, term, round(tf, 9) AS tf FROM tf")
def tf(spark: SparkSession, d: str) -> DataFrame:
    return rounded(term_frequencies(_passages(spark, d)).drop("split_name"), "tf")


@query(f"{_TFIDF} SELECT term, df, round(idf, 9) AS idf FROM idf")
def idf(spark: SparkSession, d: str) -> DataFrame:
    rows = _passages(spark, d).where("split_name = 'train'")
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    return rounded(V.inverse_document_frequency(V.term_frequency(rows, "sent_id", "toks"), n), "idf")


@query(f"{_TFIDF} SELECT sent_id, term, round(value, 9) AS value FROM ti")
def tfidf(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tf_idf(spark, d).drop("split_name"), "value")


@query(f"{_TFIDF} SELECT sent_id, term, round(value, 6) AS value, k AS place FROM (SELECT *, row_number() OVER (PARTITION BY sent_id ORDER BY round(value, 9) DESC, term) AS k FROM ti) WHERE k <= 10")
def tfidf_top_terms(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("sent_id").orderBy(F.round("value", 9).desc(), "term"))
    return rounded(tf_idf(spark, d).select("sent_id", "term", "value", place.alias("place")).where("place <= 10"), "value", places=6)


@query(f"{_TFIDF} SELECT split_name, count(*) AS nonzero, round(count(*) / ((SELECT count(*) FROM voc)::DOUBLE * count(DISTINCT sent_id)), 9) AS density FROM tf GROUP BY split_name")
def tfidf_density(spark: SparkSession, d: str) -> DataFrame:
    rows = _passages(spark, d)
    cells = term_frequencies(rows)
    size = cells.where("split_name = 'train'").select("term").distinct().agg(F.count(F.lit(1)).alias("v"))
    return cells.groupBy("split_name").agg(F.count(F.lit(1)).alias("nonzero"), F.countDistinct("sent_id").alias("rows")).crossJoin(F.broadcast(size)).select("split_name", "nonzero", F.round(F.col("nonzero") / (F.col("v").cast("double") * F.col("rows")), 9).alias("density"))


@query(
    f"""WITH {_APP}, t AS (SELECT sent_id, i AS pos, toks[i + 1] AS term FROM app, unnest(range(len(toks))) AS u(i) WHERE split_name = 'train'),
 f AS (SELECT term, min(sent_id * 1000000 + pos) AS pos_key FROM t GROUP BY term) SELECT term, row_number() OVER (ORDER BY pos_key) - 1 AS term_id FROM f"""
)
def first_seen_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return V.first_seen_vocabulary(passages(spark, d).where("split_name = 'train'"), "sent_id", "toks")


_HELD = f"split_name <> 'train' AND sent_id % {EVERY} = 0"
_SELF = f"split_name = 'train' AND sent_id % {EVERY} = 0"


def _knn_sql(asked: str, pool: str, align: bool, itself: bool) -> str:
    """``asked``: the queries. ``pool``: the rows whose terms the train terms are aligned to."""
    b = "SELECT sent_id AS id, term, value FROM ti WHERE split_name = 'train'"
    if align:
        b += f" AND term IN (SELECT term FROM ti WHERE {pool})"
    scored = f"""{_TFIDF}, b0 AS ({b}), q0 AS (SELECT sent_id AS id, term, value FROM ti WHERE {asked}{' AND term IN (SELECT term FROM b0)' if align else ''}),
 bn AS (SELECT id, sqrt(sum(value * value) + 1e-12) AS n FROM b0 GROUP BY id), qn AS (SELECT id, sqrt(sum(value * value) + 1e-12) AS n FROM q0 GROUP BY id),
 sc AS (SELECT q0.id AS query, b0.id AS neighbour, round(sum((q0.value / qn.n) * (b0.value / bn.n)), 6) AS score FROM q0 JOIN qn USING (id) JOIN b0 ON b0.term = q0.term JOIN bn ON bn.id = b0.id GROUP BY 1, 2)"""
    if itself:
        return f"""{scored}, rk AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, neighbour) AS place FROM sc WHERE query <> neighbour AND score > 0)
SELECT query, neighbour, score, place FROM rk WHERE place <= 5"""
    return f"""{scored}, al AS (SELECT q.sent_id AS query, t.sent_id AS neighbour FROM ne q CROSS JOIN ne t WHERE {asked.replace('split_name', 'q.split_name').replace('sent_id', 'q.sent_id')} AND t.split_name = 'train'),
 rk AS (SELECT query, neighbour, coalesce(score, 0.0) AS score, row_number() OVER (PARTITION BY query ORDER BY coalesce(score, 0.0) DESC, neighbour) AS place FROM al LEFT JOIN sc USING (query, neighbour))
SELECT query, neighbour, score, place FROM rk WHERE place <= 5"""


def _train(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    return rows.where("split_name = 'train'").select(F.col("sent_id").alias("id"), "term", "value")


def _held_out(spark: SparkSession, d: str, align: bool) -> DataFrame:
    """Five train neighbours of every asked held-out passage with words; zero scores complete those with fewer overlaps."""
    rows = stored(tf_idf(spark, d))
    asked = rows.where(_HELD).select(F.col("sent_id").alias("id"), "term", "value")
    words = _passages(spark, d)
    ids = words.where(_HELD).select(F.col("sent_id").alias("id"))
    fill = words.where("split_name = 'train'").select(F.col("sent_id").alias("id"))
    return V.cosine_neighbours(asked, _train(spark, d, rows), align=align, vocabulary=rows.where("split_name <> 'train'").select("term"), fill=fill, asked=ids)


@query(_knn_sql(_HELD, "split_name <> 'train'", True, False))
def cosine_knn_aligned(spark: SparkSession, d: str) -> DataFrame:
    """The train terms are first aligned to the terms of all val and test passages, whichever of them are asked."""
    return _held_out(spark, d, True)


@query(_knn_sql(_HELD, "split_name <> 'train'", False, False))
def cosine_knn_full(spark: SparkSession, d: str) -> DataFrame:
    return _held_out(spark, d, False)


@query(_knn_sql(_SELF, "split_name = 'train'", False, True))
def cosine_knn_self(spark: SparkSession, d: str) -> DataFrame:
    rows = stored(tf_idf(spark, d))
    return V.cosine_neighbours(rows.where(_SELF).select(F.col("sent_id").alias("id"), "term", "value"), _train(spark, d, rows), exclude_self=True)


@query(
    f"""{_TFIDF}, b0 AS (SELECT sent_id AS id, term, value FROM ti WHERE split_name = 'train'), q0 AS (SELECT sent_id AS id, term, value FROM ti WHERE split_name <> 'train'),
 bn AS (SELECT id, sqrt(sum(value * value) + 1e-12) AS n FROM b0 GROUP BY id), qn AS (SELECT id, sqrt(sum(value * value) + 1e-12) AS n FROM q0 GROUP BY id),
 sc AS (SELECT sum((q0.value / qn.n) * (b0.value / bn.n)) AS s FROM q0 JOIN qn USING (id) JOIN b0 ON b0.term = q0.term JOIN bn ON bn.id = b0.id GROUP BY q0.id, b0.id),
 k AS (SELECT (SELECT count(*) FROM qn) * (SELECT count(*) FROM bn)::DOUBLE AS pairs, count(*) AS met, sum(s) AS s1, sum(s * s) AS s2, max(s) AS hi, min(s) AS lo FROM sc)
SELECT round(s1 / pairs, 6) AS mean, round(sqrt(greatest(s2 / pairs - (s1 / pairs) * (s1 / pairs), 0)), 6) AS std, round(hi, 6) AS max, round(CASE WHEN met < pairs THEN least(lo, 0) ELSE lo END, 6) AS min FROM k"""
)
def similarity_stats(spark: SparkSession, d: str) -> DataFrame:
    """Over all val and test passages against all train passages that have known terms."""
    rows = stored(tf_idf(spark, d))
    held = rows.where("split_name <> 'train'").select(F.col("sent_id").alias("id"), "term", "value")
    n = lambda x: x.select("id").distinct().agg(F.count(F.lit(1)).alias("n"))
    train = _train(spark, d, rows)
    return rounded(V.similarity_statistics(held, train, n(held), n(train)), "mean", "std", "max", "min", places=6)


@query(
    f"""WITH {_APP}, c AS (SELECT count(*) FILTER (split_name = 'train') AS a, count(*) FILTER (split_name = 'val') AS b, count(*) FILTER (split_name = 'test') AS t FROM app WHERE len(toks) > 0)
SELECT a * a AS train_train, b * a AS val_train, t * a AS test_train, a * a + b * a + t * a AS total FROM c"""
)
def complexity_counters(spark: SparkSession, d: str) -> DataFrame:
    n = lambda s: F.count_if(F.col("split_name") == s)
    c = _passages(spark, d).agg(n("train").alias("a"), n("val").alias("b"), n("test").alias("t"))
    return c.selectExpr("a * a AS train_train", "b * a AS val_train", "t * a AS test_train", "a * a + b * a + t * a AS total")


@query(
    f"""{_TFIDF}, q0 AS (SELECT sent_id AS id, term FROM ti WHERE {_HELD}), df AS (SELECT term, count(*) AS df FROM ti WHERE split_name = 'train' GROUP BY term),
 ct AS (SELECT count(*) FILTER ({_HELD}) AS asked, count(*) FILTER (split_name = 'train') AS train FROM ne)
SELECT asked * train AS pairs_possible, (SELECT count(DISTINCT (q0.id, b.sent_id)) FROM q0 JOIN ti b ON b.term = q0.term AND b.split_name = 'train') AS pairs_met, (SELECT coalesce(sum(df), 0)::BIGINT FROM q0 JOIN df USING (term)) AS products FROM ct"""
)
def operation_counters(spark: SparkSession, d: str) -> DataFrame:
    """What the search of cosine_knn_full really does: pairs possible, pairs with a common term, and products summed for them."""
    rows = stored(tf_idf(spark, d))
    asked, train = rows.where(_HELD), rows.where("split_name = 'train'")
    df = train.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    size = _passages(spark, d).agg(F.count_if(F.expr(_HELD)).alias("q"), F.count_if(F.col("split_name") == "train").alias("b")).selectExpr("q * b AS pairs_possible")
    products = asked.groupBy("term").agg(F.count(F.lit(1)).alias("q")).join(df, "term").agg(F.coalesce(F.sum(F.col("q") * F.col("df")), F.lit(0)).alias("products"))
    long = lambda x: x.select(F.col("sent_id").alias("id"), "term", "value")
    met = V.similarity_moments(long(asked), long(train)).select(F.col("k").alias("pairs_met"))
    return size.crossJoin(F.broadcast(met)).crossJoin(F.broadcast(products))


@query()
def memory_monitor(spark: SparkSession, d: str) -> DataFrame:
    """Memory of the driver and the executors after the passages were read once."""
    with watched("passages"):
        _passages(spark, d).count()
    return memory_usage(spark)
