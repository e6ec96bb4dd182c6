"""The pN_ queries and, where SQL can express them on whole tables, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm import cooccur, distinctive, leakage, lookalike, neighbours, overlap, packing, repetition, sentences, topn, vectors
from lexispark.session import stored
from lexispark.sources.tables import latest_once, latest_once_wide, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query under its own name."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return wrap


# -- problem 2 -------------------------------------------------------------------------------------
_P2_SQL = """
WITH m AS (SELECT DISTINCT rec_id, w FROM (SELECT rec_id, word1 AS w FROM pmi_validation_scores
     UNION ALL SELECT rec_id, word2 FROM pmi_validation_scores) WHERE w IS NOT NULL AND rec_id IS NOT NULL),
 n AS (SELECT count(DISTINCT rec_id) AS n FROM pmi_validation_scores),
 c AS (SELECT w, count(*) AS k FROM m GROUP BY w),
 p AS (SELECT a.w AS word_lo, b.w AS word_hi, count(*) AS k FROM m a JOIN m b ON a.rec_id = b.rec_id AND a.w < b.w
       GROUP BY 1, 2 HAVING count(*) >= 8),
 s AS (SELECT word_lo, word_hi, x.k AS n_lo, y.k AS n_hi, p.k AS n_both, n.n AS n_records,
       p.k * n.n / (x.k::DOUBLE * y.k) AS lift FROM p JOIN c x ON x.w = word_lo JOIN c y ON y.w = word_hi CROSS JOIN n)
"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return cooccur.pair_scores(table(spark, d, "pmi_validation_scores"), "rec_id", ["word1", "word2"])


@query(_P2_SQL + "SELECT word_lo, word_hi FROM s WHERE ln(lift) >= 2")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("word_lo", "word_hi")


@query(
    _P2_SQL
    + """SELECT word_lo, word_hi, n_lo, n_hi, n_both, round(ln(lift), 6) AS pmi, round(lift, 6) AS lift,
 CASE WHEN n_both = n_lo THEN NULL ELSE round((1 - n_hi / n_records::DOUBLE) / (1 - n_both / n_lo::DOUBLE), 6) END AS conviction
 FROM s WHERE ln(lift) >= 2"""
)
def p2_pair_scores(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("word_lo", "word_hi", "n_lo", "n_hi", "n_both", *(F.round(c, 6).alias(c) for c in ("pmi", "lift", "conviction")))


# -- problem 3 -------------------------------------------------------------------------------------
_P3_SQL = """
WITH b AS (SELECT w1, w2, w3, max(p_cond) AS p FROM marathi_trigrams WHERE p_cond > 0 AND p_cond <= 1 AND w3 IS NOT NULL GROUP BY 1, 2, 3),
 r AS (SELECT *, row_number() OVER (PARTITION BY w1, w2 ORDER BY p DESC, w3) AS k FROM b)
"""


def _followers(spark: SparkSession, d: str) -> DataFrame:
    usable = table(spark, d, "marathi_trigrams").where("p_cond > 0 AND p_cond <= 1")
    return topn.top_n_per_group(usable, ["w1", "w2"], "w3", "p_cond", 3)


@query(_P3_SQL + "SELECT w1, w2, w3 FROM r WHERE k <= 3")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _followers(spark, d).select("w1", "w2", "w3")


@query(_P3_SQL + "SELECT w1, w2, w3, p AS p_cond FROM r WHERE k <= 3")
def p3_followers(spark: SparkSession, d: str) -> DataFrame:
    return _followers(spark, d)


# -- problem 1 -------------------------------------------------------------------------------------
@query()
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "application"), "sent_id", "sentence", "ingested_at")


@query()
def p1_sentence_stats(spark: SparkSession, d: str) -> DataFrame:
    """Sentences, and their mean and greatest length, per language."""
    rows = latest_once(table(spark, d, "application").select("sent_id", "lang", "ingested_at"), ["sent_id"], ["ingested_at"])
    length = F.col("end_char") - F.col("start_char")
    return (
        p1_found(spark, d)
        .join(rows.select("sent_id", "lang"), "sent_id")
        .groupBy("lang")
        .agg(F.count(F.lit(1)).alias("sentences"), F.round(F.avg(length), 6).alias("mean_chars"), F.max(length).alias("max_chars"))
    )


# -- problem 7 -------------------------------------------------------------------------------------
_P7_FIELDS = {"hindi_unigrams": "token", "marathi_trigrams": "w1"}


def _script_model(spark: SparkSession, d: str) -> lookalike.ScriptModel:
    """One model over the distinct strings of both fields, so equal prints get one form wherever they are stored."""
    strings = [table(spark, d, name).select(F.col(column).alias("s")) for name, column in _P7_FIELDS.items()]
    return lookalike.train_script_model(strings[0].unionByName(strings[1]).where("s IS NOT NULL").distinct(), "s")


def _forms(spark: SparkSession, d: str, name: str, model: lookalike.ScriptModel) -> DataFrame:
    return lookalike.canonical_forms(table(spark, d, name), _P7_FIELDS[name], model)


@query()
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    model = _script_model(spark, d)
    parts = [
        lookalike.same_print_pairs(_forms(spark, d, name, model), column).select(F.lit(f"{name}.{column}").alias("field_name"), "form_lo", "form_hi")
        for name, column in _P7_FIELDS.items()
    ]
    return parts[0].unionByName(parts[1])


@query()
def p7_canonical_counts(spark: SparkSession, d: str) -> DataFrame:
    """Token counts brought to one form: spellings and summed counts per canonical form."""
    rows = latest_once(table(spark, d, "hindi_unigrams"), ["uni_id"], ["cnt"])
    return (
        rows.join(_forms(spark, d, "hindi_unigrams", _script_model(spark, d)), "token")
        .groupBy("canonical")
        .agg(F.countDistinct("token").alias("spellings"), F.sum("cnt").alias("cnt"))
    )


# -- problem 9 -------------------------------------------------------------------------------------
def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.contained_items(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "heldout_items"), "item_id", "text")


@query()
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


@query()
def p9_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """Per test item: the documents that hold a passage of it, and the greatest share of its windows in one."""
    return _leaks(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.round(F.max(F.col("windows_found") / F.col("item_windows")), 6).alias("greatest_share"))


# -- problem 10 ------------------------------------------------------------------------------------
def _repetition(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetition(table(spark, d, "documents"), "doc_id", "text")


@query()
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The cases are defined by an exact share, which no posterior decides, so none is fitted here; p10_repetition has the posteriors."""
    return repetition.repeated_shares(table(spark, d, "documents"), "doc_id", "text").where("repeated_words >= 0.3 * n_words AND n_words > 0").select("doc_id")


@query()
def p10_repetition(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its share of repeated words and its probability of being repetitive."""
    return _repetition(spark, d).select("doc_id", "n_words", "repeated_words", *(F.round(c, 6).alias(c) for c in ("repeated_share", "posterior")))


# -- problem 6 -------------------------------------------------------------------------------------
def _overlaps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return overlap.split_overlaps(overlap.table_records(table(spark, d, "application"), table(spark, d, "bonus")))


@query()
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.record_pairs(*_overlaps(spark, d)).drop("similarity")


@query()
def p6_overlap_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(*_overlaps(spark, d))


@query()
def p6_weighted_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Held-out vectors and how many train vectors have a cosine of 0.9 or more with them, by their values."""
    return overlap.linked_records(*overlap.weighted_overlaps(vectors.vectors(table(spark, d, "bonus"))))


# -- problem 4 -------------------------------------------------------------------------------------
def _nearest(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest_vectors(vectors.vectors(vectors.once(table(spark, d, "bonus"))))


@query()
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d).select(F.least("vec", "near").alias("vec_lo"), F.greatest("vec", "near").alias("vec_hi")).distinct()


@query()
def p4_nearest(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d)


# -- problem 8 -------------------------------------------------------------------------------------
def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(table(spark, d, "documents"), "doc_id", "text")


@query()
def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


@query()
def p8_fill_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(_packed(spark, d))


# -- problem 5 -------------------------------------------------------------------------------------
def _distinctive_words(spark: SparkSession, d: str, **how) -> DataFrame:
    rows = latest_once_wide(table(spark, d, "application").select("sent_id", "sentence", "lang", "split_name", "ingested_at"), ["sent_id"], ["ingested_at"])
    rows = stored(rows.select("sent_id", "lang", "split_name", distinctive.white_space_words("sentence").alias("words")))
    size = distinctive.collection_size(rows.select(F.size("words").alias("size")))
    asked = distinctive.word_entries(rows.where("lang IN ('hi', 'mr') AND split_name IN ('val', 'test')"), "sent_id", "words")
    return distinctive.distinctive_terms(asked, stored(distinctive.word_corpus(rows, "words")), size, 3, **how)


def _distinctive_columns(spark: SparkSession, d: str, **how) -> DataFrame:
    rows = stored(vectors.vectors(vectors.once(table(spark, d, "bonus"))).select(F.col("vec").alias("rec_id"), "split_name", "cols", "vals"))
    mass = F.aggregate("vals", F.lit(0.0), lambda a, x: a + x)
    entries = rows.select("rec_id", "split_name", mass.alias("size"), F.explode(F.arrays_zip("cols", "vals")).alias("x"))
    entries = entries.select("rec_id", "split_name", "size", F.col("x.cols").alias("term"), F.col("x.vals").alias("weight"))
    size = distinctive.collection_size(rows.select(mass.alias("size")))
    corpus = stored(distinctive.corpus_terms(entries))
    return distinctive.distinctive_terms(entries.where("split_name IN ('val', 'test')"), corpus, size, 1, share_of_record=False, **how)


def _both_kinds(spark: SparkSession, d: str, **how) -> DataFrame:
    words, columns = _distinctive_words(spark, d, **how), _distinctive_columns(spark, d, **how)
    return words.select(F.lit("sentence").alias("kind"), "rec_id", "term", "score", "place").unionByName(
        columns.select(F.lit("vector").alias("kind"), "rec_id", F.col("term").cast("string").alias("term"), "score", "place")
    )


_P5_TABLES = """
WITH a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sent_id ORDER BY ingested_at DESC) AS k FROM application) WHERE k = 1),
 w AS (SELECT sent_id, lang, split_name, list_filter(regexp_split_to_array(coalesce(sentence, ''),
   '[\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'), lambda x: x <> '') AS ws FROM a),
 t AS (SELECT sent_id, lang, split_name, len(ws) AS n, unnest(ws) AS term FROM w),
 e AS (SELECT sent_id, lang, split_name, n, term, count(*) AS tf FROM t GROUP BY ALL),
 c AS (SELECT term, count(*) AS df, sum(tf)::DOUBLE AS cf FROM e GROUP BY 1),
 n AS (SELECT count(*) AS big, sum(len(ws))::DOUBLE AS mass FROM w WHERE len(ws) > 0),
 b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY loaded_at DESC) AS k FROM bonus) WHERE k = 1),
 r AS (SELECT split_name, first_vec + i AS vec, list_slice(data, indptr[i + 1] - indptr[1] + 1, indptr[i + 2] - indptr[1]) AS vs,
   list_slice(indices, indptr[i + 1] - indptr[1] + 1, indptr[i + 2] - indptr[1]) AS cs FROM b, unnest(range(n_rows)) AS u(i)),
 x AS (SELECT split_name, vec, unnest(vs)::DOUBLE AS v, unnest(cs) AS col FROM r),
 y AS (SELECT split_name, vec, col, sum(v) AS v FROM x WHERE NOT isnan(v) AND v <> 0 GROUP BY ALL),
 yc AS (SELECT col, count(*) AS df, sum(v) AS cf FROM y GROUP BY 1), ys AS (SELECT vec, sum(v) AS size FROM y GROUP BY 1),
 yn AS (SELECT count(*) AS big, sum(size) AS mass FROM ys WHERE size > 0)
"""
_P5_SQL = _P5_TABLES + """, s AS (SELECT sent_id, e.term, tf / n::DOUBLE * (ln((big + 1) / (df + 1)::DOUBLE) + 1) AS score FROM e JOIN c USING (term) CROSS JOIN n
       WHERE lang IN ('hi', 'mr') AND split_name IN ('val', 'test')),
 sr AS (SELECT *, row_number() OVER (PARTITION BY sent_id ORDER BY score DESC, term) AS place FROM s),
 vr AS (SELECT vec, col, v * (ln((big + 1) / (df + 1)::DOUBLE) + 1) AS score, row_number() OVER (PARTITION BY vec ORDER BY v * (ln((big + 1) / (df + 1)::DOUBLE) + 1) DESC, col) AS place
       FROM y JOIN yc USING (col) CROSS JOIN yn WHERE split_name IN ('val', 'test'))
SELECT 'sentence' AS kind, sent_id AS rec_id, term FROM sr WHERE place <= 3
UNION ALL SELECT 'vector', vec, col::VARCHAR FROM vr WHERE place = 1
"""
_P5_DIVERGENCE = _P5_TABLES + """, s AS (SELECT sent_id, e.term, cf / mass AS q, (tf + 100 * (cf / mass)) / (n + 100.0) AS p FROM e JOIN c USING (term) CROSS JOIN n
       WHERE lang IN ('hi', 'mr') AND split_name IN ('val', 'test') AND df >= 2),
 sr AS (SELECT *, p * ln(p / q) AS score, row_number() OVER (PARTITION BY sent_id ORDER BY p * ln(p / q) DESC, term) AS place FROM s),
 v0 AS (SELECT y.vec, y.col, cf / mass AS q, (v + 100 * (cf / mass)) / (size + 100.0) AS p FROM y JOIN yc USING (col) JOIN ys USING (vec) CROSS JOIN yn WHERE split_name IN ('val', 'test') AND df >= 2),
 vr AS (SELECT *, p * ln(p / q) AS score, row_number() OVER (PARTITION BY vec ORDER BY p * ln(p / q) DESC, col) AS place FROM v0)
SELECT 'sentence' AS kind, sent_id AS rec_id, term, round(score, 6) AS score, place::INT AS place FROM sr WHERE place <= 3
UNION ALL SELECT 'vector', vec, col::VARCHAR, round(score, 6), place::INT FROM vr WHERE place = 1
"""


@query(_P5_SQL)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _both_kinds(spark, d, scoring="idf").select("kind", "rec_id", "term")


@query(_P5_DIVERGENCE)
def p5_divergence(spark: SparkSession, d: str) -> DataFrame:
    """The same records scored by smoothed language-model divergence, terms of two records and more."""
    return _both_kinds(spark, d, scoring="divergence", min_df=2).withColumn("score", F.round("score", 6))
