"""Queries: naive Bayes by language, splits and folds, tagging and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions.text import MESSAGE_PATTERN, message_tokens
from lexispark.operators import classify as C
from lexispark.operators import tagging as H
from lexispark.plans.language_models import _APP, passages, rounded
from lexispark.plans.registry import query
from lexispark.session import stored
from lexispark.sources.tables import latest_once_wide, spread, table

_M = MESSAGE_PATTERN.replace("'", "''")
_MSG = f"""WITH m0 AS (SELECT sent_id, lang AS label, split_name, coalesce(sentence, '') AS s FROM (SELECT *, row_number() OVER (PARTITION BY sent_id ORDER BY ingested_at DESC) AS k FROM application) WHERE k = 1),
 m AS (SELECT sent_id, label, split_name, regexp_matches(s, 'https?://|www\\.')::INT AS has_url, regexp_matches(s, '\\p{{Nd}}')::INT AS has_number, contains(s, '!')::INT AS has_exclaim,
  list_transform(regexp_extract_all(s, '{_M}'), lambda x: lower(x)) AS t FROM m0),
 tr AS (SELECT * FROM m WHERE split_name = 'train' AND label IS NOT NULL), te AS (SELECT * FROM m WHERE split_name = 'test'),
 cl AS (SELECT label, count(*) AS docs, count(*) / (SELECT count(*) FROM tr)::DOUBLE AS prior, sum(has_url)::BIGINT AS has_url, sum(has_number)::BIGINT AS has_number, sum(has_exclaim)::BIGINT AS has_exclaim FROM tr GROUP BY label),
 bc AS (SELECT label, t[i + 1:i + 2] AS f, count(*) AS cnt FROM tr, unnest(range(greatest(0, len(t) - 1))) AS u(i) GROUP BY ALL),
 bt AS (SELECT label, sum(cnt)::BIGINT AS total FROM bc GROUP BY label), bv AS (SELECT count(DISTINCT f) AS v FROM bc),
 uc AS (SELECT label, f, count(*) AS cnt FROM (SELECT label, unnest(t) AS f FROM tr) GROUP BY ALL),
 ut AS (SELECT label, sum(cnt)::BIGINT AS total FROM uc GROUP BY label), uv AS (SELECT count(DISTINCT f) AS v FROM uc)"""
_PRED = f"""{_MSG}, bf AS (SELECT sent_id, t[i + 1:i + 2] AS f, count(*) AS times FROM te, unnest(range(greatest(0, len(t) - 1))) AS u(i) GROUP BY ALL),
 bs AS (SELECT sent_id, cl.label, sum(times * ln((coalesce(bc.cnt, 0) + 0.3) / (coalesce(bt.total, 0) + 0.3 * v))) AS s FROM bf CROSS JOIN cl CROSS JOIN bv LEFT JOIN bt ON bt.label = cl.label LEFT JOIN bc ON bc.label = cl.label AND bc.f = bf.f GROUP BY ALL),
 sc AS (SELECT te.sent_id, te.label AS truth, cl.label, ln(prior) + coalesce(s, 0)
   + ln(CASE WHEN te.has_url = 1 THEN (cl.has_url + 0.3) / (docs + 0.6) ELSE 1 - (cl.has_url + 0.3) / (docs + 0.6) END)
   + ln(CASE WHEN te.has_number = 1 THEN (cl.has_number + 0.3) / (docs + 0.6) ELSE 1 - (cl.has_number + 0.3) / (docs + 0.6) END)
   + ln(CASE WHEN te.has_exclaim = 1 THEN (cl.has_exclaim + 0.3) / (docs + 0.6) ELSE 1 - (cl.has_exclaim + 0.3) / (docs + 0.6) END) AS score
   FROM te CROSS JOIN cl LEFT JOIN bs ON bs.sent_id = te.sent_id AND bs.label = cl.label),
 pd AS (SELECT sent_id, truth, label AS predicted, score FROM (SELECT *, row_number() OVER (PARTITION BY sent_id ORDER BY round(score, 9) DESC, label) AS k FROM sc) WHERE k = 1)"""
K = 0.3


def messages(spark: SparkSession, d: str) -> DataFrame:
    """The passages, once, with flags and bigrams; the language is the class."""
    rows = latest_once_wide(spread(table(spark, d, "application").select("sent_id", "sentence", "lang", "split_name", "ingested_at")), ["sent_id"], ["ingested_at"])
    return C.message_features(rows.withColumn("sentence", F.coalesce("sentence", F.lit(""))), "sentence")


def _words() -> Column:
    return F.transform(message_tokens(F.col("sentence")), F.lower)


def _train(m: DataFrame) -> DataFrame:
    return m.where("split_name = 'train'")


@query(f"{_MSG} SELECT label, docs, round(prior, 9) AS prior, has_url, has_number, has_exclaim FROM cl")
def nb_priors(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.class_counts(_train(messages(spark, d)), "lang"), "prior")


@query(f"{_MSG} SELECT label, unnest(['has_url', 'has_number', 'has_exclaim']) AS feature, round(unnest([(has_url + 0.3) / (docs + 0.6), (has_number + 0.3) / (docs + 0.6), (has_exclaim + 0.3) / (docs + 0.6)]), 9) AS p FROM cl")
def nb_feature_prob(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.flag_probabilities(C.class_counts(_train(messages(spark, d)), "lang"), K), "p")


@query(f"{_MSG} SELECT bc.label, array_to_string(f, ' ') AS feature, cnt, round((cnt + 0.3) / (total + 0.3 * v), 9) AS p FROM bc JOIN bt ON bt.label = bc.label CROSS JOIN bv")
def nb_bigram_prob(spark: SparkSession, d: str) -> DataFrame:
    c = C.feature_counts(_train(messages(spark, d)), "lang", F.col("bigrams"))
    return rounded(C.feature_probabilities(c, K), "p").withColumn("feature", F.array_join("feature", " "))


def _predict(spark: SparkSession, d: str) -> DataFrame:
    m = stored(messages(spark, d).drop("sentence", "ingested_at"))
    test = m.where("split_name = 'test'")
    scores = C.nb_scores(test, "sent_id", F.col("bigrams"), C.feature_counts(_train(m), "lang", F.col("bigrams")), C.class_counts(_train(m), "lang"), K, True, False)
    return C.best_label(scores, "sent_id").join(test.select("sent_id", F.col("lang").alias("truth")), "sent_id")


@query(f"{_PRED} SELECT sent_id, predicted, round(score, 6) AS score FROM pd")
def nb_predict(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_predict(spark, d).drop("truth"), "score", places=6)


@query(
    f"""{_MSG}, uf AS (SELECT sent_id, f, count(*) AS times FROM (SELECT sent_id, unnest(t) AS f FROM te) WHERE f IN (SELECT f FROM uc) GROUP BY ALL),
 us AS (SELECT sent_id, cl.label, sum(times * ln((coalesce(uc.cnt, 0) + 1.0) / (coalesce(ut.total, 0) + v))) AS s FROM uf CROSS JOIN cl CROSS JOIN uv LEFT JOIN ut ON ut.label = cl.label LEFT JOIN uc ON uc.label = cl.label AND uc.f = uf.f GROUP BY ALL),
 sc AS (SELECT te.sent_id, cl.label, ln(prior) + coalesce(s, 0) AS score FROM te CROSS JOIN cl LEFT JOIN us ON us.sent_id = te.sent_id AND us.label = cl.label)
SELECT sent_id, label AS predicted, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY sent_id ORDER BY round(score, 9) DESC, label) AS k FROM sc) WHERE k = 1"""
)
def nb_multinomial(spark: SparkSession, d: str) -> DataFrame:
    m = stored(messages(spark, d).withColumn("words", _words()).drop("sentence", "ingested_at", "bigrams"))
    words = F.col("words")
    scores = C.nb_scores(m.where("split_name = 'test'"), "sent_id", words, C.feature_counts(_train(m), "lang", words), C.class_counts(_train(m), "lang"), 1.0, False, True)
    return rounded(C.best_label(scores, "sent_id"), "score", places=6)


@query(
    f"""{_PRED}, k AS (SELECT * FROM pd WHERE truth IS NOT NULL), l AS (SELECT truth AS label, count(*) AS actual, count(*) FILTER (truth = predicted) AS tp FROM k GROUP BY 1),
 gs AS (SELECT predicted AS label, count(*) AS guessed FROM k GROUP BY 1),
 x AS (SELECT label, actual, tp, CASE WHEN coalesce(guessed, 0) > 0 THEN tp / guessed::DOUBLE ELSE 0 END AS p, tp / actual::DOUBLE AS r FROM l LEFT JOIN gs USING (label))
SELECT round(sum(tp) / sum(actual)::DOUBLE, 6) AS accuracy, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS macro_f1 FROM x"""
)
def classification_report(spark: SparkSession, d: str) -> DataFrame:
    return C.classification_report(_predict(spark, d).where("truth IS NOT NULL"), "truth", "predicted")


_DOCS = "n AS (SELECT count(*) AS n FROM documents), o AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42-' || doc_id), doc_id) AS place FROM documents)"


@query(f"WITH {_DOCS} SELECT doc_id, CASE WHEN place <= floor(n * 0.8) THEN 'train' WHEN place <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS part FROM o CROSS JOIN n")
def split_ratio(spark: SparkSession, d: str) -> DataFrame:
    return C.split_by_ratio(table(spark, d, "documents").select("doc_id"), "doc_id")


@query(f"WITH {_DOCS} SELECT doc_id, CASE WHEN place <= least(1000, n // 3) THEN 'test' WHEN place <= 2 * least(1000, n // 3) THEN 'val' ELSE 'train' END AS part FROM o CROSS JOIN n")
def split_count(spark: SparkSession, d: str) -> DataFrame:
    return C.split_by_count(table(spark, d, "documents").select("doc_id"), "doc_id")


@query("SELECT doc_id, least((row_number() OVER (ORDER BY doc_id) - 1) // ((SELECT count(*) FROM documents) // 3), 2)::INT AS fold FROM documents")
def kfold(spark: SparkSession, d: str) -> DataFrame:
    return C.k_folds(table(spark, d, "documents"), "doc_id")


# -- tagging: no tagged corpus is given, so tags follow the shape of the word -------------------------
_TAG = "CASE WHEN regexp_matches(x, '^[0-9]') THEN 'NUM' WHEN regexp_matches(x, '^[\\x{900}-\\x{97f}]+$') THEN 'DEV' WHEN regexp_matches(x, '^[A-Z]') THEN 'CAP' WHEN regexp_matches(x, '^[a-z]+$') THEN 'LOW' ELSE 'OTH' END"
_HMM = f"""WITH {_APP}, tg AS (SELECT sent_id, toks, list_transform(toks, lambda x: {_TAG}) AS tags FROM app WHERE split_name = 'train' AND len(toks) > 0),
 pa AS (SELECT sent_id, list_concat(list_concat(['<START>'], tags), ['<END>']) AS p FROM tg),
 tr AS (SELECT p[i] AS prev, p[i + 1] AS tag, count(*) AS cnt FROM pa, unnest(range(1, len(p))) AS u(i) GROUP BY ALL),
 em AS (SELECT tag, word, count(*) AS cnt FROM (SELECT unnest(tags) AS tag, unnest(toks) AS word FROM tg) GROUP BY ALL),
 tt AS (SELECT tag, sum(c)::BIGINT AS total FROM (SELECT tag, sum(cnt) AS c FROM em GROUP BY tag UNION ALL SELECT prev, sum(cnt) FROM tr GROUP BY prev) GROUP BY tag),
 st AS (SELECT DISTINCT unnest([prev, tag]) AS tag FROM tr)"""


def tagged(rows: DataFrame) -> DataFrame:
    """(sent_id, words, tags) of the passages with words."""
    shape = lambda x: F.when(x.rlike("^[0-9]"), "NUM").when(x.rlike("^[\\x{900}-\\x{97f}]+$"), "DEV").when(x.rlike("^[A-Z]"), "CAP").when(x.rlike("^[a-z]+$"), "LOW").otherwise("OTH")
    return rows.where(F.size("toks") > 0).select("sent_id", F.col("toks").alias("words"), F.transform("toks", shape).alias("tags"))


def _tagged(spark: SparkSession, d: str, split: str = "train") -> DataFrame:
    return tagged(passages(spark, d).where(F.col("split_name") == split))


@query(f"{_HMM} SELECT a.tag AS prev, b.tag, round((coalesce(cnt, 0) + 1) / (coalesce(total, 0) + (SELECT count(*) FROM st))::DOUBLE, 9) AS p FROM st a CROSS JOIN st b LEFT JOIN tr ON tr.prev = a.tag AND tr.tag = b.tag LEFT JOIN tt ON tt.tag = a.tag WHERE a.tag <> '<END>' AND b.tag <> '<START>'")
def hmm_transitions(spark: SparkSession, d: str) -> DataFrame:
    t = _tagged(spark, d)
    moves = H.hmm_transitions(t)
    return rounded(H.transition_probabilities(moves, H.tag_counts(moves, H.hmm_emissions(t))), "p")


@query(f"{_HMM} SELECT em.tag, word, round((cnt + 1) / (total + (SELECT count(DISTINCT word) FROM em))::DOUBLE, 9) AS p FROM em JOIN tt ON tt.tag = em.tag")
def hmm_emissions(spark: SparkSession, d: str) -> DataFrame:
    t = _tagged(spark, d)
    seen = H.hmm_emissions(t)
    return rounded(H.emission_probabilities(seen, H.tag_counts(H.hmm_transitions(t), seen)), "p")


@query()
def viterbi_decode(spark: SparkSession, d: str) -> DataFrame:
    t = _tagged(spark, d)
    return H.decode(_tagged(spark, d, "test"), "sent_id", "words", stored(H.hmm_transitions(t)), stored(H.hmm_emissions(t)))


@query()
def tagger_cross_validation(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy and macro figures of the tagger, averaged over three contiguous folds."""
    rows = stored(_tagged(spark, d))
    folds = C.k_folds(rows, "sent_id", 3)
    placed = stored(rows.join(folds, "sent_id"))
    reports = []
    for fold in range(3):
        fit, held = placed.where(F.col("fold") != fold), placed.where(F.col("fold") == fold)
        guess = H.decode(held, "sent_id", "words", stored(H.hmm_transitions(fit)), stored(H.hmm_emissions(fit)))
        truth = held.select("sent_id", F.posexplode("tags").alias("pos", "truth"))
        reports.append(C.classification_report(guess.join(truth, ["sent_id", "pos"]), "truth", "tag"))
    both = reports[0].unionByName(reports[1]).unionByName(reports[2])
    return both.agg(*[F.round(F.avg(c), 6).alias(c) for c in both.columns])
