"""Queries: byte-pair and WordPiece models of the news texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions.text import SUBWORD_PATTERN, let, merge_pair
from lexispark.operators import subword as S
from lexispark.plans.registry import query
from lexispark.plans.text import documents
from lexispark.session import stored

VOCAB, MERGES = 32_000, 32_000

_W = f"""WITH w AS (SELECT word, count(*) AS freq FROM (SELECT lower(unnest(regexp_extract_all(coalesce(text, ''), '{SUBWORD_PATTERN}'))) AS word FROM documents) GROUP BY 1)"""
_PIECES = """sp AS (SELECT word, freq, i, substr(word, i, j) AS s FROM w, unnest(range(1, length(word) + 1)) AS u(i), unnest(range(1, length(word) - i + 2)) AS v(j)),
 held AS (SELECT s, sum(freq) AS c FROM (SELECT DISTINCT word, freq, s FROM sp) GROUP BY s),
 pc AS (SELECT DISTINCT CASE WHEN i > 1 THEN '##' || s ELSE s END AS piece, s FROM sp),
 ps AS (SELECT piece, c / length(s)::DOUBLE AS score FROM pc JOIN held USING (s))"""


def word_types(spark: SparkSession, d: str) -> DataFrame:
    return S.word_frequencies(documents(spark, d), "text")


@query(f"{_W} SELECT word, freq FROM w")
def subword_word_freq(spark: SparkSession, d: str) -> DataFrame:
    return word_types(spark, d)


@query(f'{_W} SELECT substr(word, i, 1) AS "left", substr(word, i + 1, 1) AS "right", sum(freq)::BIGINT AS freq FROM w, unnest(range(1, length(word))) AS u(i) GROUP BY 1, 2')
def bpe_pair_stats(spark: SparkSession, d: str) -> DataFrame:
    return S.pair_stats(word_types(spark, d))


@query()
def bpe_train(spark: SparkSession, d: str) -> DataFrame:
    return S.bpe_train(stored(word_types(spark, d)), MERGES, vocab_size=VOCAB)


@query()
def bpe_encode(spark: SparkSession, d: str) -> DataFrame:
    """Words and sub-word tokens of every document, encoded where it is read."""
    return S.bpe_token_counts(documents(spark, d), "doc_id", "text", bpe_train(spark, d))


@query(
    f"""{_W}, l AS (SELECT word, list_filter(regexp_split_to_array(word, ''), lambda x: x <> '') AS s FROM w),
 tp AS (SELECT substr(word, i, 1) AS a, substr(word, i + 1, 1) AS b FROM w, unnest(range(1, length(word))) AS u(i) GROUP BY 1, 2 ORDER BY sum(freq) DESC, 1, 2 LIMIT 1),
 hit AS (SELECT word, a, b, len(s) AS n, list_filter(range(1, len(s)), lambda i: s[i] = a AND s[i + 1] = b) AS p FROM l CROSS JOIN tp)
SELECT word, (CASE WHEN a = b THEN (SELECT sum(len(x) // 2) FROM (SELECT unnest(regexp_extract_all(hit.word, '(?:' || regexp_escape(a) || ')+')) AS x))::INTEGER ELSE len(p) END)::INTEGER AS joined,
 (n - CASE WHEN a = b THEN (SELECT sum(len(x) // 2) FROM (SELECT unnest(regexp_extract_all(hit.word, '(?:' || regexp_escape(a) || ')+')) AS x))::INTEGER ELSE len(p) END)::INTEGER AS symbols FROM hit WHERE len(p) > 0"""
)
def bpe_merge_step(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent pair merged in every word type that holds it: merges made, and symbols left."""
    words = stored(word_types(spark, d))
    top = S.pair_stats(words).orderBy(F.col("freq").desc(), "left", "right").select("left", "right").first()
    letters = F.filter(F.split("word", ""), lambda c: c != "")
    if top is None:
        return words.select("word", F.lit(0).alias("joined"), F.lit(0).alias("symbols")).where("false")
    merged = words.select("word", F.size(letters).alias("n"), F.size(merge_pair(letters, top.left, top.right)).alias("symbols"))
    return merged.where("symbols < n").select("word", (F.col("n") - F.col("symbols")).alias("joined"), "symbols")


@query(f"{_W}, {_PIECES} SELECT piece, count(*) AS words FROM (SELECT DISTINCT word, CASE WHEN i > 1 THEN '##' || s ELSE s END AS piece FROM sp) GROUP BY 1")
def wordpiece_pieces(spark: SparkSession, d: str) -> DataFrame:
    return S.word_pieces(word_types(spark, d)).groupBy("piece").agg(F.count(F.lit(1)).alias("words"))


@query(f"{_W}, {_PIECES} SELECT piece, round(score, 6) AS score FROM ps")
def wordpiece_scores(spark: SparkSession, d: str) -> DataFrame:
    return S.piece_scores(word_types(spark, d)).withColumn("score", F.round("score", 6))


@query(
    f"""{_W}, {_PIECES}, ch AS (SELECT DISTINCT substr(word, i, 1) AS piece FROM w, unnest(range(1, length(word) + 1)) AS u(i) UNION SELECT '[UNK]'),
 cd AS (SELECT piece, score, row_number() OVER (ORDER BY score DESC, piece) AS k FROM ps WHERE length(piece) > 1 AND piece NOT IN (SELECT piece FROM ch))
SELECT piece, NULL::DOUBLE AS score FROM ch UNION ALL SELECT piece, round(score, 6) FROM cd WHERE k <= {VOCAB} - (SELECT count(*) FROM ch)"""
)
def wordpiece_vocab(spark: SparkSession, d: str) -> DataFrame:
    return S.wordpiece_vocab(stored(word_types(spark, d)), VOCAB).withColumn("score", F.round("score", 6))


@query()
def wordpiece_encode(spark: SparkSession, d: str) -> DataFrame:
    """Word types of every document's vocabulary with their pieces."""
    words = stored(word_types(spark, d))
    return S.wordpiece_encode(words, S.wordpiece_vocab(words, VOCAB)).select("word", F.array_join("pieces", " ").alias("pieces"))


@query(f"{_W} SELECT word, len(list_distinct(list_transform(range(1, length(word)), lambda i: substr(word, i, 2)))) AS pairs FROM w WHERE length(word) > 1")
def distinct_pairs(spark: SparkSession, d: str) -> DataFrame:
    letters = F.filter(F.split("word", ""), lambda c: c != "")
    pairs = let(letters, lambda s: F.size(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.slice(s, i, 2)))))
    return word_types(spark, d).where(F.length("word") > 1).select("word", pairs.alias("pairs"))
