"""Queries: tokenisation and frequency analysis of the news texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions import text as T
from lexispark.operators import corpus
from lexispark.plans.registry import query
from lexispark.sources.tables import spread, table

_M = T.MESSAGE_PATTERN.replace("'", "''")
_SENTS = f"list_filter(list_transform(regexp_split_to_array(trim(coalesce(text, ''), '{T.EDGE_BLANKS}'), '{T.SENTENCE_END}'), lambda x: trim(x, '{T.EDGE_BLANKS}')), lambda x: x <> '')"
_TOK = "list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')"
_FREQ = f"WITH f AS (SELECT token, count(*) AS cnt FROM (SELECT unnest({_TOK}) AS token FROM documents) GROUP BY 1)"


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", "lang"))


def token_frequency(spark: SparkSession, d: str) -> DataFrame:
    return corpus.frequency(documents(spark, d).select(F.explode(T.blank_tokens(F.col("text"))).alias("token")))


@query(f"SELECT doc_id, i AS sent_idx, s[i + 1] AS sentence FROM (SELECT doc_id, {_SENTS} AS s FROM documents), unnest(range(len(s))) AS u(i)")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.posexplode(T.sentence_split(F.col("text"))).alias("sent_idx", "sentence"))


@query()
def word_tokens(spark: SparkSession, d: str) -> DataFrame:
    """No SQL: DuckDB's regular expressions know no Unicode word borders; tested against Python's."""
    sents = documents(spark, d).select("doc_id", F.posexplode(T.sentence_split(F.col("text"))).alias("sent_idx", "s"))
    return sents.select("doc_id", "sent_idx", F.posexplode(T.word_tokens(F.col("s"))).alias("tok_idx", "token"))


@query(f"SELECT doc_id, i AS tok_idx, t[i + 1] AS token FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_M}') AS t FROM documents), unnest(range(len(t))) AS u(i)")
def message_tokens(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.posexplode(T.message_tokens(F.col("text"))).alias("tok_idx", "token"))


@query(f"SELECT doc_id, i AS tok_idx, lower(t[i + 1]) AS token FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{T.SUBWORD_PATTERN}') AS t FROM documents), unnest(range(len(t))) AS u(i)")
def subword_pretokens(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.posexplode(T.subword_pretokens(F.col("text"))).alias("tok_idx", "token"))


@query(f"SELECT doc_id, {_TOK} AS t, len(t) AS tokens, len(list_distinct(t)) AS types FROM documents".replace(f"{_TOK} AS t, len(t)", f"len({_TOK})").replace("list_distinct(t)", f"list_distinct({_TOK})"))
def blank_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = T.blank_tokens(F.col("text"))
    return documents(spark, d).select("doc_id", F.size(t).alias("tokens"), F.size(F.array_distinct(t)).alias("types"))


@query(
    f"""WITH s AS (SELECT list_filter(list_transform({_SENTS}, lambda x: regexp_extract_all(x, '{_M}')), lambda w: len(w) > 0) AS s FROM documents),
 k AS (SELECT len(s) AS ns, flatten(s) AS w FROM s WHERE len(s) > 0),
 u AS (SELECT count(DISTINCT t) AS n FROM (SELECT unnest(w) AS t FROM k))
SELECT count(*) AS paragraphs, sum(ns)::BIGINT AS sentences, sum(len(w))::BIGINT AS words, any_value(u.n) AS unique_words,
 round(sum(len(w))::DOUBLE / sum(ns), 6) AS avg_sentence_length, round(any_value(u.n)::DOUBLE / sum(len(w)), 6) AS type_token_ratio FROM k CROSS JOIN u"""
)
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return corpus.corpus_stats(documents(spark, d), T.sentence_split(F.col("text")), T.message_tokens)


@query()
def corpus_stats_words(spark: SparkSession, d: str) -> DataFrame:
    """The same over the tokens of word_tokens. No SQL, for the same reason; tested against Python's."""
    return corpus.corpus_stats(documents(spark, d), T.sentence_split(F.col("text")), T.word_tokens)


@query(_FREQ + " SELECT token, cnt FROM f")
def token_freq(spark: SparkSession, d: str) -> DataFrame:
    return token_frequency(spark, d)


@query(_FREQ + " SELECT token, cnt FROM f WHERE cnt >= 100")
def stop_words(spark: SparkSession, d: str) -> DataFrame:
    return corpus.stop_words(token_frequency(spark, d), 100)


@query(_FREQ + " SELECT token, cnt FROM f WHERE cnt < 100 ORDER BY cnt DESC, token LIMIT 100")
def stopword_filtered_top(spark: SparkSession, d: str) -> DataFrame:
    return corpus.top_frequent(corpus.without_stop_words(token_frequency(spark, d), 100), 100)


@query(_FREQ + " SELECT token, cnt FROM f ORDER BY cnt DESC, token LIMIT 100")
def top_tokens(spark: SparkSession, d: str) -> DataFrame:
    return corpus.top_frequent(token_frequency(spark, d), 100)


@query("SELECT doc_id, regexp_matches(text, 'https?://|www\\.')::INT AS has_url, regexp_matches(text, '\\p{Nd}')::INT AS has_number, contains(text, '!')::INT AS has_exclaim FROM documents")
def message_flags(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return documents(spark, d).select("doc_id", T.has_url(t).alias("has_url"), T.has_number(t).alias("has_number"), T.has_exclaim(t).alias("has_exclaim"))
