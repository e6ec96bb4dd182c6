"""Queries: automata, plural analysis, affix rules and trie stemming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions import text as T
from lexispark.operators import morphology as M
from lexispark.plans.registry import query
from lexispark.plans.text import documents, token_frequency

_TYPES = "WITH t AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')) AS word FROM documents)"
_WORDS = "WITH w AS (SELECT word, count(*) AS cnt FROM (SELECT lower(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+'))) AS word FROM documents) GROUP BY 1)"
_LIST = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_IRREGULAR = "CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in T.IRREGULAR_PLURALS.items()) + " END"
_PREFIX = "CASE " + " ".join(f"WHEN starts_with(word, '{p}') AND length(word) > {len(p) + 1} THEN '{p}'" for p in T.PREFIXES) + " END"
_SUFFIX = "CASE " + " ".join(f"WHEN ends_with(word, '{s}') AND length(word) > {len(s) + 1} THEN '{s}'" for s in T.SUFFIXES) + " END"
#: Fixed value: branches a trie node must have to be a place to split at.
BRANCHES = 15


def english_words(spark: SparkSession, d: str) -> DataFrame:
    words = documents(spark, d).select(F.explode(F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), F.lit(0)), F.lower)).alias("word"))
    return M.word_counts(words, "word")


@query(_TYPES + " SELECT word, regexp_full_match(word, '[A-Za-z][a-z]*') AS accepted FROM t")
def dfa_accept(spark: SparkSession, d: str) -> DataFrame:
    types = token_frequency(spark, d).select(F.col("token").alias("word"))
    return types.select("word", T.dfa_accepts(F.col("word")).alias("accepted"))


@query(_TYPES + " SELECT word, regexp_full_match(word, '[a-z]+|[A-Z][a-z]*') AS accepted FROM t")
def generic_dfa(spark: SparkSession, d: str) -> DataFrame:
    """The table-driven automaton of English words (see text.word_automaton) over all tokens."""
    types = token_frequency(spark, d).select(F.col("token").alias("word"))
    return types.select("word", T.run_dfa(F.col("word"), *T.word_automaton()).alias("accepted"))


@query()
def dfa_test_words(spark: SparkSession, d: str) -> DataFrame:
    """Seeded words of every category that exercises the automaton, with its verdict."""
    words = spark.createDataFrame(T.sample_words(), "category string, number int, word string")
    return words.select("category", "number", "word", T.run_dfa(F.col("word"), *T.word_automaton()).alias("accepted"))


@query(
    _TYPES
    + f""", x AS (SELECT word, lower(word) AS w, regexp_full_match(word, '\\p{{L}}+') AS ok FROM t),
 r AS (SELECT word, w, ok, CASE WHEN {_IRREGULAR} IS NOT NULL THEN {_IRREGULAR}
  WHEN ends_with(w, 'es') AND length(w) > 2 AND w IN {_LIST(T.NO_ES_PLURAL)} THEN NULL
  WHEN ends_with(w, 'es') AND length(w) > 2 AND regexp_matches(left(w, length(w) - 2), '(s|x|z|ch|sh)$') THEN left(w, length(w) - 2)
  WHEN ends_with(w, 'ies') AND length(w) > 3 AND NOT ends_with(w, 'eies') THEN left(w, length(w) - 3) || 'y'
  WHEN ends_with(w, 's') AND length(w) > 1 AND NOT ends_with(w, 'es') AND w NOT IN {_LIST(T.ENDS_IN_S)} AND length(w) >= 3 THEN left(w, length(w) - 1) END AS root FROM x)
SELECT word, CASE WHEN ok THEN coalesce(root, w) END AS root, CASE WHEN NOT ok THEN NULL WHEN root IS NULL THEN 'SG' ELSE 'PL' END AS number,
 CASE WHEN NOT ok THEN word || ': Invalid Word' WHEN root IS NULL THEN w || ' = ' || w || '+N+SG' ELSE w || ' = ' || root || '+N+PL' END AS analysis FROM r"""
)
def plural_fst(spark: SparkSession, d: str) -> DataFrame:
    types = token_frequency(spark, d).select(F.col("token").alias("word"))
    return types.select("word", T.plural_root(F.col("word")).alias("r"), T.plural_analysis(F.col("word")).alias("analysis")).select("word", "r.root", "r.number", "analysis")


@query()
def plural_fst_edges(spark: SparkSession, d: str) -> DataFrame:
    """The labelled edges of the three drawings of the plural automaton."""
    return spark.createDataFrame(T.plural_edges(), "diagram string, source string, target string, label string")


@query(
    _WORDS
    + f""", a AS (SELECT word, {_PREFIX} AS prefix, {_SUFFIX} AS suffix FROM w)
SELECT word, prefix, suffix, CASE WHEN suffix = 'ies' THEN left(word, length(word) - 3) || 'y' WHEN suffix IS NOT NULL THEN left(word, length(word) - length(suffix)) END AS stem FROM a"""
)
def affix_rules(spark: SparkSession, d: str) -> DataFrame:
    w = F.col("word")
    rules = english_words(spark, d).select("word", T.rule_prefix(w).alias("prefix"), T.rule_suffix(w).alias("s"))
    return rules.select("word", "prefix", F.col("s.suffix").alias("suffix"), F.col("s.stem").alias("stem"))


def _trie_sql(word: str, path: str = "w") -> str:
    return f"""own AS (SELECT word, cnt, {word} AS w FROM w),
 p AS (SELECT left(w, i) AS prefix, sum(cnt) AS cnt FROM own, unnest(range(1, length(w) + 1)) AS u(i) GROUP BY 1),
 c AS (SELECT left(prefix, length(prefix) - 1) AS prefix, count(*) AS branching, max(cnt) AS max_child FROM p GROUP BY 1),
 n AS (SELECT p.prefix, p.cnt AS support, round((1 - max_child / p.cnt::DOUBLE) * branching, 9) AS score FROM p JOIN c USING (prefix) WHERE branching >= {BRANCHES}),
 m AS (SELECT word, i AS split_at, score, support, row_number() OVER (PARTITION BY word ORDER BY score DESC, i DESC) AS r
       FROM (SELECT word, i, left({path}, i) AS prefix FROM own, unnest(range(1, length(w) + 1)) AS u(i)) JOIN n USING (prefix) WHERE score > 0),
 best AS (SELECT word, split_at, score, support FROM m WHERE r = 1)"""


@query(_WORDS + ", " + _trie_sql("word") + " SELECT word, split_at::INT AS split_at, round(score, 6) AS score, support::BIGINT AS support FROM best")
def trie_prefix_split(spark: SparkSession, d: str) -> DataFrame:
    return M.best_split(english_words(spark, d), BRANCHES).withColumn("score", F.round("score", 6))


@query(_WORDS + ", " + _trie_sql("reverse(word)") + " SELECT word, split_at::INT AS split_at, round(score, 6) AS score, support::BIGINT AS support FROM best")
def trie_suffix_split(spark: SparkSession, d: str) -> DataFrame:
    return M.best_split(english_words(spark, d), BRANCHES, reverse=True).withColumn("score", F.round("score", 6))


@query(_WORDS + ", " + _trie_sql("reverse(word)", "word") + " SELECT word, split_at::INT AS split_at, round(score, 6) AS score, support::BIGINT AS support FROM best")
def trie_suffix_as_written(spark: SparkSession, d: str) -> DataFrame:
    """The double reversal: the word is walked forwards in the trie of reversed words."""
    return M.best_split(english_words(spark, d), BRANCHES, reverse=True, as_written=True).withColumn("score", F.round("score", 6))


def _stem_sql(side: str) -> str:
    if side == "prefix":
        affix, stem, trie = _PREFIX, "substr(word, length(affix) + 1)", "word"
        good, t_stem, t_affix = "split_at >= 2 AND split_at < length(word)", "left(word, split_at)", "substr(word, split_at + 1)"
    else:
        affix, trie = _SUFFIX, "reverse(word)"
        stem = "CASE WHEN affix = 'ies' THEN left(word, length(word) - 3) || 'y' ELSE left(word, length(word) - length(affix)) END"
        good, t_stem, t_affix = "length(word) - split_at >= 2", "left(word, length(word) - split_at)", "right(word, split_at)"
    return f"""SELECT word, cnt, stem, affix, how, round(score, 6) AS score, freq::BIGINT AS freq, round(freq / total::DOUBLE, 9) AS prob FROM (
 WITH {_trie_sql(trie)}, a AS (SELECT word, cnt, {affix} AS affix FROM w), ru AS (SELECT word, cnt, affix, {stem} AS stem FROM a WHERE affix IS NOT NULL)
 SELECT ru.word, ru.cnt, ru.stem, affix, 'rule' AS how, 0.0::DOUBLE AS score, coalesce(k.cnt, 0) AS freq FROM ru LEFT JOIN w k ON k.word = ru.stem
 UNION ALL SELECT word, cnt, CASE WHEN g THEN {t_stem} ELSE word END, CASE WHEN g THEN {t_affix} ELSE '' END, CASE WHEN g THEN 'trie' ELSE 'nosplit' END,
  CASE WHEN g THEN score ELSE 0 END, CASE WHEN g THEN support ELSE 0 END
 FROM (SELECT a.word, a.cnt, split_at, score, support, coalesce({good.replace('word', 'a.word')}, false) AS g FROM a LEFT JOIN best USING (word) WHERE affix IS NULL)) CROSS JOIN (SELECT sum(cnt) AS total FROM w)"""


@query(_WORDS + " " + _stem_sql("prefix"))
def prefix_stems(spark: SparkSession, d: str) -> DataFrame:
    return M.stem_words(english_words(spark, d), "prefix", BRANCHES).withColumn("score", F.round("score", 6))


@query(_WORDS + " " + _stem_sql("suffix"))
def suffix_stems(spark: SparkSession, d: str) -> DataFrame:
    return M.stem_words(english_words(spark, d), "suffix", BRANCHES).withColumn("score", F.round("score", 6))


@query(
    _WORDS
    + f""", a AS ({_stem_sql('prefix')}), b AS ({_stem_sql('suffix')}),
 pa AS (SELECT coalesce(sum(cnt) FILTER (how <> 'nosplit'), 0)::BIGINT AS prefix_count, round(coalesce(sum(score * cnt), 0), 3)::DOUBLE AS prefix_score FROM a),
 pb AS (SELECT coalesce(sum(cnt) FILTER (how <> 'nosplit'), 0)::BIGINT AS suffix_count, round(coalesce(sum(score * cnt), 0), 3)::DOUBLE AS suffix_score FROM b)
SELECT *, CASE WHEN suffix_count > prefix_count OR (suffix_count = prefix_count AND suffix_score > prefix_score) THEN 'suffix' ELSE 'prefix' END AS winner FROM pa CROSS JOIN pb"""
)
def stem_winner(spark: SparkSession, d: str) -> DataFrame:
    side = lambda s: M.stem_words(english_words(spark, d), s, BRANCHES).withColumn("score", F.round("score", 6))
    return M.stem_winner(side("prefix"), side("suffix"))
