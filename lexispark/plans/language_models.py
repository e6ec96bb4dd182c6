"""Queries: n-gram tables, smoothing, back-off and generation on the passages of the train split."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions.text import blank_tokens
from lexispark.operators import backoff, continuations, generate, ngrams, smoothing
from lexispark.plans.registry import query
from lexispark.session import stored
from lexispark.sources.tables import latest_once_wide, spread, table

ORDERS = [1, 2, 3, 4]
LAMBDAS = (0.1, 0.2, 0.3, 0.4)

_APP = """app AS (SELECT sent_id, lang, split_name, source, list_filter(regexp_split_to_array(coalesce(sentence, ''), '\\s+'), lambda x: x <> '') AS toks
 FROM (SELECT *, row_number() OVER (PARTITION BY sent_id ORDER BY ingested_at DESC) AS k FROM application) WHERE k = 1)"""
_SEQ = """tr AS (SELECT sent_id, i AS pos, toks[i] AS tok FROM app, unnest(range(1, len(toks) + 1)) AS u(i) WHERE split_name = 'train'),
 seq AS (SELECT tok AS w1, lead(tok, 1) OVER o AS w2, lead(tok, 2) OVER o AS w3, lead(tok, 3) OVER o AS w4 FROM tr WINDOW o AS (ORDER BY sent_id, pos)),
 g AS (SELECT len(gram) AS n, gram, count(*) AS cnt FROM (SELECT unnest([[w1], CASE WHEN w2 IS NOT NULL THEN [w1, w2] END,
   CASE WHEN w3 IS NOT NULL THEN [w1, w2, w3] END, CASE WHEN w4 IS NOT NULL THEN [w1, w2, w3, w4] END]) AS gram FROM seq) WHERE gram IS NOT NULL GROUP BY gram)"""
_G = f"WITH {_APP}, {_SEQ}"
_TOT = "tot AS (SELECT n, sum(cnt)::BIGINT AS total, count(*) AS types, (SELECT count(*) FROM g WHERE n = 1) AS vocab FROM g GROUP BY n)"
_TEST = """tg AS (SELECT sent_id, n, i AS place, toks[i + 1:i + n] AS gram FROM app, unnest([1, 2, 3, 4]) AS o(n), unnest(range(greatest(0, len(toks) - n + 1))) AS u(i) WHERE split_name = 'test')"""
_NC = "nc AS (SELECT n, cnt, count(*) AS nc FROM g GROUP BY n, cnt)"
_GT = f"""{_TOT}, {_NC},
 star AS (SELECT a.n, a.cnt, a.nc, CASE WHEN a.cnt <= 100 AND b.nc IS NOT NULL THEN (a.cnt + 1) * b.nc / a.nc::DOUBLE ELSE a.cnt::DOUBLE END AS c_star FROM nc a LEFT JOIN nc b ON a.n = b.n AND b.cnt = a.cnt + 1),
 un AS (SELECT tot.n, total, types, coalesce(nc, 1)::DOUBLE / types AS c_zero, coalesce(nc, 1)::DOUBLE / (types * greatest(1.0, pow(vocab::DOUBLE, tot.n) - types)) AS p_unseen FROM tot LEFT JOIN nc ON nc.n = tot.n AND nc.cnt = 1),
 gt AS (SELECT g.n, gram, g.cnt, c_star / total AS p FROM g JOIN star USING (n, cnt) JOIN tot USING (n))"""
_J = "array_to_string(gram, ' ') AS gram"


def passages(spark: SparkSession, d: str) -> DataFrame:
    """(sent_id, lang, split_name, source, toks) of every passage, once."""
    raw = spread(table(spark, d, "application").select("sent_id", "sentence", "lang", "split_name", "source", "ingested_at"))
    rows = latest_once_wide(raw, ["sent_id"], ["ingested_at"])
    return rows.select("sent_id", "lang", "split_name", "source", blank_tokens(F.col("sentence")).alias("toks"))


def counts(spark: SparkSession, d: str) -> DataFrame:
    """(n, gram, cnt) of the train split taken as one text."""
    keys = table(spark, d, "application").select("sent_id")
    return ngrams.ngram_counts(passages(spark, d).where("split_name = 'train'"), "sent_id", "toks", ORDERS, "corpus", keys)


def kept_counts(spark: SparkSession, d: str) -> DataFrame:
    """The counts as a stored table, for queries that read them more than once."""
    return stored(counts(spark, d))


def tests(spark: SparkSession, d: str, split: str = "test") -> DataFrame:
    return passages(spark, d).where(F.col("split_name") == split)


def shown(df: DataFrame) -> DataFrame:
    """The n-gram as one string."""
    return df.withColumn("gram", F.array_join("gram", " "))


def rounded(df: DataFrame, *columns: str, places: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def _order(n: int):
    @query(f"{_G} SELECT {_J}, cnt FROM g WHERE n = {n}")
    def f(spark: SparkSession, d: str) -> DataFrame:
        return shown(counts(spark, d).where(F.col("n") == n)).select("gram", "cnt")

    return f


def _register_orders() -> None:
    from lexispark.plans import registry

    for n in ORDERS:
        f = _order(n)
        f.__name__ = f"ngram_{n}"
        registry._QUERIES[f.__name__], registry._SQL[f.__name__] = registry._QUERIES.pop("f"), registry._SQL.pop("f")


_register_orders()


@query(
    f"""WITH {_APP}, s AS (SELECT n, toks[i + 1:i + n] AS gram FROM app, unnest([2, 3]) AS o(n), unnest(range(greatest(0, len(toks) - n + 1))) AS u(i))
 SELECT n, {_J}, count(*) AS cnt FROM s GROUP BY n, s.gram"""
)
def ngram_within_passages(spark: SparkSession, d: str) -> DataFrame:
    return shown(ngrams.ngram_counts(passages(spark, d), "sent_id", "toks", [2, 3], "row"))


@query(f"{_G} SELECT n, count(*) AS types, sum(cnt)::BIGINT AS tokens FROM g GROUP BY n")
def ngram_vocab(spark: SparkSession, d: str) -> DataFrame:
    return ngrams.vocabulary_sizes(counts(spark, d))


@query(
    f"""{_G} SELECT g.n, array_to_string(g.gram, ' ') AS gram, g.cnt, round(CASE WHEN g.n = 1 THEN g.cnt / (SELECT sum(cnt) FROM g WHERE n = 1)::DOUBLE ELSE coalesce(g.cnt / h.cnt::DOUBLE, 0) END, 9) AS p
 FROM g LEFT JOIN g h ON h.gram = g.gram[1:g.n - 1]"""
)
def ngram_mle(spark: SparkSession, d: str) -> DataFrame:
    return rounded(shown(ngrams.mle(kept_counts(spark, d))), "p")


@query(f"{_G} SELECT n, {_J}, cnt FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY cnt DESC, array_to_string(gram, ' ')) AS k FROM g) WHERE k <= 10")
def ngram_top(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("n").orderBy(F.col("cnt").desc(), F.col("gram")))
    return shown(counts(spark, d)).withColumn("k", k).where("k <= 10").drop("k")


@query(f"{_G}, {_NC} SELECT n, cnt, nc FROM nc")
def freq_of_freq(spark: SparkSession, d: str) -> DataFrame:
    return ngrams.frequency_of_frequency(counts(spark, d))


@query(f"{_G} SELECT n, array_to_string(gram[1:n - 1], ' ') AS history, sum(cnt)::BIGINT AS total, count(*) AS continuations FROM g WHERE n > 1 GROUP BY n, gram[1:n - 1]")
def context_sums(spark: SparkSession, d: str) -> DataFrame:
    return ngrams.context_sums(counts(spark, d)).withColumn("history", F.array_join("history", " "))


@query(f"{_G} SELECT gram[2] AS word, count(*) AS contexts FROM g WHERE n = 2 GROUP BY 1")
def kn_continuation(spark: SparkSession, d: str) -> DataFrame:
    return ngrams.continuation_counts(counts(spark, d))


_ADD = f"""{_TOT}, sm AS (SELECT n, gram, cnt, unnest(['add_one', 'add_k', 'token_type']) AS method,
 unnest([(cnt + 1) / (total + vocab)::DOUBLE, (cnt + 0.5) / (total + 0.5 * vocab), 1.0 / types]) AS p FROM g JOIN tot USING (n))"""


def _smoothed(method: str):
    @query(f"{_G}, {_ADD} SELECT n, {_J}, cnt, round(p, 9) AS p FROM sm WHERE method = '{method}'")
    def f(spark: SparkSession, d: str) -> DataFrame:
        return rounded(shown(smoothing.additive_wide(kept_counts(spark, d)).select("n", "gram", "cnt", F.col(method).alias("p"))), "p")

    return f


def _register_methods() -> None:
    from lexispark.plans import registry

    for method in ("add_one", "add_k", "token_type"):
        f = _smoothed(method)
        f.__name__ = method
        registry._QUERIES[method], registry._SQL[method] = registry._QUERIES.pop("f"), registry._SQL.pop("f")


_register_methods()


@query(
    f"""{_G}, {_ADD} SELECT n, {_J}, cnt, round(max(p) FILTER (method = 'add_one'), 9) AS add_one, round(max(p) FILTER (method = 'add_k'), 9) AS add_k, round(max(p) FILTER (method = 'token_type'), 9) AS token_type
 FROM (SELECT *, dense_rank() OVER (PARTITION BY n ORDER BY cnt DESC, array_to_string(gram, ' ')) AS k FROM sm) WHERE k <= 10 GROUP BY n, sm.gram, cnt""".replace("sm.gram, cnt", "gram, cnt").replace(f"SELECT n, {_J}, cnt, round(max", "SELECT n, array_to_string(gram, ' ') AS gram, cnt, round(max")
)
def smoothing_comparison(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("n").orderBy(F.col("cnt").desc(), F.array_join("gram", " ")))
    best = smoothing.additive_wide(kept_counts(spark, d)).withColumn("k", k).where("k <= 10").drop("k")
    return rounded(shown(best), *smoothing.METHODS)


@query(f"{_G}, {_ADD} SELECT n, round(p, 9) AS p, {_J}, cnt FROM sm WHERE method = 'add_k' AND n = 2")
def select_model(spark: SparkSession, d: str) -> DataFrame:
    """The table of one order and one method, picked by name."""
    return rounded(shown(smoothing.select_model(smoothing.additive(kept_counts(spark, d)), 2, "add_k").drop("method")), "p")


@query(f"{_G}, {_TOT} SELECT n, total AS tokens, types AS total_unique_ngrams, vocab AS vocab_size, 'add_one, add_k, token_type' AS techniques FROM tot")
def smoothing_summary(spark: SparkSession, d: str) -> DataFrame:
    return smoothing.summary_report(kept_counts(spark, d))


# every test passage with words and every order: ln p, null where the passage has no n-gram of the order
_ALL = "al AS (SELECT sent_id, len(toks) AS token_count, n FROM app, unnest([1, 2, 3, 4]) AS o(n) WHERE split_name = 'test' AND len(toks) > 0), m AS (SELECT unnest(['add_one', 'add_k', 'token_type']) AS method)"


def _scores_sql(unseen: str) -> str:
    return f"""{_G}, {_ADD}, {_TEST}, {_ALL},
 sc AS (SELECT sent_id, tg.n, m.method, count(*) AS grams, sum(ln(coalesce(p, {unseen}))) AS log_p FROM tg JOIN tot USING (n) CROSS JOIN m LEFT JOIN sm ON sm.gram = tg.gram AND sm.method = m.method GROUP BY ALL),
 x AS (SELECT al.sent_id, al.n, m.method, token_count, coalesce(grams, 0) AS grams, log_p FROM al CROSS JOIN m LEFT JOIN sc ON sc.sent_id = al.sent_id AND sc.n = al.n AND sc.method = m.method)"""


def _scores(spark: SparkSession, d: str, floor: bool) -> DataFrame:
    """(sent_id, n, token_count, grams, add_one, add_k, token_type): ln p of the test passages under every order and method."""
    c = kept_counts(spark, d)
    values = {m: F.coalesce(F.col(m), F.lit(1e-10)) for m in smoothing.METHODS}
    model = smoothing.additive_wide(c)
    if floor:
        return smoothing.score_sentences(tests(spark, d), "sent_id", "toks", model, ORDERS, values, hot=smoothing.gram_salts(c))
    unseen = {r.n: 1.0 / (r.total + r.vocab) for r in smoothing.totals(c).collect()}  # one number per order
    u = F.lit(None).cast("double")
    for n, p in unseen.items():
        u = F.when(F.col("n") == n, F.lit(p)).otherwise(u)
    return smoothing.score_sentences(tests(spark, d), "sent_id", "toks", model, ORDERS, {m: F.coalesce(F.col(m), u) for m in smoothing.METHODS}, hot=smoothing.gram_salts(c))


def _long(wide: DataFrame) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(m).alias("method"), F.round(m, 6).alias("log_p")) for m in smoothing.METHODS])
    return wide.select("sent_id", "n", "token_count", "grams", F.explode(cells).alias("x")).select("sent_id", "n", "token_count", "grams", "x.method", "x.log_p")


@query(f"{_scores_sql('1e-10')} SELECT sent_id, n, method, token_count::INT AS token_count, grams, round(log_p, 6) AS log_p FROM x")
def sentence_score_matrix(spark: SparkSession, d: str) -> DataFrame:
    """ln of the probability of every test passage under each order and method; unseen n-grams have 1e-10, passages without n-grams null."""
    return _long(_scores(spark, d, True))


@query(
    f"{_scores_sql('1e-10')} SELECT sent_id, any_value(token_count)::INT AS token_count, "
    + ", ".join(f"coalesce(printf('%.6e', exp(max(log_p) FILTER (n = {n} AND method = '{m}')))::DOUBLE, 0) AS \"{n}gram_{m}\"" for n in ORDERS for m in smoothing.METHODS)
    + " FROM x GROUP BY sent_id"
)
def sentence_matrix_wide(spark: SparkSession, d: str) -> DataFrame:
    """A row per test passage: its tokens and a probability per order and method, to 7 digits; 0 where it has no n-gram or the product underflows."""
    cell = lambda n, m: F.coalesce(smoothing.significant(F.exp(F.max(F.when(F.col("n") == n, F.col(m))))), F.lit(0.0)).alias(f"{n}gram_{m}")
    return _scores(spark, d, True).groupBy("sent_id").agg(F.max("token_count").alias("token_count"), *[cell(n, m) for n in ORDERS for m in smoothing.METHODS])


@query(
    f"""{_scores_sql('1e-10')}, rd AS (SELECT sent_id, n, method, round(log_p, 6) AS log_p FROM x WHERE log_p IS NOT NULL),
 r AS (SELECT *, row_number() OVER (PARTITION BY n, method ORDER BY log_p DESC, sent_id) AS a, row_number() OVER (PARTITION BY n, method ORDER BY log_p, sent_id) AS b FROM rd)
SELECT n, method, max(sent_id) FILTER (a = 1) AS likeliest, max(sent_id) FILTER (b = 1) AS unlikeliest FROM r GROUP BY n, method"""
)
def extreme_sentences(spark: SparkSession, d: str) -> DataFrame:
    x = _long(_scores(spark, d, True)).where("log_p IS NOT NULL")
    return x.groupBy("n", "method").agg(F.max(F.struct("log_p", (-F.col("sent_id")).alias("i"))).alias("a"), F.min(F.struct("log_p", "sent_id")).alias("b")).select(
        "n", "method", (-F.col("a.i")).alias("likeliest"), F.col("b.sent_id").alias("unlikeliest")
    )


@query(f"{_scores_sql('1.0 / (total + vocab)')} SELECT sent_id, n, method, token_count::INT AS token_count, grams, round(log_p, 6) AS log_p FROM x")
def sentence_probability_smoothed(spark: SparkSession, d: str) -> DataFrame:
    """As sentence_score_matrix, but an unseen n-gram has 1/(tokens + vocabulary) under every method."""
    return _long(_scores(spark, d, False))


@query(
    f"""{_G}, {_GT} SELECT n, 0::BIGINT AS cnt, NULL::BIGINT AS nc, round(c_zero, 9) AS c_star FROM un
UNION ALL SELECT n, cnt, nc, round(c_star, 9) FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY cnt) AS k FROM star) WHERE k <= 99"""
)
def good_turing_table(spark: SparkSession, d: str) -> DataFrame:
    return rounded(smoothing.good_turing_table(kept_counts(spark, d)), "c_star")


@query(f"{_G}, {_GT} SELECT n, {_J}, cnt, round(p, 9) AS p FROM gt")
def good_turing_prob(spark: SparkSession, d: str) -> DataFrame:
    return rounded(shown(smoothing.good_turing(kept_counts(spark, d))[0]), "p")


def _gts(split: str) -> str:
    """Good-Turing scores of the passages with words; those shorter than n have 1e-10."""
    return f"""{_TEST.replace("'test'", f"'{split}'")}, sg AS (SELECT sent_id, tg.n, sum(ln(greatest(coalesce(gt.p, p_unseen), 1e-10))) AS log_p FROM tg JOIN un USING (n) LEFT JOIN gt ON gt.gram = tg.gram GROUP BY ALL),
 sc AS (SELECT a.sent_id, o.n, coalesce(log_p, ln(1e-10)) AS log_p FROM app a CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS n) o LEFT JOIN sg ON sg.sent_id = a.sent_id AND sg.n = o.n WHERE split_name = '{split}' AND len(toks) > 0)"""


def _perplexity_sql(by: str, source: str) -> str:
    """An exponent over 709 has no double: the perplexity is infinite."""
    a = "avg(log_p) FILTER (log_p >= -745)"
    return f"SELECT {by}, count(*) AS sentences, count(*) FILTER (log_p >= -745) AS valid, {a} AS a, CASE WHEN -{a} > 709.78 THEN 'inf'::DOUBLE ELSE printf('%.6e', exp(-{a}))::DOUBLE END AS perplexity FROM {source} GROUP BY {by}"


def _gt(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(model, unseen, salts of frequent n-grams); the row per order is known to the driver."""
    c = kept_counts(spark, d)
    model, unseen = smoothing.good_turing(c)
    return model, spark.createDataFrame(unseen.collect(), unseen.schema), smoothing.gram_salts(c)


def _gt_log_p(sentences: DataFrame, model: DataFrame, unseen: DataFrame, hot: DataFrame) -> DataFrame:
    p_unseen = F.lit(None).cast("double")
    for r in unseen.collect():
        p_unseen = F.when(F.col("n") == r.n, F.lit(r.p_unseen)).otherwise(p_unseen)
    value = F.greatest(F.coalesce("p", p_unseen), F.lit(1e-10))
    return smoothing.score_sentences(sentences, "sent_id", "toks", model, ORDERS, {"log_p": value}, short=1e-10, hot=hot)


def _gt_scores(spark: SparkSession, d: str) -> DataFrame:
    return _gt_log_p(tests(spark, d), *_gt(spark, d))


@query(f"{_G}, {_GT}, {_gts('test')} SELECT sent_id, n::INT AS n, round(log_p, 6) AS log_p FROM sc")
def gt_sentence_prob(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_gt_scores(spark, d).select("sent_id", "n", "log_p"), "log_p", places=6)


@query(f"{_G}, {_GT}, {_gts('test')} SELECT n::INT AS n, sentences, valid, round(a, 6) AS avg_log_p, perplexity FROM ({_perplexity_sql('n', 'sc')})")
def gt_perplexity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(smoothing.perplexity(_gt_scores(spark, d)), "avg_log_p", places=6)


def _quads_sql(split: str, mark: str = "") -> str:
    return f"""qg{mark} AS (SELECT sent_id, i AS place, toks[i + 1:i + 4] AS gram FROM app, unnest(range(greatest(0, len(toks) - 3))) AS u(i) WHERE split_name = '{split}'),
 qs{mark} AS (SELECT sent_id, place, k.n, coalesce(gt.p, p_unseen) AS p FROM qg{mark} q CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS n) k JOIN un ON un.n = k.n LEFT JOIN gt ON gt.gram = q.gram[5 - k.n:4]),
 q4{mark} AS (SELECT sent_id, place, max(p) FILTER (n = 1) AS p1, max(p) FILTER (n = 2) AS p2, max(p) FILTER (n = 3) AS p3, max(p) FILTER (n = 4) AS p4 FROM qs{mark} GROUP BY ALL)"""


_QUADS = f"{_GT}, {_quads_sql('val')}"


def _quads(spark: SparkSession, d: str, model: DataFrame, unseen: DataFrame, hot: DataFrame, split: str = "val") -> DataFrame:
    return smoothing.quad_probabilities(tests(spark, d, split), "sent_id", "toks", model, unseen, hot)


def _val_quads(spark: SparkSession, d: str) -> DataFrame:
    return _quads(spark, d, *_gt(spark, d))


def _mixed_log_p(quads: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    return quads.groupBy("sent_id").agg(F.sum(F.ln(F.greatest(smoothing.interpolated(weights), F.lit(1e-10)))).alias("log_p"))


@query(f"{_G}, {_QUADS} SELECT sent_id, round(sum(ln(greatest(0.1 * p1 + 0.2 * p2 + 0.3 * p3 + 0.4 * p4, 1e-10))), 6) AS log_p FROM q4 GROUP BY sent_id")
def interp_prob_fixed_lambda(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_mixed_log_p(_val_quads(spark, d), LAMBDAS), "log_p", places=6)


_EM = " UNION ALL ".join(
    f"SELECT {i} AS iteration, l1, l2, l3, l4 FROM e{i}" for i in range(1, 11)
)
_STEPS = ", ".join(
    f"""e{i} AS (SELECT a / t AS l1, b / t AS l2, c / t AS l3, d / t AS l4 FROM (SELECT *, a + b + c + d AS t FROM (SELECT sum(l1 * p1 / m) AS a, sum(l2 * p2 / m) AS b, sum(l3 * p3 / m) AS c, sum(l4 * p4 / m) AS d
 FROM (SELECT *, l1 * p1 + l2 * p2 + l3 * p3 + l4 * p4 AS m FROM q4 CROSS JOIN e{i - 1}) WHERE m > 0)))"""
    for i in range(1, 11)
)


_E0 = "e0 AS (SELECT 0.25 AS l1, 0.25 AS l2, 0.25 AS l3, 0.25 AS l4)"


@query(f"{_G}, {_QUADS}, {_E0}, {_STEPS} SELECT iteration, round(l1, 6) AS l1, round(l2, 6) AS l2, round(l3, 6) AS l3, round(l4, 6) AS l4 FROM ({_EM})")
def em_lambdas(spark: SparkSession, d: str) -> DataFrame:
    trail = smoothing.optimise_lambdas(stored(_val_quads(spark, d).select("p1", "p2", "p3", "p4")))
    rows = [(i + 1, *(float(round(x, 6)) for x in w)) for i, w in enumerate(trail)]
    return spark.createDataFrame(rows, "iteration int, l1 double, l2 double, l3 double, l4 double")


@query(
    f"""{_G}, {_QUADS}, {_E0}, {_STEPS}, w AS (SELECT unnest([1, 2, 3, 4]) AS n, unnest([l1, l2, l3, l4]) AS l FROM e10)
SELECT n::INT AS n, round(100 * l, 6) AS share, n = (SELECT n FROM w ORDER BY l DESC, n LIMIT 1) AS strongest, round((SELECT -sum(l * ln(l + 1e-10)) FROM w WHERE l > 0), 6) AS entropy FROM w"""
)
def lambda_analysis(spark: SparkSession, d: str) -> DataFrame:
    """The weights learnt on the val passages: share in percent per order, the strongest order, and the entropy of all."""
    a = smoothing.lambda_analysis(smoothing.optimise_lambdas(stored(_val_quads(spark, d).select("p1", "p2", "p3", "p4")))[-1])
    rows = [(n, round(a[f"share_{n}"], 6), n == a["strongest"], round(a["entropy"], 6)) for n in ORDERS]
    return spark.createDataFrame(rows, "n int, share double, strongest boolean, entropy double")


# -- back-off ---------------------------------------------------------------------------------------
_KATZ = f"""{_NC}, dc AS (SELECT g.n, gram, g.cnt, gram[1:g.n - 1] AS history, CASE WHEN g.cnt > 5 THEN g.cnt::DOUBLE WHEN b.nc IS NOT NULL THEN (g.cnt + 1) * (b.nc / a.nc::DOUBLE) ELSE greatest(g.cnt - 0.5, 0) END AS discounted
   FROM g JOIN nc a ON a.n = g.n AND a.cnt = g.cnt LEFT JOIN nc b ON b.n = g.n AND b.cnt = g.cnt + 1 WHERE g.n > 1),
 hs AS (SELECT n, history, sum(discounted) AS base FROM dc GROUP BY n, history),
 model AS (SELECT n, gram, cnt / (SELECT sum(cnt) FROM g WHERE n = 1)::DOUBLE AS p FROM g WHERE n = 1 UNION ALL SELECT n, gram, CASE WHEN base > 0 THEN discounted / base ELSE 0 END FROM dc JOIN hs USING (n, history)),
 alphas AS (SELECT n, history, CASE WHEN base > 0 THEN 0.0 ELSE 1.0 END AS alpha FROM hs)"""
_KN = f"""dd AS (SELECT n, CASE WHEN n1 > 0 AND n2 > 0 THEN least(0.95, greatest(0.5, n1 / (n1 + 2 * n2)::DOUBLE)) ELSE 0.75 END AS d FROM (SELECT n, count(*) FILTER (cnt = 1) AS n1, count(*) FILTER (cnt = 2) AS n2 FROM g GROUP BY n)),
 ct AS (SELECT gram[2] AS w, count(*) AS c FROM g WHERE n = 2 GROUP BY 1),
 hs AS (SELECT n, gram[1:n - 1] AS history, sum(cnt) AS total, count(*) AS conts FROM g WHERE n > 1 GROUP BY n, gram[1:n - 1]),
 model AS (SELECT 1 AS n, [w] AS gram, c / (SELECT sum(c) FROM ct)::DOUBLE AS p FROM ct UNION ALL
   SELECT g.n, g.gram, greatest(g.cnt - d, 0) / total AS p FROM g JOIN hs ON hs.n = g.n AND hs.history = g.gram[1:g.n - 1] JOIN dd ON dd.n = g.n WHERE g.n > 1),
 alphas AS (SELECT hs.n, history, d * conts / total AS alpha FROM hs JOIN dd USING (n))"""
_BACK = """q AS (SELECT DISTINCT toks[i + 1:i + 4] AS gram FROM app, unnest(range(greatest(0, len(toks) - 3))) AS u(i) WHERE split_name = 'test'),
 v AS (SELECT 1.0 / (1000 * count(*)) AS u FROM g WHERE n = 1),
 z AS (SELECT q.gram, CASE WHEN m4.p IS NOT NULL THEN m4.p WHEN m3.p IS NOT NULL THEN coalesce(a4.alpha, 1) * m3.p WHEN m2.p IS NOT NULL THEN coalesce(a4.alpha, 1) * coalesce(a3.alpha, 1) * m2.p
   ELSE coalesce(a4.alpha, 1) * coalesce(a3.alpha, 1) * coalesce(a2.alpha, 1) * coalesce(m1.p, v.u) END AS p
   FROM q CROSS JOIN v LEFT JOIN model m4 ON m4.gram = q.gram LEFT JOIN model m3 ON m3.gram = q.gram[2:4] LEFT JOIN model m2 ON m2.gram = q.gram[3:4] LEFT JOIN model m1 ON m1.gram = q.gram[4:4]
   LEFT JOIN alphas a4 ON a4.history = q.gram[1:3] LEFT JOIN alphas a3 ON a3.history = q.gram[2:3] LEFT JOIN alphas a2 ON a2.history = q.gram[3:3])"""


def _test_quads(spark: SparkSession, d: str) -> DataFrame:
    return smoothing.sentence_grams(tests(spark, d), "sent_id", "toks", [4]).select("gram").distinct()


def _backed(spark: SparkSession, d: str, kind: str) -> DataFrame:
    c = kept_counts(spark, d)
    entries = backoff.katz_entries(c) if kind == "katz" else backoff.kn_entries(c)
    vocab = c.where("n = 1").count()
    return rounded(shown(backoff.score_ngrams(_test_quads(spark, d), "gram", entries, vocab, 4, backoff.word_salts(c))), "p")


@query(f"{_G}, {_KATZ} SELECT n, {_J}, cnt, round(discounted, 9) AS discounted FROM dc")
def katz_discount(spark: SparkSession, d: str) -> DataFrame:
    return rounded(shown(backoff.katz_discounts(kept_counts(spark, d))), "discounted")


@query(f"{_G}, {_KATZ} SELECT n, {_J}, round(p, 9) AS p FROM model")
def katz_prob(spark: SparkSession, d: str) -> DataFrame:
    return rounded(shown(backoff.katz_model(kept_counts(spark, d))[0]), "p")


@query(f"{_G}, {_KATZ} SELECT n, array_to_string(history, ' ') AS history, alpha::DOUBLE AS alpha FROM alphas")
def katz_backoff_weights(spark: SparkSession, d: str) -> DataFrame:
    return backoff.katz_model(kept_counts(spark, d))[1].withColumn("history", F.array_join("history", " "))


@query(f"{_G}, {_KATZ}, {_BACK} SELECT {_J}, round(p, 9) AS p FROM z")
def katz_backoff_score(spark: SparkSession, d: str) -> DataFrame:
    return _backed(spark, d, "katz")


@query(f"{_G}, {_KN} SELECT n, round(d, 9) AS d FROM dd")
def kn_discount(spark: SparkSession, d: str) -> DataFrame:
    return rounded(backoff.kn_discounts(counts(spark, d)), "d")


@query(f"{_G}, {_KN} SELECT n, {_J}, round(p, 9) AS p FROM model")
def kn_prob(spark: SparkSession, d: str) -> DataFrame:
    return rounded(shown(backoff.kn_model(kept_counts(spark, d))[0]), "p")


@query(f"{_G}, {_KN}, {_BACK} SELECT {_J}, round(p, 9) AS p FROM z")
def kn_backoff_score(spark: SparkSession, d: str) -> DataFrame:
    return _backed(spark, d, "kn")


@query(f"{_G}, {_KATZ}, kt AS (SELECT n, history, sum(discounted) AS mass, sum(cnt)::DOUBLE AS total FROM dc GROUP BY n, history) SELECT n, array_to_string(history, ' ') AS history, round(greatest(1 - mass / total, 0), 9) AS alpha FROM kt")
def katz_textbook_weights(spark: SparkSession, d: str) -> DataFrame:
    """Back-off weights with the history's count as the base: the discounted mass reaches the lower order."""
    return rounded(backoff.katz_model(kept_counts(spark, d), textbook=True)[1].withColumn("history", F.array_join("history", " ")), "alpha")


def _full_model(spark: SparkSession, d: str, kind: str):
    c = kept_counts(spark, d)
    model, alphas = backoff.katz_model(c) if kind == "katz" else backoff.kn_model(c)
    words = c.where("n = 1").select(F.element_at("gram", 1).alias("word"))
    return words, stored(model), stored(alphas), words.count()


def kept_continuations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(table, words) of the train split taken as one text (see operators/continuations.py)."""
    keys = table(spark, d, "application").select("sent_id")
    made = continuations.continuation_table(passages(spark, d).where("split_name = 'train'"), "sent_id", "toks", keys)
    return made, continuations.word_table(made)


def _model(spark: SparkSession, made: Callable[[], tuple[DataFrame, DataFrame]], kind: str):
    """What generate takes for a model, answered from the counts that ``made`` gives."""
    return None, continuations.Continuations(*made(), kind), None, 0


@query(
    f"""{_G}, {_KN}, top AS (SELECT gram[1] AS c FROM g WHERE n = 1 ORDER BY cnt DESC, gram[1] LIMIT 1), w AS (SELECT gram[1] AS word FROM g WHERE n = 1 AND gram[1] <> '<s>' UNION SELECT '</s>'),
 s AS (SELECT word, coalesce(m2.p, coalesce(a.alpha, 1) * coalesce(m1.p, 1.0 / (1000 * (SELECT count(*) FROM g WHERE n = 1)))) AS p FROM w CROSS JOIN top
   LEFT JOIN model m2 ON m2.gram = [c, word] LEFT JOIN model m1 ON m1.gram = [word] LEFT JOIN alphas a ON a.history = [c])
SELECT word, round(p / (SELECT sum(p) FROM s), 9) AS p FROM s"""
)
def next_word_probs(spark: SparkSession, d: str) -> DataFrame:
    """The distribution of the word after the most frequent word, by the Kneser-Ney model."""
    words, model, alphas, vocab = _full_model(spark, d, "kn")
    top = counts(spark, d).where("n = 1").orderBy(F.col("cnt").desc(), F.element_at("gram", 1)).select("gram").first()
    context = tuple(top.gram) if top else ()
    return rounded(generate.next_word_probs([context], words, model, alphas, vocab, 4).select("word", "p"), "p")


def _texts(spark: SparkSession, d: str, *hows: str) -> list[tuple[str, str, list[str]]]:
    """(model, method, text) of both models; the text is counted once for both."""
    make = {"greedy": lambda m: generate.greedy(*m, 4, max_length=15), "beam_search": lambda m: generate.beam(*m, 4, max_length=15, width=20)}
    made = cache(lambda: kept_continuations(spark, d))
    models = {kind: _model(spark, made, kind) for kind in ("katz", "kn")}
    return [(kind, how, make[how](model)) for kind, model in models.items() for how in hows]


def _positions(spark: SparkSession, texts: list[tuple[str, str, list[str]]]) -> DataFrame:
    return spark.createDataFrame([(kind, i, w) for kind, _, text in texts for i, w in enumerate(text)], "model string, pos int, word string")


@query()
def greedy_generate(spark: SparkSession, d: str) -> DataFrame:
    return _positions(spark, _texts(spark, d, "greedy"))


@query()
def beam_generate(spark: SparkSession, d: str) -> DataFrame:
    return _positions(spark, _texts(spark, d, "beam_search"))


@query()
def generated_copies(spark: SparkSession, d: str) -> DataFrame:
    """(model, method, number, sentence): 100 copies of the texts each model generates, greedily and by beam. The seed is not used, so all are equal."""
    texts = _texts(spark, d, "greedy", "beam_search")
    parts = [generate.copies(spark, text).select(F.lit(kind).alias("model"), F.lit(how).alias("method"), "number", "sentence") for kind, how, text in texts]
    return reduce(DataFrame.unionByName, parts)


@query(
    f"""{_G}, {_QUADS}, {_quads_sql('test', 't')}, {_E0}, {_STEPS}, {_gts('test')},
 al AS (SELECT n::VARCHAR AS model, log_p FROM sc UNION ALL SELECT 'mixed', sum(ln(greatest(l1 * p1 + l2 * p2 + l3 * p3 + l4 * p4, 1e-10))) FROM q4t CROSS JOIN e10 GROUP BY sent_id),
 av AS ({_perplexity_sql('model', 'al')}), sg2 AS (SELECT max(a) AS top, (SELECT model FROM av WHERE model <> 'mixed' AND a IS NOT NULL ORDER BY a DESC, model LIMIT 1) AS best FROM av WHERE model <> 'mixed')
SELECT model, sentences, valid, round(a, 6) AS avg_log_p, perplexity, best, CASE WHEN model = 'mixed' THEN round(100 * (1 - exp(top - a)), 6) END AS improvement FROM av CROSS JOIN sg2"""
)
def model_comparison(spark: SparkSession, d: str) -> DataFrame:
    """The four Good-Turing models and their mixture, weighted as learnt on val, on the test passages; the mixture skips those of under four words."""
    model, unseen, hot = _gt(spark, d)
    weights = smoothing.optimise_lambdas(stored(_quads(spark, d, model, unseen, hot).select("p1", "p2", "p3", "p4")))[-1]
    single = _gt_log_p(tests(spark, d), model, unseen, hot).select(F.col("n").cast("string").alias("model"), "log_p")
    mixed = _mixed_log_p(_quads(spark, d, model, unseen, hot, "test"), weights).select(F.lit("mixed").alias("model"), "log_p")
    return rounded(smoothing.compare_models(smoothing.perplexity(single.unionByName(mixed), "model")), "avg_log_p", "improvement", places=6)
