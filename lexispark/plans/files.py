"""Queries: sources and sinks. Each writes what a sink writes into the shared folder, reads it back, and must get what SQL gets from the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions import text as T
from lexispark.operators import backoff, generate, morphology as M, smoothing
from lexispark.operators import vectors as V
from lexispark.plans.classification import _HMM, _tagged
from lexispark.plans.language_models import _ADD, _G, _KN, ORDERS, _scores, _scores_sql, kept_counts, passages, rounded
from lexispark.plans.morphology import _WORDS, _stem_sql, BRANCHES, english_words
from lexispark.plans import registry
from lexispark.plans.registry import query
from lexispark.plans.text import _SENTS, documents
from lexispark.plans.vector_space import _TFIDF, _knn_sql, _HELD, cosine_knn_full, tf_idf
from lexispark.session import scratch
from lexispark.sources import readers, writers
from lexispark.sources.tables import table

#: Rows that load_texts scans: the feature of that reader.
FIRST = 1000
_LINE = "regexp_replace(coalesce(text, ''), '[\\r\\n]+', ' ', 'g')"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{T.WHITE}+|{T.WHITE}+$', '', 'g')"


def _one_field(word: Column) -> Column:
    """A word as one field of a file: white space inside it would part it."""
    return F.regexp_replace(word, T.WHITE, "·")


def _written_lines(spark: SparkSession, d: str) -> str:
    """The texts as files of one line each, in the order of their ids."""
    path = scratch(spark)
    documents(spark, d).orderBy("doc_id").select(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\r\\n]+", " ").alias("value")).write.text(path)
    return path


@query(f"SELECT doc_id, text FROM (SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT {FIRST}) WHERE length({_strip('text')}) > 0")
def load_texts(spark: SparkSession, d: str) -> DataFrame:
    """The first rows of a corpus, empty texts then left out, so fewer may remain."""
    return readers.first_texts(documents(spark, d).select("doc_id", "text"), "text", FIRST, "doc_id")


@query(f"SELECT doc_id, i AS sent_idx, j AS tok_idx, w[j + 1] AS token FROM (SELECT doc_id, i, regexp_split_to_array(s[i + 1], '\\s+') AS w FROM (SELECT doc_id, {_SENTS} AS s FROM documents), unnest(range(len(s))) AS u(i)), unnest(range(len(w))) AS v(j)")
def io_token_documents(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of tokens written as nested JSON and read back."""
    path = scratch(spark)
    sents = documents(spark, d).select("doc_id", F.posexplode(T.sentence_split(F.col("text"))).alias("sent_idx", "s"))
    writers.token_documents(sents.select("doc_id", "sent_idx", F.posexplode(F.split("s", "\\s+")).alias("tok_idx", "token")), path)
    return readers.token_documents(spark, path)


@query(f"SELECT doc_id, i AS sent_idx, array_to_string(regexp_split_to_array(s[i + 1], '\\s+'), ' ') AS sentence FROM (SELECT doc_id, {_SENTS} AS s FROM documents), unnest(range(len(s))) AS u(i)")
def io_sentence_documents(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    sents = documents(spark, d).select("doc_id", F.posexplode(T.sentence_split(F.col("text"))).alias("sent_idx", "s"))
    writers.sentence_documents(sents.select("doc_id", "sent_idx", F.posexplode(F.split("s", "\\s+")).alias("tok_idx", "token")), path)
    return readers.sentence_documents(spark, path)


@query(f"SELECT {_strip('t')} AS token, count(*) AS cnt FROM (SELECT unnest(flatten(list_transform({_SENTS}, lambda x: regexp_split_to_array(x, '[ ]')))) AS t FROM documents) WHERE {_strip('t')} <> '' GROUP BY 1")
def flat_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of nested arrays, flattened, trimmed, blank ones dropped, counted."""
    nested = documents(spark, d).select(F.transform(T.sentence_split(F.col("text")), lambda s: F.split(s, "[ ]")).alias("v"))
    return readers.flat_tokens(nested, "v", 2).groupBy("token").agg(F.count(F.lit(1)).alias("cnt"))


@query(
    f"""WITH r AS (SELECT unnest(string_split({_LINE}, '.')) AS t FROM documents), p AS (SELECT {_strip('t')} AS s FROM r)
SELECT s || '.' AS sentence, count(*) AS cnt FROM p WHERE len(list_filter(regexp_split_to_array(s, '{T.WHITE}+'), lambda x: x <> '')) > 2 GROUP BY 1"""
)
def io_text_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Text files parted at full stops: sentences of more than two words, the stop put back. Read through the chain of fallbacks."""
    path = _written_lines(spark, d)
    return readers.sentences_with_fallback(spark, [f"{path}/none.json"], [path]).groupBy("sentence").agg(F.count(F.lit(1)).alias("cnt"))


@query(f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, line FROM (SELECT doc_id, {_strip(_LINE)} AS line FROM documents) WHERE line <> ''")
def io_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines numbered over all files and splits, blank ones left out."""
    return readers.lines(spark, _written_lines(spark, d))


@query(f"SELECT lower({_strip(_LINE)}) AS word, count(*) AS cnt FROM documents WHERE {_strip(_LINE)} <> '' GROUP BY 1")
def io_word_list(spark: SparkSession, d: str) -> DataFrame:
    return readers.word_list(spark, _written_lines(spark, d)).groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))


@query(f"SELECT word, count(*) AS cnt FROM (SELECT regexp_replace(unnest(regexp_split_to_array({_LINE}, '{T.WHITE}+')), '[^\\p{{L}}]', '', 'g') AS word FROM documents) WHERE word <> '' GROUP BY 1")
def io_corpus_words(spark: SparkSession, d: str) -> DataFrame:
    return readers.corpus_words(spark, _written_lines(spark, d)).groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))


@query(f"{_G} SELECT n, array_to_string(gram, ' ') AS gram, cnt FROM g")
def io_ngram_tables(spark: SparkSession, d: str) -> DataFrame:
    """The count tables of all orders as tab-separated files, loaded again."""
    path, c = scratch(spark), kept_counts(spark, d).withColumn("p", F.lit(0.5))
    out = None
    for n in ORDERS:
        writers.ngram_tsv(c, n, f"{path}/{n}")
        part = readers.ngram_tsv(spark, f"{path}/{n}", n)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("gram", F.array_join("gram", " "))


@query(f"{_HMM}, x AS (SELECT row_number() OVER (ORDER BY sent_id) - 1 AS sent_id, list_transform(toks, lambda w: regexp_replace(w, '{T.WHITE}', '·', 'g')) AS toks, tags FROM tg) SELECT sent_id, i AS pos, toks[i + 1] AS word, tags[i + 1] AS tag FROM x, unnest(range(len(toks))) AS u(i)")
def io_tagged_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Tagged passages written as word/TAG lines and read back, sentences numbered over all splits."""
    path = scratch(spark)
    pairs = F.zip_with("words", "tags", lambda w, t: F.concat(_one_field(w), F.lit("/"), t))
    _tagged(spark, d).orderBy("sent_id").select(F.array_join(pairs, " ").alias("value")).write.text(path)
    return readers.tagged_corpus(spark, path, "/")


@query(f"{_HMM}, x AS (SELECT row_number() OVER (ORDER BY sent_id) - 1 AS sent_id, list_transform(toks, lambda w: regexp_replace(w, '{T.WHITE}', '·', 'g')) AS toks, tags FROM tg) SELECT sent_id, i AS pos, toks[i + 1] AS word, tags[i + 1] AS tag FROM x, unnest(range(len(toks))) AS u(i)")
def io_tagged_columns(spark: SparkSession, d: str) -> DataFrame:
    """The same as columns, a line per word and a blank one after every sentence."""
    path = scratch(spark)
    rows = F.concat(F.zip_with("words", "tags", lambda w, t: F.concat(_one_field(w), F.lit(" x "), t)), F.array(F.lit("")))
    _tagged(spark, d).orderBy("sent_id").select(F.explode(rows).alias("value")).write.text(path)
    return readers.tagged_corpus(spark, path, "")


@query(f"{_TFIDF} SELECT sent_id AS row, term, round(value, 9) AS value FROM ti WHERE split_name = 'train'")
def io_sparse_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The weight matrix of the train split stored as sparse blocks beside its vocabulary, and read back by names."""
    path = scratch(spark)
    vocab = V.first_seen_vocabulary(passages(spark, d).where("split_name = 'train'"), "sent_id", "toks")
    writers.vocabulary(vocab, f"{path}/vocabulary")
    known = readers.vocabulary(spark, f"{path}/vocabulary")
    cells = tf_idf(spark, d).where("split_name = 'train'").join(known, "term").select(F.col("sent_id").alias("row"), F.col("term_id").alias("col"), "value")
    writers.sparse_blocks(cells, f"{path}/matrix")
    return rounded(readers.triples_from_blocks(spark, f"{path}/matrix", known), "value")


@query(
    f"""{_TFIDF}, t AS (SELECT sent_id, i AS pos, toks[i + 1] AS term FROM app, unnest(range(len(toks))) AS u(i) WHERE split_name = 'train'),
 f AS (SELECT term, min(sent_id * 1000000 + pos) AS pos_key FROM t GROUP BY term) SELECT term, row_number() OVER (ORDER BY pos_key) - 1 AS term_id, round(idf.idf, 9) AS idf FROM f JOIN idf USING (term)"""
)
def io_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Vocabulary and inverse document frequencies, saved and loaded again."""
    path = scratch(spark)
    rows = passages(spark, d).where("split_name = 'train'")
    writers.vocabulary(V.first_seen_vocabulary(rows, "sent_id", "toks"), f"{path}/vocabulary")
    n = rows.where(F.size("toks") > 0).agg(F.count(F.lit(1)).alias("n"))
    writers.model_table(V.inverse_document_frequency(V.term_frequency(rows, "sent_id", "toks"), n).select("term", "idf"), f"{path}/idf")
    return rounded(readers.vocabulary(spark, f"{path}/vocabulary").join(readers.model_table(spark, f"{path}/idf"), "term"), "idf")


@query(f"{_G}, {_ADD} SELECT sm.n, array_to_string(gram, ' ') AS gram, cnt, method, round(p, 9) AS p, total AS tokens, vocab AS vocab_size FROM sm JOIN tot USING (n)")
def io_smoothing_tables(spark: SparkSession, d: str) -> DataFrame:
    """The smoothed tables and their summary, saved and loaded again."""
    path = scratch(spark)
    writers.smoothing_tables(kept_counts(spark, d), path)
    complete, summary = readers.smoothing_tables(spark, path)
    joined = complete.join(F.broadcast(summary), "n").withColumn("gram", F.array_join("gram", " "))
    return rounded(joined.select("n", "gram", "cnt", "method", "p", "tokens", "vocab_size"), "p")


@query(f"{_scores_sql('1e-10')} SELECT sent_id, n::INT AS n, token_count::INT AS token_count, round(max(log_p) FILTER (method = 'add_k'), 6) AS add_k, (SELECT count(DISTINCT (sent_id, n)) FROM x) AS total_sentences FROM x GROUP BY sent_id, n, token_count")
def io_sentence_probabilities(spark: SparkSession, d: str) -> DataFrame:
    """Sentence probabilities with their metadata, saved and loaded again."""
    path = scratch(spark)
    writers.sentence_probabilities(_scores(spark, d, True).select("sent_id", "n", "token_count", "add_k"), ORDERS, smoothing.METHODS, path)
    rows, about = readers.sentence_probabilities(spark, path, "sent_id long, n int, token_count int, add_k double")
    return rounded(rows.crossJoin(F.broadcast(about.select("total_sentences"))), "add_k", places=6)


@query(f"{_G}, {_KN} SELECT model.n::INT AS n, array_to_string(gram, ' ') AS gram, round(p, 9) AS p FROM model")
def io_model(spark: SparkSession, d: str) -> DataFrame:
    """A Kneser-Ney model with all orders, saved and loaded again."""
    path = scratch(spark)
    writers.model_table(backoff.kn_model(kept_counts(spark, d))[0], path)
    return rounded(readers.model_table(spark, path).withColumn("gram", F.array_join("gram", " ")), "p")


@query(f"{_G}, t AS (SELECT array_to_string(list(w), ' ') AS s FROM (SELECT gram[1] AS w FROM g WHERE n = 1 ORDER BY cnt DESC, gram[1] LIMIT 5)) SELECT 'Most Frequent' AS model_name, 'hindi' AS language, 100::INT AS num_sentences, k::INT AS number, s AS greedy, s AS beam_search FROM t, unnest(range(100)) AS u(k)")
def io_generated_sentences(spark: SparkSession, d: str) -> DataFrame:
    """100 copies of one text (here the five most frequent words) through the sinks of generated texts."""
    path = scratch(spark)
    words = [r.w for r in kept_counts(spark, d).where("n = 1").orderBy(F.col("cnt").desc(), F.element_at("gram", 1)).limit(5).select(F.element_at("gram", 1).alias("w")).collect()]
    rows = generate.copies(spark, words)
    writers.generated_sentences(rows, rows, "Most Frequent", "hindi", path)
    made = readers.generated_sentences(spark, path, "Most Frequent", "hindi")
    both = F.posexplode(F.arrays_zip("greedy", "beam_search")).alias("number", "x")
    return made.select("model_name", "language", "num_sentences", both).select("model_name", "language", "num_sentences", "number", "x.greedy", "x.beam_search")


@query(f"SELECT coalesce(split_name, '__HIVE_DEFAULT_PARTITION__') AS part, regexp_replace(coalesce(sentence, ''), '[\\r\\n]+', ' ', 'g') AS value, count(*) AS cnt FROM application GROUP BY 1, 2")
def io_split_files(spark: SparkSession, d: str) -> DataFrame:
    """One text folder per split, read back."""
    path = scratch(spark)
    rows = table(spark, d, "application").select(F.coalesce("split_name", F.lit("__HIVE_DEFAULT_PARTITION__")).alias("part"), F.coalesce("sentence", F.lit("")).alias("sentence"))
    writers.split_files(rows, "sentence", "part", path)
    return spark.read.schema("value string, part string").text(path).groupBy("part", "value").agg(F.count(F.lit(1)).alias("cnt"))


@query("SELECT rec_id, pair_pos, bigram_count, CASE WHEN NOT isnan(pmi) THEN pmi END AS pmi, count(*) AS cnt FROM pmi_validation_scores GROUP BY ALL")
def io_pmi_csv(spark: SparkSession, d: str) -> DataFrame:
    """Scores as CSV; an undefined one is an empty cell and comes back as null."""
    path = scratch(spark)
    rows = table(spark, d, "pmi_validation_scores").select("rec_id", "pair_pos", "bigram_count", F.when(~F.isnan("pmi"), F.col("pmi")).alias("pmi"))
    writers.pmi_csv(rows, path)
    back = spark.read.csv(path, header=True, schema="rec_id long, pair_pos int, bigram_count long, pmi double")
    return back.groupBy("rec_id", "pair_pos", "bigram_count", "pmi").agg(F.count(F.lit(1)).alias("cnt"))


@query(
    f"""WITH nn AS ({_knn_sql(_HELD, "split_name <> 'train'", False, False)}), tx AS (SELECT sent_id, coalesce(sentence, '') AS s FROM (SELECT *, row_number() OVER (PARTITION BY sent_id ORDER BY ingested_at DESC) AS k FROM application) WHERE k = 1)
SELECT query, 'Query: ' || any_value(q.s) || chr(10) || string_agg(place || '. (' || printf('%.6f', score) || ') ' || t.s, chr(10) ORDER BY place) AS report FROM nn JOIN tx q ON q.sent_id = query JOIN tx t ON t.sent_id = neighbour GROUP BY query"""
)
def neighbour_reports(spark: SparkSession, d: str) -> DataFrame:
    """Per query its text and the numbered lines of its neighbours."""
    from lexispark.sources.tables import latest_once_wide

    rows = latest_once_wide(table(spark, d, "application").select("sent_id", "sentence", "ingested_at"), ["sent_id"], ["ingested_at"])
    return writers.neighbour_report(cosine_knn_full(spark, d), rows.select(F.col("sent_id").alias("id"), F.coalesce("sentence", F.lit("")).alias("text")))


@query(
    f"""{_TFIDF}, r AS (SELECT sent_id, term, round(value, 6) AS value, row_number() OVER (PARTITION BY sent_id ORDER BY round(value, 9) DESC, term) AS place FROM ti)
SELECT sent_id, string_agg(term || ': ' || printf('%.6f', value), chr(10) ORDER BY place) AS report FROM r WHERE place <= 10 AND sent_id IN (SELECT DISTINCT sent_id FROM ti ORDER BY 1 LIMIT 5) GROUP BY sent_id"""
)
def term_reports(spark: SparkSession, d: str) -> DataFrame:
    """The best terms of the first five passages."""
    from lexispark.plans.vector_space import tfidf_top_terms

    return writers.term_report(tfidf_top_terms(spark, d))


def _line_sql(side: str) -> str:
    ruled = "affix || '+' || stem" if side == "prefix" else "stem || '+' || affix"
    return f"""{_WORDS} SELECT CASE how WHEN 'rule' THEN word || '=' || {ruled} || ' [freq=' || freq || ', prob=' || printf('%.4f', prob) || ', common_{side}]'
 WHEN 'trie' THEN word || '=' || stem || '+' || affix || ' [score=' || printf('%.4f', score) || ', freq=' || freq || ', prob=' || printf('%.4f', prob) || ']' ELSE word || '=' || word || '+ [nosplit]' END AS value FROM ({_stem_sql(side)})"""


@query(_line_sql("prefix"))
def io_prefix_lines(spark: SparkSession, d: str) -> DataFrame:
    """The split of every word as a line of text."""
    path = scratch(spark)
    writers.stem_lines(M.stem_words(english_words(spark, d), "prefix", BRANCHES), "prefix", path)
    return spark.read.text(path)


@query(_line_sql("suffix"))
def io_suffix_lines(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    writers.stem_lines(M.stem_words(english_words(spark, d), "suffix", BRANCHES), "suffix", path)
    return spark.read.text(path)


@query(f"SELECT analysis FROM ({registry._SQL['plural_fst']})")
def io_plural_lines(spark: SparkSession, d: str) -> DataFrame:
    """The plural analyses of all tokens as lines of text."""
    from lexispark.plans.morphology import plural_fst

    path = scratch(spark)
    writers.analysis_lines(plural_fst(spark, d), "analysis", path)
    return spark.read.text(path).select(F.col("value").alias("analysis"))
