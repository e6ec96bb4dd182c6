"""Readers of the corpus, count and model files. Every one declares its schema; nothing is inferred."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.functions.text import WHITE, strip
from lexispark.operators.ranges import range_bounds, range_part, ranked

#: Text used when no corpus file can be read (see sentences_with_fallback).
BUILT_IN = (
    "The river is wide here",
    "A small boat crosses it every morning",
    "People wait on both banks with their baskets",
    "The market opens when the boat arrives",
    "In the evening the water is calm again",
)


def first_texts(df: DataFrame, text: str, n: int, order: str | None = None) -> DataFrame:
    """The first ``n`` rows scanned, then without empty texts, so fewer may remain."""
    rows = df.orderBy(order) if order else df
    return rows.limit(n).where(F.length(strip(F.col(text))) > 0)


def nested_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, sent_idx, tok_idx, token) of a JSON file that is one array of documents of sentences of tokens."""
    whole = spark.read.text(path, wholetext=True)
    docs = whole.select(F.posexplode(F.from_json("value", "array<array<array<string>>>")).alias("doc_id", "sents"))
    return docs.select("doc_id", F.posexplode("sents").alias("sent_idx", "toks")).select("doc_id", "sent_idx", F.posexplode("toks").alias("tok_idx", "token"))


def nested_sentences(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, sent_idx, sentence) of a JSON file that is one array of documents of sentences. Empty sentences stay."""
    docs = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<array<string>>")).alias("doc_id", "sents"))
    return docs.select("doc_id", F.posexplode("sents").alias("sent_idx", "sentence"))


def flat_tokens(df: DataFrame, column: str, depth: int) -> DataFrame:
    """Tokens of arrays nested 1 to 3 deep, trimmed, blank ones dropped; other depths are an error."""
    if depth not in (1, 2, 3):
        raise ValueError("arrays are nested 1 to 3 deep")
    value = F.col(column)
    for _ in range(depth - 1):
        value = F.flatten(value)
    return df.select(F.explode(value).alias("token")).select(strip(F.col("token")).alias("token")).where(F.col("token") != "")


def text_sentences(spark: SparkSession, path: str, least_words: int = 0, end: str = "") -> DataFrame:
    """Sentences of text files parted at full stops, trimmed, with more than ``least_words`` words, ``end`` put back."""
    parts = spark.read.text(path).select(F.explode(F.split("value", "\\.")).alias("s")).select(strip(F.col("s")).alias("s"))
    words = F.size(F.filter(F.split("s", WHITE + "+"), lambda x: x != ""))
    return parts.where((F.col("s") != "") & (words > least_words)).select(F.concat("s", F.lit(end)).alias("sentence"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def sentences_with_fallback(spark: SparkSession, json_paths: list[str], text_paths: list[str], copies: int = 200) -> DataFrame:
    """(sentence) of the first file that exists: JSON files first, then text files, else built-in sentences repeated."""
    for path in json_paths:
        if _exists(spark, path):
            return nested_sentences(spark, path).select("sentence")
    for path in text_paths:
        if _exists(spark, path):
            return text_sentences(spark, path, least_words=2, end=".")
    base = spark.createDataFrame([(s,) for s in BUILT_IN], "sentence string")
    return base.crossJoin(spark.range(copies)).select("sentence")


def sampled_sentences(spark: SparkSession, path: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` sentences of a text file in a seeded order that doesn't depend on partitions."""
    rows = text_sentences(spark, path)
    return rows.withColumn("h", F.md5(F.concat(F.lit(f"{seed}-"), "sentence"))).orderBy("h", "sentence").limit(n).select("sentence")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(part, at, value): the lines of text files, read in splits; (part, at) rises in the order of path and place."""
    where = F.format_string("%s %020d", F.col("_metadata.file_path"), F.col("_metadata.file_block_start"))
    return spark.read.text(path).select(where.alias("part"), F.monotonically_increasing_id().alias("at"), "value")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(idx, line) of text files in the order of their names: trimmed, blank lines dropped, idx counts the remaining lines from 0.

    Splits of a file are ranked on their own and offset by one row per split, so no task holds a file.
    """
    rows = numbered_lines(spark, path).select("part", "at", strip(F.col("value")).alias("line")).where("line <> ''")
    return ranked(rows, "part", [F.col("at")], "place").select((F.col("place") - 1).alias("idx"), "line")


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """(word): one word a line, trimmed, lower case, repetitions kept."""
    return spark.read.text(path).select(F.lower(strip(F.col("value"))).alias("word")).where(F.col("word") != "")


def corpus_words(spark: SparkSession, path: str) -> DataFrame:
    """(word): words between blanks with everything but letters taken out, empty ones dropped."""
    words = spark.read.text(path).select(F.explode(F.split("value", WHITE + "+")).alias("w"))
    return words.select(F.regexp_replace("w", "[^\\p{L}]", "").alias("word")).where(F.col("word") != "")


def ngram_tsv(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(n, gram, cnt) of a tab-separated table with a header, n word columns, the count and the probability."""
    names = [f"w{i + 1}" for i in range(n)]
    schema = ", ".join(f"{c} string" for c in names) + ", count long, p double"
    rows = spark.read.csv(path, sep="\t", header=True, quote="", schema=schema, enforceSchema=True)
    return rows.select(F.lit(n).alias("n"), F.array(*names).alias("gram"), F.col("count").alias("cnt"))


def tagged_corpus(spark: SparkSession, path: str, mark: str | None = None) -> DataFrame:
    """(sent_id, pos, word, tag) of word_TAG lines, word/TAG lines, or word-tag columns with blank lines between sentences.

    The first non-blank of the first ten lines decides, unless ``mark`` ('_' or '/', or '' for columns) does. Pairs are parted at
    their last mark; items without one are passed over. Splits of the files are numbered on their own and offset by
    one row per split; a sentence in columns may lie across splits.
    """
    if mark is None:
        sample = next((r.value.strip() for r in spark.read.text(path).limit(10).collect() if r.value.strip()), "")
        many = len(sample.split()) > 1
        mark = "/" if "/" in sample and many else "_" if "_" in sample and many else ""
    rows = numbered_lines(spark, path)
    if mark:
        items = F.filter(F.split("value", WHITE + "+"), lambda x: x.contains(mark))
        kept = rows.select("part", "at", items.alias("items")).where(F.size("items") > 0)
        sents = ranked(kept, "part", [F.col("at")], "place").select((F.col("place") - 1).alias("sent_id"), F.posexplode("items").alias("pos", "x"))
        of = lambda i: F.regexp_extract("x", f"^(.*){mark}([^{mark}]*)$", i)
        return sents.select("sent_id", "pos", of(1).alias("word"), of(2).alias("tag"))
    # the block of a line is the number of blank lines before it: within its split, plus those of earlier splits
    blank = (strip(F.col("value")) == "").cast("int")
    marked = rows.select("part", "at", F.split(strip(F.col("value")), WHITE + "+").alias("f"), blank.alias("blank"))
    inside = F.sum("blank").over(Window.partitionBy("part").orderBy("at"))
    before = F.coalesce(F.sum("blanks").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = marked.groupBy("part").agg(F.sum("blank").alias("blanks")).select("part", before.alias("earlier"))
    parts = marked.withColumn("inside", inside).where((F.col("blank") == 0) & (F.size("f") >= 2)).join(F.broadcast(offsets), "part").withColumn("block", F.col("inside") + F.col("earlier"))
    placed = parts.select("block", F.col("f")[0].alias("word"), F.element_at("f", -1).alias("tag"), (F.row_number().over(Window.partitionBy("block").orderBy("part", "at")) - 1).alias("pos"))
    blocks = parts.select("block").distinct()
    ids = ranked(blocks.withColumn("range", range_part(F.col("block"), range_bounds(blocks, "block"))), "range", [F.col("block")], "place")
    return placed.join(ids.select("block", (F.col("place") - 1).alias("sent_id")), "block").select("sent_id", "pos", "word", "tag")


def model_table(spark: SparkSession, path: str) -> DataFrame:
    """A model saved by writers.model_table."""
    return spark.read.parquet(path)


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(term, term_id) as writers.vocabulary leaves it: a JSON object per line."""
    return spark.read.schema("term string, term_id long").json(path)


def vocabulary_object(spark: SparkSession, path: str) -> DataFrame:
    """(term, term_id) of one JSON object that maps terms to ids, as other tools write it."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,long>").alias("m"))
    return whole.select(F.explode("m").alias("term", "term_id"))


def token_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, sent_idx, tok_idx, token) of what writers.token_documents left."""
    docs = spark.read.schema("doc_id long, sentences array<array<string>>").json(path)
    sents = docs.select("doc_id", F.posexplode("sentences").alias("sent_idx", "toks"))
    return sents.select("doc_id", "sent_idx", F.posexplode("toks").alias("tok_idx", "token"))


def sentence_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, sent_idx, sentence) of what writers.sentence_documents left."""
    docs = spark.read.schema("doc_id long, sentences array<string>").json(path)
    return docs.select("doc_id", F.posexplode("sentences").alias("sent_idx", "sentence"))


def corpus_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(sentence) of several nested JSON files (one per language), those that exist; built-in sentences where none does. Blank ones are dropped."""
    found = [nested_sentences(spark, p).select("sentence") for p in paths if _exists(spark, p)]
    rows = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([(s,) for s in BUILT_IN], "sentence string")
    return rows.where(strip(F.col("sentence")) != "")


def smoothing_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(table, summary) as writers.smoothing_tables left them: n, gram, cnt, method, p and a row per order."""
    table = spark.read.schema("n int, gram array<string>, cnt long, method string, p double").json(f"{folder}/complete")
    return table, spark.read.schema("n int, tokens long, total_unique_ngrams long, vocab_size long, techniques string").json(f"{folder}/summary")


def sentence_probabilities(spark: SparkSession, folder: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, metadata) as writers.sentence_probabilities left them."""
    return spark.read.schema(schema).json(f"{folder}/sentence_probabilities"), spark.read.schema("total_sentences long, smoothing_methods array<string>, ngram_orders array<int>").json(f"{folder}/metadata")


def generated_sentences(spark: SparkSession, folder: str, model: str, language: str) -> DataFrame:
    """(model_name, language, num_sentences, greedy, beam_search) of one model's JSON."""
    schema = "model_name string, language string, num_sentences int, greedy array<string>, beam_search array<string>"
    return spark.read.schema(schema).json(f"{folder}/{generated_name(model, language)}_generated_sentences")


def generated_name(model: str, language: str) -> str:
    """File names are lower case with '_' for blanks."""
    return f"{model.lower().replace(' ', '_')}_{language}"


def triples_from_blocks(spark: SparkSession, path: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """(row, col, value) of what writers.sparse_blocks left: blocks of rows as arrays data, indices and indptr."""
    blocks = spark.read.schema("first_row long, data array<double>, indices array<long>, indptr array<long>").parquet(path)
    i = F.posexplode(F.slice("indptr", F.lit(1), F.size("indptr") - 1)).alias("i", "low")
    rows = blocks.select("first_row", "data", "indices", "indptr", i)
    cut = lambda c: F.slice(c, (F.col("low") + 1).cast("int"), (F.get("indptr", F.col("i") + 1) - F.col("low")).cast("int"))
    cells = rows.select((F.col("first_row") + F.col("i")).alias("row"), F.explode(F.arrays_zip(cut("indices").alias("col"), cut("data").alias("value"))).alias("x"))
    frame = cells.select("row", "x.col", "x.value")
    return frame if vocabulary is None else frame.join(vocabulary.select(F.col("term_id").cast("long").alias("col"), "term"), "col", "left").select("row", "term", "value")


def triples_from_csr(spark: SparkSession, path: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """(row, col, value) of one compressed sparse matrix file as other tools write it: arrays data, indices, indptr and shape.

    One such file is one matrix and is read on the driver; what the library itself stores are blocks (triples_from_blocks).
    """
    import numpy as np

    with np.load(path) as z:
        data, indices, indptr = z["data"], z["indices"], z["indptr"]
    rows = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))
    import pandas as pd

    frame = spark.createDataFrame(pd.DataFrame({"row": rows.astype("int64"), "col": indices.astype("int64"), "value": data.astype("float64")}), "row long, col long, value double")
    return frame if vocabulary is None else frame.join(vocabulary.select(F.col("term_id").cast("long").alias("col"), "term"), "col", "left").select("row", "term", "value")
