"""Writers: the files the models and reports leave behind."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.operators.smoothing import additive, summary_report
from lexispark.sources.readers import generated_name


def token_documents(tokens: DataFrame, path: str) -> None:
    """JSON lines (doc_id, sentences as arrays of tokens) from (doc_id, sent_idx, tok_idx, token)."""
    ordered = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    sents = tokens.groupBy("doc_id", "sent_idx").agg(F.transform(ordered("tok_idx", "token"), lambda x: x["token"]).alias("toks"))
    docs = sents.groupBy("doc_id").agg(F.transform(ordered("sent_idx", "toks"), lambda x: x["toks"]).alias("sentences"))
    docs.write.mode("overwrite").json(path)


def sentence_documents(tokens: DataFrame, path: str) -> None:
    """JSON lines (doc_id, sentences as texts joined by blanks)."""
    ordered = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    sents = tokens.groupBy("doc_id", "sent_idx").agg(F.array_join(F.transform(ordered("tok_idx", "token"), lambda x: x["token"]), " ").alias("s"))
    sents.groupBy("doc_id").agg(F.transform(ordered("sent_idx", "s"), lambda x: x["s"]).alias("sentences")).write.mode("overwrite").json(path)


def ngram_tsv(table: DataFrame, n: int, path: str) -> None:
    """Tab-separated table of one order from (n, gram, cnt, p), by falling count, then n-gram, with 8 decimals."""
    names = ["token"] if n == 1 else [f"w{i + 1}" for i in range(n)]
    rows = table.where(F.col("n") == n).orderBy(F.col("cnt").desc(), "gram")
    columns = [F.col("gram")[i].alias(c) for i, c in enumerate(names)]
    out = rows.select(*columns, F.col("cnt").alias("count"), F.format_string("%.8f", "p").alias("p" if n == 1 else "p_cond"))
    out.write.mode("overwrite").csv(path, sep="\t", header=True, quote="")


def json_table(df: DataFrame, path: str) -> None:
    """JSON lines, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def model_table(df: DataFrame, path: str) -> None:
    """A model with all its columns, so that a loaded model scores like the saved one."""
    df.write.mode("overwrite").parquet(path)


def split_files(df: DataFrame, text: str, part: str, path: str) -> None:
    """One text folder per split, a line per text."""
    df.select(F.col(part), F.regexp_replace(text, "[\\r\\n]+", " ").alias("value")).write.mode("overwrite").partitionBy(part).text(path)


def pmi_csv(df: DataFrame, path: str) -> None:
    """CSV with header; an undefined score is an empty cell."""
    df.write.mode("overwrite").csv(path, header=True, nullValue="")


def smoothing_tables(counts: DataFrame, folder: str) -> None:
    """complete/: n, gram, cnt, method, p as JSON lines; summary/: a row per order."""
    json_table(additive(counts), f"{folder}/complete")
    json_table(summary_report(counts), f"{folder}/summary")


def sentence_probabilities(rows: DataFrame, orders: list[int], methods: tuple[str, ...], folder: str) -> None:
    """sentence_probabilities/: a JSON line per sentence; metadata/: how many, by which orders and methods."""
    json_table(rows, f"{folder}/sentence_probabilities")
    about = rows.agg(F.count(F.lit(1)).alias("total_sentences"))
    json_table(about.select("total_sentences", F.array(*map(F.lit, methods)).alias("smoothing_methods"), F.array(*map(F.lit, orders)).alias("ngram_orders")), f"{folder}/metadata")


def generated_sentences(greedy: DataFrame, beam: DataFrame, model: str, language: str, folder: str) -> None:
    """A JSON object with both lists, and a text folder for each, from (number, sentence). The lists are as long as was asked for (100)."""
    base = f"{folder}/{generated_name(model, language)}"
    listed = lambda df, name: df.agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "sentence"))), lambda x: x["sentence"]).alias(name))
    both = listed(greedy, "greedy").crossJoin(listed(beam, "beam_search"))
    json_table(both.select(F.lit(model).alias("model_name"), F.lit(language).alias("language"), F.size("greedy").alias("num_sentences"), "greedy", "beam_search"), f"{base}_generated_sentences")
    for rows, kind in ((greedy, "greedy"), (beam, "beam_search")):
        rows.orderBy("number").select("sentence").write.mode("overwrite").text(f"{base}_{kind}_sentences")


def stem_lines(stems: DataFrame, side: str, path: str) -> None:
    """A line per word from morphology.stem_words: rule splits, trie splits with their score, and words that stay whole."""
    w, stem, affix = F.col("word"), F.col("stem"), F.col("affix")
    ruled = F.format_string(f"%s=%s+%s [freq=%d, prob=%.4f, common_{side}]", w, *((affix, stem) if side == "prefix" else (stem, affix)), F.col("freq"), F.col("prob"))
    tried = F.format_string("%s=%s+%s [score=%.4f, freq=%d, prob=%.4f]", w, stem, affix, F.col("score"), F.col("freq"), F.col("prob"))
    line = F.when(F.col("how") == "rule", ruled).when(F.col("how") == "trie", tried).otherwise(F.format_string("%s=%s+ [nosplit]", w, w))
    stems.orderBy("word").select(line.alias("value")).write.mode("overwrite").text(path)


def analysis_lines(rows: DataFrame, column: str, path: str) -> None:
    """A line per analysis, in order."""
    rows.orderBy(column).select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def vocabulary(df: DataFrame, path: str) -> None:
    """(term, term_id) as JSON lines in the order of the ids; readers.vocabulary reads it back."""
    df.orderBy("term_id").write.mode("overwrite").json(path)


def neighbour_report(neighbours: DataFrame, texts: DataFrame) -> DataFrame:
    """(query, report): the query's text and a numbered line per neighbour, scores with 6 decimals.

    neighbours: query, neighbour, score, place. texts: id, text.
    """
    named = neighbours.join(texts.select(F.col("id").alias("neighbour"), "text"), "neighbour")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", "score", "text"))), lambda x: F.format_string("%d. (%.6f) %s", x["place"], x["score"], x["text"]))
    return named.groupBy("query").agg(F.array_join(lines, "\n").alias("body")).join(texts.select(F.col("id").alias("query"), F.col("text").alias("q")), "query").select("query", F.concat(F.lit("Query: "), "q", F.lit("\n"), "body").alias("report"))


def term_report(top: DataFrame, documents: int = 5) -> DataFrame:
    """(sent_id, report): the best terms of the first documents, one per line, from (sent_id, term, value, place)."""
    first = top.select("sent_id").distinct().orderBy("sent_id").limit(documents)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", "term", "value"))), lambda x: F.format_string("%s: %.6f", x["term"], x["value"]))
    return top.join(F.broadcast(first), "sent_id").groupBy("sent_id").agg(F.array_join(lines, "\n").alias("report"))


def sparse_blocks(triples: DataFrame, path: str, rows_per_block: int = 1000) -> None:
    """Blocks of rows as arrays data, indices and indptr (from 0), from (row, col, value): every block is made by one task."""

    def block(cells: pa.Table) -> pa.Table:
        cells = cells.sort_by([("row", "ascending"), ("col", "ascending")])
        first = cells["block"][0].as_py() * rows_per_block
        sizes = np.bincount(cells["row"].to_numpy() - first)
        columns = {"first_row": [first], "data": [cells["value"].to_numpy()], "indices": [cells["col"].to_numpy()], "indptr": [np.concatenate(([0], np.cumsum(sizes)))]}
        return pa.table({name: pa.array(v, type=pa.int64() if name == "first_row" else pa.list_(pa.float64() if name == "data" else pa.int64())) for name, v in columns.items()})

    keyed = triples.select(F.floor(F.col("row") / rows_per_block).alias("block"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value"))
    made = keyed.groupBy("block").applyInArrow(block, "first_row long, data array<double>, indices array<long>, indptr array<long>")
    made.write.mode("overwrite").parquet(path)


def sparse_matrix(triples: DataFrame, rows: int, cols: int, path: str) -> None:
    """One matrix (row, col, value) as a compressed sparse file. For collections that fit one file; else keep the long table."""
    frame = triples.orderBy("row", "col").toPandas()
    indptr = np.concatenate(([0], np.cumsum(np.bincount(frame["row"], minlength=rows))))
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    np.savez_compressed(path, data=frame["value"].to_numpy(), indices=frame["col"].to_numpy(), indptr=indptr, shape=np.array([rows, cols]))
