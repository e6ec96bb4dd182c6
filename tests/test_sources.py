"""Files read back what was written."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.sources import readers, writers

NESTED = [[["यह", "है"], ["a", "b"]], [["c"]]]


def test_nested_json(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text(json.dumps(NESTED), encoding="utf-8")
    rows = readers.nested_tokens(spark, str(path))
    assert [(r.doc_id, r.sent_idx, r.tok_idx, r.token) for r in rows.orderBy("doc_id", "sent_idx", "tok_idx").collect()] == [(0, 0, 0, "यह"), (0, 0, 1, "है"), (0, 1, 0, "a"), (0, 1, 1, "b"), (1, 0, 0, "c")]
    writers.token_documents(rows, str(tmp_path / "tokens"))
    assert sorted(map(tuple, readers.token_documents(spark, str(tmp_path / "tokens")).collect())) == sorted(map(tuple, rows.collect()))
    writers.sentence_documents(rows, str(tmp_path / "sents"))
    assert sorted(map(tuple, readers.sentence_documents(spark, str(tmp_path / "sents")).collect())) == [(0, 0, "यह है"), (0, 1, "a b"), (1, 0, "c")]
    (tmp_path / "s.json").write_text(json.dumps([["One", ""], ["Two"]]))
    assert readers.nested_sentences(spark, str(tmp_path / "s.json")).count() == 3
    assert readers.sentences_with_fallback(spark, [str(tmp_path / "no.json"), str(tmp_path / "s.json")], []).count() == 3
    (tmp_path / "m.json").write_text(json.dumps([["तीन", " "]]))
    paths = [str(tmp_path / n) for n in ("s.json", "m.json", "no.json")]
    assert sorted(r.sentence for r in readers.corpus_of(spark, paths).collect()) == ["One", "Two", "तीन"]
    assert readers.corpus_of(spark, paths[2:]).count() == len(readers.BUILT_IN)


def test_text_sources(spark, tmp_path):
    (tmp_path / "n.txt").write_text("One two three. Four. \nFive six seven eight.\n\n")
    path = str(tmp_path / "n.txt")
    assert sorted(r.sentence for r in readers.text_sentences(spark, path, 2, ".").collect()) == ["Five six seven eight.", "One two three."]
    assert readers.sentences_with_fallback(spark, [], [path]).count() == 2
    assert readers.sentences_with_fallback(spark, [], [], 200).count() == 200 * len(readers.BUILT_IN)
    assert readers.sampled_sentences(spark, path, 2).collect() == readers.sampled_sentences(spark, path, 2).collect()
    (tmp_path / "l.txt").write_text(" a \n\nB\r\nb2!\n")
    path = str(tmp_path / "l.txt")
    assert [tuple(r) for r in readers.lines(spark, path).orderBy("idx").collect()] == [(0, "a"), (1, "B"), (2, "b2!")]
    assert sorted(r.word for r in readers.word_list(spark, path).collect()) == ["a", "b", "b2!"]
    assert sorted(r.word for r in readers.corpus_words(spark, path).collect()) == ["B", "a", "b"]
    df = spark.createDataFrame([(1, ""), (2, "x"), (3, "y")], "id long, text string")
    assert [r.text for r in readers.first_texts(df, "text", 2, "id").collect()] == ["x"]
    nested = spark.createDataFrame([([[["a", " "], ["b"]]],)], "v array<array<array<string>>>")
    assert sorted(r.token for r in readers.flat_tokens(nested, "v", 3).collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        readers.flat_tokens(nested, "v", 4)


def test_tables_and_models(spark, tmp_path):
    table = spark.createDataFrame([(2, ["a", '"'], 3, 0.5), (2, ["a", "b"], 5, 0.25), (1, ["a"], 8, 1.0)], "n int, gram array<string>, cnt long, p double")
    writers.ngram_tsv(table, 2, str(tmp_path / "bi"))
    back = readers.ngram_tsv(spark, str(tmp_path / "bi"), 2)
    assert {tuple(r.gram): r.cnt for r in back.collect()} == {("a", '"'): 3, ("a", "b"): 5}
    writers.model_table(table, str(tmp_path / "m"))
    assert readers.model_table(spark, str(tmp_path / "m")).count() == 3
    writers.pmi_csv(spark.createDataFrame([("a", None), ("b", 1.5)], "w string, pmi double"), str(tmp_path / "pmi"))
    assert [r.pmi for r in spark.read.csv(str(tmp_path / "pmi"), header=True, schema="w string, pmi double").orderBy("w").collect()] == [None, 1.5]
    (tmp_path / "v.json").write_text(json.dumps({"a": 0, "b": 1}))
    vocab = readers.vocabulary_object(spark, str(tmp_path / "v.json"))
    writers.vocabulary(vocab, str(tmp_path / "vocab"))
    assert sorted(map(tuple, readers.vocabulary(spark, str(tmp_path / "vocab")).collect())) == [("a", 0), ("b", 1)]
    triples = spark.createDataFrame([(0, 1, 2.0), (2, 0, 1.0)], "row long, col long, value double")
    writers.sparse_matrix(triples, 3, 2, str(tmp_path / "x.npz"))
    with np.load(tmp_path / "x.npz") as z:
        assert list(z["indptr"]) == [0, 1, 1, 2]
    writers.sparse_blocks(triples.unionByName(spark.createDataFrame([(2005, 1, 4.0), (2005, 0, 3.0)], triples.schema)), str(tmp_path / "blocks"))
    assert sorted(map(tuple, readers.triples_from_blocks(spark, str(tmp_path / "blocks"), vocab).collect())) == [(0, "b", 2.0), (2, "a", 1.0), (2005, "a", 3.0), (2005, "b", 4.0)]
    writers.sparse_blocks(triples.where("false"), str(tmp_path / "none"))
    assert readers.triples_from_blocks(spark, str(tmp_path / "none")).count() == 0
    assert sorted(map(tuple, readers.triples_from_csr(spark, str(tmp_path / "x.npz"), vocab).collect())) == [(0, "b", 2.0), (2, "a", 1.0)]


def test_reports_and_splits(spark, tmp_path):
    rows = spark.createDataFrame([("a\nb", "train"), ("c", "test")], "t string, part string")
    writers.split_files(rows, "t", "part", str(tmp_path / "s"))
    assert [r.value for r in spark.read.text(str(tmp_path / "s" / "part=train")).collect()] == ["a b"]
    made = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "number long, sentence string")
    writers.generated_sentences(made("x", "y"), made("z", "z"), "Kneser Ney", "hindi", str(tmp_path))
    assert [r.value for r in spark.read.text(str(tmp_path / "kneser_ney_hindi_greedy_sentences")).collect()] == ["x", "y"]
    assert spark.read.text(str(tmp_path / "kneser_ney_hindi_beam_search_sentences")).count() == 2
    r = readers.generated_sentences(spark, str(tmp_path), "Kneser Ney", "hindi").first()
    assert (r.model_name, r.language, r.num_sentences, r.greedy, r.beam_search) == ("Kneser Ney", "hindi", 2, ["x", "y"], ["z", "z"])
    near = spark.createDataFrame([(1, 2, 0.5, 1)], "query long, neighbour long, score double, place int")
    texts = spark.createDataFrame([(1, "q"), (2, "n")], "id long, text string")
    assert writers.neighbour_report(near, texts).first().report == "Query: q\n1. (0.500000) n"
    top = spark.createDataFrame([(1, "t", 0.25, 1)], "sent_id long, term string, value double, place int")
    assert writers.term_report(top).first().report == "t: 0.250000"


@pytest.mark.parametrize("text", ["The_DT dog_ba_NN x\n\nIt_PRP ran_VBD\n", "The/DT dog_ba/NN x\n\nIt/PRP ran/VBD\n", "The x DT\ndog_ba NN\n\n\nIt PRP\nran VBD\nx\n"])
def test_tagged_corpus(spark, tmp_path, text):
    (tmp_path / "t.txt").write_text(text)
    rows = readers.tagged_corpus(spark, str(tmp_path / "t.txt")).orderBy("sent_id", "pos").collect()
    assert [(r.sent_id, r.word, r.tag) for r in rows] == [(0, "The", "DT"), (0, "dog_ba", "NN"), (1, "It", "PRP"), (1, "ran", "VBD")]


def test_files_in_many_splits(spark, tmp_path):
    """Lines and sentences are numbered over splits of a few bytes and over several files; a sentence may lie across them."""
    sents = [[f"w{i}x{j}" for j in range(i % 5 + 1)] for i in range(60)]
    half = ["\n".join("\n".join(f"{w} TAG{len(w)}" for w in s) + "\n" for s in part) + "\n" for part in (sents[:30], sents[30:])]
    for name, text in zip(("a.txt", "b.txt"), half):
        (tmp_path / name).write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = readers.tagged_corpus(spark, str(tmp_path)).orderBy("sent_id", "pos").collect()
        assert [(r.sent_id, r.pos, r.word) for r in rows] == [(i, j, w) for i, s in enumerate(sents) for j, w in enumerate(s)]
        numbered = readers.lines(spark, str(tmp_path)).orderBy("idx").collect()
        assert [(r.idx, r.line) for r in numbered] == list(enumerate(x for t in half for x in t.split("\n") if x))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_streams(spark, tmp_path):
    from lexispark.streaming import counts

    df = spark.createDataFrame([(1, "a b. a b"), (2, "b"), (3, None)], "doc_id long, text string").withColumn("at", F.current_timestamp())
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = counts.text_stream(spark, str(tmp_path / "in"), df.schema, 1)
    q = counts.to_memory(counts.running_counts(stream, "text", [1, 2]), "grams", str(tmp_path / "c1"))
    q.processAllAvailable()
    q.stop()
    assert {tuple(r.gram): r.cnt for r in spark.table("grams").collect()} == {("a",): 2, ("b",): 2, ("b.",): 1, ("a", "b."): 1, ("b.", "a"): 1, ("a", "b"): 1}
    q = counts.to_parquet(counts.stream_words(stream, "doc_id", "text"), str(tmp_path / "out"), str(tmp_path / "c2"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    q = counts.to_memory(counts.windowed_counts(stream, "at", "text"), "days", str(tmp_path / "c3"))
    q.processAllAvailable()
    q.stop()
    assert spark.table("days").agg(F.sum("cnt")).first()[0] == 5
