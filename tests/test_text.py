"""Tokenisers and word rules against Python's own regular expressions and known answers."""

import re

import pytest
from pyspark.sql import functions as F

from lexispark.functions import text as T

SAMPLES = [
    "Visit https://a.example/x?y=1 or www.b.example, mail me@x.example by 12/05/2024 or 3.14 at 3pm.",
    "यह भाषा है। 24 लोग १२.५ किमी ते24 24ते", "গান ગુજરાતી தமிழ் తెలుగు ಕನ್ನಡ മലയാളം ਪੰਜਾਬੀ ଓଡ଼ିଆ اردو", "naïve café_x 1_000 a-b (c) [d] {e}", "", "   ", None, "12.05.24 1/2/2024x x1/2/2024",
]
WORD = [
    r"https?://\S+", r"www\.\S+", r"\S+@\S+\.\S+", r"\b\d{1,2}[-/\.]\d{1,2}[-/\.]\d{2,4}\b", r"\b\d+(?:\.\d+)?\b", "[ऀ-ॿ]+", "[઀-૿]+", "[ঀ-৿]+", "[஀-௿]+",
    "[ఀ-౿]+", "[ಀ-೿]+", "[ഀ-ൿ]+", "[਀-੿]+", "[଀-୿]+", "[؀-ۿ]+", "[a-zA-Z]+", r"[।॥!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]",
]
MESSAGE = r"https?://\S+|www\.\S+|[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}|\d{1,4}[-/]\d{1,2}[-/]\d{1,4}|\d+(?:\.\d+)?|\w+|[^\w\s]"
SUBWORD = "[ऀ-ॿ]+|[a-zA-Z]+|\\d+|[^\\w\\s]"


def evaluated(spark, values, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in df.select("i", column.alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "column, pattern, lower", [(T.word_tokens, "|".join(f"(?:{p})" for p in WORD), False), (T.message_tokens, MESSAGE, False), (T.subword_pretokens, SUBWORD, True)]
)
def test_tokenisers_agree_with_python(spark, column, pattern, lower):
    got = evaluated(spark, SAMPLES, column(F.col("t")))
    want = [[m.lower() if lower else m for m in re.findall(pattern, s or "")] for s in SAMPLES]
    assert got == want


def test_sentence_split(spark):
    assert evaluated(spark, [" A b. C!  D? यह है। 3.14 ", None, ""], T.sentence_split(F.col("t"))) == [["A b", "C", "D", "यह है", "3", "14"], [], []]


def test_dfa(spark):
    words = ["cat", "Cat", "cAt", "", "cat1", "a\n", None]
    assert evaluated(spark, words, T.dfa_accepts(F.col("t"))) == [True, True, False, False, False, False, None]
    assert evaluated(spark, [""], T.dfa_accepts(F.col("t"), accept_empty=True)) == [True]


@pytest.mark.parametrize(
    "word, want",
    [
        ("foxes", "foxes = fox+N+PL"), ("cities", "cities = city+N+PL"), ("dogs", "dogs = dog+N+PL"), ("bus", "bus = bus+N+SG"), ("Children", "children = child+N+PL"), ("cakes", "cakes = cakes+N+SG"),
        ("movies", "movies = movy+N+PL"), ("houses", "houses = hous+N+PL"), ("analyses", "analyses = analyses+N+SG"), ("foxs", "foxs = fox+N+PL"), ("as", "as = as+N+SG"), ("x1", "x1: Invalid Word"), ("", ": Invalid Word"),
    ],
)
def test_plural(spark, word, want):
    assert evaluated(spark, [word], T.plural_analysis(F.col("t"))) == [want]


def test_affixes(spark):
    assert evaluated(spark, ["undone", "interact", "un", "cat"], T.rule_prefix(F.col("t"))) == ["un", "in", None, None]
    got = evaluated(spark, ["cities", "boxes", "kindness", "cat", None], T.rule_suffix(F.col("t")))
    assert [tuple(x) if x else None for x in got] == [("city", "ies"), ("box", "es"), ("kindnes", "s"), None, None]


def test_ngrams_and_merges(spark):
    df = spark.createDataFrame([(["a", "b", "a", "b", "a"],), ([],), (["a"],)], "t array<string>")
    rows = df.select(T.ngrams(F.col("t"), 2).alias("n"), T.merge_pair(F.col("t"), "a", "b").alias("m"), T.adjacent_pairs(F.col("t")).alias("p")).collect()
    assert rows[0].n == [["a", "b"], ["b", "a"], ["a", "b"], ["b", "a"]] and rows[0].m == ["ab", "ab", "a"] and rows[0].p == [["a", "b"], ["b", "a"]]
    assert rows[1].n == [] and rows[1].m == [] and rows[2].n == [] and rows[2].m == ["a"]
