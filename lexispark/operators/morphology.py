"""Trie-based stemming as prefix counts: a node of the trie is a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions.text import rule_prefix, rule_suffix


def word_counts(words: DataFrame, word: str) -> DataFrame:
    """(word, cnt) of the words, of any length; the empty word is none."""
    return words.where(F.length(word) > 0).groupBy(F.col(word).alias("word")).agg(F.count(F.lit(1)).alias("cnt"))


def trie_nodes(counts: DataFrame, word: str = "word") -> DataFrame:
    """(prefix, cnt, branching, max_child): words (with repetition) through each node, its children and the largest of them."""
    ends = counts.select("cnt", word, F.explode(F.sequence(F.lit(1), F.length(word))).alias("i"))  # a long word streams its beginnings
    prefixes = ends.select("cnt", F.substring(F.col(word), F.lit(1), F.col("i")).alias("prefix"))
    nodes = prefixes.groupBy("prefix").agg(F.sum("cnt").alias("cnt"))
    parent = F.expr("substring(prefix, 1, length(prefix) - 1)")
    children = nodes.groupBy(parent.alias("prefix")).agg(F.count(F.lit(1)).alias("branching"), F.max("cnt").alias("max_child"))
    return nodes.join(children, "prefix", "left").select("prefix", "cnt", F.coalesce("branching", F.lit(0)).alias("branching"), F.coalesce("max_child", F.lit(0)).alias("max_child"))


def best_split(counts: DataFrame, branch_threshold: int = 15, reverse: bool = False, as_written: bool = False) -> DataFrame:
    """(word, split_at, score, support) of the words that have a node with enough branches on their path.

    score = (1 - max_child/cnt) · branching; the greatest (to 9 places), of equal ones the deepest node. With
    ``reverse`` the trie holds reversed words and split_at counts from the end; ``as_written`` then walks the word
    forwards in that trie.
    """
    own = counts.select("word", "cnt", (F.reverse("word") if reverse else F.col("word")).alias("w"))
    nodes = trie_nodes(own.select("w", "cnt"), "w").where(F.col("branching") >= branch_threshold)
    score = F.round((F.lit(1.0) - F.col("max_child") / F.col("cnt")) * F.col("branching"), 9)
    nodes = nodes.select("prefix", F.col("cnt").alias("support"), score.alias("score")).where("score > 0")
    path = F.col("word") if as_written else F.col("w")
    walked = own.select("word", path.alias("path"), F.explode(F.sequence(F.lit(1), F.length(path))).alias("split_at"))
    met = walked.select("word", "split_at", F.substring(F.col("path"), F.lit(1), F.col("split_at")).alias("prefix")).join(nodes, "prefix")
    best = Window.partitionBy("word").orderBy(F.col("score").desc(), F.col("split_at").desc())
    return met.withColumn("r", F.row_number().over(best)).where("r = 1").select("word", "split_at", "score", "support")


def stem_words(counts: DataFrame, side: str = "prefix", branch_threshold: int = 15) -> DataFrame:
    """(word, cnt, stem, affix, how, score, freq, prob) of every distinct word.

    A rule of the affix lists comes first (freq: how often the stem is itself a word); words no rule takes are
    split at the best trie node if at least two characters of stem and one of affix remain, else not at all.
    """
    if side not in ("prefix", "suffix"):
        raise ValueError("side is 'prefix' or 'suffix'")
    w = F.col("word")
    if side == "prefix":
        rule = counts.select("word", "cnt", rule_prefix(w).alias("affix")).withColumn("stem", F.expr("substring(word, length(affix) + 1)"))
    else:
        rule = counts.select("word", "cnt", rule_suffix(w).alias("r")).select("word", "cnt", F.col("r.suffix").alias("affix"), F.col("r.stem").alias("stem"))
    total = counts.agg(F.sum("cnt").alias("total"))
    known = counts.select(F.col("word").alias("stem"), F.col("cnt").alias("freq"))
    ruled = rule.where("affix IS NOT NULL").join(known, "stem", "left").select("word", "cnt", "stem", "affix", F.lit("rule").alias("how"), F.lit(0.0).alias("score"), F.coalesce("freq", F.lit(0)).alias("freq"))
    split = best_split(counts, branch_threshold, reverse=side == "suffix")
    rest = rule.where("affix IS NULL").select("word", "cnt").join(split, "word", "left")
    n = F.length("word")
    if side == "prefix":
        stem, affix = F.expr("substring(word, 1, split_at)"), F.expr("substring(word, split_at + 1)")
    else:
        stem, affix = F.expr("substring(word, 1, length(word) - split_at)"), F.expr("substring(word, length(word) - split_at + 1)")
    good = F.col("split_at").isNotNull() & ((F.col("split_at") >= 2) & (F.col("split_at") < n) if side == "prefix" else (n - F.col("split_at") >= 2))
    tried = rest.select(
        "word", "cnt", F.when(good, stem).otherwise(F.col("word")).alias("stem"), F.when(good, affix).otherwise("").alias("affix"), F.when(good, "trie").otherwise("nosplit").alias("how"),
        F.when(good, F.col("score")).otherwise(0.0).alias("score"), F.when(good, F.col("support")).otherwise(0).alias("freq"),
    )
    return ruled.unionByName(tried).crossJoin(F.broadcast(total)).withColumn("prob", F.round(F.col("freq") / F.col("total"), 9)).drop("total")


def stem_winner(prefix: DataFrame, suffix: DataFrame) -> DataFrame:
    """One row: splits and summed trie scores of both sides (over word occurrences) and the side that wins."""
    side = lambda df, s: df.agg(
        F.coalesce(F.sum(F.when(F.col("how") != "nosplit", F.col("cnt"))), F.lit(0)).alias(f"{s}_count"), F.round(F.coalesce(F.sum(F.col("score") * F.col("cnt")), F.lit(0.0)), 3).alias(f"{s}_score")
    )
    suffix_wins = (F.col("suffix_count") > F.col("prefix_count")) | ((F.col("suffix_count") == F.col("prefix_count")) & (F.col("suffix_score") > F.col("prefix_score")))
    return side(prefix, "prefix").crossJoin(side(suffix, "suffix")).withColumn("winner", F.when(suffix_wins, "suffix").otherwise("prefix"))
