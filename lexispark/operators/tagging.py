"""Hidden Markov tagger: counts, smoothed probabilities and Viterbi decoding."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.operators.skew import lookup_join

START, END = "<START>", "<END>"


def hmm_transitions(tagged: DataFrame) -> DataFrame:
    """(prev, tag, cnt) with start and end marks, from one row per sentence with arrays ``words`` and ``tags``."""
    path = F.concat(F.array(F.lit(START)), "tags", F.array(F.lit(END)))
    pairs = F.transform(F.sequence(F.lit(1), F.size("tags") + 1), lambda i: F.struct(F.element_at(path, i).alias("prev"), F.element_at(path, i + 1).alias("tag")))
    return tagged.select(F.explode(pairs).alias("x")).groupBy("x.prev", "x.tag").agg(F.count(F.lit(1)).alias("cnt"))


def hmm_emissions(tagged: DataFrame) -> DataFrame:
    """(tag, word, cnt)."""
    return tagged.select(F.explode(F.arrays_zip("tags", "words")).alias("x")).groupBy(F.col("x.tags").alias("tag"), F.col("x.words").alias("word")).agg(F.count(F.lit(1)).alias("cnt"))


def tag_counts(transitions: DataFrame, emissions: DataFrame) -> DataFrame:
    """(tag, total): a tag is counted where it stands and again where it precedes, so twice; the start mark once a sentence."""
    here = emissions.groupBy("tag").agg(F.sum("cnt").alias("c"))
    before = transitions.groupBy(F.col("prev").alias("tag")).agg(F.sum("cnt").alias("c"))
    return here.unionByName(before).groupBy("tag").agg(F.sum("c").alias("total"))


def tag_set(transitions: DataFrame) -> DataFrame:
    """(tag) of all states, marks included."""
    return transitions.select(F.explode(F.array("prev", "tag")).alias("tag")).distinct()


def transition_probabilities(transitions: DataFrame, totals: DataFrame) -> DataFrame:
    """(prev, tag, p) of every pair of states: (c + 1) / (total(prev) + tags). A tag set is small by nature."""
    tags = tag_set(transitions)
    n = tags.agg(F.count(F.lit(1)).alias("n"))
    grid = tags.select(F.col("tag").alias("prev")).where(F.col("prev") != END).crossJoin(F.broadcast(tags.where(F.col("tag") != START)))
    joined = grid.join(transitions, ["prev", "tag"], "left").join(F.broadcast(totals.select(F.col("tag").alias("prev"), "total")), "prev", "left").crossJoin(F.broadcast(n))
    return joined.select("prev", "tag", ((F.coalesce("cnt", F.lit(0)) + 1) / (F.coalesce("total", F.lit(0)) + F.col("n"))).alias("p"))


def emission_probabilities(emissions: DataFrame, totals: DataFrame) -> DataFrame:
    """(tag, word, p) of the pairs seen: (c + 1) / (total(tag) + words)."""
    n = emissions.select("word").distinct().agg(F.count(F.lit(1)).alias("v"))
    return emissions.join(F.broadcast(totals), "tag").crossJoin(F.broadcast(n)).select("tag", "word", ((F.col("cnt") + 1) / (F.col("total") + F.col("v"))).alias("p"))


class Moves:
    """Log-probabilities of tag steps in sparse form: a default per previous tag, and the steps seen, which are never worse.

    An unseen step has (0 + 1) / (total + tags), so the best way into a tag is the best default of all tags or the best
    seen step. Memory grows with the steps seen, not with the square of the tags.
    """

    def __init__(self, tags: list[str], totals: dict[str, int], seen: list[tuple[str, str, int]], states: int):
        at = {t: i for i, t in enumerate(tags)}
        own = np.array([totals.get(t, 0) + states for t in tags], dtype=np.float64)
        self.tags, self.default = tags, -np.log(own)
        begin = totals.get(START, 0) + states
        self.first = np.full(len(tags), -math.log(begin))
        steps = sorted((at[b], at[a], math.log((n + 1) / own[at[a]])) for a, b, n in seen if a in at and b in at)
        for a, b, n in seen:
            if a == START and b in at:
                self.first[at[b]] = math.log((n + 1) / begin)
        self.to, self.source, self.log_p = (np.array(x) for x in zip(*steps)) if steps else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
        self.heads = np.flatnonzero(np.append(True, self.to[1:] != self.to[:-1])) if len(self.to) else np.zeros(0, dtype=np.int64)

    def step(self, layer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best score into every tag, and the previous tag it comes from (of equal ones the smaller), for rows of layers."""
        loose = layer + self.default
        link = np.repeat(loose.argmax(axis=1)[:, None], len(self.tags), axis=1)
        best = np.repeat(loose.max(axis=1)[:, None], len(self.tags), axis=1)
        if len(self.to):
            offers = layer[:, self.source] + self.log_p
            top = np.maximum.reduceat(offers, self.heads, axis=1)
            group = np.repeat(np.arange(len(self.heads)), np.diff(np.append(self.heads, len(self.to))))
            came = np.minimum.reduceat(np.where(offers == top[:, group], self.source, len(self.tags)), self.heads, axis=1)
            at = self.to[self.heads]
            better = (top > best[:, at]) | ((top == best[:, at]) & (came < link[:, at]))
            best[:, at], link[:, at] = np.where(better, top, best[:, at]), np.where(better, came, link[:, at])
        return best, link


def viterbi(scores: np.ndarray, begin: np.ndarray, moves: Moves) -> np.ndarray:
    """The best tag number of every word. ``scores`` (words x tags) holds ln p of the words of sentences that begin at ``begin``.

    Sentences are walked side by side, the longest first, so that each step is one array operation.
    """
    size = np.diff(np.append(begin, len(scores)))
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    out = np.zeros(len(scores), dtype=np.int64)
    if not len(size) or not size[0] or not len(moves.tags):
        return out
    layer = moves.first + scores[begin]
    links: list[np.ndarray] = []
    for t in range(1, int(size[0])):
        live = int(np.searchsorted(-size, -t, side="left"))  # sentences of more than t words
        best, link = moves.step(layer[:live])
        layer[:live] = best + scores[begin[:live] + t]
        links.append(link)
    at = layer.argmax(axis=1)
    for t in range(int(size[0]) - 1, -1, -1):
        live = int(np.searchsorted(-size, -t, side="left"))
        out[begin[:live] + t] = at[:live]
        if t:
            at[:live] = links[t - 1][np.arange(live), at[:live]]
    return out


#: Cells (words x tags) that a task scores at once.
CELLS = 4_000_000


def decode(sentences: DataFrame, key: str, words: str, transitions: DataFrame, emissions: DataFrame) -> DataFrame:
    """(key, pos, word, tag) of the likeliest tags; of equal paths the smaller tag.

    What all tasks get is the model of steps: a number per tag and the tag pairs seen. Emission counts meet the words in
    a shuffled join that parts frequent words, each sentence then carries the log-probabilities of what its words
    were seen as; all other tags have the default of the tag. The end mark's transition plays no part. Sentences
    without words give nothing.
    """
    totals = tag_counts(transitions, emissions)
    states = tag_set(transitions).count()
    seen = [(r.prev, r.tag, r.cnt) for r in transitions.collect()]
    tags = sorted({t for a, b, _ in seen for t in (a, b)} - {START, END})
    total = {r.tag: r.total for r in totals.collect()}
    vocab = emissions.select("word").distinct().count()
    shared = sentences.sparkSession.sparkContext.broadcast((Moves(tags, total, seen, states), np.array([total.get(t, 0) + vocab for t in tags], dtype=np.float64)))
    number = sentences.sparkSession.createDataFrame([(t, i) for i, t in enumerate(tags)], "tag string, number int")
    per_word = emissions.join(F.broadcast(number), "tag").groupBy("word").agg(F.collect_list("number").alias("numbers"), F.collect_list("cnt").alias("counts"), F.sum("cnt").alias("cnt"))
    rows = lookup_join(sentences.select(key, F.posexplode(words).alias("pos", "word")), per_word, "word", "cnt", "left")
    grouped = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "word", "numbers", "counts"))).alias("w"))

    def tagged(batch: pa.RecordBatch) -> pa.RecordBatch:
        moves, base = shared.value
        lists = batch.column(1)
        begin = lists.offsets.to_numpy()[:-1].astype(np.int64) - lists.offsets[0].as_py()
        pos, word, numbers, counts = lists.flatten().flatten()
        size = np.nan_to_num(pc.list_value_length(numbers).to_numpy(zero_copy_only=False)).astype(np.int64)
        row = np.repeat(np.arange(len(size)), size)
        scores = np.repeat(-np.log(base)[None, :], len(size), axis=0)
        tag = numbers.flatten().to_numpy(zero_copy_only=False)
        scores[row, tag] = np.log((counts.flatten().to_numpy(zero_copy_only=False) + 1) / base[tag])
        best = viterbi(scores, begin, moves)
        sentence = np.repeat(np.arange(batch.num_rows), np.diff(np.append(begin, len(size))))
        names = pa.array(moves.tags, type=pa.string()).take(pa.array(best)) if moves.tags else pa.nulls(len(best), pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(sentence)), pos, word, names], names=[key, "pos", "word", "tag"])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = max(1, len(shared.value[1]))
        for batch in batches:
            ends = batch.column(1).offsets.to_numpy()
            low = 0
            while low < batch.num_rows:  # pieces of a bounded number of cells, or one sentence
                high = max(low + 1, int(np.searchsorted(ends, ends[low] + CELLS // width, side="right")) - 1)
                yield tagged(batch.slice(low, high - low))
                low = high

    return grouped.mapInArrow(step, f"`{key}` {dict(sentences.dtypes)[key]}, pos int, word string, tag string")
