"""Byte-pair and WordPiece sub-word models over counted word types."""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.functions.text import subword_pretokens
from lexispark.session import stored

UNKNOWN = "[UNK]"
#: Word types a task remembers while it encodes texts.
REMEMBERED = 1_000_000


def word_frequencies(docs: DataFrame, text: str) -> DataFrame:
    """(word, freq) of the pre-tokens: the one pass over the corpus."""
    return docs.select(F.explode(subword_pretokens(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def pair_stats(words: DataFrame) -> DataFrame:
    """(left, right, freq): neighbouring characters, summed over word frequencies."""
    letters = F.filter(F.split("word", ""), lambda c: c != "")
    split = words.select("freq", letters.alias("s")).where(F.size("s") > 1)
    pairs = F.transform(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.struct(F.element_at("s", i).alias("left"), F.element_at("s", i + 1).alias("right")))
    return split.select("freq", F.explode(pairs).alias("p")).groupBy("p.left", "p.right").agg(F.sum("freq").alias("freq"))


def _joined(symbols: list[str], pair: tuple[str, str]) -> list[str]:
    """The symbols with every occurrence of the pair made one, from the left; places are found first, then closed from the right."""
    places: list[int] = []
    for i, here in enumerate(zip(symbols, symbols[1:])):
        if here == pair and (not places or i > places[-1] + 1):
            places.append(i)
    out = symbols[:]
    for i in reversed(places):
        out[i : i + 2] = ["".join(pair)]
    return out


def learn_merges(freqs: dict[str, int], merges: int, vocab_size: int | None = None) -> list[tuple[str, str, int]]:
    """(left, right, freq) in merge order; of equally frequent pairs the smaller one.

    Pair counts are kept up to date per merge, and only words that hold the merged pair are touched. The best pair is the
    top of a heap, into which every pair goes again when its count changes; entries of older counts are passed over.
    """
    splits = {w: list(w) for w in freqs}
    vocab = {c for w in freqs for c in w}
    stats: Counter[tuple[str, str]] = Counter()
    where: dict[tuple[str, str], set[str]] = defaultdict(set)
    for w, s in splits.items():
        for p in zip(s, s[1:]):
            stats[p] += freqs[w]
            where[p].add(w)
    heap = [(-n, p) for p, n in stats.items()]
    heapq.heapify(heap)
    out = []
    while heap and len(out) < merges and (vocab_size is None or len(vocab) < vocab_size):
        n, best = heapq.heappop(heap)
        if -n != stats.get(best, 0) or n >= 0:
            continue
        out.append((*best, -n))
        vocab.add(best[0] + best[1])
        changed = set()
        for w in where.pop(best):
            old = splits[w]
            s = splits[w] = _joined(old, best)
            if len(s) == len(old):
                continue
            for p in zip(old, old[1:]):
                stats[p] -= freqs[w]
                changed.add(p)
            for p in zip(s, s[1:]):
                stats[p] += freqs[w]
                where[p].add(w)
                changed.add(p)
        for p in changed:
            if stats[p] > 0:
                heapq.heappush(heap, (-stats[p], p))
            else:
                del stats[p]
                where.pop(p, None)
    return out


def _next_merges(pairs: list[tuple[str, str, int]], whole: bool) -> list[tuple[str, str, int]]:
    """The front of the most frequent pairs that surely are the next merges, in this order. ``whole``: there are no pairs but these.

    A new pair stands where a neighbour of a merged one stood, (x, left) or (right, x), and is at most as frequent. So the
    front ends with a pair of equal symbols (its own neighbour), before a neighbour of the others, and where a neighbour is
    as frequent and the new pair would be the smaller one. For that, all pairs as frequent have to be given: so not for the last count.
    """
    least = 0 if whole or not pairs else pairs[-1][2]
    by_count: dict[int, list[tuple[str, str]]] = defaultdict(list)
    for left, right, n in pairs:
        by_count[n].append((left, right))
    out: list[tuple[str, str, int]] = []
    begins: dict[str, list[str]] = defaultdict(list)  # left -> rights, right -> lefts of the front
    ends: dict[str, list[str]] = defaultdict(list)

    def new_pairs(x: str, y: str) -> Iterator[tuple[str, str]]:
        """What the pair may become by the merges of the front: x may have been taken up by its left, y by its right."""
        yield from ((a, b) for a in [x, *(z + x for z in ends.get(x, ()))] for b in [y, *(y + z for z in begins.get(y, ()))] if (a, b) != (x, y))

    for left, right, n in pairs:
        if out:
            if n <= least or right in begins or left in ends:
                break
            if any(p <= (left, right) for x, y in by_count[n] for p in new_pairs(x, y)):
                break
        out.append((left, right, n))
        if left == right:
            break
        begins[left].append(right)
        ends[right].append(left)
    return out


def _mapped(batches: Iterator[pa.RecordBatch], shared) -> Iterator[tuple[list[int], list[list[str]]]]:
    """Frequencies and symbols of each batch after the merges."""
    ranked = shared.value
    for batch in batches:
        yield batch.column(0).to_pylist(), [_applied(s, ranked) for s in batch.column(1).to_pylist()]


def _merges_in_rounds(words: DataFrame, merges: int, vocab_size: int | None, top: int, fold: int) -> list[tuple[str, str, int]]:
    """As learn_merges, with the word types and their symbols left in Spark.

    Each round counts all pairs and brings the ``top`` most frequent to the driver, which takes those that surely come next
    (_next_merges). Merges are applied where the symbols are read; the table of symbols is written anew every ``fold`` merges.
    """
    context = words.sparkSession.sparkContext

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(w) for w in batch.column(1).to_pylist()], type=pa.list_(pa.string()))], names=["freq", "s"])

    table = stored(words.where("word IS NOT NULL").select(F.col("freq").cast("long"), "word").mapInArrow(letters, "freq long, s array<string>"))
    size = table.select(F.explode("s").alias("c")).distinct().count()
    out: list[tuple[str, str, int]] = []
    folded = 0
    made: set[str] = set()
    while len(out) < merges and (vocab_size is None or size + len(made) < vocab_size):
        shared = context.broadcast({p[:2]: i for i, p in enumerate(out[folded:])})

        def rewrite(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for freqs, symbols in _mapped(batches, shared):
                kept = [(n, s) for n, s in zip(freqs, symbols) if len(s) > 1]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in kept], type=pa.int64()), pa.array([s for _, s in kept], type=pa.list_(pa.string()))], names=["freq", "s"])

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for freqs, symbols in _mapped(batches, shared):
                stats: Counter[tuple[str, str]] = Counter()
                for n, s in zip(freqs, symbols):
                    for p in zip(s, s[1:]):
                        stats[p] += n
                columns = [pa.array([p[0] for p in stats], type=pa.string()), pa.array([p[1] for p in stats], type=pa.string()), pa.array(list(stats.values()), type=pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["left", "right", "freq"])

        if len(out) - folded >= fold:
            table = stored(table.mapInArrow(rewrite, "freq long, s array<string>"))
            folded = len(out)
            shared.unpersist()
            continue
        pairs = table.mapInArrow(count, "left string, right string, freq long").groupBy("left", "right").agg(F.sum("freq").alias("freq"))
        best = [tuple(r) for r in pairs.where("freq > 0").orderBy(F.col("freq").desc(), "left", "right").limit(top).collect()]
        shared.unpersist()
        if not best:
            break
        for p in _next_merges(best, len(best) < top):
            if len(out) == merges or (vocab_size is not None and size + len(made) >= vocab_size):
                break
            out.append(p)
            made.add(p[0] + p[1])
    return out


def bpe_train(words: DataFrame, merges: int = 100, max_types: int = 200_000, vocab_size: int | None = None, top: int = 4096, fold: int = 1000) -> DataFrame:
    """(rank, left, right, freq).

    The corpus is counted by Spark. Up to ``max_types`` word types (of 16 characters on average) are merged by the driver;
    of more, the symbols stay in Spark and only the ``top`` most frequent pairs of a round reach the driver. All
    types count in both, and both give the same merges.
    """
    known = words.where("word IS NOT NULL")
    size = known.agg(F.count(F.lit(1)).alias("types"), F.coalesce(F.sum(F.length("word")), F.lit(0)).alias("letters")).first()
    if size.types <= max_types and size.letters <= 16 * max_types:
        learnt = learn_merges({r.word: r.freq for r in known.select("word", "freq").collect()}, merges, vocab_size)
    else:
        learnt = _merges_in_rounds(words, merges, vocab_size, top, fold)
    return words.sparkSession.createDataFrame([(i, *m) for i, m in enumerate(learnt)], "rank int, left string, right string, freq long")


def _per_word(words: DataFrame, column: str, encode) -> DataFrame:
    """Distinct words with ``pieces``: each type is encoded once, whatever its frequency."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = [encode(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pieces, type=pa.list_(pa.string()))], names=[column, "pieces"])

    return words.where(F.col(column).isNotNull()).select(column).distinct().mapInArrow(step, f"`{column}` string, pieces array<string>")


def _applied(symbols: list[str], ranked: dict[tuple[str, str], int]) -> list[str]:
    """The symbols after all merges in rank order."""
    done = -1
    while len(symbols) > 1:
        ranks = [ranked[p] for p in zip(symbols, symbols[1:]) if ranked.get(p, -1) > done]
        if not ranks:
            break
        done = min(ranks)
        symbols = _joined(symbols, next(p for p in zip(symbols, symbols[1:]) if ranked.get(p) == done))
    return symbols


def bpe_encode(words: DataFrame, merges: DataFrame, column: str = "word") -> DataFrame:
    """(word, pieces) of distinct words, merges applied in rank order. The merge table is a model of fixed size."""
    ranked = {(r.left, r.right): r.rank for r in merges.collect()}
    return _per_word(words, column, lambda word: _applied(list(word), ranked))


def bpe_token_counts(docs: DataFrame, key: str, text: str, merges: DataFrame) -> DataFrame:
    """(key, words, tokens) of every text with words: pre-tokens and the sub-words they are encoded to.

    Texts are encoded where they are read; nothing is shuffled. The merges (a model of fixed size) are broadcast, and a task
    remembers what it has encoded, up to REMEMBERED word types at once.
    """
    shared = docs.sparkSession.sparkContext.broadcast({(r.left, r.right): r.rank for r in merges.collect()})

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked, known = shared.value, {}
        for batch in batches:
            lists = batch.column(1)
            bounds = lists.offsets.to_numpy()
            types = lists.flatten().dictionary_encode()
            sizes = []
            for w in types.dictionary.to_pylist():
                size = known.get(w)
                if size is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    size = known[w] = len(_applied(list(w), ranked))
                sizes.append(size)
            total = np.concatenate(([0], np.cumsum(np.array(sizes, dtype=np.int64)[types.indices.to_numpy()] if len(sizes) else np.zeros(0, dtype=np.int64))))
            bounds = bounds - bounds[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds).astype(np.int64)), pa.array(np.diff(total[bounds]))], names=[key, "words", "tokens"])

    tokens = docs.select(key, subword_pretokens(F.col(text)).alias("w")).where(F.size("w") > 0)
    return tokens.mapInArrow(step, f"`{key}` {dict(docs.dtypes)[key]}, words long, tokens long")


def _spans(words: DataFrame, *carried: str) -> DataFrame:
    """(word, carried, i, s): every substring s of each word with its place i, streamed row by row however long the word."""
    starts = words.where(F.length("word") > 0).select("word", *carried, F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i"))
    sized = starts.select("word", *carried, "i", F.explode(F.sequence(F.lit(1), F.length("word") - F.col("i") + 1)).alias("j"))
    return sized.select("word", *carried, "i", F.substring(F.col("word"), F.col("i"), F.col("j")).alias("s"))


def word_pieces(words: DataFrame) -> DataFrame:
    """(piece, word): all substrings of each word once, '##' before those that don't begin it.

    A substring counts at the first place where it stands inside the word, so no copies are made that a shuffle would have to drop.
    """
    inner = F.expr("locate(s, word, 2) = i")
    spans = _spans(words).where((F.col("i") == 1) | inner)
    return spans.select("word", F.when(F.col("i") > 1, F.concat(F.lit("##"), "s")).otherwise(F.col("s")).alias("piece"))


def piece_scores(words: DataFrame) -> DataFrame:
    """(piece, score): summed frequency of the words that hold the piece anywhere, over its length; each word counts once.

    One aggregation by substring: a word counts at the substring's first place, and whether it stands at the
    beginning of a word, or inside one, says which pieces it makes.
    """
    spans = _spans(words, "freq").where((F.col("i") == 1) | F.expr("locate(s, word, 2) = i"))
    first = F.expr("locate(s, word) = i")
    held = spans.groupBy("s").agg(F.sum(F.when(first, F.col("freq"))).alias("c"), F.bool_or(F.col("i") == 1).alias("begins"), F.bool_or(F.col("i") > 1).alias("inside"))
    pieces = F.array(F.when(F.col("begins"), F.col("s")), F.when(F.col("inside"), F.concat(F.lit("##"), "s")))
    return held.select(F.explode(pieces).alias("piece"), (F.col("c") / F.length("s")).alias("score")).where("piece IS NOT NULL")


def wordpiece_vocab(words: DataFrame, vocab_size: int = 32_000) -> DataFrame:
    """(piece, score): [UNK], all characters, then the best-scoring pieces until the size is reached.

    Scores don't change while the vocabulary grows, so growing it is a top-k; of equal scores the smaller piece.
    """
    chars = words.select(F.explode(F.split("word", "")).alias("piece")).where("piece <> ''").distinct()
    base = chars.select("piece", F.lit(None).cast("double").alias("score")).union(words.sparkSession.createDataFrame([(UNKNOWN, None)], "piece string, score double"))
    room = max(0, vocab_size - base.count())
    candidates = piece_scores(words).where((F.length("piece") > 1) & (F.col("piece") != UNKNOWN))
    return base.unionByName(candidates.orderBy(F.col("score").desc(), F.col("piece").asc()).limit(room))


def wordpiece_encode(words: DataFrame, vocab: DataFrame, column: str = "word") -> DataFrame:
    """(word, pieces) of distinct words: the longest known piece at every place, [UNK] for a character without one."""
    known = {r.piece for r in vocab.select("piece").collect()}
    longest = max(map(len, known), default=0)
    shared = words.sparkSession.sparkContext.broadcast(known)

    def encode(word: str) -> list[str]:
        own, out, start = shared.value, [], 0
        while start < len(word):
            mark = "##" if start else ""
            ends = range(min(len(word), start + longest), start, -1)
            end = next((e for e in ends if mark + word[start:e] in own), None)
            out.append(UNKNOWN if end is None else mark + word[start:end])
            start = start + 1 if end is None else end
        return out

    return _per_word(words, column, encode)
