"""Evaluation texts leaking into training text: MinHash containment search with exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm import wordkernel
from lexispark.operators.skew import salted_join
from lexispark.session import stored

#: Words of a shingle.
SHINGLE = 5
#: Bits of the table of item windows: 32 per window, but never more than this.
MOST_BITS = 1 << 27
WINDOW = "size_class int, sketch long, digest long, words string"


def _sketch(w: wordkernel.Words, run: int) -> tuple[np.ndarray, np.ndarray]:
    """MinHash of the shingles of every window of ``run`` words, and whether the window lies in one text."""
    shingle, _ = w.runs(SHINGLE)
    n = len(w.hash) - run + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
    least, width, want = shingle, 1, run - SHINGLE + 1
    while width < want:
        step = min(width, want - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    return least[:n], w.doc[:n] == w.doc[run - 1 :]


def _bits(sketch: np.ndarray, digest: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of a window in a table of ``size`` bits (a power of two): one of its MinHash, one of the window itself."""
    mask = np.uint64(size - 1)
    return wordkernel.mix(sketch) & mask, wordkernel.mix(digest + np.uint64(0x9E3779B97F4A7C15)) & mask


def item_windows(items: DataFrame, item: str, text: str, run: int, short: bool) -> DataFrame:
    """(item, place, WINDOW) of every window of the items.

    Items of ``run`` words and more are cut into windows of ``run`` words. With ``short``, items of SHINGLE to run - 1 words
    are windows of their own length, so there are at most run - SHINGLE + 1 size classes, each of sets of one size.
    """
    kind = dict(items.dtypes)[item]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in wordkernel.chunks(batch.column(1).to_pylist()):
                w = wordkernel.words(texts)
                size = np.bincount(w.doc, minlength=len(texts))
                begin = np.searchsorted(w.doc, np.arange(len(texts)))
                for k in range(SHINGLE if short else run, run + 1):
                    sketch, ok = _sketch(w, k)
                    at = np.flatnonzero(ok & ((size[w.doc[: len(ok)]] == k) | (k == run)))
                    if len(at):
                        digest = w.runs(k)[0][at]
                        own = batch.column(0).take(pa.array(first + w.doc[at]))
                        columns = [own, at - begin[w.doc[at]], np.full(len(at), k), sketch[at].view(np.int64), digest.view(np.int64), [w.text(i, i + k) for i in at]]
                        kinds = (None, pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
                        yield pa.RecordBatch.from_arrays([own, *(pa.array(c, type=t) for c, t in zip(columns[1:], kinds[1:]))], names=["item", "place", "size_class", "sketch", "digest", "words"])

    known = items.where(F.col(text).isNotNull()).select(F.col(item).alias("item"), text)
    return known.mapInArrow(step, f"item {kind}, place long, {WINDOW}")


def _table(windows: DataFrame, size: int) -> np.ndarray:
    """The bits of all item windows, set where they are read and merged by words of 64: at most size/64 rows reach the driver."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                both = np.concatenate(_bits(*(batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in (0, 1)), size))
                word, at = np.unique(both >> np.uint64(6), return_inverse=True)
                value = np.zeros(len(word), dtype=np.uint64)
                np.bitwise_or.at(value, at, np.left_shift(np.uint64(1), both & np.uint64(63)))
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(value.view(np.int64))], names=["word", "bits"])

    rows = windows.select("sketch", "digest").mapInArrow(step, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(max(1, size >> 6), dtype=np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def _hits(docs: DataFrame, key: str, text: str, table: np.ndarray, classes: list[int]) -> DataFrame:
    """(key, WINDOW) of the windows of the texts that may be an item's: both their bits are set. Each once per text and size class."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        size = len(own) << 6
        held = lambda place: (own[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        for batch in batches:
            for first, texts in wordkernel.chunks(batch.column(1).to_pylist()):
                w = wordkernel.words(texts)
                for k in classes:
                    sketch, ok = _sketch(w, k)
                    if not ok.any():
                        continue
                    digest = w.runs(k)[0]
                    # neighbouring windows mostly share their MinHash: only those whose MinHash is known are looked at further
                    near = np.flatnonzero(ok & held(wordkernel.mix(sketch) & np.uint64(size - 1)))
                    near = near[held(_bits(sketch[near], digest[near], size)[1])]
                    if len(near):
                        _, once = np.unique(np.stack([w.doc[near].astype(np.uint64), digest[near]]), axis=1, return_index=True)
                        near = near[once]
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array(first + w.doc[near])), pa.array(np.full(len(near), k), type=pa.int32()), pa.array(sketch[near].view(np.int64)), pa.array(digest[near].view(np.int64)), pa.array([w.text(i, i + k) for i in near])],
                            names=["doc", "size_class", "sketch", "digest", "words"],
                        )

    return docs.select(key, text).mapInArrow(step, f"doc {dict(docs.dtypes)[key]}, {WINDOW}")


def contained_items(docs: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str, run: int = 12, short: bool = False) -> DataFrame:
    """Rows (key, item, windows_found, item_windows): texts that hold at least ``run`` words in a row of an item.

    Items are cut into windows of ``run`` words: sets of one size (run - 4 shingles of five words) that a long text either
    contains wholly or not at all; the MinHash value of such a window is the least of its shingle hashes. A text holding the
    window has a window with the same value, so no case is missed. With ``short``, items of fewer words (five at least)
    are found where a text holds them wholly; they form size classes of their own, one per number of words.

    The texts are read once, whatever the number of items, and never shuffled: the items' windows mark a table of bits
    (32 per window up to MOST_BITS, which is broadcast), and only windows of a text whose MinHash and digest are both marked are
    sent on. They meet the items' windows in a join that parts hot ones, and are compared word by word there. More windows than the
    table was made for only send more on. windows_found counts the different windows of the item found under the
    key, item_windows all it has. Null and short texts or items match nothing; rows with equal keys, or items with equal
    ids, count together. An item column named like the key comes out as item_<name>.
    """
    windows = stored(item_windows(items, item, item_text, run, short))
    sizes = {r.size_class: r.n for r in windows.groupBy("size_class").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = min(MOST_BITS, 1 << max(16, (32 * sum(sizes.values())).bit_length()))
    hits = stored(_hits(docs, key, text, _table(windows, size), sorted(sizes)))
    same = ["size_class", "sketch", "digest"]
    met = salted_join(windows.withColumnRenamed("words", "item_words"), hits, same, "doc").where(F.col("words") == F.col("item_words"))
    found = met.groupBy("doc", "item").agg(F.countDistinct("place").alias("windows_found"))
    total = windows.groupBy("item").agg(F.countDistinct("place").alias("item_windows"))
    name = f"item_{item}" if item == key else item
    return found.join(total, "item").select(F.col("doc").alias(key), F.col("item").alias(name), "windows_found", "item_windows")
