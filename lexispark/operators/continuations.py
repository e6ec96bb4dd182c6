"""The best next words of back-off models, from counts of the asked histories alone: no model is made."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions.text import let
from lexispark.operators import backoff
from lexispark.operators.ngrams import corpus_windows
from lexispark.session import stored

START, END = "<s>", "</s>"
ORDERS = (2, 3, 4)
#: Most frequent words known to the driver. A context that needs a further one is scored over the whole vocabulary.
TOP_WORDS = 1000
#: Rows of a page of the stored table: what a step skips or reads.
PAGE_ROWS = 1000


def continuation_table(df: DataFrame, key: str, tokens: str, keys: DataFrame | None = None) -> DataFrame:
    """(w1, w2, w3, w4, c, c2, c3): every window of four words of the rows taken as one text, with its count, stored.

    c2 and c3 count the first two and three words and stand in one row of each; c2, c3 and w2 to w4 are null at the end of the text. Rows with
    the first two words in common lie together, sorted, so the counts of all orders come from one shuffle and one sort of a row per
    word, and what follows a history is a few pages of the files.
    """
    windows = corpus_windows(df, key, tokens, 4, keys=keys).select(*[F.get("w", F.lit(i)).alias(f"w{i + 1}") for i in range(4)])
    rows = windows.repartition("w1", "w2").groupBy("w1", "w2", "w3", "w4").agg(F.count(F.lit(1)).alias("c"))
    out = []
    for n in (2, 3):
        inside = Window.partitionBy(*[f"w{i}" for i in range(1, n + 1)]).orderBy(*[f"w{i}" for i in range(n + 1, 5)])
        whole = F.sum("c").over(inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        out.append(F.when((F.row_number().over(inside) == 1) & F.col(f"w{n}").isNotNull(), whole).alias(f"c{n}"))
    return stored(rows.select("w1", "w2", "w3", "w4", "c", *out), **{"parquet.page.row.count.limit": str(PAGE_ROWS)})


def word_table(table: DataFrame) -> DataFrame:
    """(word, cnt, contexts): how often each word stands in the text, and after how many different words; stored."""
    none = F.lit(0).cast("long")
    first = table.select(F.col("w1").alias("word"), F.col("c").alias("cnt"), none.alias("contexts"))
    after = table.where("c2 IS NOT NULL").select(F.col("w2").alias("word"), none.alias("cnt"), F.lit(1).cast("long").alias("contexts"))
    return stored(first.unionByName(after).groupBy("word").agg(F.sum("cnt").alias("cnt"), F.sum("contexts").alias("contexts")))


def _levels() -> list[tuple[int, Column, Column, Column]]:
    """(order, history as one string, word, count) of a row of the table; the count is null where the row doesn't tell it."""
    last = F.when(F.col("w4").isNotNull(), F.col("c"))
    return [(n, F.concat_ws(" ", *[f"w{i}" for i in range(1, n)]), F.col(f"w{n}"), c) for n, c in zip(ORDERS, (F.col("c2"), F.col("c3"), last))]


def ngram_table(table: DataFrame, words: DataFrame) -> DataFrame:
    """(n, gram, cnt) of orders 1 to 4, as ngrams.ngram_counts gives them."""
    parts = [words.select(F.lit(1).alias("n"), F.array("word").alias("gram"), "cnt")]
    for n, _, _, c in _levels():
        parts.append(table.where(c.isNotNull()).select(F.lit(n).alias("n"), F.array(*[f"w{i}" for i in range(1, n + 1)]).alias("gram"), c.alias("cnt")))
    return reduce(DataFrame.unionByName, parts)


def _kernel(contexts: list[list[int]], order_of: list[int], discounts: dict, top: frozenset, k: int):
    """Map of (word, weight, found: h, cnt) to what the driver adds up: at most k rows per context and order, and the ``top`` words met.

    kind 0: count, sum of values and number of words of history ``at``; 1: sum of values of the words that context ``at`` takes from order
    ``n``; 2: the best of those; 3: the summed weight of all words met; 4: a word of ``top`` that was met.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        data = pa.Table.from_batches(batches).combine_chunks()
        words = data["word"].to_pylist()
        weight = data["weight"].to_numpy()
        found = data["found"].combine_chunks()
        found = found.chunk(0) if isinstance(found, pa.ChunkedArray) else found
        at = np.repeat(np.arange(len(words)), found.value_lengths().to_numpy(zero_copy_only=False))
        flat = found.flatten()
        h, cnt = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        n = np.array(order_of)[h]
        value = cnt.astype(float)
        for order, (low, cut) in discounts.items():
            mine = n == order
            for c, v in low.items():
                value[mine & (cnt == c)] = v
            value[mine] = np.maximum(value[mine] - cut, 0.0)
        sizes = (np.bincount(h, cnt, len(order_of)), np.bincount(h, value, len(order_of)), np.bincount(h, minlength=len(order_of)))
        out = [(0, i, order_of[i], None, float(sizes[1][i]), int(round(sizes[0][i])), int(sizes[2][i])) for i in np.flatnonzero(sizes[2]).tolist()]
        rows_of = {i: np.flatnonzero(h == i) for i in {x for ends in contexts for x in ends}}
        plain = np.array([w != START for w in words])
        known = np.array([w in top for w in words])
        for c, ends in enumerate(contexts):
            met = np.zeros(len(words), bool)
            for i in ends:
                rows = rows_of[i]
                rows = rows[~met[at[rows]]]
                met[at[rows]] = True
                rows = rows[plain[at[rows]]]
                if not len(rows):
                    continue
                v = value[rows]
                out.append((1, c, order_of[i], None, float(v.sum()), 0, 0))
                if len(rows) > k:
                    keep = v >= np.partition(v, len(v) - k)[len(v) - k]
                    rows, v = rows[keep], v[keep]
                best = sorted(zip((-v).tolist(), (words[x] for x in at[rows].tolist())))[:k]
                out += [(2, c, order_of[i], w, -x, 0, 0) for x, w in best]
            met &= plain
            if met.any():
                out.append((3, c, 0, None, 0.0, int(weight[met].sum()), 0))
                out += [(4, c, 0, words[x], 0.0, 0, 0) for x in np.flatnonzero(met & known).tolist()]
        names = ["kind", "at", "n", "word", "value", "total", "number"]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)

    return run


class Continuations:
    """The best words after contexts of at most three words, by the Katz or Kneser-Ney model of a continuation_table.

    Exactly what the models of backoff.py give, from the counts of what was seen after the endings of the contexts: those rows are read, each word is
    brought together with all its counts, every task sends back k rows per context and order, and sums. What words no ending was
    followed by get comes from the sums and the TOP_WORDS most frequent words; where these can't decide, the context is scored by
    ``whole`` over the whole vocabulary. Words hold no blanks.
    """

    def __init__(self, table: DataFrame, words: DataFrame, kind: str, threshold: int = 5):
        self.table, self.words, self.kind, self.threshold = table, words, kind, threshold
        self.known: dict[tuple[tuple[str, ...], int], list[tuple[str, float]]] = {}

    @cached_property
    def discounts(self) -> dict[int, tuple[dict[int, float], float]]:
        """order -> (values that small counts get, what is taken off every count)."""
        cells = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), c.alias("c")) for n, _, _, c in _levels()])).alias("x")
        rows = self.table.select(cells).where((F.col("x.c") <= self.threshold + 1)).groupBy("x.n", "x.c").count().collect()
        nc = {(r.n, r.c): r["count"] for r in rows}
        out = {}
        for n in ORDERS:
            if self.kind == "katz":
                star = lambda c, n=n: (c + 1) * (nc[n, c + 1] / nc[n, c]) if (n, c + 1) in nc else max(c - 0.5, 0.0)
                out[n] = ({c: star(c) for c in range(1, self.threshold + 1) if (n, c) in nc}, 0.0)
            else:
                n1, n2 = nc.get((n, 1), 0), nc.get((n, 2), 0)
                out[n] = ({}, min(0.95, max(0.5, n1 / (n1 + 2 * n2))) if n1 and n2 else 0.75)
        return out

    @cached_property
    def unigrams(self) -> tuple[int, int, float, float, list[tuple[float, str]], bool]:
        """(divisor, summed numerators, p of a word without, sum of those, the greatest with their words, whether these are all)."""
        mine = F.col("cnt" if self.kind == "katz" else "contexts")
        plain, end = F.col("word") != START, F.col("word") == END
        n, total, usual, lacking, ends = self.words.agg(
            F.count(F.lit(1)), F.sum(mine), F.sum(F.when(plain, mine)), F.count_if(plain & (mine == 0)), F.count_if(end)
        ).first()
        total = max(total or 0, 1)
        floor = 1.0 / max(1, 1000 * n)
        rows = self.words.where(plain).select("word", mine.alias("m")).orderBy(F.col("m").desc(), "word").limit(TOP_WORDS + 1).collect()
        top = [(r.m / total if r.m else floor, r.word) for r in rows[:TOP_WORDS]]
        return total, usual or 0, floor, floor * (lacking + (not ends)), top, len(rows) <= TOP_WORDS

    @cached_property
    def counts(self) -> DataFrame:
        return ngram_table(self.table, self.words)

    @cached_property
    def whole(self) -> tuple[DataFrame, DataFrame, DataFrame, int]:
        """(words, model, alphas, vocab) as generate.next_word_probs takes them."""
        model, alphas = backoff.katz_model(self.counts, self.threshold) if self.kind == "katz" else backoff.kn_model(self.counts)
        return self.words.select("word"), stored(model), stored(alphas), self.words.count()

    def best(self, contexts: list[tuple[str, ...]], k: int, whole: Callable) -> dict[tuple[str, ...], list[tuple[str, float]]]:
        """Up to k best words per context and their normalised p; fewer only where all others have p = 0. ``whole(contexts)`` decides what can't be decided here."""
        new = [c for c in dict.fromkeys(contexts) if (c, k) not in self.known]
        if new:
            found = self._best(new, k)
            undecided = [c for c, words in found.items() if words is None]
            found |= whole(undecided) if undecided else {}
            self.known |= {(c, k): words for c, words in found.items()}
        return {c: self.known[c, k] for c in contexts}

    def _best(self, contexts: list[tuple[str, ...]], k: int) -> dict[tuple[str, ...], list[tuple[str, float]] | None]:
        asked: dict[tuple[str, ...], int] = {}
        ends = [[asked.setdefault(c[i:], len(asked)) for i in range(len(c))] for c in contexts]
        order_of = [len(h) + 1 for h in asked]
        top = self.unigrams[4]
        rows = self._rows(asked, ends, order_of, frozenset(w for _, w in top), k) if asked else []
        base, seen, value, taken, met = {}, {}, {}, {}, {}
        parts: dict[int, list[tuple[int, float, str]]] = {}
        for kind, at, n, word, v, total, number in rows:
            if kind == 0:
                base[at] = base.get(at, 0) + (v if self.kind == "katz" else total)
                seen[at] = seen.get(at, 0) + number
            elif kind == 1:
                value[at, n] = value.get((at, n), 0.0) + v
            elif kind == 2:
                parts.setdefault(at, []).append((n, v, word))
            elif kind == 3:
                taken[at] = taken.get(at, 0) + total
            else:
                met.setdefault(at, set()).add(word)
        out: dict[tuple[str, ...], list[tuple[str, float]] | None] = {}
        for at, context in enumerate(contexts):
            factor, factors, total = 1.0, {}, 0.0
            for h in ends[at]:
                n = order_of[h]
                if h in base:
                    factors[n] = (base[h], factor)
                    total += value.get((at, n), 0.0) / base[h] * factor
                    factor *= 0.0 if self.kind == "katz" else self.discounts[n][1] * seen[h] / base[h]
            options = [(-(v / factors[n][0] * factors[n][1]), w) for n, v, w in parts.get(at, [])]
            out[context] = self._ranked(options, factor, total, taken.get(at, 0), met.get(at, set()), k)
        return out

    def _ranked(self, options: list[tuple[float, str]], factor: float, total: float, taken: int, met: set[str], k: int) -> list[tuple[str, float]] | None:
        """The options seen after an ending and the most frequent other words, in order; None where that doesn't decide."""
        divisor, usual, floor, rest, top, complete = self.unigrams
        if factor > 0:
            total += factor * ((usual - taken) / divisor + rest)
            options += [(-(p * factor), w) for p, w in top if w not in met]
            options += [(-(floor * factor), END)] if not any(w == END for _, w in options) and END not in met else []
        if total <= 0:
            return None
        options = sorted(options)[:k]
        if factor > 0 and not complete and (len(options) < k or options[-1] > (-(top[-1][0] * factor), top[-1][1])):
            return None
        return [(w, -p / total) for p, w in options if p < 0]

    def _rows(self, asked: dict[tuple[str, ...], int], ends: list[list[int]], order_of: list[int], top: frozenset, k: int) -> list[tuple]:
        firsts = sorted({h[0] for h in asked})
        # up to ten values a list reach the files' page statistics one by one
        near = reduce(Column.__or__, [F.col("w1").isin(firsts[i : i + 10]) for i in range(0, len(firsts), 10)])
        number = F.from_json(F.lit(json.dumps({" ".join(h): i for h, i in asked.items()})), "map<string,int>")
        cells = F.array(*[F.struct(number[history].alias("h"), word.alias("word"), c.alias("cnt")) for _, history, word, c in _levels()])
        hits = self.table.where(near).select(F.explode(let(cells, lambda x: F.filter(x, lambda y: y["h"].isNotNull() & y["cnt"].isNotNull()))).alias("x"))
        found = hits.groupBy("x.word").agg(F.collect_list(F.struct("x.h", "x.cnt")).alias("found"))
        weighed = found.withColumn("weight", F.lit(0).cast("long")) if self.kind == "katz" else found.join(self.words.select("word", F.col("contexts").alias("weight")), "word")
        kernel = _kernel(ends, order_of, self.discounts, top if self.kind == "kn" else frozenset(), k)
        made = weighed.select("word", "weight", "found").mapInArrow(kernel, "kind int, at int, n int, word string, value double, total long, number long")
        return list(zip(*[column.to_pylist() for column in made.toArrow().columns]))
