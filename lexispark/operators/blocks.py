"""A stated query set against all rows, in blocks: sparse products of bounded blocks, reduced where they are made."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.session import stored

#: Entries (terms of documents) of one block; a side of a task holds about as many.
BLOCK_ENTRIES = 1_000_000
#: Entries from which a block is worth a task of its own.
LEAST_ENTRIES = 40_000
#: Cells of the dense piece that is worked on at once.
CELLS = 4_000_000


def packed(vectors: DataFrame) -> DataFrame:
    """(id, terms, values): one row per document of (id, term, value), terms as 64-bit hashes."""
    entry = F.struct(F.xxhash64("term").alias("t"), F.col("value").cast("double").alias("v"))
    rows = vectors.groupBy("id").agg(F.collect_list(entry).alias("e"))
    return rows.select("id", F.transform("e", lambda x: x["t"]).alias("terms"), F.transform("e", lambda x: x["v"]).alias("values"))


class Side:
    """Documents of a block by rising id: for every entry its row, term and value over the length of its document."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("id").combine_chunks()
        self.ids = table["id"].to_numpy()
        lists = table["terms"].combine_chunks() if table.num_rows else None
        size = np.diff(lists.offsets.to_numpy()) if table.num_rows else np.zeros(0, dtype=np.int64)
        self.row = np.repeat(np.arange(len(size)), size)
        self.term = lists.flatten().to_numpy() if table.num_rows else np.zeros(0, dtype=np.int64)
        value = table["values"].combine_chunks().flatten().to_numpy() if table.num_rows else np.zeros(0)
        norm = np.sqrt(np.bincount(self.row, value * value, minlength=len(size)) + 1e-12)
        self.value = value / norm[self.row]
        self.begin = np.concatenate(([0], np.cumsum(size)))


def products(queries: Side, base: Side) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first base row, cosines, whether a term is shared) in pieces of base rows x queries."""
    n = len(queries.ids)
    order = np.argsort(queries.term, kind="stable")
    terms, first = np.unique(queries.term[order], return_index=True)
    last = np.append(first[1:], len(order))
    step = max(1, CELLS // max(1, n))
    positive = bool((queries.value > 0).all() and (base.value > 0).all())
    for low in range(0, len(base.ids), step):
        high = min(low + step, len(base.ids))
        part = slice(base.begin[low], base.begin[high])
        at = np.minimum(np.searchsorted(terms, base.term[part]), max(0, len(terms) - 1))
        known = terms[at] == base.term[part] if len(terms) else np.zeros(at.shape, dtype=bool)
        at, row, value = at[known], base.row[part][known] - low, base.value[part][known]
        width = last[at] - first[at]
        total = int(width.sum())
        own = np.repeat(np.arange(len(at)), width)
        entry = order[np.arange(total) - np.repeat(np.cumsum(width) - width, width) + first[at][own]] if total else np.zeros(0, dtype=np.int64)
        cell = row[own] * n + queries.row[entry]
        cosine = np.bincount(cell, value[own] * queries.value[entry], minlength=(high - low) * n).reshape(high - low, n)
        shared = cosine > 0 if positive else np.bincount(cell, minlength=(high - low) * n).reshape(high - low, n) > 0
        yield low, cosine, shared


def in_blocks(queries: DataFrame, base: DataFrame, work: Callable[[Side, Side], pa.Table], schema: str, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """The union of work(query block, base block) over all pairs of blocks. Both sides are (id, term, value).

    Blocks have about ``block_entries`` entries and lie by hash of the id, so a task holds two blocks at any size of
    either side; every row travels once per block of the other side. Documents are packed into rows before
    they travel, and ``work`` reduces its products on the spot.
    """
    q, b = stored(packed(queries)), stored(packed(base))
    entries = lambda df: df.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    n_q, n_b = entries(q), entries(b)
    most = q.sparkSession.sparkContext.defaultParallelism
    parts = lambda n, least: max(1, -(-n // block_entries), min(least, n // LEAST_ENTRIES))
    n_q, n_b = parts(n_q, 1), parts(n_b, most)
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.select(own(n_q).alias("qb"), every(n_b).alias("bb"), "id", "terms", "values")
    right = b.select(every(n_q).alias("qb"), own(n_b).alias("bb"), "id", "terms", "values")

    def pair(l: pa.Table, r: pa.Table) -> pa.Table:  # noqa: E741
        return work(Side(l), Side(r))

    return left.groupBy("qb", "bb").cogroup(right.groupBy("qb", "bb")).applyInArrow(pair, schema)


def nearest(k: int, exclude_self: bool) -> Callable[[Side, Side], pa.Table]:
    """The k best base documents per query within the two blocks; of equal cosines (to 6 places) the smaller id."""

    def work(queries: Side, base: Side) -> pa.Table:
        n, rows = len(queries.ids), max(1, len(base.ids))
        best = np.zeros((0, n), dtype=np.int64)  # cosine in millionths, then the rank of the base row from the end
        cosines = np.zeros((0, n))
        if n and len(base.ids):
            for low, cosine, shared in products(queries, base):
                rank = (rows - 1 - low - np.arange(len(cosine)))[:, None]
                rough = np.rint(cosine * 1e6).astype(np.int64)
                ok = shared & (base.ids[low : low + len(cosine), None] != queries.ids[None, :]) & (rough > 0) if exclude_self else shared
                best = np.concatenate((best, np.where(ok, (rough + 2_000_000) * rows + rank, -1)))
                cosines = np.concatenate((cosines, cosine))
                if len(best) > k:
                    top = np.argpartition(-best, k - 1, axis=0)[:k]
                    best, cosines = np.take_along_axis(best, top, axis=0), np.take_along_axis(cosines, top, axis=0)
        at, query = np.nonzero(best >= 0)
        near = rows - 1 - best[at, query] % rows
        return pa.table({"query": pa.array(queries.ids[query], type=pa.int64()), "neighbour": pa.array(base.ids[near] if len(near) else [], type=pa.int64()), "score": pa.array(cosines[at, query], type=pa.float64())})

    return work


def moments(queries: Side, base: Side) -> pa.Table:
    """One row: pairs with a common term, the sums of their cosines and squares, the greatest and the least."""
    k, s1, s2, hi, lo = 0, 0.0, 0.0, None, None
    if len(queries.ids) and len(base.ids):
        for _, cosine, shared in products(queries, base):
            x = cosine[shared]
            if len(x):
                k, s1, s2 = k + len(x), s1 + float(x.sum()), s2 + float(x @ x)
                hi, lo = max(float(x.max()), hi if hi is not None else -2.0), min(float(x.min()), lo if lo is not None else 2.0)
    return pa.table({"k": pa.array([k], type=pa.int64()), "s1": [s1], "s2": [s2], "hi": pa.array([hi], type=pa.float64()), "lo": pa.array([lo], type=pa.float64())})
