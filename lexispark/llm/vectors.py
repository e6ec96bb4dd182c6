"""Blocks of sparse row vectors read as one row per vector, without a shuffle."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lexispark.sources.tables import latest_once_wide

SCHEMA = "vec long, split_name string, source string, loaded_at timestamp, cols array<int>, vals array<double>"


def _steps(sizes: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... anew for each of the sizes, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows per block, row, column, value) of whole blocks at once: entries sorted by row and column, equal columns added, zeros and NaN left out.

    Bounds that fall or point outside the block are held within it, and rows without bounds are empty.
    """
    data, columns, bounds = (batch.column(c) for c in (0, 1, 2))
    at = [x.offsets.to_numpy().astype(np.int64) - x.offsets[0].as_py() for x in (data, columns, bounds)]
    length = [np.diff(x) for x in at]
    rows = batch.column(4).to_numpy(zero_copy_only=False).astype(np.int64)
    limit = np.minimum(length[0], length[1])
    # bounds from 0 in every block; shifted by the blocks before, one running maximum serves all blocks
    flat = bounds.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    block = np.repeat(np.arange(len(rows)), length[2])
    place = _steps(length[2])
    first = flat[np.minimum(at[2][:-1], max(0, len(flat) - 1))] if len(flat) else np.zeros(len(rows), dtype=np.int64)
    shift = np.cumsum(limit) - limit
    inside = place <= rows[block]
    block, place = block[inside], place[inside]
    low = np.maximum.accumulate(np.clip(flat[inside] - first[block], 0, limit[block]) + shift[block]) if len(block) else flat[:0]
    begins = np.flatnonzero(block[1:] == block[:-1])
    size = low[begins + 1] - low[begins]
    own = block[begins]
    row = np.repeat((np.cumsum(rows) - rows)[own] + place[begins], size)
    entry = np.repeat(low[begins] - shift[own], size) + _steps(size)
    whole = np.repeat(own, size)
    value = data.flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False)[at[0][whole] + entry].astype(np.float64)
    column = columns.flatten().fill_null(0).to_numpy(zero_copy_only=False)[at[1][whole] + entry].astype(np.int64)
    keep = np.isfinite(value) & (value != 0)
    key, inverse = np.unique((row[keep] << 32) | column[keep], return_inverse=True)
    total = np.bincount(inverse, value[keep], minlength=len(key)) if len(key) else np.zeros(0)
    key, total = key[total != 0], total[total != 0]
    return rows, key >> 32, key & 0xFFFFFFFF, total


def _rows_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        whole = [c.is_valid() for c in batch.columns[:5]]
        usable = functools.reduce(pc.and_, [*whole, pc.fill_null(pc.greater(batch.column(4), 0), False)])
        batch = batch.filter(usable)
        if not batch.num_rows:
            continue
        rows, row, column, value = _entries(batch)
        block = pa.array(np.repeat(np.arange(len(rows)), rows))
        vec = np.repeat(batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64), rows) + _steps(rows)
        offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(vec))))).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (column.astype(np.int32), value)]
        yield pa.RecordBatch.from_arrays([pa.array(vec), *(batch.column(c).take(block) for c in (5, 6, 7)), *lists], names=["vec", "split_name", "source", "loaded_at", "cols", "vals"])


def vectors(blocks: DataFrame) -> DataFrame:
    """One row per stored vector: vec, split_name, source, loaded_at, sorted cols and their vals.

    indptr may start anywhere; a column that occurs twice is added up; zeros, NaN, infinities and nulls count as absent, so
    a vector may be empty. Blocks without a number, rows or arrays give nothing. Blocks delivered
    twice give their vectors twice: see once().
    """
    return blocks.select("data", "indices", "indptr", "first_vec", "n_rows", "split_name", "source", "loaded_at").mapInArrow(_rows_of_blocks, SCHEMA)


def once(blocks: DataFrame) -> DataFrame:
    """The blocks, each once: as loaded last."""
    needed = ["block_id", "split_name", "source", "first_vec", "n_rows", "data", "indices", "indptr", "loaded_at"]
    return latest_once_wide(blocks.select(*needed), ["block_id"], ["loaded_at"])
