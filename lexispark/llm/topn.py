"""Top N items within every group by secondary sort."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _first_rows(keys: Sequence[str], n: int):
    """Arrow stream step: of rows sorted by key, the first n of each run of equal keys.

    Only the last key and its count so far live across batches; a group is never buffered.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            change = np.zeros(rows, dtype=bool)
            for k in keys:
                column = batch.column(k)
                here, before = column.slice(1), column.slice(0, rows - 1)
                same = pc.fill_null(pc.equal(here, before), False)
                both_null = pc.and_(pc.is_null(here), pc.is_null(before))
                change[1:] |= ~pc.or_(same, both_null).to_numpy(zero_copy_only=False)
            first = tuple(batch.column(k)[0].as_py() for k in keys)
            carried = seen if first == last else 0
            change[0] = True
            starts = np.flatnonzero(change)
            lengths = np.diff(np.append(starts, rows))
            rank = np.arange(rows) - np.repeat(starts, lengths)
            rank[: lengths[0]] += carried
            last = tuple(batch.column(k)[rows - 1].as_py() for k in keys)
            seen = int(rank[-1]) + 1
            keep = rank < n
            if keep.any():
                yield batch.filter(pa.array(keep))

    return step


def top_n_per_group(df: DataFrame, keys: Sequence[str], item: str, score: str, n: int) -> DataFrame:
    """For every group the ``n`` items of highest score; of equal scores the smaller item.

    Each item counts once per group, with its highest score. Rows whose score is null or NaN, or whose
    item is null, never rank; null keys form a group of their own. ``n`` below 1 or an empty
    table gives no rows. Columns other than keys, item and score are dropped.

    The highest score per (group, item) is found first, combined map-side; that leaves the rows
    hash-partitioned by (group, item), so even a group with a third of all rows is spread over all tasks. Each task
    sorts and keeps its own first n of every group; only those travel to the
    partition of the group, where the same step runs again.
    """
    best = (
        df.where(F.col(item).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score))
        .groupBy(*keys, item)
        .agg(F.max(score).alias(score))
        .select(*keys, item, score)
    )
    order = [*(F.col(k).asc_nulls_first() for k in keys), F.col(score).desc(), F.col(item).asc()]
    local = best.sortWithinPartitions(*order).mapInArrow(_first_rows(keys, n), best.schema)
    return local.repartition(*keys).sortWithinPartitions(*order).mapInArrow(_first_rows(keys, n), best.schema)
