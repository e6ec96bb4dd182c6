"""Document frequencies in a table whose size does not grow with the data."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells by which entries are ordered, rarest first. Entries that share a cell share a frequency, which can
#: only cost pruning power: any fixed order of entries leaves the joins exact.
CELLS = 1 << 18


def cell_frequencies(entries: DataFrame) -> np.ndarray:
    """How many rows of ``entries`` (column term, a number) fall in each cell; at most CELLS rows reach the driver."""
    return summed_cells(entries.select("term", F.lit(1).cast("long").alias("n")))


def summed_cells(counts: DataFrame) -> np.ndarray:
    """The column n summed by the cell of the column term."""
    cell = F.pmod(F.col("term"), F.lit(CELLS)).cast("int")
    rows = counts.groupBy(cell.alias("cell")).agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CELLS, dtype=np.int64)
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out


#: Bits of the membership table of touched().
TOUCH_BITS = 1 << 22


def touched(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows whose ``column`` (a 64-bit hash) may be among ``ids`` (its only column): all that are, and few others.

    A bitmap of fixed size (TOUCH_BITS bits, at most TOUCH_BITS/64 rows at the driver) is broadcast
    instead of the ids, so rows nobody asks for are dropped before they are shuffled.
    """
    key = ids.columns[0]
    bit = F.pmod(F.col(key), F.lit(TOUCH_BITS))
    words = ids.select(bit.alias("b")).groupBy((F.col("b") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("bits")).toArrow()
    table = np.zeros(TOUCH_BITS // 64, dtype=np.int64)
    table[words["w"].to_numpy()] = words["bits"].to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(table)
    at = rows.columns.index(column)

    def step(batches):
        own = shared.value
        for batch in batches:
            if batch.num_rows:
                b = np.mod(batch.column(at).to_numpy(zero_copy_only=False), TOUCH_BITS)
                yield batch.filter(pa.array((own[b >> 6] >> (b & 63)) & 1 == 1))

    return rows.mapInArrow(step, rows.schema)
