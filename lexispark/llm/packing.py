"""Filling fixed-capacity containers with texts: sum-of-squares online packing."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts that one packing task takes in turn.
TEXTS_PER_TASK = 20_000
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how the public vocabulary parts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=2)
def _encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, n_tokens) of every row; null and empty texts have 0.

    The vocabulary file is read by the driver alone and broadcast (its size is that of the tokenizer, a few MB), so workers need no file.
    """
    shared = df.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(shared.value).encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, type=pa.int64())], names=[key, "n_tokens"])

    return df.select(key, text).mapInArrow(step, f"`{key}` {dict(df.dtypes)[key]}, n_tokens long")


class Levels:
    """Open containers by fill level. An item goes where the sum of squared level counts ends smallest."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, dtype=np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def place(self, size: int) -> tuple[int, int]:
        """(container, fill level before) for an item of 1..capacity; of equal levels the fullest."""
        capacity, count = self.capacity, self.count
        top = capacity - size
        change = 2 * count[size : capacity + 1]  # joining level h adds 2·N(h+size)+1 ...
        change[-1] = -1  # ... but a full container is counted nowhere
        change -= 2 * count[: top + 1]  # leaving level h takes 2·N(h)-1 away
        change += 1 + (count[: top + 1] > 0)
        change[count[: top + 1] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * count[size] + 1 if size < capacity else 0
        level = top - int(np.argmin(change[::-1]))
        if level:
            box = self.open[level].pop()
            count[level] -= 1
        else:
            box = self.made
            self.made += 1
        if level + size < capacity:
            self.open[level + size].append(box)
            count[level + size] += 1
        return box, level


def _pack(capacity: int, key: str):
    """Stream of pieces sorted by part -> pieces with their container; the state is one level array per part."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, levels = None, Levels(capacity)
        for batch in batches:
            boxes: list[int | None] = []
            offsets: list[int] = []
            for p, size in zip(batch.column("part").to_pylist(), batch.column("n_tokens").to_pylist()):
                if p != part:
                    part, levels = p, Levels(capacity)
                box, level = levels.place(size) if size else (None, 0)
                boxes.append(None if box is None else (p << 40) | box)
                offsets.append(level)
            own = [batch.column(c) for c in (key, "piece", "first_token", "n_tokens")]
            yield pa.RecordBatch.from_arrays([pa.array(boxes, type=pa.int64()), *own, pa.array(offsets, type=pa.int64())], names=["container_id", key, "piece", "first_token", "n_tokens", "offset"])

    return step


def pack_texts(df: DataFrame, key: str, text: str, capacity: int = 2048, tokenizer: str = TOKENIZER, per_task: int = TEXTS_PER_TASK) -> DataFrame:
    """One row per placed piece: container_id, key, piece, first_token, n_tokens, offset (where it begins in the container).

    A text of up to ``capacity`` tokens is one piece; a longer one is cut into full containers and a rest.
    Texts without tokens come out with a null container. Rows with equal keys are packed separately; equal
    input gives equal containers. Texts stay where they are read: only (key, tokens) is shuffled, to
    parts of about ``per_task`` texts that are packed independently, largest pieces first.
    """
    parts = max(1, -(-df.count() // per_task))
    firsts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_tokens") - 1, F.lit(0).cast("long")), F.lit(capacity).cast("long"))
    pieces = (
        token_counts(df, key, text, tokenizer)
        .select(F.pmod(F.xxhash64(key), F.lit(parts)).alias("part"), key, F.col("n_tokens").alias("total"), F.posexplode(firsts).alias("piece", "first_token"))
        .select("part", key, F.col("piece").cast("long").alias("piece"), "first_token", F.least(F.col("total") - F.col("first_token"), F.lit(capacity)).alias("n_tokens"))
    )
    kind = dict(df.dtypes)[key]
    return (
        pieces.repartition(parts, "part")
        .sortWithinPartitions("part", F.col("n_tokens").desc(), key, "piece")
        .mapInArrow(_pack(capacity, key), f"container_id long, `{key}` {kind}, piece long, first_token long, n_tokens long, offset long")
    )


def fill_report(placed: DataFrame, capacity: int = 2048) -> DataFrame:
    """Containers used, the fewest possible (tokens / capacity, rounded up), and the share of room left over."""
    boxes = placed.where("container_id IS NOT NULL").groupBy("container_id").agg(F.sum("n_tokens").alias("fill"))
    room = F.lit(1.0) - F.sum("fill") / (F.count(F.lit(1)) * F.lit(float(capacity)))
    return boxes.agg(
        F.count(F.lit(1)).alias("containers"), F.ceil(F.sum("fill") / F.lit(float(capacity))).alias("fewest"), F.max("fill").alias("fullest"), F.round(room, 6).alias("room_left")
    )
