"""Same or near-same records across splits: a weighted cosine join with pruned inverted lists."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm import vectors, wordkernel
from lexispark.llm.frequency import CELLS, cell_frequencies, touched
from lexispark.operators.skew import salted_join
from lexispark.session import stored
from lexispark.sources.tables import latest_once

TERMS = "kind string, id long, split_name string, source string, at timestamp, set_id binary, terms array<long>"


def _emit(kind: str, ids, splits, sources, at, sets: list[np.ndarray]) -> pa.RecordBatch:
    """Records with their sorted distinct entries; the set id is a 128-bit digest of kind and entries."""
    digest = [hashlib.blake2b(s.tobytes(), digest_size=16, key=kind.encode()).digest() for s in sets]
    offsets = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
    flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * len(sets)), ids, splits, sources, at, pa.array(digest, type=pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(flat, type=pa.int64()))],
        names=["kind", "id", "split_name", "source", "at", "set_id", "terms"],
    )


def sentence_terms(df: DataFrame) -> DataFrame:
    """Records of texts (sent_id, sentence, split_name, source, ingested_at) with their distinct words as hashes."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in wordkernel.chunks(batch.column(1).to_pylist()):
                w = wordkernel.words(texts)
                order = np.lexsort((w.hash, w.doc))
                h, d = w.hash[order], w.doc[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                h, d = h[new].view(np.int64), d[new]
                cuts = np.searchsorted(d, np.arange(1, len(texts)))
                here = [batch.column(c).slice(first, len(texts)) for c in (0, 2, 3, 4)]
                yield _emit("sentence", *here, [np.sort(x) for x in np.split(h, cuts)])

    return df.select("sent_id", "sentence", "split_name", "source", "ingested_at").mapInArrow(step, TERMS)


def vector_terms(df: DataFrame) -> DataFrame:
    """Records of sparse vectors (as vectors.vectors gives them) with the columns that have a value."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lists = batch.column(4)
                bounds = lists.offsets.to_numpy()
                flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False)).astype(np.uint64)
                mixed = wordkernel.mix(flat + np.uint64(0xA0761D6478BD642F)).view(np.int64)
                bounds = bounds - bounds[0]
                sets = [np.sort(mixed[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
                yield _emit("vector", *(batch.column(c) for c in (0, 1, 2, 3)), sets)

    return df.select("vec", "split_name", "source", "loaded_at", "cols").mapInArrow(step, TERMS)


POSTING = "term long, cid long, held boolean, size int, place int, weight double, rest double, bits_a long, bits_b long"
#: Sets whose postings a task remembers having sent, so that copies are sent once per task.
REMEMBERED = 500_000


def _bits(term: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit picture of every set: the pictures of two sets differ in at most as many bits as the sets in entries."""
    place = (wordkernel.mix(term.view(np.uint64)) >> np.uint64(57)).astype(np.uint64)
    one = np.left_shift(np.uint64(1), place & np.uint64(63))
    high = place >= 64
    zero = np.uint64(0)
    return tuple(np.bitwise_or.reduceat(np.where(m, one, zero), bounds[:-1]).view(np.int64) for m in (~high, high))


def _unit_weights(batch: pa.RecordBatch, size: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Weights of the entries in vectors of length one: those of the column weights, or equal ones."""
    if batch.num_columns < 4:
        return 1 / np.sqrt(size[row])
    weight = batch.column(3).flatten().to_numpy(zero_copy_only=False)
    return weight / np.sqrt(np.bincount(row, weight * weight, minlength=len(size)))[row]


def _greatest_weights(records: DataFrame) -> np.ndarray:
    """Per side (train, held out) and cell of terms the greatest weight of an entry; at most 2 * CELLS rows reach the driver."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.zeros(2 * CELLS)
        for batch in batches:
            if batch.num_rows:
                lists = batch.column(2)
                size = np.diff(lists.offsets.to_numpy())
                row = np.repeat(np.arange(batch.num_rows), size)
                side = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)[row] * CELLS
                cell = side + (lists.flatten().to_numpy(zero_copy_only=False) & (CELLS - 1))
                np.maximum.at(top, cell, np.abs(_unit_weights(batch, size, row)))
        held = np.flatnonzero(top)
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(top[held])], names=["cell", "w"])

    rows = records.mapInArrow(step, "cell int, w double").groupBy("cell").agg(F.max("w").alias("w")).toArrow()
    out = np.zeros(2 * CELLS)
    out[rows["cell"].to_numpy()] = rows["w"].to_numpy()
    return out.reshape(2, CELLS)


def _postings(records: DataFrame, frequency: np.ndarray, greatest: np.ndarray, cosine: float) -> DataFrame:
    """The indexed entries of every vector: rarest first, until what is left can't reach the threshold any more.

    What is left is bounded by its norm, and by its weights times the greatest weight the other side has in each cell. Every
    entry carries its weight and the norm of the entries after it.
    """
    shared = records.sparkSession.sparkContext.broadcast((frequency, greatest))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (cells, top), sent = shared.value, set()
        for batch in batches:
            if len(sent) > REMEMBERED:
                sent.clear()
            fresh = []
            for i, k in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if k not in sent:
                    sent.add(k)
                    fresh.append(i)
            if not fresh:
                continue
            batch = batch.take(pa.array(fresh))
            lists = batch.column(2)
            bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            term = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False))
            size = np.diff(bounds)
            low, high = _bits(term, bounds)
            row = np.repeat(np.arange(batch.num_rows), size)
            weight = _unit_weights(batch, size, row)
            order = np.lexsort((term, cells[term & (CELLS - 1)], row))
            term, weight = term[order], weight[order]
            place = np.arange(len(term)) - np.repeat(bounds[:-1], size)
            other = 1 - batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)[row]
            past = lambda x: np.repeat(np.add.reduceat(x, bounds[:-1]), size) - np.cumsum(x) + np.repeat(np.concatenate(([0.0], np.cumsum(x)))[bounds[:-1]], size)
            after = np.maximum(0, past(weight * weight))
            bound = np.abs(weight) * top[other, term & (CELLS - 1)]
            keep = (after + weight * weight >= cosine * cosine - 1e-9) & (past(bound) + bound >= cosine - 1e-9)
            at = row[keep]
            take = pa.array(at)
            numbers = (size[at].astype(np.int32), place[keep].astype(np.int32), weight[keep], np.sqrt(after[keep]), low[at], high[at])
            yield pa.RecordBatch.from_arrays([pa.array(term[keep]), batch.column(0).take(take), batch.column(1).take(take), *map(pa.array, numbers)], names=["term", "cid", "held", "size", "place", "weight", "rest", "bits_a", "bits_b"])

    return records.mapInArrow(step, POSTING)


def _met(records: DataFrame, cosine: float, near) -> DataFrame:
    """(cid_t, cid_e) of a train and a held-out vector that may reach the cosine: they share an indexed entry, and the bounds there allow it.

    At their rarest common entry, two vectors' product is at most that of the entry and the norms of both rests.
    ``near`` adds bounds of its own from the columns of both sides.
    """
    weights = ["weights"] if "weights" in records.columns else []
    rows = records.select("cid", "held", "terms", *weights)
    postings = _postings(rows, cell_frequencies(records.select(F.explode("terms").alias("term"))), _greatest_weights(rows), cosine)
    fields = ("cid", "size", "weight", "rest", "bits_a", "bits_b")
    side = lambda flag, s: postings.where(flag).select("term", *(F.col(c).alias(f"{c}_{s}") for c in fields))
    allowed = F.col("weight_t") * F.col("weight_e") + F.col("rest_t") * F.col("rest_e") >= F.lit(cosine - 1e-9)
    found = salted_join(side("held", "e"), side("NOT held", "t"), ["term"], "cid_t").where(allowed & near).select("cid_t", "cid_e").distinct()
    return stored(found)


def _with_sets(records: DataFrame, candidates: DataFrame, *columns: str) -> DataFrame:
    """The candidates with set_id and the columns of both sides; of the records only those asked for travel."""
    asked = candidates.select("cid_t").unionByName(candidates.select(F.col("cid_e").alias("cid_t")))
    first = [F.first(c).alias(c) for c in columns]
    sets = touched(records.select("cid", "set_id", *columns), "cid", asked).groupBy("cid", "set_id").agg(*first)
    named = lambda s: sets.select(*(F.col(c).alias(f"{c}_{s}") for c in ("cid", "set_id", *columns)))
    return candidates.join(named("e"), "cid_e").join(named("t"), "cid_t")


def set_pairs(records: DataFrame, share: float) -> DataFrame:
    """Pairs (set_id_t of train, set_id_e held out) of sets that share at least ``share`` of the entries either has.

    shared / all >= share implies a cosine of at least 2·share/(1+share) between the two sets seen as unit
    vectors of equal weights, so the cosine join finds every such pair. Its inverted lists are pruned by
    greatest weights and residual norms (see _postings, _met), by size, and by pictures of 128 bits that bound the number of
    entries not shared; the exact product decides.
    """
    entries = F.col("size_t") + F.col("size_e")
    apart = F.bit_count(F.col("bits_a_t").bitwiseXOR(F.col("bits_a_e"))) + F.bit_count(F.col("bits_b_t").bitwiseXOR(F.col("bits_b_e")))
    near = (
        (F.col("size_t") >= F.ceil(F.col("size_e") * F.lit(share) - F.lit(1e-9)))
        & (F.col("size_e") >= F.ceil(F.col("size_t") * F.lit(share) - F.lit(1e-9)))
        & (apart <= entries - 2 * F.ceil(entries * F.lit(share / (1 + share)) - F.lit(1e-9)))
    )
    candidates = _met(records.select("cid", "held", "set_id", "terms"), 2 * share / (1 + share), near)
    return (
        _with_sets(records, candidates, "terms")
        .withColumn("shared", F.size(F.array_intersect("terms_t", "terms_e")))
        .withColumn("similarity", F.col("shared") / (F.size("terms_t") + F.size("terms_e") - F.col("shared")))
        .where(F.col("similarity") >= F.lit(share - 1e-12))
        .select("set_id_t", "set_id_e", "similarity")
    )


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set_id_t, set_id_e, terms_t, weights_t, terms_e, weights_e) -> their exact cosines."""
    for batch in batches:
        n, sides = batch.num_rows, []
        if not n:
            continue
        for c in (2, 4):
            lists = batch.column(c)
            row = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
            weight = batch.column(c + 1).flatten().to_numpy(zero_copy_only=False)
            norm = np.sqrt(np.bincount(row, weight * weight, minlength=n))
            sides.append((row, lists.flatten().to_numpy(zero_copy_only=False), weight / norm[row]))
        row, term = (np.concatenate([s[k] for s in sides]) for k in (0, 1))
        order = np.lexsort((term, row))
        same = np.flatnonzero((row[order][1:] == row[order][:-1]) & (term[order][1:] == term[order][:-1]))
        weight = np.concatenate([s[2] for s in sides])[order]
        cosine = np.bincount(row[order][same], weight[same] * weight[same + 1], minlength=n)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(cosine, 9))], names=["set_id_t", "set_id_e", "similarity"])


def weighted_pairs(records: DataFrame, cosine: float) -> DataFrame:
    """Pairs (set_id_t of train, set_id_e held out) of vectors whose weights have a cosine of at least ``cosine``.

    ``records``: cid, held, set_id, terms, weights (one per term, terms once each). The same join as set_pairs, with real weights.
    """
    candidates = _met(records, cosine, F.lit(True))
    columns = ["set_id_t", "set_id_e", "terms_t", "weights_t", "terms_e", "weights_e"]
    exact = _with_sets(records, candidates, "terms", "weights").select(*columns).mapInArrow(_products, "set_id_t binary, set_id_e binary, similarity double")
    return exact.where(F.col("similarity") >= cosine)


def weighted_overlaps(vectors_: DataFrame, cosine: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(pairs, membership) as split_overlaps, of sparse vectors (see vectors.vectors) by the cosine of their values between splits."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bounds = batch.column(4).offsets.to_numpy()
                bounds = bounds - bounds[0]
                cols = batch.column(4).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                vals = batch.column(5).flatten().to_numpy(zero_copy_only=False)
                ids = [hashlib.blake2b(cols[a:b].tobytes() + vals[a:b].tobytes(), digest_size=16).digest() for a, b in zip(bounds[:-1], bounds[1:])]
                offsets = pa.array(bounds.astype(np.int32))
                terms = wordkernel.mix(cols.astype(np.uint64) + np.uint64(0xA0761D6478BD642F)).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(4)), pa.array(ids, type=pa.binary()), *(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (terms, vals))], names=["id", "split_name", "source", "at", "set_id", "terms", "weights"])

    rows = vectors_.mapInArrow(named, "id long, split_name string, source string, at timestamp, set_id binary, terms array<long>, weights array<double>")
    kept = stored(rows.where((F.size("terms") > 0) & F.col("split_name").isNotNull()))
    members = latest_once(kept.select("id", "at", "split_name", "source", "set_id"), ["id"], ["at"]).drop("at")
    return weighted_pairs(kept.select(F.xxhash64("set_id").alias("cid"), (F.col("split_name") != "train").alias("held"), "set_id", "terms", "weights"), cosine), members.withColumn("kind", F.lit("vector"))


def linked_records(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(kind, id, split_name, source, class_id, links, best): a row per held-out record, its class of equal records, and how many train records it meets."""
    train = members.where("split_name = 'train'").groupBy(F.col("set_id").alias("set_id_t")).agg(F.count(F.lit(1)).alias("copies"))
    links = pairs.join(train, "set_id_t").groupBy(F.col("set_id_e").alias("set_id")).agg(F.sum("copies").alias("links"), F.max("similarity").alias("best"))
    held = members.where("split_name <> 'train'").join(links, "set_id", "left")
    return held.select("kind", "id", "split_name", "source", F.hex("set_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), F.round("best", 6).alias("best"))


def split_overlaps(records: DataFrame, share: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(set pairs, membership) of records in TERMS form between split 'train' and all other splits.

    Set pairs: set_id_t, set_id_e, similarity. Membership: kind, id, split_name, source, set_id, one row per record,
    as delivered last. Records with equal entries share one set, which is compared once, so a group of
    copies costs what one record costs. Records without entries or split match nothing.
    """
    filled = records.where((F.size("terms") > 0) & F.col("split_name").isNotNull())
    kept = stored(filled)
    members = latest_once(kept.select("kind", "id", "at", "split_name", "source", "set_id"), ["kind", "id"], ["at"]).drop("at")
    return set_pairs(kept.select(F.xxhash64("set_id").alias("cid"), (F.col("split_name") != "train").alias("held"), "set_id", "terms"), share), members


def record_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Set pairs spelled out: kind, eval_split, source, id_lo, id_hi, similarity. The result is defined as these pairs."""
    held = members.where("split_name <> 'train'").select("kind", F.col("split_name").alias("eval_split"), "source", F.col("id").alias("id_e"), F.col("set_id").alias("set_id_e"))
    train = members.where("split_name = 'train'").select(F.col("id").alias("id_t"), F.col("set_id").alias("set_id_t"))
    return salted_join(salted_join(pairs, held, ["set_id_e"], "id_e"), train, ["set_id_t"], "id_t").select(
        "kind", "eval_split", "source", F.least("id_t", "id_e").alias("id_lo"), F.greatest("id_t", "id_e").alias("id_hi"), "similarity"
    )


def overlap_report(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Grouped counts per kind, held-out split and source: records, those found in train, exact ones, and their train partners.

    Partners are summed by class size, so copies are never spelled out.
    """
    train = members.where("split_name = 'train'").groupBy(F.col("set_id").alias("set_id_t")).agg(F.count(F.lit(1)).alias("copies"))
    links = pairs.join(train, "set_id_t").groupBy(F.col("set_id_e").alias("set_id")).agg(F.sum("copies").alias("links"), F.max("similarity").alias("best"))
    return (
        members.where("split_name <> 'train'")
        .groupBy("kind", "split_name", "source", "set_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(links, "set_id", "left")
        .groupBy("kind", F.col("split_name").alias("eval_split"), "source")
        .agg(
            F.sum("n").alias("records"),
            F.sum(F.when(F.col("links").isNotNull(), F.col("n")).otherwise(0)).alias("overlapping"),
            F.sum(F.when(F.col("best") >= 1, F.col("n")).otherwise(0)).alias("exact"),
            F.coalesce(F.sum(F.col("n") * F.col("links")), F.lit(0)).alias("links"),
        )
    )


def table_records(application: DataFrame, bonus: DataFrame) -> DataFrame:
    """The records of both tables; a block delivered twice gives equal records, of which one counts."""
    return sentence_terms(application).unionByName(vector_terms(vectors.vectors(bonus)))
