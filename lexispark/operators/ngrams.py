"""n-grams over token arrays, within rows or across the borders of an ordered corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions.text import ngrams
from lexispark.operators.ranges import PART_ROWS, range_bounds, range_part


def join_grams(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on n-gram arrays, led by a 64-bit hash of them: sorting compares numbers, arrays only where hashes agree."""
    h = F.xxhash64(*keys)
    return left.withColumn("__h", h).join(right.withColumn("__h", h), ["__h", *keys], how).drop("__h")


def digest(gram: Column | str, prefix: str = "h") -> list[Column]:
    """128 bits of hash by which n-grams are told apart where only their numbers travel: two columns, <prefix>a and <prefix>b."""
    return [F.xxhash64(gram).alias(f"{prefix}a"), F.xxhash64(F.lit(1), gram).alias(f"{prefix}b")]


def within(df: DataFrame, tokens: str, orders: list[int]) -> DataFrame:
    """(gram) rows of all orders inside each row's token array: no shuffle.

    A window of the longest order is cut at every token and its beginnings are the n-grams, so a long text is
    streamed and never held as all its n-grams at once.
    """
    at = F.sequence(F.lit(1), F.size(tokens))
    windows = df.where(F.size(tokens) > 0).select(F.explode(F.transform(at, lambda i: F.slice(tokens, i, F.lit(max(orders))))).alias("w"))
    return windows.select(F.explode(F.array(*[F.when(F.size("w") >= n, F.slice("w", 1, n)) for n in orders])).alias("gram")).where("gram IS NOT NULL")


def _borders(df: DataFrame, key: str, tokens: str, reach: int, part_rows: int = PART_ROWS, keys: DataFrame | None = None) -> DataFrame:
    """(tail, halo): the last ``reach`` tokens of every row and the ``reach`` that follow them, rows taken in the order of their integer key.

    Only the key, the first and the last few tokens of every row move. Rows are cut into ranges of about ``part_rows``
    by the quantiles of the key, however its values are spread, and each range is walked in its own window; what follows a
    range comes from a table of one row per range. Rows without tokens are passed over. Keys must be unique and not null.
    ``keys`` (a table with the column ``key``) may name where the quantiles are cheaper to read.
    """
    ends = (
        df.where(F.col(key).isNotNull() & (F.size(tokens) > 0))
        .select(F.col(key).alias("k"), F.slice(tokens, 1, reach).alias("head"), F.reverse(F.slice(F.reverse(tokens), 1, reach)).alias("tail"))
        .withColumn("part", range_part(F.col("k"), range_bounds(df if keys is None else keys, key, part_rows)))
    )
    inside = Window.partitionBy("part").orderBy("k")
    empty = F.array().cast("array<string>")
    nexts = lambda column, window: F.flatten(F.array(*[F.coalesce(F.lead(column, i).over(window), empty) for i in range(1, reach + 1)]))
    walked = ends.withColumn("after", nexts("head", inside)).withColumn("place", F.row_number().over(inside))
    starts = walked.where(F.col("place") == 1).select("part", F.slice(F.concat("head", "after"), 1, reach).alias("start"))
    following = starts.select("part", nexts("start", Window.orderBy("part")).alias("beyond"))
    halo = F.slice(F.concat("after", "beyond"), 1, reach)
    return walked.join(F.broadcast(following), "part").select("tail", halo.alias("halo"))


def crossing(df: DataFrame, key: str, tokens: str, orders: list[int], part_rows: int = PART_ROWS, keys: DataFrame | None = None) -> DataFrame:
    """(gram) rows that begin in one row and end in a later one, rows taken in the order of their integer key (see _borders)."""
    reach = max(orders) - 1
    if reach < 1:
        return within(df, tokens, [1]).where("false")
    joined = _borders(df, key, tokens, reach, part_rows, keys)
    own = []
    for n in orders:
        if n > 1:
            own.append(ngrams(F.concat(F.reverse(F.slice(F.reverse("tail"), 1, n - 1)), F.slice("halo", 1, n - 1)), n))
    return joined.select(F.explode(F.flatten(F.array(*own))).alias("gram"))


def corpus_windows(df: DataFrame, key: str, tokens: str, n: int, part_rows: int = PART_ROWS, keys: DataFrame | None = None) -> DataFrame:
    """(w): the n words from every word on, all rows in the order of their integer key as one text; fewer at its end.

    Windows inside a row are cut where it is read, those that begin in its last n - 1 words come from _borders. A row with a null key has no
    place among the others and is a text of its own.
    """
    cut = lambda words, last: F.explode(F.transform(F.sequence(F.lit(1), last), lambda i: F.slice(words, i, F.lit(n)))).alias("w")
    loose = F.col(key).isNull()
    last = F.when(loose, F.size(tokens)).otherwise(F.size(tokens) - (n - 1))
    inside = df.where((F.size(tokens) > 0) & (last > 0)).select(cut(F.col(tokens), last))
    return inside.unionByName(_borders(df, key, tokens, n - 1, part_rows, keys).select(cut(F.concat("tail", "halo"), F.size("tail"))))


def ngram_counts(df: DataFrame, key: str, tokens: str, orders: list[int], boundary: str = "row", keys: DataFrame | None = None) -> DataFrame:
    """(n, gram, cnt) of all orders in one aggregation, counted map-side first.

    boundary='row' keeps to each token array; 'corpus' treats all rows, ordered by ``key``, as one text.
    """
    grams = within(df, tokens, orders)
    if boundary == "corpus":
        grams = grams.unionByName(crossing(df, key, tokens, orders, keys=keys))
    elif boundary != "row":
        raise ValueError(f"unknown boundary {boundary!r}: 'row' or 'corpus'")
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("cnt")).select(F.size("gram").alias("n"), "gram", "cnt")


def vocabulary_sizes(counts: DataFrame) -> DataFrame:
    """(n, types, tokens) per order."""
    return counts.groupBy("n").agg(F.count(F.lit(1)).alias("types"), F.sum("cnt").alias("tokens"))


def mle(counts: DataFrame) -> DataFrame:
    """(n, gram, cnt, p): count over the count of the history in the table of the next lower order; 0 if that is missing.

    Unigrams are divided by all tokens.
    """
    total = counts.where("n = 1").agg(F.sum("cnt").alias("total"))
    ones = counts.where("n = 1").crossJoin(F.broadcast(total)).withColumn("p", F.col("cnt") / F.col("total")).drop("total")
    history = counts.select(*digest("gram", "k"), F.col("cnt").alias("seen"))
    more = counts.where("n > 1").select("n", "gram", "cnt", *digest(F.slice("gram", F.lit(1), F.col("n") - 1), "k"))
    conditional = more.join(history, ["ka", "kb"], "left").select("n", "gram", "cnt", F.coalesce(F.col("cnt") / F.col("seen"), F.lit(0.0)).alias("p"))
    return ones.unionByName(conditional)


def frequency_of_frequency(counts: DataFrame) -> DataFrame:
    """(n, cnt, nc): how many n-grams have each count."""
    return counts.groupBy("n", "cnt").agg(F.count(F.lit(1)).alias("nc"))


def context_sums(counts: DataFrame) -> DataFrame:
    """(n, history, total, continuations) of the n-grams of order 2 and more."""
    more = counts.where("n > 1").select("n", F.slice("gram", F.lit(1), F.col("n") - 1).alias("history"), "cnt")
    return more.groupBy("n", "history").agg(F.sum("cnt").alias("total"), F.count(F.lit(1)).alias("continuations"))


def continuation_counts(counts: DataFrame) -> DataFrame:
    """(word, contexts): different words seen before each word."""
    return counts.where("n = 2").groupBy(F.element_at("gram", 2).alias("word")).agg(F.count(F.lit(1)).alias("contexts"))
