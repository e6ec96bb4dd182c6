"""Streaming: stateless tokenising, and running counts that Structured Streaming keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lexispark.functions.text import blank_tokens, ngrams, sentence_split, word_tokens


def text_stream(spark: SparkSession, folder: str, schema: StructType, per_trigger: int | None = None) -> DataFrame:
    """A stream over parquet files that arrive in a folder."""
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def stream_sentences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sent_idx, sentence): no state."""
    return docs.select(key, F.posexplode(sentence_split(F.col(text))).alias("sent_idx", "sentence"))


def stream_words(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sent_idx, tok_idx, token): no state."""
    return stream_sentences(docs, key, text).select(key, "sent_idx", F.posexplode(word_tokens(F.col("sentence"))).alias("tok_idx", "token"))


def running_counts(docs: DataFrame, text: str, orders: list[int]) -> DataFrame:
    """(n, gram, cnt) so far: n-grams end with their row, so the only state is one count per n-gram."""
    tokens = blank_tokens(F.col(text))
    grams = docs.select(F.explode(F.flatten(F.array(*[ngrams(tokens, n) for n in orders]))).alias("gram"))
    return grams.groupBy(F.size("gram").alias("n"), "gram").agg(F.count(F.lit(1)).alias("cnt"))


def windowed_counts(docs: DataFrame, time: str, text: str, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """(window, token, cnt) by event time; state older than the watermark is dropped."""
    tokens = docs.withWatermark(time, late).select(time, F.explode(blank_tokens(F.col(text))).alias("token"))
    return tokens.groupBy(F.window(time, window).alias("window"), "token").agg(F.count(F.lit(1)).alias("cnt"))


def to_memory(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Start the stream into an in-memory table (tests and demonstrations)."""
    return df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).start()


def to_parquet(df: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append finished rows to parquet files, each exactly once."""
    return df.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).start()
