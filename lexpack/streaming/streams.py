"""Streams of records: stateless compression, container files as sink and source, running statistics.

Compression and profiling of a stream are row by row and need no state. A container per micro-batch is the sink. Running token counts
by window are beyond what a codec needs and are offered on their own: they hold state, bounded by the watermark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexpack.functions.vocabulary import Vocabulary
from lexpack.operators import codec, containers
from lexpack.session import ship
from lexpack.sources import container as source


def compressed(rows: DataFrame, data: str, vocabulary: Vocabulary | None = None, dictionary=None, name: str = "blob", **how) -> DataFrame:
    """``rows`` (a stream or a table) with the compressed record."""
    ship(rows.sparkSession)
    return rows.withColumn(name, codec.compress(vocabulary, dictionary, **how)(F.col(data)))


def decompressed(rows: DataFrame, blob: str, vocabulary: Vocabulary | None = None, dictionary=None, name: str = "data") -> DataFrame:
    """``rows`` with the records; a bad stream gives null and the reason in ``error`` and doesn't stop the query."""
    ship(rows.sparkSession)
    return rows.withColumn("__x", codec.try_decompress(vocabulary, dictionary)(F.col(blob))).withColumns({name: F.col("__x.data"), "error": F.col("__x.error")}).drop("__x")


def to_containers(rows: DataFrame, path: str, checkpoint: str, vocabulary: Vocabulary | None = None, dictionary=None, kind: str = "index", **trigger) -> StreamingQuery:
    """Write the column ``data`` of a stream to container files, every row once: a repeated batch replaces its own files."""
    source.register(rows.sparkSession)
    options = {"path": path, "kind": kind} | {k: source.handle(v) for k, v in (("vocabulary", vocabulary), ("dictionary", dictionary)) if v is not None}
    return rows.select("data").writeStream.format("lexpack").options(**options, checkpointLocation=checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def from_containers(spark, path: str, vocabulary: Vocabulary | None = None, dictionary=None) -> DataFrame:
    """(path, ordinal, data) of container files as they come."""
    source.register(spark)
    options = {"path": path} | {k: source.handle(v) for k, v in (("vocabulary", vocabulary), ("dictionary", dictionary)) if v is not None}
    return spark.readStream.format("lexpack").options(**options).load()


def packed_batches(rows: DataFrame, keys: list[str], data: str, order: str, path: str, checkpoint: str, **how) -> StreamingQuery:
    """Each micro-batch's records by key as containers in a Parquet folder of its own (batch=N), which a repeated batch replaces."""

    def write(batch: DataFrame, number: int) -> None:
        containers.pack(batch, keys, data, order, **how).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def token_counts(rows: DataFrame, tokens: Column, time: str, window: str = "1 hour", late: str = "1 hour", keys: list[str] | None = None) -> DataFrame:
    """(window, keys, token, n): token counts of a stream by time window; rows over ``late`` behind the newest are dropped, and a
    window closes and leaves the state when the watermark passes its end."""
    keyed = rows.withWatermark(time, late).select(F.window(time, window).alias("window"), *(keys or ()), F.explode(tokens).alias("token"))
    return keyed.groupBy("window", *(keys or ()), "token").agg(F.count(F.lit(1)).alias("n"))
