"""Uniform shuffle into shards of exact sizes with a hypergeometric communication matrix.

Each input partition must send a random number of rows to each block of each shard, such that rows and columns of the matrix
add up and every assignment of rows to places is equally likely. The matrix is drawn by halving: the places of all partitions
are split between the first and the second half of them by a multivariate hypergeometric draw, then within each half, with a
generator seeded by the node. A task follows only its own path, so it draws its row of the matrix in log2(partitions) steps,
alike on every attempt, and no matrix exists anywhere.

A task permutes its rows locally (they are ordered by a keyed hash, then take the places of a seeded permutation), rows are
exchanged by block, and each block is permuted again by another keyed hash. A shard is a row of blocks of at most
``block_rows`` rows, and a task gets one block, so no task holds a shard; slots go on from block to block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexpack.session import ship

SHARDS = 8
BLOCK_ROWS = 16384
SEED = 4


def even(total: int, parts: int) -> np.ndarray:
    """Sizes of ``parts`` parts of ``total``, at most one apart, the larger ones first."""
    return np.full(parts, total // parts, np.int64) + (np.arange(parts) < total % parts)


def split(rng: np.random.Generator, columns: np.ndarray, n: int) -> np.ndarray:
    """How many of n places drawn without replacement fall to each column."""
    if int(columns.sum()) < 10**9:
        return rng.multivariate_hypergeometric(columns, n, method="marginals")
    # Beyond numpy's sizes the columns are halved level by level; the draws of a level don't depend on each other.
    levels = [np.append(columns, np.zeros((1 << max(0, len(columns) - 1).bit_length()) - len(columns), np.int64))]
    while len(levels[-1]) > 1:
        levels.append(levels[-1][0::2] + levels[-1][1::2])
    drawn = np.array([n], np.int64)
    for level in levels[-2::-1]:
        good, bad, left = level[0::2], level[1::2], np.zeros(len(drawn), np.int64)
        small = np.maximum(good, bad) < 10**9
        left[small] = rng.hypergeometric(good[small], bad[small], drawn[small])
        for j in np.flatnonzero(~small).tolist():
            left[j] = hypergeometric(rng, int(good[j]), int(bad[j]), int(drawn[j]))
        drawn = np.stack([left, drawn - left], axis=1).ravel()
    return drawn[: len(columns)]


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric draw; numpy's where it takes the sizes (under 10**9), else by ratio of uniforms with log-gamma weights."""
    if max(good, bad) < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    low, high, g = max(0, n - bad), min(n, good), math.lgamma
    if low == high:
        return low
    p, total = good / (good + bad), good + bad
    mean, sd = n * p, math.sqrt(n * p * (1 - p) * (total - n) / (total - 1)) + 0.5
    weight = lambda k: -(g(k + 1) + g(good - k + 1) + g(n - k + 1) + g(bad - n + k + 1))
    top, width = weight(min(high, max(low, int((n + 1) * (good + 1) / (total + 2))))), 2 * sd * math.sqrt(2 / math.e) + 1.2
    while True:
        u, v = 1 - rng.random(), rng.random()
        k = math.floor(mean + width * (v - 0.5) / u + 0.5)
        if low <= k <= high and 2 * math.log(u) <= weight(k) - top:
            return k


def matrix_row(rows: np.ndarray, columns: np.ndarray, i: int, seed: int = SEED) -> np.ndarray:
    """Row i of the communication matrix with the given sums."""
    low, high, columns = 0, len(rows), columns.astype(np.int64)
    total = np.concatenate([[0], np.cumsum(rows)])
    while high - low > 1:
        mid = (low + high) // 2
        first = split(np.random.default_rng([seed, low, high]), columns, int(total[mid] - total[low]))
        low, high, columns = (low, mid, first) if i < mid else (mid, high, columns - first)
    return columns


def shuffle(docs: DataFrame, shards: int = SHARDS, keys: list[str] | None = None, block_rows: int = BLOCK_ROWS, seed: int = SEED) -> DataFrame:
    """``docs`` with shard (int, 0 to shards - 1) and slot (long, gapless from 0 in each shard): a uniform random order.

    Shard sizes are at most one apart. ``keys``: columns whose values tell rows apart (all columns that can be hashed by
    default); rows alike in all of them are interchangeable. Copies are rows like any other, nulls too. Empty input gives an
    empty result. The input's partitions must come out alike when recomputed, as those of a file scan do; a task whose row
    count differs from the counted one fails rather than lose a row. The exchange has a task for each block: choose ``block_rows`` by
    the bytes of a row (16,384 rows of 2 KB are 32 MB) and the number of tasks the cluster can bear. Columns named shard or slot are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    spark = ship(docs.sparkSession)
    docs = docs.select(*(c for c in docs.columns if c.lower() not in ("shard", "slot")))
    keys = [c for c in docs.columns if not isinstance(docs.schema[c].dataType, (T.MapType, T.VariantType))] if keys is None else keys
    ordered = docs.withColumn("__key", F.xxhash64(F.lit(seed), *keys)).sortWithinPartitions("__key", *keys[:1])
    sizes = {r.p: r.n for r in docs.select(*keys[:1]).groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    rows = np.array([sizes.get(p, 0) for p in range(max(sizes, default=-1) + 1)], np.int64)
    per_shard = even(int(rows.sum()), shards)
    blocks = max(1, -(-int(per_shard.max()) // block_rows))
    columns = np.stack([even(int(n), blocks) for n in per_shard])
    shared = spark.sparkContext.broadcast((rows, columns.ravel()))
    schema = T.StructType([*ordered.schema, T.StructField("__block", T.LongType())])

    def deal(batches):
        rows, columns = shared.value
        i, at, places = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if places is None:
                places = np.repeat(np.arange(len(columns)), matrix_row(rows, columns, i, seed)) if i < len(rows) else np.zeros(0, np.int64)
                places = np.random.default_rng([seed, i]).permutation(places)
            part = places[at : at + batch.num_rows]
            at += batch.num_rows
            if len(part) < batch.num_rows:
                raise RuntimeError(f"partition {i} has more rows than the {len(places)} counted")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], names=[*batch.schema.names, "__block"])
        if at != (len(places) if places is not None else rows[i] if i < len(rows) else 0):
            raise RuntimeError(f"partition {i} has fewer rows than counted")

    again = F.xxhash64(F.lit(seed + 1), F.col("__key"), *keys)
    # A block is a task by its number: hashes would bring several together, the more the fewer tasks the session sets.
    total, n_blocks = int(rows.sum()), len(columns.ravel())
    block = F.col("__block")
    dealt = ordered.mapInArrow(deal, schema).withColumn("__block", block.cast("int")).repartitionById(max(1, n_blocks), block)
    place = F.row_number().over(Window.partitionBy("__block").orderBy(again, "__key")) - 1
    # The sizes that ``even`` gives, as arithmetic: where block j of a shard of n rows begins.
    shard, j = F.floor(block / blocks), F.pmod(block, F.lit(blocks))
    n = F.lit(total // shards) + (shard < total % shards).cast("long")
    first = j * F.floor(n / blocks) + F.least(j, F.pmod(n, F.lit(blocks)))
    return dealt.select(*docs.columns, shard.cast("int").alias("shard"), (first + place).cast("long").alias("slot"))


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document row: doc_id, size (UTF-8 bytes of the text, null none, plus 1), text_crc32, law ('rows'), shard, slot, grown_shard (null)."""
    rows = shuffle(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")))
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return rows.select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
