"""Token counts of flat token files by a separator scan.

A token file is a run of token ids of fixed width, documents one after another, each closed by the end-of-document id; it has
no index. The files are cut into blocks of equal size regardless of documents. A task reads one block, finds all separators by
one vectorised comparison, and keeps the tokens before the first, after the last, and between neighbours. A prefix scan
over the blocks' summaries stitches the documents that cross blocks (one may cover many) and numbers them.

Files are read and written through ``pyarrow.fs``, so that any store which it and the cluster know will do.
"""

from __future__ import annotations

import os
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexpack.session import shared_dir, ship, stored
from lexpack.llm.text import encoded, pieces, slices

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256
DTYPE = "<u2"
BLOCK_BYTES = 8 << 20
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def encoder(path: str):
    """The byte-level BPE encoder of a rank file."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def open_store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_files(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end: int = END, dtype: str = DTYPE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenise documents into flat files, one a task, and return (path, ordinal, doc_id): where each document went.

    Null texts are documents without tokens. Texts are tokenised in pieces of a megabyte, cut at white space. A file gets its name
    when it is complete, so that a repeated attempt leaves no half file; the returned table is stored, and only files it names
    count.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        encode, stop = encoder(tokenizer), np.array([end], dtype).tobytes()
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        ordinal, done = 0, []
        with store.open_output_stream(f"{base}/{name}.part") as out:
            for batch in slices(batches, "text"):
                raw = encoded(batch.column(1))
                for t in raw:
                    for piece in pieces(t or b""):
                        ids = np.array(encode.encode_ordinary(piece.decode("utf-8", "replace")), np.int64)
                        if len(ids) and (ids.max() > np.iinfo(dtype).max or (ids == end).any()):
                            raise ValueError("the tokenizer's ids don't fit the width, or one is the separator")
                        out.write(ids.astype(dtype).tobytes())
                    out.write(stop)
                done.append((ordinal, batch.column(0)))
                ordinal += batch.num_rows
        store.move(f"{base}/{name}.part", f"{base}/{name}.bin")
        for first, ids in done:
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder.rstrip('/')}/{name}.bin"] * n, pa.string()), pa.array(np.arange(first, first + n)), ids], names=["path", "ordinal", "doc_id"])

    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("ordinal", T.LongType()), rows.schema["doc_id"]])
    return stored(rows.mapInArrow(run, schema), "token-manifest")


def count_files(spark: SparkSession, paths: DataFrame, end: int = END, dtype: str = DTYPE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, ordinal, n_tokens) of every document in the files of ``paths`` (column path, distinct).

    Tokens after the last separator of a file are a document of their own; an empty file has none. Separators aren't counted. A
    file whose size isn't a multiple of the token width fails the job.
    """
    ship(spark)
    width = np.dtype(dtype).itemsize
    block = max(width, block_bytes // width * width)

    def with_size(batches):
        for batch in batches:
            found = []
            for p in batch.column(0).to_pylist():
                store, path = open_store(p)
                found.append(store.get_file_info(path).size)
                if found[-1] % width:
                    raise ValueError(f"{p}: its size is no multiple of the token width {width}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["path", "size"])

    files = paths.select("path").mapInArrow(with_size, "path string, size long").where("size > 0")
    blocks = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / block))).alias("block"), F.lit(0).alias("_")).drop("_").repartition(F.col("path"), F.col("block"))

    def scan(batches):
        for batch in batches:
            for p, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, path = open_store(p)
                with store.open_input_file(path) as f:
                    ids = np.frombuffer(f.read_at(block, b * block), dtype)
                at = np.flatnonzero(ids == end)
                head, last = (int(at[0]), len(ids) - 1 - int(at[-1])) if len(at) else (len(ids), 0)
                inner = (np.diff(at) - 1).astype("<i8")
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([b]), pa.array([len(at)]), pa.array([head]), pa.array([last]), pa.array([inner], pa.list_(pa.int64()))], names=["path", "block", "ends", "head", "rest", "inner"])

    found = stored(blocks.mapInArrow(scan, "path string, block long, ends long, head long, rest long, inner array<long>"), "token-blocks")
    w = Window.partitionBy("path").orderBy("block")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    scanned = found.select("path", "block", "ends", "head", "rest")
    scanned = scanned.withColumn("first", F.coalesce(F.sum("ends").over(before), F.lit(0))).withColumn("run", F.coalesce(F.sum((F.col("ends") > 0).cast("long")).over(before), F.lit(0)))
    # Blocks of one run follow a separator: the rest behind it, then whole blocks without any.
    same = Window.partitionBy("path", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.lag("rest", 1, 0).over(w)
    scanned = scanned.withColumn("open", F.when(F.row_number().over(Window.partitionBy("path", "run").orderBy("block")) == 1, carried).otherwise(0)).withColumn("sofar", F.coalesce(F.sum(F.col("open") + F.col("head")).over(same), F.lit(0)) + F.col("open"))
    tail = Window.partitionBy("path")
    ends = scanned.withColumn("last", F.max("block").over(tail))
    crossing = ends.where("ends > 0").select("path", F.col("first").alias("ordinal"), (F.col("sofar") + F.col("head")).alias("n_tokens"))
    trailing = ends.where("block = last").select("path", (F.col("first") + F.col("ends")).alias("ordinal"), F.when(F.col("ends") > 0, F.col("rest")).otherwise(F.col("sofar") + F.col("head")).alias("n_tokens")).where("n_tokens > 0")
    inner = found.where("ends > 1").select("path", "block", F.posexplode("inner").alias("k", "n_tokens")).join(scanned.select("path", "block", "first"), ["path", "block"]).select("path", (F.col("first") + 1 + F.col("k")).alias("ordinal"), "n_tokens")
    return crossing.unionByName(inner).unionByName(trailing)


def report(docs: DataFrame, tokenizer: str = TOKENIZER, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a document row: doc_id, n_tokens, counted from flat files that are written to the shared folder and removed again."""
    spark = ship(docs.sparkSession)
    folder = f"{shared_dir(spark).rstrip('/')}/lexpack/tokens-{uuid.uuid4().hex}"
    manifest = write_files(docs, folder, tokenizer, doc_id=doc_id, text=text)
    counts = stored(count_files(spark, manifest.select("path").distinct(), block_bytes=block_bytes), "token-counts")
    store, base = open_store(folder)
    if store.get_file_info(base).type.name == "Directory":
        store.delete_dir(base)
    return manifest.join(counts, ["path", "ordinal"]).select("doc_id", "n_tokens")
