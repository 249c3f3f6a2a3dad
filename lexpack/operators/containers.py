"""Packing rows into containers and back.

Rows are dealt out by range of (keys, order) and sorted in their partition, so a container's records are neighbours and a key of
any size is spread over many tasks. A task closes a container where the key changes or ``most_bytes`` are full, and holds one
container at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexpack.functions import container
from lexpack.functions.vocabulary import Vocabulary, _plain
from lexpack.operators import jvm
from lexpack.operators.codec import _is_plain, compress
from lexpack.session import ship

MOST_BYTES = 1 << 20
PACKED = (("first", None), ("n_records", T.LongType()), ("n_bytes", T.LongType()), ("blob", T.BinaryType()))


def pack(df: DataFrame, keys: list[str], data: str, order: str, kind: str = "batch", vocabulary: Vocabulary | None = None, dictionary=None, integrity: bool = True, fast: bool = False, most_bytes: int = MOST_BYTES, partitions: int | None = None) -> DataFrame:
    """(keys, first, n_records, n_bytes, blob): containers of the records of each key in order.

    ``first``: the order value of a container's first record. Null records are left out. ``kind``: batch or index. A container has
    up to ``most_bytes`` of records, or one record that is longer. Where containers end depends on how rows are
    dealt out; the records and their order do not. Rows with equal keys and order are in no defined order.
    """
    if kind not in ("batch", "index"):
        raise ValueError(f"unknown kind {kind}")
    if fast and dictionary is not None:
        raise ValueError("fast and a dictionary exclude each other")
    ship(df.sparkSession)
    names = [*keys, "__o", "__d"]
    rows = df.where(F.col(data).isNotNull()).select(*keys, F.col(order).alias("__o"), F.col(data).cast("binary").alias("__d"))
    dealt = rows.repartitionByRange(*[partitions] * bool(partitions), *keys, "__o").sortWithinPartitions(*keys, "__o")
    # The JVM codes what tasks gather here: a batch's head and its records end to end, or an index's records.
    index = jvm.function("Index", "binary") if _is_plain(vocabulary, dictionary) else None
    kinds = [("first", rows.schema["__o"].dataType), *PACKED[1:3], *([("__head", T.BinaryType()), ("__r", T.ArrayType(T.BinaryType()))] if index else PACKED[3:])]
    schema = T.StructType([*(rows.schema[k] for k in keys), *(T.StructField(n, t) for n, t in kinds)])
    gathered = index is not None

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        v, types = vocabulary or _plain(), to_arrow_schema(schema)
        at, first, held, size = None, None, [], 0

        def closed():
            if gathered:
                last = (container.batch_head(held), [b"".join(held)]) if kind == "batch" else (None, held)
            else:
                last = (container.pack(held, v, dictionary, integrity, fast) if kind == "batch" else _index(held, v, dictionary, integrity),)
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, (*at, first, len(held), size, *last), strict=True))], types)

        parts, sizes = [], []

        def batch_of():
            lengths = np.concatenate(sizes)
            row = (*at, first, len(lengths), int(lengths.sum()), container.batch_head_of(lengths), [b"".join(parts)])
            parts.clear()
            sizes.clear()
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True))], types)

        def spans(columns):
            """Whole runs of rows at once: up to a change of key, or what fills a container."""
            nonlocal at, first
            *own, order, data = columns
            n = len(data)
            ends = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
            text = memoryview(data.buffers()[2] or b"")
            new = np.zeros(n, bool)
            for c in own:
                a, b = c.slice(0, max(0, n - 1)), c.slice(1)
                differ = pc.if_else(pc.and_(a.is_valid(), b.is_valid()), pc.not_equal(a, b), pc.xor(a.is_valid(), b.is_valid()))
                new[1:] |= np.asarray(differ.to_numpy(zero_copy_only=False), bool)
            stops, i = [*np.flatnonzero(new).tolist(), n], 0
            for stop in stops:
                while i < stop:
                    held_bytes = sum(int(x.sum()) for x in sizes)
                    if sizes and [c[i].as_py() for c in own] != at:
                        yield batch_of()
                        held_bytes = 0
                    k = int(np.searchsorted(ends, ends[i] + most_bytes - held_bytes, "right")) - 1
                    k = min(stop, k)
                    if k <= i:
                        if sizes:
                            yield batch_of()
                            continue
                        k = i + 1
                    if not sizes:
                        at, first = [c[i].as_py() for c in own], order[i].as_py()
                    parts.append(bytes(text[ends[i] : ends[k]]))
                    sizes.append(np.diff(ends[i : k + 1]))
                    i = k

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            if gathered and kind == "batch":
                yield from spans(columns)
                continue
            for *key, o, d in zip(*(c.to_pylist() for c in columns), strict=True):
                if held and (key != at or size + len(d) > most_bytes):
                    yield closed()
                    held, size = [], 0
                if not held:
                    at, first = key, o
                held.append(d)
                size += len(d)
        if held:
            yield closed()
        if sizes:
            yield batch_of()

    packed = dealt.mapInArrow(run, schema)
    if not gathered:
        return packed
    blob = F.concat("__head", compress(vocabulary, None, integrity, fast)(F.col("__r")[0])) if kind == "batch" else index(F.col("__r"), F.lit(integrity))
    return packed.select(*keys, "first", "n_records", "n_bytes", blob.alias("blob"))


def _index(records, vocabulary, dictionary, integrity) -> bytes:
    w = container.IndexWriter(vocabulary, dictionary, integrity)
    w.add_many(records)
    return w.finish()


def unpack(df: DataFrame, blob: str, keep: list[str] | None = None, vocabulary: Vocabulary | None = None, dictionary=None) -> DataFrame:
    """(keep, ordinal, data): the records of each row's batch, index or stream. A null container has none; a bad one fails."""
    ship(df.sparkSession)
    keep = [c for c in df.columns if c != blob] if keep is None else keep
    if _is_plain(vocabulary, dictionary) and (records := jvm.function("Unpack", "array<binary>")):
        each = df.select(*keep, F.posexplode(records(F.col(blob), F.lit(_plain().fingerprint.hex()))).alias("ordinal", "data"))
        return each.withColumn("ordinal", F.col("ordinal").cast("long"))
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("ordinal", T.LongType()), T.StructField("data", T.BinaryType())])

    def run(batches):
        v = vocabulary or _plain()
        for batch in batches:
            for i, b in enumerate(batch.column(batch.num_columns - 1)):
                if b.is_valid:
                    records = list(container.unpack(b.as_py(), v, dictionary))
                    at = pa.array([i] * len(records), pa.int64())
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(keep))), pa.array(range(len(records)), pa.int64()), pa.array(records, pa.binary())], names=schema.names)

    return df.select(*keep, F.col(blob).alias("__blob")).mapInArrow(run, schema)


def count():
    """A function from containers to their number of records, by the header."""

    @F.pandas_udf("long")
    def run(blob: pd.Series) -> pd.Series:
        return blob.map(lambda b: None if b is None else container.count(bytes(b)))

    return run


def read(i: int, vocabulary: Vocabulary | None = None, dictionary=None):
    """A function from indexes to their record i; a container that has none fails the job."""

    @F.pandas_udf("binary")
    def run(blob: pd.Series) -> pd.Series:
        v = vocabulary or _plain()
        return blob.map(lambda b: None if b is None else container.read(bytes(b), i, v, dictionary))

    return jvm.either(run, "Read", "binary", i, _plain().fingerprint.hex()) if _is_plain(vocabulary, dictionary) else run


def index_table(df: DataFrame, keys: list[str], order: str, data: Column, **how) -> DataFrame:
    """(keys, ordinal, offset, n_bytes, stream): an index as rows, each record's own stream with its place and byte offset in its key.

    The running sums move ordinals and sizes only. A key's rows meet in one task there; for hot keys give ``keys`` a part number.
    """
    streams = df.select(*keys, F.col(order).alias("__o"), compress(**how)(data).alias("stream")).withColumn("n_bytes", F.octet_length("stream").cast("long"))
    w = Window.partitionBy(*keys).orderBy("__o")
    before = F.coalesce(F.sum("n_bytes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return streams.select(*keys, (F.row_number().over(w) - 1).cast("long").alias("ordinal"), before.alias("offset"), "n_bytes", "stream")


def offsets(df: DataFrame, keys: list[str], order: str, size: Column) -> DataFrame:
    """(keys, order, ordinal, offset): running sums of sizes within each key, by order."""
    w = Window.partitionBy(*keys).orderBy(order)
    sized = df.select(*keys, order, size.cast("long").alias("__n"))
    before = F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sized.select(*keys, order, (F.row_number().over(w) - 1).cast("long").alias("ordinal"), before.alias("offset"))


def record(df: DataFrame, keys: list[str], order: str, i: int) -> DataFrame:
    """The i-th row of each key by order, found by top-i selection, not by a sort of everything; none where there are fewer."""
    if i < 0:
        raise IndexError("a record number is not negative")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("__k", rank).where(F.col("__k") <= i + 1).where(F.col("__k") == i + 1).drop("__k")
