"""Data source ``lexpack``: folders of container files, batch and streaming, both ways.

Reading gives (path, ordinal, data). A partition is one batch file or a run of an index file's records, so an index file of any
size is read by many tasks and none of it twice. The option ``ordinals`` (numbers with commas) gives those records only, and of an
index only their streams are read. It is an option and no pushed filter because Spark 4.1 keeps a Python source's filtered plan for
later reads of the same DataFrame, which would lack rows. A count of records needs headers alone (``counts``). Writing makes one
index or batch file a task.

Options: path; kind (index or batch, for writing); records (per partition, for reading indexes; 10,000); ordinals; dictionary and
vocabulary, as ``handle`` gives them. Files are reached through ``pyarrow.fs``; where only Spark can read a store, use ``files.binary`` and
``containers.unpack``.
"""

from __future__ import annotations

import base64
import pickle
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage

from lexpack.functions import container, stream
from lexpack.functions.vocabulary import Vocabulary, _plain
from lexpack.session import ship
from lexpack.sources import store

SCHEMA = "path string, ordinal long, data binary"
HEAD = 17  # magic, version, count, body size of an index
SUFFIX = ".lxc"


def handle(x) -> str:
    """A vocabulary or dictionary as an option's text (both are bounded). Only pass on what you made yourself: it is a pickle."""
    return base64.b64encode(pickle.dumps(x)).decode()


def register(spark: SparkSession) -> SparkSession:
    ship(spark).dataSource.register(ContainerSource)
    return spark


def _models(options) -> tuple[Vocabulary, object]:
    load = lambda k: pickle.loads(base64.b64decode(options[k])) if options.get(k) else None
    return load("vocabulary") or _plain(), load("dictionary")


@dataclass
class Part(InputPartition):
    path: str
    first: int = 0
    last: int | None = None  # None: a batch file or single stream, all of it
    wanted: tuple[int, ...] | None = None


def head(path: str) -> tuple[str, int]:
    """(kind, records) of a file, from its first bytes."""
    fs, place = store.opened(path)
    with fs.open_input_file(place) as f:
        raw = f.read(HEAD)
    return container.kind(raw), container.count(raw)


def parts(path: str, per: int, wanted: tuple[int, ...] | None = None) -> list[Part]:
    kind, n = head(path)
    if kind != "index":
        return [Part(path, wanted=wanted)]
    if wanted is not None:
        return [Part(path, 0, n, tuple(i for i in wanted if i < n))]
    return [Part(path, a, min(n, a + per)) for a in range(0, n, per)]


def records(part: Part, vocabulary, dictionary):
    """(ordinal, record) of a partition; of an index only the offsets and streams that are needed are read."""
    fs, place = store.opened(part.path)
    with fs.open_input_file(place) as f:
        if part.last is None:
            for i, r in enumerate(container.unpack(f.read(), vocabulary, dictionary)):
                if part.wanted is None or i in part.wanted:
                    yield i, r
            return
        size = f.size()
        raw = f.read_at(HEAD, 0)
        n, body = int.from_bytes(raw[5:9], "little"), int.from_bytes(raw[9:17], "little")
        start = HEAD + 8 * n
        if raw[4] != container.VERSION or start + body != size:
            raise ValueError(f"{part.path}: the header doesn't fit the file")
        runs = [(part.first, part.last)] if part.wanted is None else [(i, i + 1) for i in part.wanted]
        for a, b in runs:
            offsets = np.frombuffer(f.read_at(8 * min(b - a + 1, n - a), HEAD + 8 * a), "<u8").astype(np.int64)
            offsets = np.append(offsets, body) if len(offsets) == b - a else offsets
            if (np.diff(offsets) < 0).any() or offsets[-1] > body:
                raise ValueError(f"{part.path}: the offsets don't fit the body")
            streams = f.read_at(int(offsets[-1] - offsets[0]), start + int(offsets[0]))
            for i, (x, y) in enumerate(zip((offsets[:-1] - offsets[0]).tolist(), (offsets[1:] - offsets[0]).tolist(), strict=True)):
                yield a + i, stream.decompress(streams[x:y], vocabulary, dictionary)


def batches(part: Part, options, size: int = 1000):
    held: list[tuple[int, bytes]] = []

    def made():
        return pa.RecordBatch.from_arrays([pa.array([part.path] * len(held)), pa.array([i for i, _ in held], pa.int64()), pa.array([r for _, r in held], pa.binary())], names=["path", "ordinal", "data"])

    for x in records(part, *_models(options)):
        held.append(x)
        if len(held) == size:
            yield made()
            held = []
    if held:
        yield made()


class ContainerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lexpack"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return ContainerReader(self.options)

    def streamReader(self, schema):  # noqa: N802
        return ContainerStreamReader(self.options)

    def writer(self, schema, overwrite):
        return ContainerWriter(self.options, overwrite)

    def streamWriter(self, schema, overwrite):  # noqa: N802
        return ContainerStreamWriter(self.options)


class ContainerReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)
        asked = self.options.get("ordinals")
        self.wanted = None if asked is None else tuple(sorted({int(x) for x in asked.split(",") if x.strip()}))
        if self.wanted and self.wanted[0] < 0:
            raise IndexError("a record number is not negative")

    def partitions(self):
        per = int(self.options.get("records", 10_000))
        return [p for path, _ in store.listed(self.options["path"], SUFFIX) for p in parts(path, per, self.wanted)]

    def read(self, partition):
        # An empty folder has no partition, and Spark then reads one that is None.
        yield from batches(partition, self.options) if isinstance(partition, Part) else ()


class ContainerStreamReader(DataSourceStreamReader):
    """Files in the order of their names; a batch is the files behind the last name seen. Names must grow, as the sink's do."""

    def __init__(self, options):
        self.options = dict(options)

    def initialOffset(self):  # noqa: N802
        return {"name": ""}

    def latestOffset(self):  # noqa: N802
        found = store.listed(self.options["path"], SUFFIX)
        return {"name": found[-1][0].rpartition("/")[2] if found else ""}

    def partitions(self, start, end):
        per = int(self.options.get("records", 10_000))
        chosen = [p for p, _ in store.listed(self.options["path"], SUFFIX) if start["name"] < p.rpartition("/")[2] <= end["name"]]
        return [x for p in chosen for x in parts(p, per)]

    def read(self, partition):
        yield from batches(partition, self.options)


@dataclass
class Wrote(WriterCommitMessage):
    path: str | None
    records: int


def _write(options, rows, name: str) -> Wrote:
    """One task's file: rows come as Arrow batches with a column ``data``, in order."""
    vocabulary, dictionary = _models(options)
    kind, found = options.get("kind", "index"), []
    for batch in rows:
        found += [r for r in batch.column(batch.schema.get_field_index("data")).to_pylist() if r is not None]
    if not found:
        return Wrote(None, 0)
    if kind == "batch":
        blob = container.pack(found, vocabulary, dictionary)
    else:
        w = container.IndexWriter(vocabulary, dictionary)
        w.add_many(found)
        blob = w.finish()
    path = f"{options['path'].rstrip('/')}/{name}{SUFFIX}"
    store.put(path, blob)
    return Wrote(path, len(found))


def _forget(messages) -> None:
    for m in messages:
        if m is not None and m.path:
            fs, place = store.opened(m.path)
            fs.delete_file(place)


class ContainerWriter(DataSourceArrowWriter):
    """Null records are left out. A failed job's files are removed; files of lost attempts are left under names not committed."""

    def __init__(self, options, overwrite: bool):
        self.options, self.job = dict(options), uuid.uuid4().hex
        self.old = [p for p, _ in store.listed(self.options["path"], SUFFIX)] if overwrite else []

    def write(self, iterator):
        from pyspark import TaskContext

        # A repeated attempt writes the same name, so a task has one file whatever happens.
        return _write(self.options, iterator, f"{self.job}-{TaskContext.get().partitionId():06d}")

    def commit(self, messages):
        _forget([Wrote(p, 0) for p in self.old])

    def abort(self, messages):
        _forget(messages)


class ContainerStreamWriter(DataSourceStreamArrowWriter):
    """A batch's files carry its number; a batch that is run again replaces them, so that every row is there once."""

    def __init__(self, options):
        self.options, self.run = dict(options), uuid.uuid4().hex

    def write(self, iterator):
        from pyspark import TaskContext

        return _write(self.options, iterator, f".open-{self.run}-{uuid.uuid4().hex}-{TaskContext.get().partitionId():06d}")

    def commit(self, messages, batchId):  # noqa: N803
        fs, folder = store.opened(self.options["path"])
        prefix = f"{batchId:012d}-"
        for p, _ in store.listed(self.options["path"], SUFFIX):
            if p.rpartition("/")[2].startswith(prefix):
                fs.delete_file(store.opened(p)[1])
        # In ascending order, so that a reader that goes by names never sees a later file before an earlier one.
        for part, path in sorted((m.path.rpartition("-")[2], m.path) for m in messages if m is not None and m.path):
            fs.move(store.opened(path)[1], f"{folder.rstrip('/')}/{prefix}{part}")

    def abort(self, messages, batchId):  # noqa: N803
        _forget(messages)


def counts(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, records) of every file, from headers only."""
    files = spark.createDataFrame(store.listed(path, SUFFIX), "path string, size long")

    def run(found):
        for batch in found:
            heads = [head(p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([k for k, _ in heads], pa.string()), pa.array([n for _, n in heads], pa.int64())], names=["path", "kind", "records"])

    ship(spark)
    return files.mapInArrow(run, "path string, kind string, records long")
