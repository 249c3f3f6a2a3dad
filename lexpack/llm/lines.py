"""Line dedup by content-defined chunks of lines.

A text is cut into lines and every line hashed. A rolling hash over ``roll`` consecutive line hashes has a local minimum about
every third line; chunks end there. Whether a line ends a chunk depends on it and its neighbours only, so a passage that is
moved or has other text around it is cut at the same inner places. A chunk of several lines that occurs again anywhere in the
corpus is removed but for its first occurrence (by doc_id, nulls last, then by place).

Such chunks miss what is repeated at the edges of a passage, and most passages of few lines. So what they leave is looked at again
with a boundary at every line: of all runs of ``least_lines`` lines, and of lines of over ``long_words`` words, those that occur
again go too, but for lines of a first occurrence. After that no such run or line is there twice. Runs inside chunks already removed
have no part in it, so the rows of a large group of copies don't come this far.

Repeats are found by a 128-bit hash on light rows, and then the bytes of all occurrences are compared: for each hash the smallest
and the largest byte string must be equal, which is combined before the shuffle. Should two different chunks ever share a
hash, everything is hashed again under another seed. Texts are read twice and never exchanged.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexpack.session import shared_dir, ship, stored
from lexpack.llm.text import encoded, slices
from lexpack.sources import store

ROLL = 2
LONGEST = 32
LEAST_LINES = 2
LONG_WORDS = 50
CHUNK, RUN = 0, 1
_M = np.uint64(0x9E3779B97F4A7C15)


def cuts(lines: list[bytes], roll: int = ROLL, longest: int = LONGEST) -> list[int]:
    """Where chunks end, as line counts; the last is ``len(lines)``. No chunk is longer than ``longest`` lines."""
    n = len(lines)
    if n <= 2:
        return [n]
    hashes = np.array([xxhash.xxh64_intdigest(x) for x in lines], np.uint64)
    rolled = np.zeros(n, np.uint64)
    for j in range(min(roll, n)):
        rolled[j:] = rolled[j:] * _M + hashes[: n - j]
    rolled = (rolled ^ (rolled >> np.uint64(32))) * _M
    inner = np.flatnonzero((rolled[1:-1] < rolled[:-2]) & (rolled[1:-1] <= rolled[2:])) + 2
    out, last = [], 0
    for at in [*inner.tolist(), n]:
        while at - last > longest:
            last += longest
            out.append(last)
        if at > last:
            out.append(at)
            last = at
    return out


def chunked(text: bytes | None, seed: int = 0, hash_bits: int = 128, roll: int = ROLL) -> list[tuple[bytes, int, bytes]]:
    """(hash, lines, bytes) of the chunks of a text; joined by newlines, their bytes are the text."""
    if text is None:
        return []
    lines, out, last = text.split(b"\n"), [], 0
    for at in cuts(lines, roll):
        body = b"\n".join(lines[last:at])
        out.append((xxhash.xxh3_128_digest(body, seed)[: hash_bits // 8], at - last, body))
        last = at
    return out


def runs(lines: list[bytes], least_lines: int = LEAST_LINES, long_words: int = LONG_WORDS) -> list[tuple[int, int]]:
    """(first line, lines) of every run of ``least_lines`` lines, none blank, and of every line of over ``long_words`` words."""
    words = [len(x.split()) for x in lines]
    out = [(i, 1) for i, n in enumerate(words) if n > long_words]
    return out + [(i, least_lines) for i in range(len(lines) - least_lines + 1) if all(words[i : i + least_lines])]


def _parts(text: bytes | None, least_lines: int, long_words: int, seed: int, hash_bits: int):
    """(lines, chunk of each line, [(kind, first line, lines, hash)]) of a text: its chunks and runs that may be repeats."""
    if text is None:
        return [], [], []
    lines, owner, out, at = text.split(b"\n"), [], [], 0
    for k, (h, n, body) in enumerate(chunked(text, seed, hash_bits)):
        owner += [k] * n
        if n >= least_lines and body.strip():
            out.append((CHUNK, at, n, h))
        at += n
    for i, n in runs(lines, least_lines, long_words):
        out.append((RUN, i, n, xxhash.xxh3_128_digest(b"\n".join(lines[i : i + n]), seed)[: hash_bits // 8]))
    return lines, owner, out


def _repeated(places: DataFrame, name: str) -> DataFrame:
    """(row, d, at, n, a, b, h, first) of the places whose hash occurs again."""
    place = F.struct(F.col("d").isNull().alias("n"), "d", "row", "at")
    # Stored, so that both sides of the join below are shuffled for it alone and Spark can split a frequent chunk's rows.
    again = stored(places.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min(place).alias("first")).where("m > 1").select("h", F.col("first.row").alias("r"), F.col("first.at").alias("j")), name)
    return places.join(again, "h").select("row", "d", "at", "n", "a", "b", "h", ((F.col("row") == F.col("r")) & (F.col("at") == F.col("j"))).alias("first"))


def _once(docs: DataFrame, doc_id: str, text: str, least_lines: int, long_words: int, seed: int, hash_bits: int) -> DataFrame:
    """The result under one seed, stored, with the repeated chunks' hashes and bytes in ``__found``."""
    rows = docs.withColumn("__row", F.monotonically_increasing_id())
    how = (least_lines, long_words, seed, hash_bits)

    def index(batches):
        for batch in slices(batches, "t"):
            found = [[(kind, at, n, owner[at], owner[at + n - 1], h) for kind, at, n, h in own] for _, owner, own in (_parts(t, *how) for t in encoded(batch.column(2)))]
            each = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) for x in found]))
            columns = list(zip(*(x for own in found for x in own), strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0).take(each), batch.column(1).take(each), *(pa.array(x, pa.int32()) for x in columns[:5]), pa.array(columns[5], pa.binary())], names=["row", "d", "kind", "at", "n", "a", "b", "h"])

    slim = rows.select(F.col("__row").alias("row"), F.col(doc_id).alias("d"), F.col(text).cast("string").alias("t"))
    schema = T.StructType([slim.schema["row"], slim.schema["d"], *(T.StructField(c, T.IntegerType()) for c in ("kind", "at", "n", "a", "b")), T.StructField("h", T.BinaryType())])
    places = stored(slim.mapInArrow(index, schema), "line-chunks")
    chunks = stored(_repeated(places.where(f"kind = {CHUNK}"), "line-repeats"), "line-flags")
    gone = chunks.where("not first").groupBy("row").agg(F.collect_set("a").alias("gone"))
    # Most runs occur once and drop out by their hashes; only then are those inside removed chunks left out, and the rest counted anew.
    runs_again = _repeated(places.where(f"kind = {RUN}"), "line-repeats").drop("first").join(gone, "row", "left")
    left = stored(runs_again.where(F.col("gone").isNull() | F.exists(F.sequence("a", "b"), lambda c: ~F.array_contains("gone", c))).drop("gone"), "line-runs")
    flags = chunks.select("row", F.lit(CHUNK).alias("kind"), "at", "n", "h", "first").unionByName(_repeated(left, "line-repeats").select("row", F.lit(RUN).alias("kind"), "at", "n", "h", "first"))
    # A row's number holds its partition, so flags are laid out by partition and the task that reads the texts fetches its own.
    folder = f"{shared_dir(docs.sparkSession).rstrip('/')}/lexpack/line-flags-{uuid.uuid4().hex}"
    flags.withColumn("part", F.shiftright("row", 33)).repartition("part").write.partitionBy("part").parquet(folder)
    own = [c for c in docs.columns if c != text]
    fields = [T.StructField(text, T.StringType()), *(T.StructField(c, T.LongType()) for c in ("n_lines", "n_removed", "n_repeated")), T.StructField("__found", T.ArrayType(T.StructType([T.StructField("h", T.BinaryType()), T.StructField("b", T.BinaryType())])))]

    def fetched(part: int) -> dict[int, list[dict]]:
        found: dict[int, list[dict]] = {}
        for path, _ in store.listed(f"{folder}/part={part}", ".parquet"):
            for x in pq.read_table(pa.BufferReader(store.get(path))).to_pylist():
                found.setdefault(x["row"], []).append(x)
        return found

    def judged(t: bytes | None, flags: list[dict]):
        lines, _, parts = _parts(t, *how) if flags else ([] if t is None else t.split(b"\n"), None, [])
        if not {(x["kind"], x["at"], x["n"], x["h"]) for x in flags} <= set(parts):
            raise RuntimeError("a row's text is not the one that was indexed; cut the input's lineage first")
        state = np.zeros(len(lines), np.int8)  # 1: occurs again, 2: stays, 3: goes
        for kind, first, mark in ((RUN, False, 1), (CHUNK, True, 1), (RUN, True, 2), (CHUNK, False, 3)):
            for x in flags:
                if x["kind"] == kind and x["first"] == first:
                    state[x["at"] : x["at"] + x["n"]] = mark
        runs_on = np.zeros(len(lines), bool)
        for x in flags:
            if x["kind"] == RUN and not x["first"]:
                runs_on[x["at"] : x["at"] + x["n"]] = True
        goes = (state == 3) | (runs_on & (state == 1))
        found = [{"h": x["h"], "b": b"\n".join(lines[x["at"] : x["at"] + x["n"]])} for x in flags]
        kept = t if not goes.any() else b"\n".join(b for b, g in zip(lines, goes.tolist(), strict=True) if not g)
        return None if kept is None else kept.decode("utf-8", "replace"), len(lines), int(goes.sum()), int((state > 0).sum()), found

    def apply(batches):
        part, flags = None, {}
        for batch in slices(batches, text):
            numbers = batch.column(batch.schema.get_field_index("__row")).to_pylist()
            if part is None:
                part = numbers[0] >> 33
                flags = fetched(part)
            out = [judged(t, flags.pop(i, [])) for t, i in zip(encoded(batch.column(batch.schema.get_field_index(text))), numbers, strict=True)]
            arrays = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("h", pa.binary()), ("b", pa.binary())]))), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in own), *arrays], names=[*own, *(f.name for f in fields)])
        if flags:
            raise RuntimeError("rows that were indexed are not there; cut the input's lineage first")

    return stored(rows.mapInArrow(apply, T.StructType([*(docs.schema[c] for c in own), *fields])), "lines")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_lines: int = LEAST_LINES, long_words: int = LONG_WORDS, hash_bits: int = 128) -> DataFrame:
    """``docs`` with repeated lines removed from the text, and the numbers n_lines, n_removed and n_repeated (lines that occur again, those that stay included).

    A null text has no lines, an empty one has one. Blank chunks are left alone, as are runs with a blank line. Repeated rows repeat
    all their chunks. A row's lines beyond the first occurrence may all go, which leaves an empty text. Removed
    lines go with their newline. Columns named like a result are replaced. The input's partitions must come out alike when
    recomputed, as those of a file scan do; a row that differs fails the job.
    """
    ship(docs.sparkSession)
    names = ("n_lines", "n_removed", "n_repeated")
    slim = docs.select(*(c for c in docs.columns if c.lower() not in names))
    for seed in range(64):
        found = _once(slim, doc_id, text, least_lines, long_words, seed, hash_bits)
        one = found.select(F.explode("__found").alias("x")).groupBy("x.h").agg(F.min("x.b").alias("low"), F.max("x.b").alias("high"))
        if one.where("low <> high").isEmpty():
            return found.select(*slim.columns, *names)
    raise RuntimeError("every hash seed gave two chunks one hash")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document row: doc_id, n_lines, n_removed, n_repeated, kept_bytes and kept_crc32 of the remaining text."""
    rows = deduplicate(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return rows.select("doc_id", "n_lines", "n_removed", "n_repeated", F.octet_length(body).cast("long").alias("kept_bytes"), F.crc32(body).alias("kept_crc32"))
