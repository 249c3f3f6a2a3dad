"""SimHash near-dedup with bit-sliced comparison.

Fingerprints are compared only within buckets that must hold every pair: 64 bits are four bands of 16, and two fingerprints
that differ in at most two bits agree in at least two of the bands, so six tables keyed by two bands each miss no pair.
Inside a bucket the 32 remaining bit planes are stored vertically (bit t of 64 fingerprints in one word); a carry-save counter
of two bits and an overflow adds one plane for 64 pairs at a time, and a block is abandoned when all its counters are beyond
the radius.

Equal fingerprints are one node, so thousands of copies cost one comparison. A bucket of more than ``block`` nodes is
dealt out as pairs of blocks, each compared by its own task. Buckets give links of a spanning forest, never all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexpack.session import ship, stored
from lexpack.llm.graph import components, local_labels
from lexpack.llm.text import LOWER, encoded, extended, pieces

SEED = 42
SHINGLE = 3
RADIUS = 2
BLOCK = 2048
_BANDS = list(combinations(range(4), 2))


def bits_set(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set."""
    out = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = np.ascontiguousarray(hashes[at : at + (1 << 15)]).astype("<u8", copy=False)
        out += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return out


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit b is 1 if over half the shingles' XXH64 values have it; shingles are of words of the lower-cased text, repeats included."""
    counts, n, carried = np.zeros(64, np.int64), 0, []
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for piece in pieces((text or b"").translate(LOWER)):
        words = carried + piece.split()
        if len(words) >= shingle:
            found = [digest(s, seed) for s in map(join, zip(*(words[j:] for j in range(shingle)), strict=False))]
            counts += bits_set(np.array(found, np.uint64))
            n += len(found)
            carried = words[len(words) - shingle + 1 :]
        else:
            carried = words
    if not n and carried:
        return digest(join(carried), seed)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0]) if n else 0


def fingerprinted(docs: DataFrame, text: str = "text", keep: list[str] | None = None, name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint as a signed 64-bit number."""

    def make():
        def per_batch(batch: pa.RecordBatch):
            raw = encoded(batch.column(batch.schema.get_field_index(text)))
            return [pa.array(np.array([fingerprint(t) for t in raw], np.uint64).view(np.int64))]

        return per_batch

    return extended(docs, text, [T.StructField(name, T.LongType())], make, keep)


def planes(values: np.ndarray, bits: list[int]) -> np.ndarray:
    """Bit planes (len(bits), words): bit t of 64 values in each word."""
    n = -(-len(values) // 64) * 64
    padded = np.zeros(n, np.uint64)
    padded[: len(values)] = values
    return np.stack([np.packbits((padded >> np.uint64(t) & np.uint64(1)).astype(np.uint8), bitorder="little").view("<u8") for t in bits])


def near(a: np.ndarray, b: np.ndarray, bits: list[int], radius: int = RADIUS) -> np.ndarray:
    """Boolean matrix of the pairs that differ in at most ``radius`` (0 to 3) of the given bits."""
    vertical, full = planes(b, bits), np.uint64(0xFFFFFFFFFFFFFFFF)
    ones = np.zeros((len(a), vertical.shape[1]), np.uint64)
    twos, over = ones.copy(), ones.copy()
    for i, t in enumerate(bits):
        differ = vertical[i][None, :] ^ np.where(a >> np.uint64(t) & np.uint64(1), full, np.uint64(0))[:, None]
        carry = ones & differ
        ones ^= differ
        over |= twos & carry
        twos ^= carry
        if i % 8 == 7 and (over == full).all():
            break
    beyond = over | (ones if radius < 1 else np.uint64(0)) | (twos if radius < 2 else ones & twos if radius < 3 else np.uint64(0))
    return np.unpackbits((~beyond).view(np.uint8), axis=1, bitorder="little")[:, : len(b)].astype(bool)


def bucket_links(values: np.ndarray, left: np.ndarray, right: np.ndarray, bits: list[int], radius: int = RADIUS) -> np.ndarray:
    """Labels of the components that links between ``left`` and ``right`` rows make."""
    a, b = np.flatnonzero(left), np.flatnonzero(right)

    def rows():
        for at in range(0, len(a), 256):
            found = near(values[a[at : at + 256]], values[b], bits, radius)
            for i in np.flatnonzero(found.any(axis=1)).tolist():
                yield int(a[at + i]), b[found[i]]

    return local_labels(len(values), rows())


def links(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints (column fp) as all pairs within the radius (at most 2) would."""
    if not 0 <= radius <= 2:
        raise ValueError("two equal bands are sure only for a radius of at most 2")
    band = [F.shiftrightunsigned(F.col("fp"), 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    keys = F.array(*(F.struct(F.lit(k).alias("t"), (band[i] * 65536 + band[j]).alias("key")) for k, (i, j) in enumerate(_BANDS)))
    rows = prints.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.key")
    sizes = rows.groupBy("t", "key").count().where("count > 1").select("t", "key", F.ceil(F.col("count") / block).cast("int").alias("n"))
    part = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    dealt = rows.join(sizes, ["t", "key"]).withColumn("p", part)
    dealt = dealt.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("t", "key", "fp", "p", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"))

    def per_group(key, table):
        t, lo, hi = key[0].as_py(), key[-2].as_py(), key[-1].as_py()
        values = table.column("fp").to_numpy().view(np.uint64)
        p = table.column("p").to_numpy()
        bits = [b for b in range(64) if b // 16 not in _BANDS[t]]
        labels = bucket_links(values, p == lo, p == hi, bits, radius)
        moved = np.flatnonzero(labels != np.arange(len(values)))
        signed = values.view(np.int64)
        return pa.table({"a": signed[moved], "b": signed[labels[moved]]})

    return dealt.groupBy("t", "key", "lo", "hi").applyInArrow(per_group, "a long, b long")


def grouped(prints: DataFrame, fp: str = "fingerprint", doc_id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(fp, root, component_id): each distinct fingerprint with the smallest fingerprint and the smallest non-null doc_id of its component."""
    classes = prints.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("least"))
    found = components(links(classes, radius=radius)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    named = classes.join(found, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(smallest, "root").select("fp", "root", "component_id")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row a document row: doc_id, fingerprint (16 lowercase hex digits), component_id.

    Null, empty and blank texts have the fingerprint zero and link like any other. A text of fewer words than a shingle is
    one shingle. Null doc_ids never name a component unless all of its ids are null (then null). Repeated rows are kept.
    """
    ship(docs.sparkSession)
    light = stored(fingerprinted(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), keep=["doc_id"]), "simhash")
    found = grouped(light, radius=radius)
    return light.join(found, light.fingerprint == found.fp).select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One document row of each component: that of the smallest doc_id (nulls last), the first row among repeated ones."""
    ship(docs.sparkSession)
    table = stored(fingerprinted(docs, text, name="__fp").withColumn("__row", F.monotonically_increasing_id()), "simhash")
    light = table.select(F.col(doc_id).alias("__id"), "__fp", "__row")
    found = grouped(light, "__fp", "__id", radius)
    chosen = light.join(found, light["__fp"] == found["fp"]).groupBy("root")
    first = chosen.agg(F.min(F.struct(F.col("__id").isNull().alias("n"), F.col("__id").alias("i"), F.col("__row").alias("r"))).alias("m")).select(F.col("m.r").alias("__row"))
    return table.join(first, "__row", "left_semi").select(*docs.columns)
