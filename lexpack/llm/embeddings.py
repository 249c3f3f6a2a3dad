"""Embedding near-dedup with spherical-cap filters.

A filter is a direction on the sphere, and a vector belongs to all filters whose inner product with it is at least a
threshold. Directions are the words of a random product code: the (randomly rotated) space is cut into blocks, each with a
small random codebook, and a direction is one codeword of each block. Because the inner product is a sum over blocks, the filters
that exceed the threshold are list-decoded by walking the blocks' codewords from the best down, without looking at the others.
Vectors are joined on filters and every candidate pair is verified in double precision.

The threshold follows from the number of distinct vectors: a filter takes about ``bucket`` of them if they are spread evenly and
a vector has about ``lists`` filters, the best ``least`` of them in any case; caps are never narrower than ``WIDE`` times the angle
of a pair. Narrow caps are shared by fewer pairs, so ``lists`` and ``least`` grow with the number of vectors: until, of pairs
planted at the wanted cosine itself, a share of ``RECALL`` have a common filter. This is found once, on the driver.
A pair that shares none is missed (the tests measure recall). Equal vectors are one node, so copies cost nothing. A filter of
more than ``block`` nodes is dealt out as pairs of blocks. A pair is counted only in the smallest filter that both have, inside
the task, so pairs are never emitted: a task returns link counts and the links of a spanning forest.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexpack.session import cut, ship, stored
from lexpack.llm.graph import components, local_labels

COSINE = 0.95
LISTS = 24
LEAST = 10
BUCKET = 64
BLOCK = 1024
PARTS = 3
#: Large filters (16 bytes each) that are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 500_000
WIDE = 2.5
#: The share of pairs at the wanted cosine that a code must give a common filter, the pairs it's tried on, and how lists grow.
RECALL, TRIED, GROW, MOST_GROWTH = 0.99, 2000, 1.25, 32.0


def tail(z: float, dim: int) -> float:
    """The share of the unit sphere with an inner product of at least z with a direction."""
    if dim < 2:
        return 0.5
    t = np.linspace(-1, 1, 20001)[1:-1]
    logs = (dim - 3) / 2 * np.log1p(-t * t)
    weight = np.exp(logs - logs.max())
    return float(weight[t >= z].sum() / weight.sum())


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """Rows padded to a power of two and turned by two rounds of random signs and a Hadamard transform."""
    d = 1 << max(2, (x.shape[1] - 1).bit_length())
    out = np.zeros((len(x), d))
    out[:, : x.shape[1]] = x
    rng = np.random.default_rng([seed, d])
    for _ in range(2):
        out *= rng.choice([-1.0, 1.0], d)
        h = 1
        while h < d:
            pair = out.reshape(len(x), -1, 2, h)
            out = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(len(x), d)
            h *= 2
        out /= math.sqrt(d)
    return out


def planted(dim: int, pairs: int, cosine: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows in random directions, and others at the cosine from them."""
    rng = np.random.default_rng([seed, dim])
    a, b = (rng.standard_normal((pairs, dim)) for _ in range(2))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return a, cosine * a + math.sqrt(max(0.0, 1 - cosine * cosine)) * b


class Code:
    """The product code for vectors of one length among about n.

    Lists are ``growth`` times ``lists`` and ``least``; by default, beyond four dimensions, as many times as ``RECALL`` needs, up to
    about ``MOST_GROWTH``.
    """

    def __init__(self, dim: int, n: int, cosine: float = COSINE, lists: int = LISTS, bucket: int = BUCKET, least: int = LEAST, seed: int = 2, growth: float | None = None):
        self.growth = growth or 1.0
        self._make(dim, n, cosine, lists, bucket, least, seed)
        d = 1 << max(2, (dim - 1).bit_length())
        # Up to four dimensions a block of one number has but two codewords, so longer lists add little; caps there don't narrow with n.
        if growth is None and d > 4:
            a, b = planted(d, TRIED, cosine, seed)
            while self.recall(a, b) < RECALL and self.growth < MOST_GROWTH:
                self.growth *= GROW
                self._make(dim, n, cosine, lists, bucket, least, seed)

    def recall(self, a: np.ndarray, b: np.ndarray) -> float:
        """The share of the pairs of unit rows that have a common filter."""
        return sum(not set(x).isdisjoint(y) for x, y in zip(self.decode(a), self.decode(b), strict=True)) / len(a)

    def _make(self, dim: int, n: int, cosine: float, lists: float, bucket: int, least: int, seed: int) -> None:
        lists, self.seed, self.least = lists * self.growth, seed, math.ceil(least * self.growth)
        d = 1 << max(2, (dim - 1).bit_length())
        # In few dimensions a small cap is narrow against the angle of a pair, whose ends would then seldom lie in one.
        share = max(min(0.05, bucket / max(n, 1)), tail(math.cos(min(WIDE * math.acos(max(-1.0, min(1.0, cosine))), math.pi / 2)), d))
        # Filters are numbered by 31 bits: enough for some five billion distinct vectors at full fineness; beyond, buckets grow.
        self.size = min(1290, max(4, math.ceil((lists / share) ** (1 / PARTS))))
        low, high = -1.0, 1.0
        for _ in range(40):
            mid = (low + high) / 2
            low, high = (mid, high) if tail(mid, d) > lists / self.size**PARTS else (low, mid)
        self.threshold = high
        rng = np.random.default_rng([seed, d, self.size])
        self.blocks = np.array_split(np.arange(d), PARTS)
        self.books = []
        for b in self.blocks:
            c = rng.standard_normal((self.size, len(b)))
            self.books.append(c / np.linalg.norm(c, axis=1, keepdims=True) / math.sqrt(PARTS))

    def decode(self, x: np.ndarray) -> list[list[int]]:
        """The sorted filters of each unit row."""
        turned = rotate(x, self.seed)
        products = [turned[:, b] @ c.T for b, c in zip(self.blocks, self.books, strict=True)]
        orders = [np.argsort(-p, axis=1, kind="stable") for p in products]
        ranked = [np.take_along_axis(p, o, axis=1) for p, o in zip(products, orders, strict=True)]
        return [self._list([r[i].tolist() for r in ranked], [o[i].tolist() for o in orders]) for i in range(len(x))]

    def _list(self, ranked: list[list[float]], order: list[list[int]]) -> list[int]:
        (a, b, c), (p, q, r), size, threshold = ranked, order, self.size, self.threshold
        while True:
            found = []
            for i, x in enumerate(a):
                if x + b[0] + c[0] < threshold:
                    break
                for j, y in enumerate(b):
                    if x + y + c[0] < threshold:
                        break
                    for k, z in enumerate(c):
                        if x + y + z < threshold:
                            break
                        found.append((x + y + z, (p[i] * size + q[j]) * size + r[k]))
            if len(found) >= min(self.least, size**PARTS):
                break
            threshold -= 0.02
        if threshold < self.threshold:
            found = sorted(found, reverse=True)[: self.least]
        return sorted(f for _, f in found)


@lru_cache(8)
def code_for(dim: int, n: int, cosine: float, lists: int, bucket: int, least: int, growth: float | None = None) -> Code:
    return Code(dim, n, cosine, lists, bucket, least, growth=growth)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, without overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def packed(x: np.ndarray) -> bytes:
    """A vector in single precision where that loses nothing, else in double; equal vectors have equal bytes (-0 counts as 0)."""
    x = x + 0.0
    with np.errstate(over="ignore"):
        small = x.astype(np.float32)
    return b"f" + small.tobytes() if (small == x).all() else b"d" + x.tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.float32 if blob[:1] == b"f" else np.float64, offset=1).astype(np.float64)


def length(blob: bytes) -> int:
    return (len(blob) - 1) // (4 if blob[:1] == b"f" else 8)


def linked(x: np.ndarray, a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Boolean matrix of the pairs of unit rows with at least the cosine."""
    return x[a] @ x[b].T >= cosine


def covered(filters: np.ndarray, sizes: np.ndarray, f: int, rows: np.ndarray) -> np.ndarray:
    """Boolean matrix of the pairs of ``rows`` that have a filter below f in common; filters: the lists of all rows, one after another."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.full(len(sizes), -1)
    place[rows] = np.arange(len(rows))
    at = np.flatnonzero((filters < f) & (place[owner] >= 0))
    _, column, n = np.unique(filters[at], return_inverse=True, return_counts=True)
    shared = np.flatnonzero(n > 1)
    out = np.zeros((len(rows), len(rows)), np.float32)
    number = np.full(len(n), -1)
    for first in range(0, len(shared), 4096):
        part = shared[first : first + 4096]
        number[:] = -1
        number[part] = np.arange(len(part))
        own = number[column] >= 0
        has = np.zeros((len(rows), len(part)), np.float32)
        has[place[owner[at[own]]], number[column[own]]] = 1
        out += has @ has.T
    return out > 0


def bucket_links(x: np.ndarray, filters: np.ndarray, sizes: np.ndarray, weight: np.ndarray, left: np.ndarray, right: np.ndarray, f: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(links counted here, label) of each row of a filter's bucket: pairs of a left and another right row.

    filters: the rows' lists one after another; sizes: their lengths. Most buckets hold no link, and are done after one product.
    """
    a, b = np.flatnonzero(left), np.flatnonzero(right)
    same = len(a) == len(b) and bool((a == b).all())
    total, labels = np.zeros(len(x), np.int64), np.arange(len(x))
    found = linked(x, a, b, cosine)
    if same:
        np.fill_diagonal(found, False)
    if not found.any():
        return total, labels
    u, v = np.flatnonzero(found.any(axis=1)), np.flatnonzero(found.any(axis=0))
    rows = np.unique(np.concatenate([a[u], b[v]]))
    before = covered(filters, sizes, f, rows)
    found = found[np.ix_(u, v)]
    a, b = a[u], b[v]
    counted = found & ~before[np.ix_(np.searchsorted(rows, a), np.searchsorted(rows, b))]
    total[a] += counted @ weight[b]
    if not same:
        total[b] += counted.T @ weight[a]
    # A pair that a lower filter has too was joined there.
    return total, local_labels(len(x), ((int(a[i]), b[counted[i]]) for i in np.flatnonzero(counted.any(axis=1)).tolist()))


def report(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, lists: int = LISTS, bucket: int = BUCKET, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """One row a vector row: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and vectors of different
    lengths don't link with each other. Repeated rows are vectors of their own. Null ids never name a component unless all of
    its ids are null; a vector is kept if its id is the component's (both null counts).
    """
    ship(vectors.sparkSession)
    e = F.col("e").cast("array<double>")
    bad = F.coalesce(F.size("e") < 1, F.lit(True)) | F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("e")).withColumn("bad", bad)

    def to_bytes(batches):
        for batch in batches:
            made = [None if b else packed(np.array(x, np.float64)) for x, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["vec_id", "v"])

    keyed = rows.mapInArrow(to_bytes, T.StructType([rows.schema["vec_id"], T.StructField("v", T.BinaryType())]))
    classes = keyed.where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    n = classes.count()
    # A code depends on the length's power of two, so there are few to fit; workers get the results, lest rounding tell them apart.
    size = F.when(F.substring("v", 1, 1) == F.lit(b"f"), F.lit(4)).otherwise(F.lit(8))
    bits = F.greatest(F.lit(2), F.length(F.bin(((F.octet_length("v") - 1) / size).cast("long") - 1)))
    growth = {r.bits: code_for(1 << r.bits, n, cosine, lists, bucket, least).growth for r in classes.select(bits.alias("bits")).distinct().collect()}

    def listed(batches):
        for batch in batches:
            blobs = batch.column(1).to_pylist()
            lengths = np.array([length(x) for x in blobs])
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                for part in np.array_split(at, max(1, len(at) * dim // 1_000_000)):
                    x = unit(np.stack([unpacked(blobs[i]) for i in part]))
                    found = code_for(dim, n, cosine, lists, bucket, least, growth[max(2, (dim - 1).bit_length())]).decode(x)
                    own = pa.array(part)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(2).take(own), batch.column(1).take(own), pa.array([dim] * len(part)), pa.array(found, pa.list_(pa.int32()))], names=["node", "copies", "v", "dim", "filters"])

    coded = stored(classes.select("node", "v", "copies").mapInArrow(listed, "node long, copies long, v binary, dim long, filters array<int>"), "vector-filters")
    sizes = coded.select("dim", F.explode("filters").alias("f")).groupBy("dim", "f").count()
    large = cut(sizes.where(f"count > {block}").select("dim", "f", F.ceil(F.col("count") / block).cast("int").alias("n")))
    members = coded.select("*", F.explode("filters").alias("f"))
    # With a broadcast the members are exchanged once, for the comparison, and not for this too.
    members = members.join(F.broadcast(large) if large.count() <= MOST_BROADCAST else large, ["dim", "f"], "left")
    dealt = members.withColumn("n", F.coalesce("n", F.lit(1))).withColumn("p", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    dealt = dealt.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("lo", F.least("p", "q")).withColumn("hi", F.greatest("p", "q"))
    # Small buckets share a call: a call costs more than such a bucket. Those in parts are of up to two blocks and have their own.
    dealt = dealt.withColumn("g", F.when(F.col("n") == 1, F.pmod(F.xxhash64("f"), F.lit(max(1, n * 32 // (8 * block)))))).select("dim", "g", "f", "lo", "hi", "p", "node", "copies", "v", "filters")

    def per_group(key, table):
        f, lo, hi = (table.column(c).to_numpy() for c in ("f", "lo", "hi"))
        order = np.lexsort((hi, lo, f))
        ends = np.flatnonzero(np.diff(f[order]) | np.diff(lo[order]) | np.diff(hi[order])) + 1
        made = [pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})]
        for at in np.split(order, ends):
            if len(at) < 2:
                continue
            own = table.take(pa.array(np.sort(at)))
            node, p = own.column("node").to_numpy(), own.column("p").to_numpy()
            i = int(at[0])
            x = unit(np.stack([unpacked(v.as_py()) for v in own.column("v")]))
            own_filters = own.column("filters").combine_chunks()
            total, labels = bucket_links(x, own_filters.flatten().to_numpy(), np.diff(own_filters.offsets.to_numpy()), own.column("copies").to_numpy(), p == lo[i], p == hi[i], int(f[i]), cosine)
            hit = np.flatnonzero((total > 0) | (labels != np.arange(len(labels))))
            made.append(pa.table({"a": node[hit], "b": node[labels[hit]], "n": total[hit]}))
        return pa.concat_tables(made)

    # Groups of small buckets are not by filter alone, so a group's key has no filter but where a bucket is in parts.
    alone = F.when(F.col("g").isNull(), F.col("f")), F.when(F.col("g").isNull(), F.col("lo")), F.when(F.col("g").isNull(), F.col("hi"))
    keyed_dealt = dealt.withColumns({"k1": alone[0], "k2": alone[1], "k3": alone[2]})
    found = stored(keyed_dealt.groupBy("dim", "g", "k1", "k2", "k3").applyInArrow(per_group, "a long, b long, n long"), "vector-links")
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = components(found.select("a", "b"))
    nodes = classes.join(counts, "node", "left").join(roots, "node", "left").select("v", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("root"))
    smallest = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(smallest, "root").select("v", "n_links", F.col("component_id").alias("c"))
    out = keyed.join(nodes, "v", "left")
    component = F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("c"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
