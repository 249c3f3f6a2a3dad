"""Training of shared dictionaries: text to refer to, and frequency tables with and without context.

Counting runs on the cluster. The greedy choice of priming text runs on the driver over the first candidates of each group of alike ones, and the
cluster gives more of a group where the choice among all needs them (``Pool``). The result has at most 4,096 priming tokens and 65 tables, so it goes to tasks inside the function that uses it.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexpack.functions import lz
from lexpack.functions.ans import Table
from lexpack.functions.stream import SUPPORT, cap
from lexpack.functions.vocabulary import Vocabulary, _plain
from lexpack.operators import tables, tokens
from lexpack.session import cut, ship, stored

PRIMING = 4096
CONTEXTS = 64
SEGMENT, DMER, DISCOUNT = 256, 8, 0.3
#: Candidates of a group that are stored in order at a time, and the most groups.
POOL, MOST_POOL = 256, 1024
#: Candidates of each group that the driver begins with; and the numbers of hot features that are tried for groups.
FEW, HOT = 16, (4, 16, 64, 256)
#: Scores are equal to so much whatever the order of their sums.
NEAR = 1e-6
#: D-mers of a block of rows and of a range of hashes.
BLOCK, BUCKET = 1 << 20, 1 << 21
#: Hashes of texts whose texts are counted.
AHEAD = 100_000
PICKERS = ("concat", "coverage", "diverse", "cover")


@dataclass
class Dictionary:
    """Priming tokens, the order-0 table and tables by previous symbol; ``escape`` is a symbol beyond the alphabet."""

    priming: list[int]
    order0: Table
    contexts: dict[int, Table]
    escape: int
    vocabulary: bytes
    fingerprint: bytes = field(default=b"")

    def __post_init__(self):
        h = hashlib.blake2b(self.vocabulary, digest_size=8)
        h.update(repr((self.priming, self.escape, self.order0.symbols, self.order0.freqs)).encode())
        for c in sorted(self.contexts):
            h.update(repr((c, self.contexts[c].symbols, self.contexts[c].freqs)).encode())
        self.fingerprint = h.digest()

    @cached_property
    def history(self) -> lz.History:
        return lz.History(self.priming)

    def __getstate__(self):
        return (self.priming, (self.order0.symbols, self.order0.freqs), {c: (t.symbols, t.freqs) for c, t in self.contexts.items()}, self.escape, self.vocabulary)

    def __setstate__(self, s):
        self.__init__(s[0], Table(*s[1]), {c: Table(*t) for c, t in s[2].items()}, s[3], s[4])

    def info(self) -> dict:
        return {"id": self.fingerprint.hex(), "alphabet": self.escape, "priming": len(self.priming), "order0_symbols": len(self.order0.symbols), "context_tables": len(self.contexts)}

    def save(self, spark: SparkSession, path: str) -> None:
        """One Parquet table (part, context, symbol, freq): priming tokens in order, tables, and the fingerprints."""
        rows = [("priming", i, t, 0) for i, t in enumerate(self.priming)]
        rows += [("order0", -1, s, f) for s, f in zip(self.order0.symbols, self.order0.freqs, strict=True)]
        rows += [("context", c, s, f) for c, t in self.contexts.items() for s, f in zip(t.symbols, t.freqs, strict=True)]
        meta = [(f"vocabulary:{self.vocabulary.hex()}", 0, self.escape, 0), (f"fingerprint:{self.fingerprint.hex()}", 0, 0, 0)]
        spark.createDataFrame(rows + meta, "part string, context int, symbol int, freq int").coalesce(1).write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Dictionary:
        """The dictionary of a saved table; a table whose content doesn't give its fingerprint is refused."""
        rows = spark.read.parquet(path).collect()  # 4,096 + 65 * 65,536 rows at most
        part = lambda p: sorted((r.context, r.symbol, r.freq) for r in rows if r.part == p)
        meta = dict(r.part.split(":") for r in rows if ":" in r.part)
        if set(meta) != {"vocabulary", "fingerprint"}:
            raise ValueError(f"{path} holds no dictionary")
        contexts: dict[int, tuple[list, list]] = {}
        for c, s, f in part("context"):
            contexts.setdefault(c, ([], []))
            contexts[c][0].append(s)
            contexts[c][1].append(f)
        order0 = part("order0")
        escape = next(r.symbol for r in rows if r.part.startswith("vocabulary:"))
        out = cls([s for _, s, _ in part("priming")], Table([s for _, s, _ in order0], [f for _, _, f in order0]), {c: Table(*t) for c, t in contexts.items()}, escape, bytes.fromhex(meta["vocabulary"]))
        if out.fingerprint.hex() != meta["fingerprint"]:
            raise ValueError(f"{path} is damaged")
        return out


def doc_frequency(rows: DataFrame, key: str = "id", ids: str = "tokens") -> DataFrame:
    """(token, df): in how many rows a token occurs."""
    return rows.select(F.explode(F.array_distinct(ids)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def coverage(rows: DataFrame, key: str = "id", ids: str = "tokens") -> DataFrame:
    """(key, score): the sum of ln(1 + df) over a row's distinct tokens, rounded so that order doesn't depend on summation."""
    each = rows.select(key, F.explode(F.array_distinct(ids)).alias("token"))
    return each.join(doc_frequency(rows, key, ids), "token").groupBy(key).agg(F.round(F.sum(F.log1p("df")), 6).alias("score"))


def dmers(rows: DataFrame, keep: list[str], ids: str = "tokens", d: int = DMER) -> DataFrame:
    """(keep, pos, dmer): all runs of d tokens."""
    at = F.when(F.size(ids) >= d, F.sequence(F.lit(1), F.size(ids) - (d - 1))).otherwise(F.array().cast("array<int>"))
    return rows.select(*keep, ids, F.explode(at).alias("pos")).select(*keep, (F.col("pos") - 1).alias("pos"), F.slice(ids, F.col("pos"), d).alias("dmer"))


def most_frequent(each: DataFrame, text: str, k: int, ahead: int = AHEAD) -> DataFrame:
    """(text, n): the k most frequent texts, lower ones first among equals.

    Hashes are counted first, and texts only where their hash is among the ``ahead`` most frequent: a text is no more frequent than its hash. Where
    a text beyond those could be among the k (many are equal, say), all texts are counted.
    """
    hashed = each.groupBy(F.xxhash64(text).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    heavy = cut(hashed.orderBy(F.col("n").desc()).limit(ahead))
    seen = heavy.agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("least")).first()
    count = lambda df: df.groupBy(text).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), text).limit(k)
    if seen.rows < ahead:
        return count(each)
    found = cut(count(each.join(F.broadcast(heavy.select("h")), F.xxhash64(text) == F.col("h"), "left_semi")))
    own = found.agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("least")).first()
    return found if own.rows == k and own.least > seen.least else count(each)


def segments(rows: DataFrame, keep: list[str], ids: str = "tokens", length: int = SEGMENT) -> DataFrame:
    """(keep, start, tokens): half-overlapping windows; the last is clipped, and the first that touches the end is the last."""
    step = max(1, length // 2)
    n = F.size(ids)
    count = F.when(n <= length, 1).otherwise(F.ceil((n - length) / step) + 1).cast("int")
    starts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: i * step)
    return rows.where(n > 0).select(*keep, ids, F.explode(starts).alias("start")).select(*keep, "start", F.slice(ids, F.col("start") + 1, length).alias("tokens"))


def segment_scores(rows: DataFrame, key: str = "id", ids: str = "tokens", length: int = SEGMENT, d: int = DMER, block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """(key, start, score): the sum of ln(1 + frequency) over a segment's d-mers.

    A task takes blocks of rows of some ``block`` d-mers and sends each distinct one as 80 bits of hashes with its count in the block, in order and
    by ranges of hashes, so that a range holds some ``bucket`` of them. A range's task sums the counts and answers each block, which meets a second
    reading of its rows that says which of its d-mers is where. What travels is arrays, neither a row a d-mer nor sorted by Spark. Both readings
    must cut the same blocks, so rows that come out of an exchange are stored first.
    """
    rows = rows.where(F.size(ids) >= d).select(key, ids)
    if "Exchange" in rows._jdf.queryExecution().executedPlan().toString():
        rows = stored(rows, "segments")
    total = rows.agg(F.sum(F.size(ids) - (d - 1))).first()[0] or 0
    n = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(total / bucket))
    keys = T.ArrayType(rows.schema[key].dataType)
    sent = T.StructType([T.StructField("to", T.IntegerType()), T.StructField("block", T.StringType()), T.StructField("first", T.LongType()), T.StructField("blob", T.BinaryType()), T.StructField("keys", keys), T.StructField("sizes", T.ArrayType(T.IntegerType()))])
    step = max(1, length // 2)
    scores = T.StructType([rows.schema[key], T.StructField("start", T.IntegerType()), T.StructField("score", T.DoubleType())])
    hashed = rows.select(key, F.transform(ids, lambda t: F.xxhash64(t)).alias("h"), F.spark_partition_id().alias("task"))
    asked, own = (hashed.mapInArrow(lambda batches, own=own: _asked(batches, d, block, n, own), sent) for own in (False, True))
    told = asked.repartition(n, "to").mapInArrow(_told, sent).union(own).repartition(n, "block")
    found = told.mapInArrow(lambda batches: _scores(batches, length, step, d), scores)
    return found.groupBy(key, "start").agg(F.round(F.sum("score"), 6).alias("score"))


def _planes(x: np.ndarray) -> bytes:
    """The bytes of numbers, all first ones first: what is alike in them is then side by side for the exchange's compression."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unplaned(blob: bytes, at: int, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(blob, np.uint8, n * size, at).reshape(size, n).T.copy().view(kind).ravel()


def _mixed(h: np.ndarray, d: int, seed: int) -> np.ndarray:
    """A 64-bit hash of every d neighbours."""
    odd, x = np.random.default_rng(seed).integers(0, 1 << 63, d, dtype=np.uint64) * np.uint64(2) + np.uint64(1), np.zeros(len(h) - d + 1, np.uint64)
    for j in range(d):
        x += h[j : len(h) - d + 1 + j] * odd[j]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def _alike(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of pairs, and where in it each distinct one begins."""
    o = np.argsort(a)
    same = a[o[1:]] == a[o[:-1]]
    other = b[o[1:]] != b[o[:-1]]
    if (same & other).any():
        o = np.lexsort((b, a))
        same, other = a[o[1:]] == a[o[:-1]], b[o[1:]] != b[o[:-1]]
    return o, np.flatnonzero(np.concatenate(([True] if len(a) else [], ~same | other)))


def _rows(sent: list[tuple], keys: pa.Array | None, kind: pa.DataType) -> pa.RecordBatch:
    """Rows (to, block, first, blob, sizes) of d-mers or frequencies, or with ``keys`` a block's only one."""
    to, block, first, blob, sizes = zip(*sent, strict=True)
    held = pa.nulls(len(sent), pa.list_(kind)) if keys is None else pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(block, pa.string()), pa.array(first, pa.int64()), pa.array(blob, pa.binary()), held, pa.array(sizes, pa.list_(pa.int32()))], ["to", "block", "first", "blob", "keys", "sizes"])


def _asked(batches, d: int, block: int, n: int, places: bool):
    """Of each block its distinct d-mers by range, or (``places``) a row of its keys, sizes and places."""
    task, made = 0, 0
    keys, hashes, sizes, many = [], [], [], 0

    def whole():
        own, h, size = pa.concat_arrays(keys), np.concatenate(hashes), np.concatenate(sizes)
        m = size - (d - 1)
        begin, at = np.cumsum(size) - size, np.cumsum(m) - m
        begins = np.arange(m.sum()) + np.repeat(begin - at, m)
        a, b = _mixed(h, d, 1)[begins], _mixed(h, d, 2)[begins].astype(np.uint16)
        o, first = _alike(a, b)
        rank = np.zeros(len(o), np.int32)
        rank[first] = 1
        place = np.empty(len(o), np.int32)
        place[o] = np.cumsum(rank, dtype=np.int32) - 1
        a, b, counts = a[o[first]], b[o[first]], np.diff(np.append(first, len(o)))
        # A block made of other rows has another name: if rows come in another order when they are read again, answers don't fit and the job fails.
        name = f"{task}-{made}-{zlib.crc32(a.tobytes()):08x}-{zlib.crc32(place.tobytes()):08x}"
        if places:
            yield _rows([(0, name, -len(a), _planes(place), size.tolist())], own, own.type)
            return
        to = ((a >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(to)) + 1, [len(to)]))
        yield _rows([(int(to[i]), name, int(i), _planes(np.diff(a[i:j], prepend=np.uint64(0))) + _planes(b[i:j]) + _planes(counts[i:j]), None) for i, j in zip(cuts[:-1], cuts[1:], strict=True)], None, own.type)

    for batch in batches:
        if not batch.num_rows:
            continue
        task, lists = batch.column(2)[0].as_py(), batch.column(1)
        values, size = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.diff(lists.offsets.to_numpy()).astype(np.int64)
        ends, i = np.cumsum(size), 0
        held = np.cumsum(size - (d - 1))
        while i < len(size):
            # Up to the row that fills the block.
            j = min(len(size), int(np.searchsorted(held, (held[i - 1] if i else 0) + block - many)) + 1)
            keys.append(batch.column(0).slice(i, j - i))
            hashes.append(values[ends[i] - size[i] : ends[j - 1]])
            sizes.append(size[i:j])
            many += int(held[j - 1] - (held[i - 1] if i else 0))
            i = j
            if many >= block:
                yield from whole()
                keys, hashes, sizes, many, made = [], [], [], 0, made + 1
    if keys:
        yield from whole()


def _told(batches):
    """To each block the frequencies of its d-mers, range by range."""
    kind, ranges = None, {}
    for batch in batches:
        kind = batch.schema.field("keys").type.value_type
        for to, block, first, blob in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            ranges.setdefault(to, []).append((block, first, blob))
    while ranges:
        _, asked = ranges.popitem()
        many = [len(x) // 18 for _, _, x in asked]
        a, b, counts = ([_unplaned(x, at * m, m, t) for (_, _, x), m in zip(asked, many, strict=True)] for at, t in ((0, np.uint64), (8, np.uint16), (10, np.int64)))
        a, b, counts = np.concatenate([np.cumsum(x, dtype=np.uint64) for x in a]), np.concatenate(b), np.concatenate(counts)
        o, first = _alike(a, b)
        n = np.empty(len(o), np.int64)
        n[o] = np.repeat(np.add.reduceat(counts[o], first), np.diff(np.append(first, len(o))))
        ends = np.cumsum(many)
        yield _rows([(0, block, at, _planes(n[e - m : e]), None) for (block, at, _), m, e in zip(asked, many, ends, strict=True)], None, kind)


def _scores(batches, length: int, step: int, d: int):
    """The scores of the segments of each block's rows, once all its frequencies are there."""
    own, told, have = {}, {}, {}
    for batch in batches:
        for i in range(batch.num_rows):
            _, block, first, blob = (batch.column(k)[i].as_py() for k in range(4))
            if first < 0:
                own[block] = (-first, blob, batch.column(4)[i].values, batch.column(5)[i].values.to_numpy().astype(np.int64))
            else:
                told.setdefault(block, []).append((first, blob))
                have[block] = have.get(block, 0) + len(blob) // 8
            if block not in own or have.get(block, 0) != own[block][0]:
                continue
            distinct, places, keys, size = own.pop(block)
            n = np.zeros(distinct, np.int64)
            for at, x in told.pop(block):
                n[at : at + len(x) // 8] = _unplaned(x, 0, len(x) // 8, np.int64)
            m = size - (d - 1)
            w = np.append(np.log1p(n)[_unplaned(places, 0, len(places) // 4, np.int32)], 0.0)
            c = np.where(size <= length, 1, -(-(size - length) // step) + 1)
            row = np.repeat(np.arange(len(size)), c)
            k = np.arange(len(row)) - np.repeat(np.cumsum(c) - c, c)
            # A d-mer that a segment's end cuts is in the next segment whole.
            low, high = k * step, np.minimum(k * step + length, size[row]) - d
            keep = high >= low
            row, k, low, high = row[keep], k[keep], low[keep], high[keep]
            if not len(row):
                continue
            at = (np.cumsum(m) - m)[row]
            sums = np.add.reduceat(w, np.stack((at + low, at + high + 1), 1).ravel())[::2]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(row)), pa.array((k * step).astype(np.int32)), pa.array(sums)], ["key", "start", "score"])
    if own or told:
        raise RuntimeError("frequencies of a block are missing: its rows came in another order when they were read again")


def _take(picked: list[list[int]], most: int) -> list[int]:
    return [t for x in picked for t in x][:most]


def scored(weights: list) -> float:
    """The sum of ln(1 + weight) over a candidate's features in their order, each occurrence counted."""
    return round(sum(math.log1p(w) for w in weights), 9)


class Pool:
    """Candidates of groups whose order within a group is known, and the choice among all of them with few of them at hand.

    A group's candidates hold the same hot features, as often. Its next candidate was scored at first and has lost at least what the hot features have
    lost since, so that is a bound for all that follow; and while a candidate at hand has lost no more than that, none that follows it comes before it.
    """

    def __init__(self, features, fade, copies: bool):
        self.features, self.fade, self.copies = features, fade, copies
        self.weights: dict = {}
        self.users: dict = {}
        self.rows: list = []
        self.scores: list[float] = []
        self.left: list[int] = []
        self.live: set[int] = set()
        self.waiting: dict[str, list] = {}
        self.last: dict[str, tuple] = {}
        self.more: dict[str, bool] = {}
        self.hot: dict[str, dict] = {}
        self.lost: dict[str, float] = {}
        self.head: dict[str, int] = {}

    def receive(self, group: str, rows: list, more: bool, hot: set) -> None:
        """The next candidates of a group, in order, and whether it has others after them."""
        if group not in self.hot and rows:
            own: dict = {}
            for f, w in zip(self.features(list(rows[0].tokens)), rows[0].w, strict=True):
                if f in hot:
                    own[f] = (own.get(f, (0, w))[0] + 1, w)
            self.hot[group] = own
            self._lose(group)
        self.waiting.setdefault(group, [])[:0] = reversed(rows)
        self.more[group] = more
        if rows:
            self.last[group] = (rows[-1].score, tuple(rows[-1]["first"]))

    def _lose(self, group: str) -> None:
        self.lost[group] = sum(k * (math.log1p(w) - math.log1p(self.weights.get(f, w))) for f, (k, w) in self.hot[group].items())

    def _score(self, i: int) -> float:
        r, get = self.rows[i], self.weights.get
        return scored([get(f, w) for f, w in zip(self.features(list(r.tokens)), r.w, strict=True)])

    def _take(self, group: str) -> None:
        r = self.waiting[group].pop()
        i = len(self.rows)
        self.rows.append(r)
        self.left.append(r.copies if self.copies else 1)
        self.scores.append(self._score(i))
        self.live.add(i)
        self.head[group] = i
        for f in set(self.features(list(r.tokens))):
            self.users.setdefault(f, []).append(i)

    def _key(self, i: int) -> tuple:
        return (-self.scores[i], tuple(self.rows[i]["first"]))

    def best(self) -> tuple[int | None, list[str]]:
        """The next choice, None if no candidate adds anything; or the groups whose next candidates must be fetched first."""
        best = min(self.live, key=self._key, default=None)
        wanted = []
        for group in list(self.last):
            while True:
                waiting = self.waiting[group]
                if not waiting and not self.more[group]:
                    break
                start = waiting[-1].score if waiting else self.last[group][0]
                # Weights are whole numbers, so what adds anything adds ln 2.
                if start - self.lost[group] + NEAR < max(0.5, 0.5 if best is None else self.scores[best]):
                    break
                u = self.head.get(group)
                if u in self.live and self.scores[u] >= self.rows[u].score - self.lost[group] - NEAR and waiting and not self.rows[u].score - NEAR < start < self.rows[u].score:
                    break
                if not waiting:
                    wanted.append(group)
                    break
                self._take(group)
                if best is None or self._key(self.head[group]) < self._key(best):
                    best = self.head[group]
        if best is not None and self.scores[best] <= 0:
            best = None
        return best, wanted

    def choose(self, i: int) -> list[int]:
        """Tokens of a candidate, chosen: the weight of every occurrence of its features fades."""
        r = self.rows[i]
        own = self.features(list(r.tokens))
        self.left[i] -= 1
        if not self.left[i]:
            self.live.discard(i)
        for f, w in zip(own, r.w, strict=True):
            self.weights.setdefault(f, w)
        for f in own:
            self.weights[f] = self.fade(self.weights[f])
        for k in {k for f in set(own) for k in self.users[f] if k in self.live}:
            self.scores[k] = self._score(k)
        for group, hot in self.hot.items():
            if any(f in hot for f in own):
                self._lose(group)
        return list(r.tokens)


def _choose(candidates: DataFrame, features, most: int, fade, copies: bool, hot: list) -> list[int]:
    """Tokens of the greedy choice among distinct candidates (tokens, first, copies, w); ``features`` of a token list, whose weights ``w`` has in order.

    Every candidate is scored once, where it lies, and grouped by which of the ``hot`` features it holds how often: by as many of them, from the most
    frequent on, as make up to MOST_POOL groups. The driver gets the first few of each group, and more of those that a choice needs.
    """
    spark = candidates.sparkSession
    kinds = [k for k in HOT if k < len(hot)] + [len(hot)] if len(hot) < HOT[-1] else list(HOT)
    place = spark.sparkContext.broadcast({f: i for i, f in enumerate(hot)})

    @F.pandas_udf("score double, " + ", ".join(f"g{k} string" for k in kinds))
    def measured(tokens: pd.Series, w: pd.Series) -> pd.DataFrame:
        at, out = place.value, []
        for t, x in zip(tokens, w, strict=True):
            held = sorted(at[f] for f in features(t.tolist()) if f in at)
            out.append((scored(x.tolist()), *(hashlib.blake2b(repr([i for i in held if i < k]).encode(), digest_size=16).hexdigest() for k in kinds)))
        return pd.DataFrame(out, columns=["score", *(f"g{k}" for k in kinds)])

    every = stored(candidates.withColumn("m", measured("tokens", "w")).select("tokens", "first", "copies", "w", "m.*").where("score > 0"), "candidates")
    k = next((k for k in reversed(kinds) if every.select(f"g{k}").distinct().limit(MOST_POOL + 1).count() <= MOST_POOL), 0)
    every = every.withColumn("g", F.col(f"g{k}") if k else F.lit(""))
    columns = ["g", "tokens", "first", "copies", "w", "score"]
    order = Window.partitionBy("g").orderBy(F.col("score").desc(), "first")
    rank = lambda df, n: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)

    heads, pool, known = stored(rank(every.select(*columns), POOL), "heads"), Pool(features, fade, copies), set(hot[:k])
    at: dict[str, int] = {}
    chosen: list[int] = []

    def fetch(wanted: dict[str, int]) -> None:
        """The next candidates of groups: up to so many each, of those that are stored in order; where these are at an end, the next ones are put in order."""
        nonlocal heads
        if over := {g: at[g] for g in wanted if at[g] and at[g] % POOL == 0}:
            base, here = F.create_map(*(F.lit(x) for pair in over.items() for x in pair)), F.col("g").isin(list(over))
            kinds = every.schema["first"].dataType
            ends = F.create_map(*(x for g in over for s, first in [pool.last[g]] for x in (F.lit(g), F.struct(F.lit(s).alias("s"), F.struct(*(F.lit(x).cast(t.dataType).alias(t.name) for x, t in zip(first, kinds, strict=True))).alias("first")))))
            end = ends[F.col("g")]
            after = every.select(*columns).where(here).where((F.col("score") < end["s"]) | (F.col("score") == end["s"]) & (F.col("first") > end["first"]))
            heads = heads.where(~here).unionByName(stored(rank(after, POOL).withColumn("rank", F.col("rank") + base[F.col("g")]), "heads"))
        upto = {g: min(at[g] + n, at[g] - at[g] % POOL + POOL) for g, n in wanted.items()}
        low, high = (F.create_map(*(F.lit(x) for pair in m.items() for x in pair))[F.col("g")] for m in ({g: at[g] for g in wanted}, upto))
        found: dict[str, list] = {g: [] for g in wanted}
        for r in heads.where(F.col("g").isin(list(wanted))).where((F.col("rank") > low) & (F.col("rank") <= high)).collect():
            found[r.g].append(r)
        for g, rows in found.items():
            at[g] += len(rows)
            rows.sort(key=lambda r: r.rank)
            pool.receive(g, rows, at[g] == upto[g], known)

    # Every group of the heads, at most MOST_POOL.
    at |= {r.g: 0 for r in heads.where("rank = 1").select("g").collect()}
    step = dict.fromkeys(at, FEW)
    if at:
        fetch(step)
    while len(chosen) < most:
        best, wanted = pool.best()
        if wanted:
            step |= {g: min(FEW * step[g], POOL) for g in wanted}
            # Groups that run low come along.
            fetch({g: step[g] for g in at if g in wanted or pool.more[g] and len(pool.waiting[g]) < FEW // 2})
        elif best is None:
            break
        else:
            chosen += pool.choose(best)
    return chosen[:most]


def priming(rows: DataFrame, picker: str, most: int = PRIMING, length: int = SEGMENT, d: int = DMER, discount: float = DISCOUNT) -> list[int]:
    """Priming tokens from rows (id, tokens).

    ``concat``: the first tokens in id order. ``coverage``: whole rows, best score first, higher ids first among equals.
    ``diverse``: rows by what they add, scored anew after each pick; the first of equals. ``cover``: segments by the frequency of
    their d-mers, which counts less (times ``discount``, rounded down, once for every occurrence) after a pick; equal segments
    may be taken as often as they occur, in the place of the first.
    """
    if picker not in PICKERS:
        raise ValueError(f"unknown picker {picker}; there are {', '.join(PICKERS)}")
    if picker == "concat":
        before = F.sum(F.size("tokens")).over(Window.orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
        first = rows.where(F.size("tokens") > 0).orderBy("id").limit(most)
        found = first.withColumn("b", F.coalesce(before, F.lit(0))).where(F.col("b") < most).orderBy("id").select(F.slice("tokens", 1, most).alias("tokens")).collect()
        return _take([r.tokens for r in found], most)
    if picker == "coverage":
        best = rows.join(coverage(rows), "id").orderBy(F.col("score").desc(), F.col("id").desc()).limit(most).select(F.slice("tokens", 1, most).alias("tokens")).collect()
        return _take([r.tokens for r in best], most)
    if picker == "diverse":
        distinct = rows.where(F.size("tokens") > 0).groupBy("tokens").agg(F.struct(F.min("id").alias("id")).alias("first"), F.count(F.lit(1)).alias("copies"))
        df = cut(doc_frequency(rows).withColumnRenamed("df", "n"))
        found = _weighed(distinct, F.posexplode(F.array_distinct("tokens")), df, "token")
        return _choose(found, lambda t: list(dict.fromkeys(t)), most, lambda w: 0, copies=False, hot=_hottest(df, "token"))
    freq = cut(dmers(rows, [], "tokens", d).groupBy("dmer").agg(F.count(F.lit(1)).alias("n")))
    parts = segments(rows, ["id"], "tokens", length).groupBy("tokens").agg(F.min(F.struct("id", "start")).alias("first"), F.count(F.lit(1)).alias("copies"))
    at = F.when(F.size("tokens") >= d, F.sequence(F.lit(1), F.size("tokens") - (d - 1))).otherwise(F.array().cast("array<int>"))
    found = _weighed(parts, F.posexplode(F.transform(at, lambda i: F.slice("tokens", i, d))), freq, "dmer")
    return _choose(found, lambda t: [tuple(t[i : i + d]) for i in range(len(t) - d + 1)], most, lambda w: int(w * discount), copies=True, hot=[tuple(x) for x in _hottest(freq, "dmer")])


def _hottest(weights: DataFrame, feature: str) -> list:
    return [r[0] for r in weights.orderBy(F.col("n").desc(), feature).limit(HOT[-1]).collect()]


def _weighed(parts: DataFrame, each, weights: DataFrame, feature: str) -> DataFrame:
    """Candidates that have features (by ``each``: place, feature), with the weights ``n`` of them in order as ``w``; lineage cut."""
    parts = cut(parts)
    found = parts.select("first", each.alias("pos", feature)).join(weights, feature).groupBy("first").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "n"))), lambda x: x["n"]).alias("w"))
    return cut(parts.join(found, "first"))


def train(samples: DataFrame, data: str = "data", order: str = "id", vocabulary: Vocabulary | None = None, picker: str = "cover", max_priming: int = PRIMING, use_priming: bool = True, use_contexts: bool = True, segment: int = SEGMENT, dmer: int = DMER, discount: float = DISCOUNT) -> Dictionary:
    """A dictionary of the sample records; ``order`` is a unique id that gives their order.

    Records are tokenised once. Null records are left out. Symbols are those of the primed match search, counted by the cluster; the
    driver gets the 65,535 most frequent symbols and the tables of the CONTEXTS best contexts with SUPPORT transitions (equal
    ones by id).
    """
    spark = ship(samples.sparkSession)
    v = vocabulary or _plain()
    ids = tokens.encode(v)(F.col(data)) if vocabulary is not None and not vocabulary.plain else tokens.byte_ids(F.col(data))
    rows = cut(samples.where(F.col(data).isNotNull()).select(F.col(order).alias("id"), ids.alias("tokens")))
    prime = priming(rows, picker, max_priming, segment, dmer, discount) if use_priming else []
    shared, flag = spark.sparkContext.broadcast(prime), v.flag

    @F.pandas_udf("array<int>")
    def symbols(x: pd.Series) -> pd.Series:
        history = lz.History(shared.value)
        return x.map(lambda t: lz.flat(lz.parse(t.tolist(), history), flag))

    flat = cut(rows.select(symbols("tokens").alias("s")))
    escape = flag + 1
    counts = flat.select(F.explode("s").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    best = counts.orderBy(F.col("n").desc(), "s").limit(cap()).collect()
    total = sum(r.n for r in best)
    share = max(1, round(total * 0.015))
    one = sorted((r.s, r.n) for r in best)
    order0 = Table.of([*(s for s, _ in one), escape], [*(n for _, n in one), share])
    contexts: dict[int, Table] = {}
    if use_contexts:
        from lexpack.operators.profile import bigrams

        found: dict[int, list[tuple[int, int]]] = {}
        pairs = tables.contexts(bigrams(flat, [], F.col("s")), SUPPORT, CONTEXTS)
        for r in tables.top(pairs, ["a"], "b", "n", cap()).select("a", "b", "n").collect():
            found.setdefault(r.a, []).append((r.b, r.n))
        for c, next_ones in sorted(found.items()):
            next_ones.sort()
            contexts[c] = Table.of([*(s for s, _ in next_ones), escape], [*(n for _, n in next_ones), len(next_ones)])
    return Dictionary(prime, order0, contexts, escape, v.fingerprint)
