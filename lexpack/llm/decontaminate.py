"""Benchmark decontamination by winnowing.

Every word k-gram of the benchmark's windows is hashed and the smallest hash of each run of consecutive k-grams becomes a
fingerprint. Documents are fingerprinted by the same rule, the two sides meet on equal fingerprints, and each hit is
extended to the full windows around it, which are compared word for word. A shared span of ``window`` words always holds a
common fingerprint: it has ``window - k + 1`` k-grams, and both sides choose the same smallest one.

Plan: the benchmark's index is broadcast in blocks of at most ``block_bytes`` of text (the size is checked by an
aggregate first); documents are scanned without a shuffle, and spans found by earlier blocks are carried along in the row.
A usual benchmark is one block. Up to TOGETHER blocks share a scan; only between such runs is the table checkpointed.
Words are hashed in bulk, and an index is sorted arrays beside the bytes of its items, so it has a few times their size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexpack.session import cut, ship
from lexpack.llm.text import PIECE_BYTES, WORDS, encoded, extended, pieces

WINDOW = 10
K = 5
BLOCK_BYTES = 16 << 20
TOGETHER = 4
_M = np.uint64(0x9E3779B97F4A7C15)
_STEP = 1 << 20

SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("spans", SPAN), T.StructField("item_ids", T.ArrayType(T.StringType()))]


def gram_hashes(x: np.ndarray, k: int, starts: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of the k-grams of word hashes: of all, or of those that begin at ``starts``."""
    n = max(0, len(x) - k + 1) if starts is None else len(starts)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD1342543DE82EF95) + (x[j : j + n] if starts is None else x[starts + j]).astype(np.uint64) * _M
    out ^= out >> np.uint64(32)
    return out * _M


def winnowed(hashes: np.ndarray, starts: np.ndarray, w: int) -> np.ndarray:
    """For the windows of w k-grams that begin at ``starts``: the positions of the smallest hash, the rightmost of equal ones."""
    return np.unique(_minima(hashes, starts, w)) if len(starts) else starts


def _minima(hashes: np.ndarray, starts: np.ndarray, w: int) -> np.ndarray:
    out = np.empty_like(starts)
    for a in range(0, len(starts), _STEP >> 2):
        part = starts[a : a + (_STEP >> 2)]
        each = hashes[part[:, None] + np.arange(w - 1, -1, -1)[None, :]]
        out[a : a + len(part)] = part + (w - 1) - np.argmin(each, axis=1)
    return out


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2^64, as far as the longest text asked for."""

    base, inverse = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)]), dtype=np.uint64) for x in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


@dataclass
class Words:
    """Texts as one run of bytes, a blank after each word; where words begin (and, last, where all end), their hashes, and the first word of each text (and, last, their number)."""

    raw: bytes
    at: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @staticmethod
    def of(texts: list[bytes | None]) -> Words:
        powers, parts, at, hashes, first = _Powers(), [], [], [], [0]
        for text in texts:
            n = 0
            # Small texts are one piece; a piece is hashed whole.
            for piece in pieces((text or b"").translate(WORDS), PIECE_BYTES):
                words = piece.split()
                if words:
                    parts.append(b" ".join(words) + b" ")
                    n += len(words)
            first.append(first[-1] + n)
        raw = b"".join(parts)
        del parts
        bytes_, begin = np.frombuffer(raw, np.uint8), 0
        while begin < len(raw):
            # A step ends behind a word, so a long word makes a long step.
            end = len(raw) if len(raw) - begin <= _STEP else raw.find(b" ", begin + _STEP) + 1
            part = bytes_[begin:end]
            up, down = powers.upto(len(part) + 1)
            ends = np.flatnonzero(part == 32)
            starts = np.concatenate([np.zeros(1, np.int64), ends[:-1] + 1])
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])
            x = (total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)
            x = (x ^ (x >> np.uint64(31))) * _M
            hashes.append(x ^ (x >> np.uint64(29)))
            at.append(starts + begin)
            begin = end
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        return Words(raw, np.append(join(at, np.int64), len(raw)), join(hashes, np.uint64), np.array(first))

    def span(self, start: int, n: int) -> bytes:
        """The bytes of n words, their blanks included."""
        return self.raw[self.at[start] : self.at[start + n]]


@dataclass
class Size:
    """The distinct windows of one size: fingerprints and a bit for each of their leading parts; hashes of windows in order, the words they begin at, and the items of window i, ``items[owns[i]:owns[i + 1]]``."""

    prints: np.ndarray
    bits: np.ndarray
    hashes: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    owns: np.ndarray
    items: np.ndarray


@dataclass
class Index:
    """Benchmark windows of every size, and the bytes of the items, against which a hit is compared. No object is kept for a word or a window."""

    window: int
    k: int
    raw: bytes
    sizes: dict[int, Size]
    items: list[str | None]


def _leading(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The places of hashes in a table of bits, whose length is a power of two."""
    return (hashes >> np.uint64(65 - len(bits).bit_length())).astype(np.int64)


def _sized(words: Words, starts: np.ndarray, owner: np.ndarray, n: int, k: int) -> Size:
    h = gram_hashes(words.hashes, k)
    prints = np.unique(h[winnowed(h, starts, n - k + 1)])
    bits = np.zeros(1 << (8 * len(prints)).bit_length(), bool)
    bits[_leading(prints, bits)] = True
    full = gram_hashes(words.hashes, n, starts)
    order = np.lexsort((starts, full))
    full, starts, owner = full[order], starts[order], owner[order]
    # Equal windows lie together, and differing ones of one hash, should there be any, are told apart by their bytes.
    new = np.append(True, full[1:] != full[:-1])
    group = np.cumsum(new) - 1
    edges = np.append(np.flatnonzero(new), len(full))
    number = edges[:-1][group].astype(np.int64)
    for g in np.flatnonzero(np.diff(edges) > 1).tolist():
        texts: dict[bytes, int] = {}
        for i in range(edges[g], edges[g + 1]):
            number[i] = texts.setdefault(words.span(int(starts[i]), n), i)
    order = np.lexsort((owner, number))
    number, owner = number[order], owner[order]
    keep = np.append(True, (number[1:] != number[:-1]) | (owner[1:] != owner[:-1]))
    number, owner = number[keep], owner[keep]
    distinct, owns = np.unique(number, return_index=True)
    begin = starts[distinct]
    return Size(prints, bits, full[distinct], words.at[begin].astype(np.int32), words.at[begin + n].astype(np.int32), np.append(owns, len(owner)).astype(np.int32), owner.astype(np.int32))


def build_index(items: list[tuple[str | None, bytes | None]], window: int = WINDOW, k: int = K) -> Index:
    words = Words.of([t for _, t in items])
    counts = np.diff(words.first)
    sizes = np.minimum(counts, window)
    found = {}
    for n in np.unique(sizes[sizes > 0]).tolist():
        own = np.flatnonzero(sizes == n)
        each = counts[own] - n + 1
        owner = np.repeat(own, each)
        starts = np.arange(len(owner)) + np.repeat(words.first[own] - (np.cumsum(each) - each), each)
        found[n] = _sized(words, starts, owner, n, k if n == window else n)
    return Index(window, k, words.raw, found, [name for name, _ in items])


def _among(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def scan(words: Words, index: Index) -> list[tuple[int, int, np.ndarray]]:
    """(start, length, items) of every benchmark window that occurs in a text of ``words``.

    Fingerprints of documents are those of the windows near a k-gram that the benchmark has, for no other window can share one.
    """
    found = []
    for at in range(0, len(words.hashes), _STEP):
        part = words.hashes[at : at + _STEP + index.window - 1]
        for n, own in index.sizes.items():
            k = index.k if n == index.window else n
            h = gram_hashes(part, k)
            near = np.flatnonzero(own.bits[_leading(h, own.bits)])
            near = near[_among(own.prints, h[near])]
            w = n - k + 1
            starts = np.unique((near[:, None] - np.arange(w)[None, :]).ravel())
            starts = starts[(starts >= 0) & (starts < _STEP) & (starts + n <= len(part))]
            if not len(starts):
                continue
            # The fingerprint of a document's window must be one of the benchmark, and a window must lie in one text.
            starts = starts[_among(own.prints, h[_minima(h, starts, w)])]
            text = np.searchsorted(words.first, starts + at, side="right")
            starts = starts[starts + at + n <= words.first[np.minimum(text, len(words.first) - 1)]]
            full = gram_hashes(part, n, starts)
            low, high = np.searchsorted(own.hashes, full), np.searchsorted(own.hashes, full, side="right")
            for i in np.flatnonzero(high > low).tolist():
                start = int(starts[i]) + at
                span = words.span(start, n)
                for j in range(low[i], high[i]):
                    if index.raw[own.begin[j] : own.end[j]] == span:
                        found.append((start, n, own.items[own.owns[j] : own.owns[j + 1]]))
    return found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open spans, those that overlap or touch made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scanner(index: Index, text: str, carried: bool):
    def per_batch(batch: pa.RecordBatch):
        raw = encoded(batch.column(batch.schema.get_field_index(text)))
        words = Words.of(raw)
        first = words.first
        spans: list[list] = [[] for _ in raw]
        items: list[set] = [set() for _ in raw]
        if carried:
            for d, (s, x) in enumerate(zip(batch.column(batch.schema.get_field_index("spans")).to_pylist(), batch.column(batch.schema.get_field_index("item_ids")).to_pylist(), strict=True)):
                spans[d] += [(p["start"], p["end"]) for p in s]
                items[d].update(x)
        found = scan(words, index)
        owners = np.searchsorted(first, [s for s, _, _ in found], side="right") - 1
        for d, (s, n, own) in zip(owners.tolist(), found, strict=True):
            spans[d].append((s - int(first[d]), s - int(first[d]) + n))
            items[d].update(index.items[i] for i in own.tolist() if index.items[i] is not None)
        return [np.diff(first), [[{"start": a, "end": b} for a, b in merged(x)] for x in spans], [sorted(x) for x in items]]

    return per_batch


def hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, spans (half-open word positions inside benchmark windows, merged) and item_ids (sorted strings).

    Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z. A window is ``window`` consecutive words of
    an item; an item of fewer words, but not none, is one window, matched by its own full hash. Null or wordless texts and
    items match nothing. An item whose id is null marks words but can't be listed; rows that repeat an item_id count as one
    item. Repeated document rows each get their own result. A column of ``docs`` named like a result column is replaced.
    An empty benchmark leaves every document clean. ``k`` must be at most ``window``.
    """
    if not 1 <= k <= window:
        raise ValueError("k must be from 1 to window")
    spark = ship(docs.sparkSession)
    bench = benchmark.select(F.col(item_id).cast("string").alias("i"), F.encode(F.col(item_text).cast("string"), "UTF-8").alias("t")).where("t is not null")
    total = bench.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    out = docs
    for b in range(blocks):
        part = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        index = spark.sparkContext.broadcast(build_index([(r.i, bytes(r.t)) for r in part.toLocalIterator()], window, k))
        if b and b % TOGETHER == 0:
            out = cut(out)
        out = extended(out, text, FIELDS, _lazy(index, text, bool(b)), keep=[c for c in docs.columns if c.lower() not in {f.name for f in FIELDS}] + [f.name for f in FIELDS] * bool(b))
    return out


def _lazy(index, text, carried):
    return lambda: _scanner(index.value, text, carried)


def report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row a document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = hits(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), benchmark, **how)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """The documents that hold no window of the benchmark, with their own columns."""
    clash = {f.name for f in FIELDS}
    own = {c: f"__own_{c}" for c in docs.columns if c.lower() in clash}
    found = hits(docs.withColumnsRenamed(own), benchmark, text=own.get(text, text), **how)
    return found.where(F.size("spans") == 0).drop(*clash).withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)
