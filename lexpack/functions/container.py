"""Containers of many records: a batch (one stream over all of them) and an index (a stream each, with offsets).

A batch is smaller, for the records share one model; it is decoded as a whole. An index reads any record by itself.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

from lexpack.functions import stream
from lexpack.functions.bits import Source, varint

BATCH, INDEX, VERSION = b"LXPB", b"LXPI", 1


def pack(records: list[bytes], vocabulary, trained=None, integrity: bool = True, fast: bool = False) -> bytes:
    """A batch: magic, version, count, lengths, the stream of all records in order."""
    return batch_head(records) + stream.compress(b"".join(records), vocabulary, trained, integrity, fast)


def batch_head(records: list[bytes]) -> bytes:
    """All of a batch before its stream."""
    return batch_head_of(np.array([len(r) for r in records], np.int64))


def batch_head_of(lengths: np.ndarray) -> bytes:
    """The same from the records' lengths."""
    if len(lengths) >= 1 << 32:
        raise ValueError("a batch holds under 2**32 records")
    each = lengths.astype(np.uint8).tobytes() if (lengths < 128).all() else b"".join(map(varint, lengths.tolist()))
    return BATCH + bytes([VERSION]) + len(lengths).to_bytes(4, "little") + each


def batch_lengths(blob: bytes) -> tuple[list[int], bytes]:
    """The record lengths of a batch, and its inner stream."""
    source = Source(blob)
    if source.take(4) != BATCH:
        raise ValueError("not a batch")
    if (version := source.take(1)[0]) != VERSION:
        raise ValueError(f"version {version} is unknown")
    n = source.number(4)
    if n > source.left:
        raise ValueError("the batch is cut off")
    return [source.varint() for _ in range(n)], blob[source.at :]


def index_offsets(blob: bytes) -> tuple[np.ndarray, int]:
    """Where each record's stream begins and the last ends, counted from the body; and where the body begins."""
    source = Source(blob)
    if source.take(4) != INDEX:
        raise ValueError("not an index")
    if (version := source.take(1)[0]) != VERSION:
        raise ValueError(f"version {version} is unknown")
    n, body = source.number(4), source.number(8)
    if n * 8 > source.left:
        raise ValueError("the index is cut off")
    offsets = np.append(np.frombuffer(source.take(8 * n), "<u8").astype(np.int64), body)
    if body != source.left or (n and offsets[0] != 0) or (np.diff(offsets) < 0).any():
        raise ValueError("the offsets don't fit the body")
    return offsets, source.at


class IndexWriter:
    """Builds an index record by record; streams may come ready-made."""

    def __init__(self, vocabulary, trained=None, integrity: bool = True):
        self.how = (vocabulary, trained, integrity)
        self.streams: list[bytes] = []

    def add(self, record: bytes) -> None:
        self.streams.append(stream.compress(record, *self.how))

    def add_many(self, records: Iterable[bytes]) -> None:
        for r in records:
            self.add(r)

    def finish(self) -> bytes:
        return indexed(self.streams)


def indexed(streams: list[bytes]) -> bytes:
    """An index of ready-made streams."""
    if len(streams) >= 1 << 32:
        raise ValueError("an index holds under 2**32 records")
    sizes = np.array([len(s) for s in streams], np.int64)
    offsets = (np.cumsum(sizes) - sizes).astype("<u8").tobytes()
    return INDEX + bytes([VERSION]) + len(streams).to_bytes(4, "little") + int(sizes.sum()).to_bytes(8, "little") + offsets + b"".join(streams)


def kind(blob: bytes) -> str:
    """batch, index or stream."""
    found = {BATCH: "batch", INDEX: "index", stream.MAGIC: "stream"}.get(bytes(blob[:4]))
    if found is None:
        raise ValueError("neither a container nor a stream")
    return found


def count(blob: bytes) -> int:
    """The number of records, from the header alone."""
    if kind(blob) == "stream":
        return 1
    if len(blob) < 9 or blob[4] != VERSION:
        raise ValueError("the header is cut off or of an unknown version")
    return int.from_bytes(blob[5:9], "little")


def unpack(blob: bytes, vocabulary, trained=None) -> Iterator[bytes]:
    """The records in order; an index is decoded one at a time, and a stream is one record."""
    found = kind(blob)
    if found == "stream":
        yield stream.decompress(blob, vocabulary, trained)
    elif found == "index":
        offsets, at = index_offsets(blob)
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            yield stream.decompress(blob[at + a : at + b], vocabulary, trained)
    else:
        lengths, inner = batch_lengths(blob)
        data = stream.decompress(inner, vocabulary, trained)
        if sum(lengths) != len(data):
            raise ValueError("the record lengths don't add up to the decoded size")
        at = 0
        for n in lengths:
            yield data[at : at + n]
            at += n


def read(blob: bytes, i: int, vocabulary, trained=None) -> bytes:
    """Record i of an index, without decoding others; IndexError if there is none."""
    offsets, at = index_offsets(blob)
    if not 0 <= i < len(offsets) - 1:
        raise IndexError(f"record {i} of {len(offsets) - 1}")
    return stream.decompress(blob[at + int(offsets[i]) : at + int(offsets[i + 1])], vocabulary, trained)
