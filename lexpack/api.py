"""Records one at a time or in lists, in this process: the codec without Spark, for small things and for tests.

For columns use ``lexpack.operators.codec`` and ``containers``, for files ``lexpack.sources.files``.
"""

from __future__ import annotations

import math
import time
from collections import Counter
from collections.abc import Iterable, Iterator
from concurrent.futures import ProcessPoolExecutor
from functools import partial
from multiprocessing import get_context

from lexpack.functions import container, stream
from lexpack.functions.container import IndexWriter, count, read  # noqa: F401
from lexpack.functions.vocabulary import Vocabulary, _plain


def raw(data: bytes | str) -> bytes:
    return data.encode() if isinstance(data, str) else bytes(data)


def compress(data: bytes | str, dictionary=None, vocabulary: Vocabulary | None = None, integrity: bool = True, fast: bool = False) -> bytes:
    return stream.compress(raw(data), vocabulary or _plain(), dictionary, integrity, fast)


def decompress(blob: bytes, dictionary=None, vocabulary: Vocabulary | None = None) -> bytes:
    return stream.decompress(blob, vocabulary or _plain(), dictionary)


def _each(f, records, workers: int | None) -> list[bytes]:
    """``f`` of every record in order, by so many processes; None or 1: by this one. ``f`` must be picklable."""
    if workers is None or workers == 1:
        return [f(r) for r in records]
    if workers < 1:
        raise ValueError("workers must be at least 1")
    held = list(records)
    with ProcessPoolExecutor(workers, get_context("spawn")) as pool:
        return list(pool.map(f, held, chunksize=max(1, len(held) // (8 * workers))))


def compress_each(records: Iterable[bytes | str], workers: int | None = None, **how) -> list[bytes]:
    return _each(partial(compress, **how), records, workers)


def decompress_each(streams: Iterable[bytes], workers: int | None = None, **how) -> list[bytes]:
    return _each(partial(decompress, **how), streams, workers)


def pack(records: Iterable[bytes | str], dictionary=None, vocabulary: Vocabulary | None = None, integrity: bool = True) -> bytes:
    return container.pack([raw(r) for r in records], vocabulary or _plain(), dictionary, integrity)


def index(records: Iterable[bytes | str], dictionary=None, vocabulary: Vocabulary | None = None, integrity: bool = True) -> bytes:
    w = IndexWriter(vocabulary or _plain(), dictionary, integrity)
    w.add_many(map(raw, records))
    return w.finish()


def unpack(blob: bytes, dictionary=None, vocabulary: Vocabulary | None = None) -> Iterator[bytes]:
    return container.unpack(blob, vocabulary or _plain(), dictionary)


def read_at(blob: bytes, i: int, dictionary=None, vocabulary: Vocabulary | None = None) -> bytes:
    return read(blob, i, vocabulary or _plain(), dictionary)


def token_stats(data: bytes | str, vocabulary: Vocabulary | None = None) -> dict[str, float]:
    """The columns of ``profile.profile`` for one record; zeros for an empty one."""
    b = raw(data)
    ids = (vocabulary or _plain()).encode(b)
    n, one, two = len(ids), Counter(ids), Counter(zip(ids, ids[1:], strict=False))
    h0 = -sum(c / n * math.log2(c / n) for c in one.values())
    h1 = -sum(c / n * math.log2(c / one[a]) for (a, _), c in two.items())
    each = lambda x, y: x / y if y else 0.0
    return {"n_bytes": len(b), "n_tokens": n, "n_distinct": len(one), "h0": h0 + 0.0, "h1": h1 + 0.0, "mutual_information": h0 - h1, "bits_per_byte": each(h0 * n, len(b)), "tokens_per_kb": each(n * 1000, len(b)), "bytes_per_token": each(len(b), n)}


def benchmark(data: bytes | str, dictionary=None, vocabulary: Vocabulary | None = None) -> dict[str, float]:
    """Sizes, ratio, seconds and rates of one round trip, and whether it gave the record back."""
    b = raw(data)
    t = time.perf_counter()
    blob = compress(b, dictionary, vocabulary)
    coded = time.perf_counter() - t
    t = time.perf_counter()
    back = decompress(blob, dictionary, vocabulary)
    decoded = time.perf_counter() - t
    return {"bytes_in": len(b), "bytes_out": len(blob), "ratio": len(blob) / len(b) if b else 0.0, "encode_s": coded, "decode_s": decoded, "encode_mb_s": len(b) / 1e6 / max(coded, 1e-9), "decode_mb_s": len(b) / 1e6 / max(decoded, 1e-9), "bits_per_byte": 8 * len(blob) / len(b) if b else 0.0, "lossless": back == b}
