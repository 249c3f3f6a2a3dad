"""Byte-level text helpers for the Arrow-batched operators.

Texts are handled as UTF-8 bytes and in pieces of bounded size, so that memory depends on the largest text and not on
the number of rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Lower-cases A-Z and leaves all other bytes.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Lower-cases A-Z, keeps 0-9, a-z and all bytes of characters beyond ASCII, and blanks the rest.
WORDS = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b > 127 else b + 32 if 65 <= b < 91 else 32 for b in range(256))
#: As WORDS, but digits are blanked too.
LETTERS = bytes(32 if 48 <= b < 58 else WORDS[b] for b in range(256))

SLICE_BYTES = 4 << 20
PIECE_BYTES = 1 << 20
_SPACE = re.compile(rb"(?<=[^\x09-\x0d\x1c-\x20])[\x09-\x0d\x20]")


def _blank_before(raw: bytes, at: int) -> bool:
    """Whether the character that ends before ``at`` is white space."""
    start = at - 1
    while start > 0 and raw[start] & 0xC0 == 0x80 and at - start < 4:
        start -= 1
    return raw[start:at].decode("utf-8", "replace").isspace()


def pieces(raw: bytes, limit: int = PIECE_BYTES) -> Iterator[bytes]:
    """``raw`` in parts of about ``limit`` bytes, cut only at ASCII white space that follows another character than white space, so runs stay whole."""
    at = 0
    while len(raw) - at > limit:
        m = _SPACE.search(raw, at + limit)
        while m is not None and raw[m.start() - 1] > 127 and _blank_before(raw, m.start()):
            m = _SPACE.search(raw, m.end())
        if m is None:
            break
        yield raw[at : m.start()]
        at = m.start()
    yield raw[at:] if at else raw


def encoded(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose texts have about ``limit`` bytes together; one text at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16
        at = 0
        ends = np.cumsum(sizes)
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def extended(df: DataFrame, text: str, fields: list[T.StructField], make: Callable, keep: list[str] | None = None) -> DataFrame:
    """``df`` with columns that ``make()`` computes from texts; a new column replaces one of the same name.

    ``make()`` runs once for each task and returns a function from a slice (RecordBatch) to the arrays of ``fields``, or to
    (arrays, mask) when rows are filtered. ``keep``: the input columns that stay, all by default.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    new = {f.name.lower() for f in fields}
    names = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    schema = T.StructType([df.schema[c] for c in names] + fields)
    types = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in slices(batches, text):
            made = f(batch)
            made, mask = made if isinstance(made, tuple) else (made, None)
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in names]
            arrays += [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(made, types, strict=True)]
            out = pa.RecordBatch.from_arrays(arrays, names=[*names, *(x.name for x in fields)])
            yield out if mask is None else out.filter(pa.array(mask))

    return df.select(*dict.fromkeys([*names, text, *([] if keep is None else keep)])).mapInArrow(run, schema)


def word_counts(texts: list[bytes | None]) -> np.ndarray:
    """Runs of other than ASCII white space in each text; null has none."""
    return np.fromiter((0 if t is None else sum(len(p.split()) for p in pieces(t)) for t in texts), np.int64, len(texts))
