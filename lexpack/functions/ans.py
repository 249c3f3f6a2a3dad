"""Frequency tables that sum to a power of two, and the range coder over them.

A model turns symbols into (start, frequency) intervals in decoding order; ``flush`` codes them all, last first, so that the
decoder meets them in order. Models therefore only run forwards, on both sides.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate
from operator import sub

import numpy as np

from lexpack.functions.bits import Source, varint

LOG = 16
_LOW = 1 << 32


def normalise(counts, log: int | None = None, total: int | None = None) -> np.ndarray:
    """Positive frequencies with the sum ``2**log``, near to the counts' shares.

    Each starts at the rounded-down share, 1 at least. What is missing or too much is then dealt out one unit at a time, round
    after round in order, as far as each has room; that is a water level, found here directly. ``total`` stands in for the sum
    of the counts where a model counts mass beyond them.
    """
    log = LOG if log is None else log
    n, m = len(counts), 1 << log
    if n == 0 or n > m:
        raise ValueError(f"{n} symbols can't share {m} slots")
    if n == 1:
        return np.array([m])
    if n <= _FEW:
        f = _few(counts, n, m, total)
        if f is not None:
            return np.array(f)
    c = np.asarray(counts, np.int64)
    if (c <= 0).any():
        raise ValueError("counts must be positive")
    total = int(c.sum()) if total is None else total
    f = np.clip([int(x) * m // total for x in c] if total > 1 << 46 else c * m // total, 1, m - 1).astype(np.int64)
    short = m - int(f.sum())
    room = (m - (n - 1) - f) if short > 0 else f - 1
    room = np.maximum(room, 0)
    need = abs(short)
    if need:
        low, high = 0, int(room.max())
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if int(np.minimum(room, mid).sum()) <= need else (low, mid - 1)
        move = np.minimum(room, low)
        more = np.flatnonzero(room > low)[: need - int(move.sum())]
        move[more] += 1
        f += move if short > 0 else -move
    return f


#: Tables of up to so many symbols are normalised without arrays where the rule's first round suffices.
_FEW = 128


def _few(counts, n: int, m: int, total: int | None) -> list[int] | None:
    if min(counts) <= 0:
        return None
    total = total or sum(counts)
    f = [c * m // total or 1 for c in counts]
    short = m - sum(f)
    if not 0 <= short <= n or max(f) >= m - n:
        return None
    for i in range(short):
        f[i] += 1
    return f


class Table:
    """Symbols with frequencies: intervals by symbol, and symbols by slot."""

    __slots__ = ("symbols", "freqs", "starts", "at")

    def __init__(self, symbols: list[int], freqs: list[int]):
        self.symbols, self.freqs = symbols, freqs
        self.starts = [0, *accumulate(freqs)][:-1]
        self.at: dict[int, tuple[int, int]] | None = None

    @classmethod
    def of(cls, symbols: list[int], counts, total: int | None = None) -> Table:
        if 1 < len(symbols) <= _FEW:
            f = _few(counts, len(symbols), 1 << LOG, total)
            if f is not None:
                return cls(symbols, f)
        return cls(symbols, normalise(counts, total=total).tolist())

    def intervals(self) -> dict[int, tuple[int, int]]:
        if self.at is None:
            self.at = dict(zip(self.symbols, zip(self.starts, self.freqs, strict=True), strict=True))
        return self.at

    def interval(self, symbol: int) -> tuple[int, int] | None:
        return (self.at or self.intervals()).get(symbol)

    def to_bytes(self) -> bytes:
        """Ascending symbols as differences, each with its frequency less one."""
        steps = map(varint, map(sub, self.symbols, [0, *self.symbols]))
        sizes = [varint(f - 1) for f in self.freqs]
        return varint(len(self.symbols)) + b"".join([x for pair in zip(steps, sizes, strict=True) for x in pair])

    @classmethod
    def read(cls, source: Source, below: int) -> Table:
        n = source.varint()
        if 2 * n > source.left:
            raise ValueError("a table is longer than its stream")
        symbols, freqs, last = [], [], 0
        for k in range(n):
            step = source.varint()
            last += step
            if k and not step or last >= below:
                raise ValueError("table symbols must ascend within the alphabet")
            symbols.append(last)
            freqs.append(source.varint() + 1)
        if sum(freqs) != 1 << LOG:
            raise ValueError("a table's frequencies have another sum")
        return cls(symbols, freqs)


def flush(intervals: list[tuple[int, int]]) -> bytes:
    """The coded intervals: word count, final state, 16-bit words in reading order."""
    x, words = _LOW, []
    for start, f in reversed(intervals):
        if x >= f << 48 - LOG:
            words.append(x & 0xFFFF)
            x >>= 16
        q, r = divmod(x, f)
        x = (q << LOG) + r + start
    return varint(len(words)) + x.to_bytes(8, "little") + np.array(words[::-1], "<u2").tobytes()


class Decoder:
    def __init__(self, source: Source):
        n = source.varint()
        self.x = source.number(8)
        if n * 2 > source.left or not _LOW <= self.x < _LOW << 16:
            raise ValueError("the coded part is damaged")
        self.words, self.at = np.frombuffer(source.take(2 * n), "<u2").tolist(), 0

    def symbol(self, table: Table) -> int:
        slot = self.x & (1 << LOG) - 1
        i = bisect_right(table.starts, slot) - 1
        self.x = table.freqs[i] * (self.x >> LOG) + slot - table.starts[i]
        if self.x < _LOW:
            if self.at >= len(self.words):
                raise ValueError("the coded part is cut off")
            self.x = self.x << 16 | self.words[self.at]
            self.at += 1
        return table.symbols[i]

    def close(self) -> None:
        if self.at != len(self.words) or self.x != _LOW:
            raise ValueError("the coded part does not end where it should")
