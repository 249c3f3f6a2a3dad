"""The record stream: a header, one of the payload layouts, trailers.

Layouts code either the flat symbol sequence or the split one (roles, literals, and a table each for the two distance bytes and
the length). Literals, or all symbols of a flat layout, are coded by one of three models:

* ``Static``: one table, sent along;
* ``Adaptive``: a Laplace table of the chunks before, so only the active ids are sent;
* ``Context``: tables by previous symbol once they have SUPPORT transitions, with an escape to an adaptive table.

``dictionary`` is a flat layout over trained tables: by previous symbol, else without context, else out of band. ``smallest``
builds every candidate and keeps the shortest, the first of equals.
"""

from __future__ import annotations

import zlib
from collections import Counter

from lexpack.functions import lz
from lexpack.functions.ans import LOG, Decoder, Table, flush
from lexpack.functions.bits import Source, ids_from, ids_to_bytes, pack_bits, unpack_bits, varint
from lexpack.functions.vocabulary import _plain

MAGIC, VERSION = b"LXPK", 2
RAW, SPARSE, EMPTY, DICTIONARY, ADAPTIVE, SPLIT, ADAPTIVE_SPLIT, CONTEXT, CONTEXT_SPLIT = range(9)
NAMES = ("raw", "sparse", "empty", "dictionary", "adaptive", "split", "adaptive_split", "context", "context_split")
CRC, STAMP = 0x80, 0x40
SUPPORT = 20
LONG_ENOUGH = 512


def chunk_size(n: int, k: int) -> int:
    """Symbols between two table updates: larger where tables are large, so that rebuilding stays in proportion."""
    return max(256, n * k // 2_000_000)


def cap() -> int:
    """The most symbols of a table beside its escape."""
    return (1 << LOG) - 1


def kept(counts: Counter) -> tuple[list[int], bool]:
    """The ids that get a place of their own, ascending, and whether others are left: the most frequent, lower ids first."""
    ids = sorted(counts, key=lambda s: (-counts[s], s))
    return sorted(ids[: cap()]), len(ids) > cap()


class Static:
    """One table; symbols without a place are escaped and listed."""

    @staticmethod
    def encode(symbols: list[int], alphabet: int):
        counts = Counter(symbols)
        ids, others = kept(counts)
        values = [counts[s] for s in ids]
        if others:
            ids, values = [*ids, alphabet], [*values, len(symbols) - sum(values)]
        if not ids:
            return varint(0), []
        table = Table.of(ids, values)
        if not others:
            return table.to_bytes(), list(map(table.intervals().__getitem__, symbols))
        escape = table.interval(alphabet)
        listed = [s for s in symbols if table.interval(s) is None]
        return table.to_bytes() + b"".join(map(varint, listed)), [table.interval(s) or escape for s in symbols]

    def __init__(self, source: Source, n: int, alphabet: int):
        self.table, self.escape = None, alphabet
        if n:
            self.table = Table.read(source, alphabet + 1)
            self.source, self.alphabet = source, alphabet
            self.listed: list[int] | None = None
        elif source.varint():
            raise ValueError("a table without symbols to code")

    def finish_header(self, source: Source, n_listed: int) -> None:
        self.listed = [source.varint() for _ in range(n_listed)][::-1]

    def next(self, decoder: Decoder) -> int:
        s = decoder.symbol(self.table)
        if s != self.escape:
            return s
        if not self.listed:
            raise ValueError("an escape has no value")
        s = self.listed.pop()
        if s >= self.alphabet:
            raise ValueError("an escaped symbol is outside the alphabet")
        return s


class Adaptive:
    """Counts of earlier chunks plus one; symbols without a place of their own share the escape. Chunks grow with what was seen."""

    def __init__(self, ids: list[int], others: bool, n: int, alphabet: int):
        self.ids, self.escape = [*ids, alphabet] if others else ids, alphabet
        self.size = chunk_size(n, len(self.ids))
        self.counts, self.seen, self.table, self.renew = dict.fromkeys(self.ids, 1), 0, None, 0

    def current(self) -> Table:
        if self.seen >= self.renew:
            self.table = Table.of(self.ids, list(self.counts.values()))
            self.renew = self.seen + max(self.size, self.seen >> 4)
        return self.table

    def update(self, symbol: int) -> None:
        self.counts[symbol if symbol in self.counts else self.escape] += 1
        self.seen += 1

    def code(self, symbol: int) -> list[tuple[int, int]]:
        table = self.current()
        out = [table.interval(symbol) or table.interval(self.escape)]
        self.update(symbol)
        return out

    def read(self, decoder: Decoder, listed: list[int]) -> int:
        s = decoder.symbol(self.current())
        if s == self.escape:
            if not listed:
                raise ValueError("an escape has no value")
            s = listed.pop()
        self.update(s)
        return s

    def place(self, symbol: int) -> bool:
        return symbol in self.counts


class Context(Adaptive):
    """As Adaptive, tried after the table of the previous symbol; those are rebuilt at chunk ends where they have grown by an eighth."""

    def __init__(self, ids: list[int], others: bool, n: int, alphabet: int):
        super().__init__(ids, others, n, alphabet)
        self.after: dict[int, dict[int, int]] = {}
        self.tables: dict[int, Table] = {}
        self.totals: dict[int, int] = {}
        self.due: dict[int, int] = {}  # the transitions at which a context's table is built anew
        self.dirty: set[int] = set()
        self.last = -1

    def context(self) -> Table | None:
        if self.seen % self.size == 0 and self.dirty:
            for c in self.dirty:
                own, total = self.after[c], self.totals[c]
                ids = sorted(own)
                if len(ids) <= cap():
                    self.tables[c] = Table.of([*ids, self.escape], [*(own[s] for s in ids), len(ids)])
                self.due[c] = total + max(1, total >> 3)
            self.dirty.clear()
        return self.tables.get(self.last)

    def note(self, symbol: int) -> None:
        # A symbol without a place of its own is no one's successor and nobody's context.
        last = self.last
        if symbol not in self.counts:
            self.last = -1
            return
        if last >= 0:
            own = self.after.get(last)
            if own is None:
                own = self.after[last] = {}
                self.totals[last] = 0
            own[symbol] = own.get(symbol, 0) + 1
            self.totals[last] = total = self.totals[last] + 1
            if total >= self.due.get(last, SUPPORT):
                self.dirty.add(last)
        self.last = symbol

    def code(self, symbol: int) -> list[tuple[int, int]]:
        table, out = self.context(), []
        hit = table.interval(symbol) if table else None
        if hit:
            out.append(hit)
        else:
            if table:
                out.append(table.interval(self.escape))
            lower = self.current()
            out.append(lower.interval(symbol) or lower.interval(self.escape))
        self.current()
        self.note(symbol)
        self.update(symbol)
        return out

    def read(self, decoder: Decoder, listed: list[int]) -> int:
        table = self.context()
        s = decoder.symbol(table) if table else self.escape
        lower = self.current()
        if s == self.escape:
            s = decoder.symbol(lower)
            if s == self.escape:
                if not listed:
                    raise ValueError("an escape has no value")
                s = listed.pop()
        self.note(s)
        self.update(s)
        return s


def _adaptive_encode(kind: type, symbols: list[int], alphabet: int):
    """The header and, for each symbol, its intervals."""
    ids, others = kept(Counter(symbols))
    if not ids:
        return ids_to_bytes([]) + b"\0" + varint(0), []
    model = kind(ids, others, len(symbols), alphabet)
    listed = [s for s in symbols if not model.place(s)] if others else []
    steps = [model.code(s) for s in symbols]
    return ids_to_bytes(ids) + bytes([others]) + varint(len(listed)) + b"".join(map(varint, listed)), steps


def _adaptive_header(kind: type, source: Source, n: int, alphabet: int):
    ids, others = ids_from(source, alphabet), source.take(1)[0]
    listed = [source.varint() for _ in range(_bounded(source, source.varint()))][::-1]
    if any(s >= alphabet for s in listed) or n and not ids:
        raise ValueError("the symbols of an adaptive table don't fit")
    return (kind(ids, bool(others), n, alphabet) if ids else None), listed


def _bounded(source: Source, n: int) -> int:
    if n > source.left:
        raise ValueError("a list is longer than its stream")
    return n


class _StaticLiterals:
    @staticmethod
    def encode(symbols, alphabet):
        head, intervals = Static.encode(symbols, alphabet)
        listed = 0
        if len(symbols) > cap() and len(counts := Counter(symbols)) > cap():
            ids = set(kept(counts)[0])
            listed = sum(s not in ids for s in symbols)
        return varint(listed) + head, [(x,) for x in intervals]

    def __init__(self, source, n, alphabet):
        listed = _bounded(source, source.varint())
        self.model = Static(source, n, alphabet)
        self.model.finish_header(source, listed)

    def next(self, decoder):
        return self.model.next(decoder)


class _AdaptiveLiterals:
    kind: type = Adaptive

    @classmethod
    def encode(cls, symbols, alphabet):
        return _adaptive_encode(cls.kind, symbols, alphabet)

    def __init__(self, source, n, alphabet):
        self.model, self.listed = _adaptive_header(self.kind, source, n, alphabet)

    def next(self, decoder):
        if self.model is None:
            raise ValueError("a symbol without a table")
        return self.model.read(decoder, self.listed)


class _ContextLiterals(_AdaptiveLiterals):
    kind = Context


_FLAT = {SPARSE: _StaticLiterals, ADAPTIVE: _AdaptiveLiterals, CONTEXT: _ContextLiterals}
_SPLIT = {SPLIT: _StaticLiterals, ADAPTIVE_SPLIT: _AdaptiveLiterals, CONTEXT_SPLIT: _ContextLiterals}


def encode_events(events, mode: int, flag: int, trained=None) -> bytes:
    """The payload of one layout."""
    if mode in _SPLIT:
        literals = [a for role, a, _ in events if not role]
        matches = [(a, b) for role, a, b in events if role]
        parts = [([role for role, _, _ in events], 2), ([a >> 8 for a, _ in matches], 256), ([a & 255 for a, _ in matches], 256), ([b for _, b in matches], 256)]
        coded = [Static.encode(s, n) for s, n in parts]
        head, own = _SPLIT[mode].encode(literals, flag)
        roles, high, low, length = (iter(x[1]) for x in coded)
        # In the order a reader needs them; a literal is coded by one interval or more.
        order, steps = [], iter(own)
        for role, _, _ in events:
            order.append(next(roles))
            order += (next(high), next(low), next(length)) if role else next(steps)
        return varint(len(events)) + varint(len(literals)) + b"".join(x[0] for x in coded) + head + flush(order)
    symbols = lz.flat(events, flag)
    if mode == RAW:
        return varint(len(symbols)) + pack_bits(symbols, flag.bit_length())
    if mode == DICTIONARY:
        return varint(len(symbols)) + _dictionary_encode(symbols, trained)
    head, steps = _FLAT[mode].encode(symbols, flag + 1)
    return varint(len(symbols)) + head + flush([x for step in steps for x in step])


def decode_events(source: Source, mode: int, flag: int, most: int, trained=None):
    """The events of a payload; ``most``: how many there can be at most."""
    n = source.varint()
    if n > most:
        raise ValueError(f"{n} symbols are impossible for the declared size")
    if mode in _SPLIT:
        n_literals = source.varint()
        if n_literals > n:
            raise ValueError("more literals than events")
        models = []
        for count, alphabet in ((n, 2), (n - n_literals, 256), (n - n_literals, 256), (n - n_literals, 256)):
            models.append(Static(source, count, alphabet))
            models[-1].finish_header(source, 0)
        literal = _SPLIT[mode](source, n_literals, flag)
        decoder, out, left = Decoder(source), [], n_literals
        roles, high, low, length = models
        for _ in range(n):
            if roles.next(decoder):
                if len(out) - (n_literals - left) >= n - n_literals:
                    raise ValueError("more matches than declared")
                out.append((1, high.next(decoder) << 8 | low.next(decoder), length.next(decoder)))
            else:
                left -= 1
                if left < 0:
                    raise ValueError("more literals than declared")
                out.append((0, literal.next(decoder), 0))
        decoder.close()
        return out
    if mode == RAW:
        width = flag.bit_length()
        symbols = unpack_bits(source.take(-(-n * width // 8)), n, width).astype(int).tolist()
    elif mode == DICTIONARY:
        symbols = _dictionary_decode(source, n, flag, trained)
    elif mode in _FLAT:
        model = _FLAT[mode](source, n, flag + 1)
        decoder = Decoder(source)
        symbols = [model.next(decoder) for _ in range(n)]
        decoder.close()
    else:
        raise ValueError(f"unknown mode {mode}")
    if symbols and max(symbols) > flag:
        raise ValueError("a symbol is outside the alphabet")
    return lz.unflat(symbols, flag)


def _dictionary_encode(symbols, trained) -> bytes:
    intervals, listed, last, escape = [], [], -1, trained.escape
    for s in symbols:
        table = trained.contexts.get(last)
        hit = table.interval(s) if table else None
        if hit:
            intervals.append(hit)
        else:
            if table:
                intervals.append(table.interval(escape))
            hit = trained.order0.interval(s)
            intervals.append(hit or trained.order0.interval(escape))
            if not hit:
                listed.append(s)
        last = s
    return trained.fingerprint + varint(len(listed)) + b"".join(map(varint, listed)) + flush(intervals)


def _dictionary_decode(source: Source, n: int, flag: int, trained) -> list[int]:
    wanted = source.take(8)
    if trained is None:
        raise ValueError(f"the stream needs the dictionary {wanted.hex()}")
    if trained.fingerprint != wanted:
        raise ValueError(f"the stream needs the dictionary {wanted.hex()}, not {trained.fingerprint.hex()}")
    listed = [source.varint() for _ in range(_bounded(source, source.varint()))][::-1]
    decoder, out, last, escape = Decoder(source), [], -1, trained.escape
    for _ in range(n):
        table = trained.contexts.get(last)
        s = decoder.symbol(table) if table else escape
        if s == escape:
            s = decoder.symbol(trained.order0)
            if s == escape:
                if not listed:
                    raise ValueError("an escape has no value")
                s = listed.pop()
        out.append(s)
        last = s
    decoder.close()
    return out


def candidates(n: int, fast: bool) -> list[int]:
    """The layouts worth building for n flat symbols, in order of preference among equals."""
    if fast:
        return [SPARSE, SPLIT] if n < LONG_ENOUGH else [ADAPTIVE_SPLIT]
    return [RAW, SPARSE, SPLIT, ADAPTIVE_SPLIT, *([ADAPTIVE, CONTEXT, CONTEXT_SPLIT] if n >= LONG_ENOUGH else [])]


def compress(data: bytes, vocabulary, trained=None, integrity: bool = True, fast: bool = False, mode: int | None = None) -> bytes:
    """One record's stream. ``fast`` builds one or two candidates only; ``mode`` forces a layout."""
    if fast and trained is not None:
        raise ValueError("fast and a dictionary exclude each other")
    if len(data) >= 1 << 32:
        raise ValueError("a record must be under 4 GiB")
    if not data:
        best, payload = EMPTY, b""
    else:
        tokens, flag = vocabulary.encode(data), vocabulary.flag
        events = lz.parse(tokens)
        if mode is not None and mode not in (EMPTY, DICTIONARY):
            built = [(mode, encode_events(events, mode, flag))]
        elif mode is not None and (mode == EMPTY or trained is None):
            raise ValueError("this layout can't be forced here")
        else:
            n = sum(4 if e[0] else 1 for e in events)
            built = [] if mode == DICTIONARY else [(m, encode_events(events, m, flag)) for m in candidates(n, fast)]
            if trained is not None:
                if trained.vocabulary != vocabulary.fingerprint:
                    raise ValueError("the dictionary was trained with another vocabulary")
                built.append((DICTIONARY, encode_events(lz.parse(tokens, trained.history), DICTIONARY, flag, trained)))
        best, payload = min(built, key=lambda x: len(x[1]))
    stamp = b"" if vocabulary.plain else vocabulary.fingerprint
    head = MAGIC + bytes([VERSION, best | STAMP * bool(stamp) | CRC * bool(integrity)]) + varint(len(data))
    out = head + payload + stamp
    return out + zlib.crc32(data, zlib.crc32(head)).to_bytes(4, "little") if integrity else out


def header(blob: bytes) -> dict:
    """magic-checked fields of a stream: mode, size, crc, vocabulary (its fingerprint; that of the single bytes is not in the stream), payload, head (the bytes before)."""
    if blob[:4] != MAGIC:
        raise ValueError("not a record stream")
    if len(blob) < 7:
        raise ValueError("the stream is cut off")
    if blob[4] != VERSION:
        raise ValueError(f"version {blob[4]} is unknown")
    mode, stamped, has_crc = blob[5] & 31, bool(blob[5] & STAMP), bool(blob[5] & CRC)
    if mode >= len(NAMES) or blob[5] & 0x20:
        raise ValueError(f"mode byte {blob[5]} is unknown")
    source = Source(blob)
    source.take(6)
    size, end = source.varint(), len(blob) - 4 * has_crc
    if end - 8 * stamped < source.at or size >= 1 << 32:
        raise ValueError("the stream is cut off")
    stamp = blob[end - 8 : end] if stamped else _plain().fingerprint
    return {"mode": mode, "size": size, "crc": has_crc, "vocabulary": stamp, "payload": blob[source.at : end - 8 * stamped], "head": blob[: source.at]}


def decompress(blob: bytes, vocabulary, trained=None) -> bytes:
    """The record of a stream; anything that doesn't fit raises ValueError."""
    h = header(blob)
    if h["vocabulary"] != vocabulary.fingerprint:
        raise ValueError(f"the stream needs the vocabulary {h['vocabulary'].hex()}, not {vocabulary.fingerprint.hex()}")
    source, size = Source(h["payload"]), h["size"]
    if h["mode"] == EMPTY:
        data = b""
    else:
        events = decode_events(source, h["mode"], vocabulary.flag, 2 * size + 64, trained)
        tokens = lz.replay(events, trained.priming if h["mode"] == DICTIONARY else None)
        if len(tokens) > size:
            raise ValueError("more tokens than bytes")
        data = vocabulary.decode(tokens)
    if source.left or len(data) != size:
        raise ValueError(f"{len(data)} bytes were decoded and {source.left} left over; the header says {size}")
    if h["crc"] and zlib.crc32(data, zlib.crc32(h["head"])) != int.from_bytes(blob[-4:], "little"):
        raise ValueError("the checksum differs")
    return data
