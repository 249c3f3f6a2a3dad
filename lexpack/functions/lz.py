"""Token-level match finding: a token sequence as literals and back references."""

from __future__ import annotations

WINDOW = 32768
SHORTEST, LONGEST = 3, 255


class History:
    """Text before the first token, with the latest place of each of its pairs; made once for many records."""

    def __init__(self, tokens: list[int]):
        self.tokens = list(tokens)
        self.latest = {pair: i for i, pair in enumerate(zip(self.tokens, self.tokens[1:], strict=False))}


_NOTHING = History([])


def parse(tokens: list[int], history: list[int] | History | None = None) -> list[tuple[int, int, int]]:
    """Greedy events (role, a, b): (0, token, 0) for a literal, (1, distance, length) for a match.

    A match goes to the latest earlier place with the same two tokens, at most WINDOW back; ``history`` is text before the
    first token that may be referred to.
    """
    past = history if isinstance(history, History) else History(history) if history else _NOTHING
    data, at, before = past.tokens + list(tokens), len(past.tokens), past.latest.get
    latest: dict[tuple[int, int], int] = {}
    out, n = [], len(data)
    while at < n:
        length = 0
        if at + 1 < n:
            pair = (data[at], data[at + 1])
            found = latest.get(pair)
            if found is None:
                found = before(pair)
            if found is not None and at - found <= WINDOW:
                most = min(LONGEST, n - at)
                length = 2
                while length < most and data[found + length] == data[at + length]:
                    length += 1
        if length >= SHORTEST:
            out.append((1, at - found, length))
            stop = at + length
        else:
            out.append((0, data[at], 0))
            stop = at + 1
        while at < stop:
            if at + 1 < n:
                latest[data[at], data[at + 1]] = at
            at += 1
    return out


def replay(events, history: list[int] | None = None) -> list[int]:
    """The tokens of the events; references before the history's start and empty matches are errors."""
    out = list(history or ())
    first = len(out)
    for role, a, b in events:
        if role == 0:
            out.append(a)
            continue
        if not 0 < a <= len(out) or not 0 < b <= LONGEST:
            raise ValueError(f"a match of length {b} goes back {a} of {len(out)} tokens")
        if a >= b:
            out += out[len(out) - a : len(out) - a + b]
        else:
            for _ in range(b):
                out.append(out[-a])
    return out[first:]


def flat(events, flag: int) -> list[int]:
    """One sequence of symbols: a literal is itself; a match is the flag, the distance's two bytes and the length."""
    out: list[int] = []
    for role, a, b in events:
        if role:
            out += (flag, a >> 8, a & 255, b)
        else:
            out.append(a)
    return out


def unflat(symbols: list[int], flag: int) -> list[tuple[int, int, int]]:
    out, at, n = [], 0, len(symbols)
    while at < n:
        if symbols[at] != flag:
            out.append((0, symbols[at], 0))
            at += 1
            continue
        if at + 4 > n:
            raise ValueError("a match is cut off")
        high, low, length = symbols[at + 1 : at + 4]
        if max(high, low, length) > 255:
            raise ValueError("a match has fields of over a byte")
        out.append((1, high << 8 | low, length))
        at += 4
    return out
