"""Bit packing, variable-length numbers and delta-coded id lists of the stream format."""

from __future__ import annotations

import numpy as np


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """Unsigned numbers of ``width`` bits each, least significant bit first; the last byte is padded with zeros."""
    values = np.asarray(values, np.uint64)
    if len(values) and width < 64 and int(values.max()) >> width:
        raise ValueError(f"a value does not fit {width} bits")
    bits = (values[:, None] >> np.arange(width, dtype=np.uint64)[None, :]) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, count: int, width: int) -> np.ndarray:
    need = -(-count * width // 8)
    if len(data) < need:
        raise ValueError("the bit stream is cut off")
    bits = np.unpackbits(np.frombuffer(data[:need], np.uint8), bitorder="little")
    if bits[count * width :].any():
        raise ValueError("the padding isn't zero")
    bits = bits[: count * width]
    return (bits.reshape(count, width).astype(np.uint64) << np.arange(width, dtype=np.uint64)[None, :]).sum(axis=1, dtype=np.uint64)


#: The numbers of up to two bytes, ready-made.
_SHORT = [bytes([i]) for i in range(128)] + [bytes([i & 127 | 128, i >> 7]) for i in range(128, 1 << 14)]


def varint(value: int) -> bytes:
    """LEB128 of a number from 0 to 2**64 - 1."""
    if 0 <= value < len(_SHORT):
        return _SHORT[value]
    if not 0 <= value < 1 << 64:
        raise ValueError("a variable-length number holds 0 to 64 bits")
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


class Source:
    """A cursor over bytes whose reads fail at the end instead of coming short."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("the stream is cut off")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, size: int) -> int:
        return int.from_bytes(self.take(size), "little")

    def varint(self) -> int:
        value = 0
        for shift in range(0, 70, 7):
            byte = self.take(1)[0]
            value |= (byte & 127) << shift
            if byte < 128:
                if value >> 64:
                    break
                return value
        raise ValueError("a variable-length number is over 64 bits")

    @property
    def left(self) -> int:
        return len(self.data) - self.at


def ids_to_bytes(ids: list[int]) -> bytes:
    """A count and the differences of ascending ids."""
    out, last = [varint(len(ids))], 0
    for i in ids:
        if i < last:
            raise ValueError("ids must ascend")
        out.append(varint(i - last))
        last = i
    return b"".join(out)


def ids_from(source: Source, below: int) -> list[int]:
    """Strictly ascending ids under ``below``."""
    n = source.varint()
    if n > source.left:
        raise ValueError("an id list is longer than its stream")
    out, last = [], 0
    for k in range(n):
        step = source.varint()
        if k and not step:
            raise ValueError("ids repeat")
        last += step
        if last >= below:
            raise ValueError("an id is outside the alphabet")
        out.append(last)
    return out
