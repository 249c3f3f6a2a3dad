"""The record stream: layouts, damage, limits."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexpack.functions import ans, bits, lz, stream
from lexpack.functions.vocabulary import Vocabulary, merge

PLAIN = Vocabulary()
MODES = [m for m in range(9) if m not in (stream.EMPTY, stream.DICTIONARY)]


def payloads():
    r = random.Random(7)
    line = lambda i: f'{{"user":"u{i % 13}","action":"click","v":{i % 17}}}\n'
    yield from (
        b"a", b"ab", b"abc", b"\0", b"\xff" * 500, bytes(range(256)), b"tiny text", "".join(map(line, range(300))).encode(), b"\xff\xfe" * 300, b"abc" * 1500, bytes(4000),
        bytes(r.randrange(256) for _ in range(2500)), "日本語 한국어 العربية 😀".encode() * 40, " ".join(r.choice(["red", "green", "blue", "amber"]) for _ in range(700)).encode(),
    )


@pytest.mark.parametrize("mode", MODES)
def test_layouts(mode):
    for data in payloads():
        blob = stream.compress(data, PLAIN, mode=mode)
        assert stream.header(blob)["mode"] == mode
        assert stream.decompress(blob, PLAIN) == data


def test_smallest_is_no_larger_than_any():
    for data in payloads():
        best = len(stream.compress(data, PLAIN))
        n = sum(4 if e[0] else 1 for e in lz.parse(PLAIN.encode(data)))
        assert best == min(len(stream.compress(data, PLAIN, mode=m)) for m in stream.candidates(n, False))
        assert stream.decompress(stream.compress(data, PLAIN, fast=True), PLAIN) == data


def test_empty_has_its_own_layout_and_a_checksum():
    blob = stream.compress(b"", PLAIN)
    assert stream.header(blob)["mode"] == stream.EMPTY and stream.decompress(blob, PLAIN) == b""
    zeroed = stream.compress(b"abc" * 50, PLAIN)
    with pytest.raises(ValueError):
        stream.decompress(zeroed[:6] + b"\0" + zeroed[8:], PLAIN)


@pytest.mark.parametrize("mode", MODES)
def test_every_flipped_byte_is_found(mode):
    data = b"the quick brown fox jumps over the lazy dog. " * 14
    blob = stream.compress(data, PLAIN, mode=mode)
    for i in range(0, len(blob), max(1, len(blob) // 60)):
        for flip in (1, 0x80):
            bad = blob[:i] + bytes([blob[i] ^ flip]) + blob[i + 1 :]
            with pytest.raises((ValueError, OverflowError)):
                stream.decompress(bad, PLAIN)


def test_cut_streams_and_headers():
    blob = stream.compress(b"some record " * 20, PLAIN)
    for n in (0, 3, 5, 12, 17, len(blob) // 2, len(blob) - 1):
        with pytest.raises(ValueError):
            stream.decompress(blob[:n], PLAIN)
    for at, value in ((0, 0x58), (4, 0x7F), (5, 0x1F | stream.STAMP | stream.CRC)):
        with pytest.raises(ValueError):
            stream.decompress(blob[:at] + bytes([value]) + blob[at + 1 :], PLAIN)


def test_wrong_vocabulary():
    other = Vocabulary({bytes([b]): 255 - b for b in range(256)})
    with pytest.raises(ValueError, match="vocabulary"):
        stream.decompress(stream.compress(b"record", PLAIN), other)


def test_impossible_count_is_refused_before_work():
    body = bits.varint(0xFFFFFFFF) + bytes(40)
    with pytest.raises(ValueError, match="impossible"):
        stream.decode_events(bits.Source(body), stream.RAW, PLAIN.flag, 2 * 10 + 64)


@pytest.mark.parametrize("mode", [m for m in MODES if m != stream.RAW])
def test_escapes_where_tables_are_small(monkeypatch, mode):
    """With six-bit tables most symbols have no place of their own."""
    monkeypatch.setattr(ans, "LOG", 9)
    monkeypatch.setattr(stream, "LOG", 7)
    r = random.Random(3)
    for n in (600, 1500):
        data = bytes(r.choice((r.randrange(256), 65, 66)) for _ in range(n))
        assert stream.decompress(stream.compress(data, PLAIN, mode=mode), PLAIN) == data


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400), st.sampled_from(MODES))
def test_any_bytes(data, mode):
    if data:
        assert stream.decompress(stream.compress(data, PLAIN, mode=mode), PLAIN) == data


def rounds(counts, m, total=None):
    """One unit at a time, round after round: what ``normalise`` gives directly."""
    total = total or sum(counts)
    n = len(counts)
    if n == 1:
        return [m]
    f = [min(max(c * m // total, 1), m - 1) for c in counts]
    short = m - sum(f)
    while short:
        for i in range(n):
            if short > 0 and f[i] < m - (n - 1):
                f[i], short = f[i] + 1, short - 1
            elif short < 0 and f[i] > 1:
                f[i], short = f[i] - 1, short + 1
            if not short:
                break
    return f


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 5), st.integers(1, 10**6)), min_size=1, max_size=200), st.integers(0, 300))
def test_normalise(counts, more):
    total = sum(counts) + more
    got = ans.normalise(counts, 10, total).tolist()
    assert got == rounds(counts, 1024, total) and sum(got) == 1024 and min(got) >= 1


def test_normalise_limits():
    assert ans.normalise([5]).tolist() == [65536]
    with pytest.raises(ValueError):
        ans.normalise(np.ones(65537, np.int64))
    with pytest.raises(ValueError):
        ans.normalise([1, 0])


def test_coder():
    table = ans.Table.of([3, 9, 200], [500, 300, 1])
    symbols = random.Random(1).choices([3, 9, 200], [500, 300, 1], k=3000)
    source = bits.Source(table.to_bytes() + ans.flush([table.interval(s) for s in symbols]))
    again = ans.Table.read(source, 256)
    decoder = ans.Decoder(source)
    assert [decoder.symbol(again) for _ in symbols] == symbols
    decoder.close()
    assert source.left == 0


def test_bits_and_numbers():
    r = random.Random(2)
    for width in (1, 7, 9, 17, 33, 64):
        values = [r.randrange(1 << width) for _ in range(50)]
        assert bits.unpack_bits(bits.pack_bits(np.array(values, np.uint64), width), 50, width).tolist() == values
    for x in (0, 127, 128, 16383, 16384, 2**32, 2**64 - 1):
        assert bits.Source(bits.varint(x)).varint() == x
    with pytest.raises(ValueError):
        bits.Source(b"\xff" * 10 + b"\x01").varint()
    with pytest.raises(ValueError):
        bits.varint(1 << 64)
    ids = [0, 5, 6, 300, 70000]
    assert bits.ids_from(bits.Source(bits.ids_to_bytes(ids)), 70001) == ids
    with pytest.raises(ValueError):
        bits.ids_from(bits.Source(bits.ids_to_bytes(ids)), 70000)


def test_matches():
    tokens = [1, 2, 3, 4, 5] * 100
    events = lz.parse(tokens)
    assert lz.replay(events) == tokens and len(events) < 12
    assert lz.unflat(lz.flat(events, 256), 256) == events
    primed = lz.parse([10, 11, 12, 13], [9, 10, 11, 12, 13, 14])
    assert primed == [(1, 5, 4)] and lz.replay(primed, [9, 10, 11, 12, 13, 14]) == [10, 11, 12, 13]
    for bad in ([(1, 1, 3)], [(0, 7, 0), (1, 2, 3)], [(0, 7, 0), (1, 1, 0)]):
        with pytest.raises(ValueError):
            lz.replay(bad)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=400))
def test_matches_of_anything(tokens):
    assert lz.replay(lz.parse(tokens)) == tokens


def test_bpe_of_a_vocabulary_is_its_merges():
    from lexpack.operators.training import merges, vocabulary_of

    pieces = {b"low": 5, b"lower ": 4, b"newest ": 6, b"widest ": 3, b"\xff\xfe\xff\xfe": 2}
    chain = merges(pieces, 20)
    v = vocabulary_of(chain)
    v.check()
    tokens = [bytes([b]) for b in range(256)]
    pairs = []
    for a, b in chain:
        pairs.append((tokens[a], tokens[b]))
        tokens.append(tokens[a] + tokens[b])
    for p in pieces:
        assert [v._tokens[i] for i in v.encode(p)] == merge(p, pairs)
    for data in payloads():
        assert v.decode(v.encode(data)) == data
        assert stream.decompress(stream.compress(data, v), v) == data
    assert Vocabulary.from_lines(v.lines()).fingerprint == v.fingerprint
    with pytest.raises(ValueError):
        Vocabulary({b"ab": 256, **{bytes([b]): b for b in range(256) if b != 97}, b"a": 97, b"abcd": 257}).check()


def plain_merges(pieces, n):
    """BPE by its definition: all pairs are counted anew for every merge."""
    words, out = [(list(p), c) for p, c in pieces.items()], []
    while len(out) < n:
        counts = {}
        for ids, c in words:
            for pair in zip(ids, ids[1:], strict=False):
                counts[pair] = counts.get(pair, 0) + c
        if not counts:
            break
        best = min(counts, key=lambda p: (-counts[p], p))
        for k, (ids, c) in enumerate(words):
            i, made = 0, []
            while i < len(ids):
                hit = tuple(ids[i : i + 2]) == best
                made.append(256 + len(out) if hit else ids[i])
                i += 1 + hit
            words[k] = (made, c)
        out.append(best)
    return out


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.binary(max_size=12).map(lambda b: bytes(x % 3 + 97 for x in b)), st.integers(1, 5), max_size=12))
def test_merges_are_those_of_the_definition(pieces):
    from lexpack.operators.training import merges

    assert merges(pieces, 30) == plain_merges(pieces, 30)


def test_lists_on_several_processes():
    from lexpack import api

    data = [f"record {i % 7}".encode() * (i % 5) for i in range(50)]
    streams = api.compress_each(data, workers=2)
    assert streams == api.compress_each(data) and api.decompress_each(streams, workers=2) == data
    with pytest.raises(ValueError):
        api.compress_each(data, workers=-1)


def test_small_frames():
    """Eleven bytes beside the payload; eight more for a vocabulary of one's own, which is then needed."""
    from lexpack.operators.training import merges, vocabulary_of

    v = vocabulary_of(merges({b"abc": 3}, 2))
    plain, own = (stream.compress(b"abcabcabd", x, mode=stream.RAW) for x in (PLAIN, v))
    assert len(plain) - len(stream.header(plain)["payload"]) == 11 and len(own) - len(stream.header(own)["payload"]) == 19
    assert stream.decompress(own, v) == stream.decompress(plain, PLAIN) == b"abcabcabd"
    for blob, wrong in ((plain, v), (own, PLAIN)):
        with pytest.raises(ValueError, match="vocabulary"):
            stream.decompress(blob, wrong)
