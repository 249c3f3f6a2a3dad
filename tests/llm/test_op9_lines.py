import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexpack.llm import lines, queries


def brute(docs, least=2, long=50):
    """By bytes alone: of equal chunks all but the first go, then of equal runs of ``least`` lines and equal long lines in what is left."""
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0, i))
    texts = [None if t is None else t.encode() for _, t in docs]
    own = [[] if t is None else t.split(b"\n") for t in texts]
    chunks = []
    for t in texts:
        at, out = 0, []
        for _, n, b in lines.chunked(t):
            if n >= least and b.strip():
                out.append((at, n, b))
            at += n
        chunks.append(out)
    again, gone = [set() for _ in docs], [set() for _ in docs]
    counts, seen = Counter(b for x in chunks for _, _, b in x), set()
    for i in order:
        for at, n, b in chunks[i]:
            if counts[b] > 1:
                again[i].update(range(at, at + n))
                gone[i].update(range(at, at + n) if b in seen else ())
                seen.add(b)
    parts = []
    for i, x in enumerate(own):
        runs = [(k, least) for k in range(len(x) - least + 1) if all(y.split() for y in x[k : k + least])] + [(k, 1) for k, y in enumerate(x) if len(y.split()) > long]
        parts.append([(k, n) for k, n in runs if not gone[i].issuperset(range(k, k + n))])
    counts, seen = Counter(tuple(own[i][k : k + n]) for i, x in enumerate(parts) for k, n in x), set()
    out = [None] * len(docs)
    for i in order:
        first, later = set(), set()
        for k, n in sorted(parts[i]):
            key = tuple(own[i][k : k + n])
            if counts[key] > 1:
                again[i].update(range(k, k + n))
                (later if key in seen else first).update(range(k, k + n))
                seen.add(key)
        gone[i] |= later - first
        kept = b"\n".join(y for k, y in enumerate(own[i]) if k not in gone[i])
        out[i] = (docs[i][0], None if texts[i] is None else kept.decode(), len(own[i]), len(gone[i]), len(again[i]))
    return out


def check(df, docs):
    key = lambda r: [(x is None, x) for x in r]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed, r.n_repeated) for r in df.collect()), key=key)
    assert got == sorted(brute(docs), key=key)


def test_whole_table(spark, sf_dir, documents, plain):
    docs = [r[:2] for r in plain]
    check(lines.deduplicate(documents.select("doc_id", "text")), docs)
    want = sorted((d, n, r, k, len((t or "").encode()), zlib.crc32((t or "").encode())) for d, t, n, r, k in brute(docs))
    assert sorted(tuple(r) for r in queries.queries()["op9_lines"](spark, sf_dir).collect()) == want and any(r[2] for r in want)


def test_moved_passages_are_found(spark):
    r = np.random.default_rng(3)
    line = lambda: " ".join(f"w{x}" for x in r.integers(0, 10**6, 6))
    passage = [line() for _ in range(60)]
    docs = [(i, "\n".join([line() for _ in range(i)] + passage + [line() for _ in range(7 - i)])) for i in range(8)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    check(lines.deduplicate(df), docs)
    for q in lines.deduplicate(df).where("doc_id > 0").collect():
        assert q.n_removed == 60 and q.text.count("\n") + 1 == q.n_lines - q.n_removed
    first = lines.deduplicate(df).where("doc_id = 0").first()
    assert first.text == docs[0][1] and first.n_repeated > 0


def test_short_passages_are_found(spark):
    """Runs of two to five lines, and long single lines, inside different text."""
    r = np.random.default_rng(9)
    line = lambda n=6: " ".join(f"w{x}" for x in r.integers(0, 10**6, n))
    docs, want = [], {}
    for n in (1, 2, 3, 4, 5):
        for k in range(6):
            passage = [line(60 if n == 1 else 9) for _ in range(n)]
            for c in range(3):
                d = len(docs)
                docs.append((d, "\n".join([line() for _ in range(r.integers(0, 5))] + passage + [line() for _ in range(r.integers(0, 5))])))
                want[d] = n if c else 0
    docs += [(len(docs) + k, line() + "\none short line alone\n" + line()) for k in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    check(lines.deduplicate(df), docs)
    assert {q.doc_id: q.n_removed for q in lines.deduplicate(df).collect()} == {d: want.get(d, 0) for d, _ in docs}


def test_no_run_is_left_twice(spark, documents):
    left = [r.text.split("\n") for r in lines.deduplicate(documents.select("doc_id", "text")).where("text is not null").collect()]
    original = {r.doc_id: (r.text or "").split("\n") for r in documents.collect()}
    n = Counter(p for x in original.values() for p in set(zip(x, x[1:], strict=False)))
    assert sum(c > 1 for c in n.values()) > 10 and all(isinstance(x, list) for x in left)
    long = Counter(y for x in left for y in x if len(y.split()) > 50)
    assert max(long.values(), default=0) <= 1


def test_short_hashes_are_told_apart_by_bytes(spark, documents):
    slim = documents.select("doc_id", "text")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    calls = []
    once = lines._once
    try:
        lines._once = lambda *a: calls.append(a) or once(*a)
        assert rows(lines.deduplicate(slim, hash_bits=24)) == rows(lines.deduplicate(slim))
    finally:
        lines._once = once
    assert calls


def test_two_chunks_of_one_hash_give_a_new_seed(spark):
    docs = [(i, f"first {i}\nsecond {i}") for i in range(6)] + [(6, "first 1\nsecond 1")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    seeds = []
    once = lines._once
    try:
        lines._once = lambda *a: seeds.append(a[5]) or once(*a)
        check(lines.deduplicate(df, hash_bits=8), docs)
    finally:
        lines._once = once
    assert seeds == list(range(len(seeds)))


def test_edges(spark, odd, clash, nothing):
    check(lines.deduplicate(odd), [(r.doc_id, r.text) for r in odd.collect()])
    more = [(1, "a\nb"), (1, "a\nb"), (None, "a\nb"), (2, "\n\n"), (3, "\n\n"), (4, "a\nb\n"), (5, None), (6, "")]
    df = spark.createDataFrame(more, "doc_id long, text string").coalesce(1)
    check(lines.deduplicate(df), more)
    out = lines.deduplicate(clash)
    assert [c for c in out.columns if c not in ("n_lines", "n_removed", "n_repeated")] == [c for c in clash.columns if c != "n_lines"] and out.count() == odd.count()
    assert lines.deduplicate(nothing).count() == 0 and lines.report(nothing).count() == 0


def test_chunks_join_to_the_text():
    r = np.random.default_rng(5)
    for n in (1, 2, 3, 50, 500):
        text = "\n".join(str(x) for x in r.integers(0, 5, n)).encode()
        found = lines.chunked(text)
        assert b"\n".join(b for _, _, b in found) == text and sum(k for _, k, _ in found) == n and max(k for _, k, _ in found) <= 32
    assert lines.chunked(None) == [] and [k for _, k, _ in lines.chunked(b"\n" * 200)][0] <= 32


def test_a_changed_row_fails(spark):
    shaky = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("a\nb\n"), F.uuid()).alias("text")).unionByName(spark.createDataFrame([(99, "x\ny")], "doc_id long, text string"))
    try:
        out = lines.deduplicate(shaky).count()
        assert out == 41
    except Exception as e:
        assert "not the one that was indexed" in str(e)


@pytest.mark.parametrize("roll", [1, 2, 3])
def test_cuts_depend_on_near_lines_only(roll):
    r = np.random.default_rng(roll)
    body = [str(x).encode() for x in r.integers(0, 10**9, 200)]
    a, b = lines.cuts(body, roll, 1000), lines.cuts([b"x", b"y", b"z", *body], roll, 1000)
    inner = {x for x in a if 10 < x < 190}
    assert inner and inner == {x - 3 for x in b if 13 < x < 193}
