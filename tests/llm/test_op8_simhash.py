import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexpack.llm import graph, queries, simhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text):
    w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not w:
        return 0
    hashes = [xxhash.xxh64(b" ".join(w[i : i + 3]), seed=42).intdigest() for i in range(len(w) - 2)] or [xxhash.xxh64(b" ".join(w), seed=42).intdigest()]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """Labels by all pairs of distinct values."""
    values = sorted(set(prints))
    label = {v: v for v in values}
    for i, a in enumerate(values):
        for b in values[:i]:
            if bin(a ^ b).count("1") <= 2 and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {v: new if x == old else x for v, x in label.items()}
    return label


def check(rows, docs):
    prints = [fingerprint(t) for _, t in docs]
    label, least = components(prints), {}
    for (d, _), p in zip(docs, prints, strict=True):
        if d is not None:
            least[label[p]] = min(d, least.get(label[p], d))
    want = [(d, f"{p:016x}", least.get(label[p])) for (d, _), p in zip(docs, prints, strict=True)]
    key = lambda r: [(x is None, x) for x in r]
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in rows), key=key) == sorted(want, key=key)


def test_whole_table(spark, sf_dir, plain):
    rows = queries.queries()["op8_simhash"](spark, sf_dir).collect()
    check(rows, [r[:2] for r in plain])
    assert len({r.component_id for r in rows}) < len(rows)


def test_edges(spark, odd, clash, nothing):
    check(simhash.report(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert simhash.report(clash).count() == odd.count() and simhash.report(nothing).count() == 0
    kept = simhash.deduplicate(clash)
    assert kept.columns == clash.columns and kept.count() == len({fingerprint(r.text) for r in odd.collect()}) and simhash.deduplicate(nothing).count() == 0


def test_long_texts_in_pieces():
    text = "word other third " * 50_000
    assert simhash.fingerprint(text.encode()) == fingerprint(text)
    assert [simhash.fingerprint(t) for t in (None, b"", b" \n", b"a", b"a b", b"A  b\tC")] == [fingerprint(t) for t in (None, "", " \n", "a", "a b", "a b c")]


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_links_are_those_of_all_pairs(spark, radius):
    r = np.random.default_rng(radius)
    base = r.integers(0, 1 << 62, 150).tolist()
    values = set(base)
    for v in base:
        for _ in range(3):
            for b in r.choice(64, int(r.integers(1, 4)), replace=False).tolist():
                v ^= 1 << int(b)
            values.add(v)
    values |= {base[0] ^ (1 << i) for i in range(64)}
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    prints = spark.createDataFrame([(v,) for v in signed], "fp long")
    label = {}
    values = sorted(v & (1 << 64) - 1 for v in signed)
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if bin(a ^ b).count("1") <= radius:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    for block in (16, 2048):
        for one_task in (0, graph.ONE_TASK):
            found = graph.components(simhash.links(prints, radius, block), one_task)
            got = {q.node & (1 << 64) - 1: q.component for q in found.collect()}
            groups, want = defaultdict(set), defaultdict(set)
            for v in values:
                groups[got.get(v, v)].add(v)
                want[root(v)].add(v)
            label[block, one_task] = sorted(map(sorted, groups.values()))
            assert label[block, one_task] == sorted(map(sorted, want.values()))


def test_bit_sliced_comparison():
    r = np.random.default_rng(4)
    a, b = r.integers(0, 1 << 63, 70).astype(np.uint64), r.integers(0, 1 << 63, 130).astype(np.uint64)
    b[:70] = a ^ np.array([sum(1 << int(x) for x in r.choice(64, k % 6, replace=False)) for k in range(70)], np.uint64)
    bits = list(range(64))
    want = np.array([[bin(int(x) ^ int(y)).count("1") for y in b] for x in a])
    for radius in range(4):
        assert (simhash.near(a, b, bits, radius) == (want <= radius)).all()
    assert (simhash.near(a, b, [1, 5, 9], 1) == (np.array([[sum((int(x) ^ int(y)) >> t & 1 for t in (1, 5, 9)) for y in b] for x in a]) <= 1)).all()


@pytest.mark.parametrize("one_task", [0, graph.ONE_TASK])
def test_components(spark, one_task):
    r = np.random.default_rng(8)
    edges = [(i, i + 1) for i in range(200)] + [(500, 500), (600, 601), (601, 600), (600, 601)] + [tuple(x) for x in r.integers(1000, 1100, (60, 2)).tolist()]
    got = {q.node: q.component for q in graph.components(spark.createDataFrame(edges, "a long, b long"), one_task).collect()}
    label = {}
    for a, b in edges:
        if a != b:
            x, y = label.get(a, a), label.get(b, b)
            label |= {a: x, b: y}
            label = {v: min(x, y) if c in (x, y) else c for v, c in label.items()}
    assert got == label
    assert graph.components(spark.createDataFrame([], "a long, b long"), one_task).count() == 0


def test_one_of_each_group_stays(spark, documents):
    kept, report = simhash.deduplicate(documents), simhash.report(documents)
    assert {r.doc_id for r in kept.collect()} == {r.component_id for r in report.select("component_id").distinct().collect()}
    copies = documents.unionByName(documents.withColumn("doc_id", F.col("doc_id") + 10**6))
    assert {r.doc_id for r in simhash.deduplicate(copies).collect()} == {r.doc_id for r in kept.collect()}
