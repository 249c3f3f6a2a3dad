import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from lexpack.llm import mixing, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Rounds of sharing by weight until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = share * total - sum(most * sizes[s] for s in capped)
        open_w = sum(w[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and w[s] * left / open_w > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else w[s] * left / open_w for s in names}
        capped |= over


def check(rows, docs):
    sizes = defaultdict(int)
    for _, t, s in docs:
        sizes[s] += len(WORD.findall(t or ""))
    want = targets(sizes) if sum(sizes.values()) else {}
    taken, source = defaultdict(int), defaultdict(list)
    for d, t, s in docs:
        source[d].append(s)
    for r in rows:
        s = source[r.doc_id][0]
        if len(set(source[r.doc_id])) == 1:
            assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
            taken[s] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    for s, n in taken.items():
        assert abs(n - want[s]) <= 2, s


def test_whole_table_and_sql(spark, sf_dir, plain):
    df = queries.queries()["op7_mix"](spark, sf_dir)
    rows = df.collect()
    check(rows, [(d, t, s) for d, t, _, s in plain])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({queries.OP7_SQL})").fetchall()
    assert sorted(tuple(r) for r in df.select("doc_id", "size", "source_size", "target", "taken").collect()) == sorted(want)


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 10, "c": 1}, {"a": 1, "b": 1, None: 500}, {"x": 0, "y": 7}, {f"s{i:02d}": i * i for i in range(20)}, {"one": 9}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: (r.source_size, r.target) for r in mixing.targets(df).collect()}
    want = targets(sizes)
    assert {s: n for s, (n, _) in got.items()} == sizes and all(got[s][1] == pytest.approx(want[s]) for s in sizes)


def test_ties_are_broken_by_text_and_place(spark):
    rows = [("a", 10, 5, 1, p) for p in range(7)] + [("b", 1, k, 0, k) for k in range(20)] + [("c", 3, 9, k % 2, k) for k in range(10)]
    df = spark.createDataFrame(rows, "source string, size long, h long, t long, p long")
    goal = spark.createDataFrame([("a", 70, 33.0), ("b", 20, 12.0), ("c", 30, 17.5)], "source string, source_size long, target double")
    got = {r.source: (tuple(r.limit), r.part) for r in mixing.thresholds(df, goal).collect()}
    assert got == {"a": ((5, 1, 3), 3), "b": ((12, 0, 12), 0), "c": ((9, 1, 1), 2)}


@pytest.mark.parametrize("few", [mixing.FEW_SOURCES, 0])
def test_targets_are_met_whatever_the_ids(spark, monkeypatch, few):
    """Null or repeated ids, equal texts and equal rows: a source's taken words are its target's, and no row exceeds twice its size. With few sources and, as if, with many."""
    monkeypatch.setattr(mixing, "FEW_SOURCES", few)
    cases = [
        [(None, "w", "a")] * 9 + [(None, "w " * 1991, "a"), (1, "w " * 1000, "b")],
        [(None, "same text", "a")] * 300 + [(k, "x y z", "b") for k in range(90)] + [(3, f"t {k}", None) for k in range(50)],
        [(k % 2, f"{'word ' * (k % 5)}", "ab"[k % 2]) for k in range(101)],
    ]
    for docs in cases:
        rows = mixing.report(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)).collect()
        sizes = defaultdict(int)
        for _, t, s in docs:
            sizes[s] += len(WORD.findall(t))
        want, taken = targets(sizes), defaultdict(int)
        by_target = {(sizes[s], round(want[s], 6)): s for s in want}
        assert len(by_target) == len(want) and len(rows) == len(docs)
        for r in rows:
            assert 0 <= r.taken <= 2 * r.size
            taken[by_target[r.source_size, round(r.target, 6)]] += r.taken
        assert all(abs(taken[s] - want[s]) < 1 for s in want)


def test_texts_are_not_exchanged(spark, documents):
    plan = mixing.mixed(documents)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan


def test_edges(spark, odd, clash, nothing):
    assert mixing.report(odd).count() == odd.count() and mixing.report(nothing).count() == 0
    assert all(r.taken <= 2 * r.size for r in mixing.report(clash).collect())
    wordless = odd.withColumn("text", F.lit(" "))
    assert {(r.size, r.target, r.taken) for r in mixing.report(wordless).collect()} == {(0, 0.0, 0)}
    mixed = mixing.mixed(clash, n_chars="n_chars")
    assert mixed.columns == clash.columns and mixed.where("n_chars <> length(text)").count() == 0 and mixing.mixed(nothing).count() == 0


def test_mixed_rows_hold_what_is_taken(spark, documents):
    taken = {r.doc_id: r.taken for r in mixing.report(documents).collect()}
    got = defaultdict(int)
    original = {r.doc_id: r.text for r in documents.collect()}
    for r in mixing.mixed(documents, n_chars="n_chars").collect():
        got[r.doc_id] += len(WORD.findall(r.text or ""))
        assert r.n_chars == len(r.text) and original[r.doc_id].split()[: len(r.text.split())] == r.text.split()
    assert {d: n for d, n in taken.items() if n} == {d: n for d, n in got.items() if n}
