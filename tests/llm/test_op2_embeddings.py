import math

import numpy as np
import pytest

from lexpack.llm import embeddings, queries


def brute(rows, cosine=0.95):
    """(id, links, component, kept) from all pairs."""
    good = [v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if g else None for (_, v), g in zip(rows, good, strict=True)]
    n = len(rows)
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and good[i] and good[j] and len(unit[i]) == len(unit[j]):
                near[i, j] = unit[i] @ unit[j] >= cosine
    label = list(range(n))
    for i in range(n):
        for j in np.flatnonzero(near[i]):
            a, b = label[i], label[j]
            if a != b:
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {c: min((rows[i][0] for i in range(n) if label[i] == c and rows[i][0] is not None), default=None) for c in label}
    return [(i, int(near[k].sum()), least[label[k]], i == least[label[k]]) for k, (i, _) in enumerate(rows)]


def key(r):
    return [(x is None, x) for x in r]


def found(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=key)


def test_registered_query(spark, sf_dir, tmp_path):
    """The small table's vectors are far apart, so near and exact copies of some are added to it."""
    r = np.random.default_rng(7)
    rows = [(x.vec_id, x.embedding) for x in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert found(queries.queries()["op2_embeddings"](spark, sf_dir)) == sorted(brute(rows), key=key)
    more = [(10_000 + 10 * i + j, (np.array(rows[i][1]) + r.standard_normal(64) * np.linalg.norm(rows[i][1]) * 0.02 * j).tolist()) for i in range(60) for j in range(5)]
    spark.createDataFrame(rows + more, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    back = [(x.vec_id, x.embedding) for x in spark.read.parquet(str(tmp_path / "embeddings.parquet")).collect()]
    got, want = found(queries.queries()["op2_embeddings"](spark, str(tmp_path))), sorted(brute(back), key=key)
    links = sum(x[1] for x in want)
    assert links > 400 and sum(x[1] for x in got) >= 0.98 * links
    assert all(a[1] <= b[1] for a, b in zip(got, want, strict=True)) and sum(a[2] == b[2] for a, b in zip(got, want, strict=True)) >= 0.99 * len(want)


@pytest.mark.parametrize("dim", [2, 3, 24, 100])
def test_recall_on_planted_pairs(spark, dim):
    r = np.random.default_rng(dim)
    base = r.standard_normal((400, dim))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = r.standard_normal((400, dim))
    other -= (other * base).sum(axis=1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cos = r.uniform(0.95, 1, (400, 1))
    near = cos * base + np.sqrt(1 - cos**2) * other
    rows = [(i, x.tolist()) for i, x in enumerate(np.concatenate([base, near * 3]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = found(embeddings.report(df)), brute(rows)
    assert sum(x[1] for x in got) >= 0.9 * sum(x[1] for x in want)
    assert all(a[1] <= b[1] for a, b in zip(sorted(got), sorted(want), strict=True))


@pytest.mark.parametrize("n", [800, 100_000, 10_000_000])
def test_recall_does_not_fall_with_the_number_of_vectors(n):
    for cosine in (0.95, 0.96):
        assert embeddings.Code(64, n).recall(*embeddings.planted(64, 1000, cosine, 77)) >= 0.98


def test_large_filters_are_dealt_out_alike(spark):
    r = np.random.default_rng(5)
    rows = [(i, x.tolist()) for i, x in enumerate(np.array([1.0] + [0.0] * 7) + r.standard_normal((300, 8)) * 0.1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(embeddings.report(df, block=32)) == found(embeddings.report(df)) == sorted(brute(rows), key=key)


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, None]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [inf, 1.0]), (8, [nan, 1.0]), (None, [1.0, 0.01]), (9, [1.0, 0.0, 0.0]), (10, [1e300, 0.0]), (11, [1e-300, -1e-303]), (None, None), (12, [0.0, -1.0]), (13, [-0.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.vec_id, r.n_links): r for r in embeddings.report(df).collect()}
    assert (1, 5) in got and (10, 5) in got and (11, 5) in got and got[None, 5].component_id == 1 and got[1, 5].kept and not got[2, 5].kept
    assert all((i, 0) in got for i in (3, 4, 5, 6, 7, 8, 9)) and got[None, 0].component_id is None and got[12, 1].component_id == 12 and got[13, 1].component_id == 12
    assert embeddings.report(df.limit(0)).count() == 0


def test_clashing_columns(spark):
    """Columns named like those that the operator makes for itself, or like its result, change nothing."""
    from pyspark.sql import functions as F

    r = np.random.default_rng(11)
    base = r.standard_normal((30, 8))
    rows = [(i, (base[i % 30] + 0.02 * r.standard_normal(8)).tolist()) for i in range(60)] + [(None, base[0].tolist()), (99, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    more = df.withColumns({c: F.lit("own") for c in ("n_links", "component_id", "kept", "v", "e", "bad", "node", "dim", "f", "p", "g", "n", "copies", "least", "filters")})
    assert found(embeddings.report(more)) == sorted(brute(rows), key=key) == found(embeddings.report(df))


@pytest.mark.parametrize("blocks", [1, 3])
def test_bucket_links_against_all_pairs(blocks):
    """Counts over all filters together are those of the pairs that share one, whatever the buckets."""
    r = np.random.default_rng(blocks)
    x = embeddings.unit(r.standard_normal((12, 6))[r.integers(0, 12, 90)] + 0.1 * r.standard_normal((90, 6)))
    lists = [np.unique(r.integers(0, 9, 4)) for _ in x]
    weight, p = r.integers(1, 4, len(x)), r.integers(0, blocks, len(x))
    total = np.zeros(len(x), np.int64)
    for f in range(9):
        for lo in range(blocks):
            for hi in range(lo, blocks):
                at = np.array([i for i in range(len(x)) if f in lists[i] and p[i] in (lo, hi)])
                if len(at):
                    n, _ = embeddings.bucket_links(x[at], np.concatenate([lists[i] for i in at]), np.array([len(lists[i]) for i in at]), weight[at], p[at] == lo, p[at] == hi, f, 0.95)
                    total[at] += n
    near = x @ x.T >= 0.95
    want = np.array([[near[i, j] and i != j and bool(set(lists[i]) & set(lists[j])) for j in range(len(x))] for i in range(len(x))])
    assert (total == want @ weight).all() and want.sum() > 100
