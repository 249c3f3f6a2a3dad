import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexpack.llm import queries, shards


def placed(df):
    return [(r.shard, r.slot) for r in df.select("shard", "slot").collect()]


def check_places(places, n, shards_=8):
    sizes = [sum(s == k for s, _ in places) for k in range(shards_)]
    assert len(places) == n and max(sizes) - min(sizes) <= 1
    for k in range(shards_):
        assert sorted(p for s, p in places if s == k) == list(range(sizes[k]))


def test_whole_table(spark, sf_dir, plain):
    rows = queries.queries()["op4_shards"](spark, sf_dir).collect()
    check_places([(r.shard, r.slot) for r in rows], len(plain))
    want = sorted((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _, _ in plain)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    again = queries.queries()["op4_shards"](spark, sf_dir).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in rows) == sorted((r.doc_id, r.shard, r.slot) for r in again)


@pytest.mark.parametrize("block_rows", [3, 16384])
def test_edges(spark, odd, clash, nothing, block_rows):
    for df in (odd, clash, odd.repartition(5)):
        stored = spark.createDataFrame(df.collect(), df.schema)
        out = shards.shuffle(stored, block_rows=block_rows).cache()
        check_places(placed(out), df.count())
        text = lambda x: sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in x.select("doc_id", "text").collect())
        assert text(out) == text(df)
        assert [c for c in out.columns if c not in ("shard", "slot")] == [c for c in df.columns if c not in ("shard", "slot")]
    assert shards.shuffle(nothing).count() == 0 and shards.shuffle(odd.limit(1)).count() == 1
    many = shards.shuffle(spark.range(1000).withColumnRenamed("id", "doc_id"), shards=70, block_rows=5)
    check_places(placed(many), 1000, 70)
    with pytest.raises(ValueError):
        shards.shuffle(odd, shards=0)


def test_matrix_has_its_sums():
    rows, columns = np.array([5, 0, 17, 3, 100, 1]), np.array([20, 31, 0, 75])
    m = np.stack([shards.matrix_row(rows, columns, i, 9) for i in range(len(rows))])
    assert (m.sum(axis=0) == columns).all() and (m.sum(axis=1) == rows).all() and (m >= 0).all()


def test_matrix_is_hypergeometric():
    rows, columns, n = np.array([4, 3, 3]), np.array([5, 5]), 4000
    draws = np.array([[shards.matrix_row(rows, columns, i, seed)[0] for i in range(3)] for seed in range(n)])
    from math import comb

    for i, k in enumerate(rows):
        for x in range(int(k) + 1):
            p = comb(5, x) * comb(5, int(k) - x) / comb(10, int(k))
            assert abs((draws[:, i] == x).mean() - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-9


def test_every_place_is_as_likely():
    """Where each row of a small table goes, over many seeds."""
    rows, columns, n = np.array([3, 2, 1]), np.array([2, 2, 2]), 3000
    seen = np.zeros((3, 3))
    for seed in range(n):
        for i in range(3):
            seen[i] += shards.matrix_row(rows, columns, i, seed)
    assert np.abs(seen / n / rows[:, None] - 1 / 3).max() < 0.04


def test_large_draws_agree_with_the_moments():
    rng = np.random.default_rng(3)
    good, bad, n = 3 * 10**9, 5 * 10**9, 10**6
    x = np.array([shards.hypergeometric(rng, good, bad, n) for _ in range(3000)])
    p = good / (good + bad)
    sd = (n * p * (1 - p) * (good + bad - n) / (good + bad - 1)) ** 0.5
    assert abs(x.mean() - n * p) < 5 * sd / 3000**0.5 and abs(x.std() / sd - 1) < 0.07
    assert shards.split(rng, np.array([3 * 10**9, 0, 2 * 10**9]), 5 * 10**9).tolist() == [3 * 10**9, 0, 2 * 10**9]


def test_large_splits_have_the_moments_of_every_column():
    rng = np.random.default_rng(5)
    columns = np.array([4 * 10**8, 0, 9 * 10**8, 10**9, 7, 3 * 10**9])
    n, total = 10**7, int(columns.sum())
    x = np.stack([shards.split(rng, columns, n) for _ in range(2000)])
    assert (x.sum(axis=1) == n).all() and (x <= columns).all() and (x >= 0).all()
    p = columns / total
    sd = np.sqrt(n * p * (1 - p) * (total - n) / (total - 1))
    assert (np.abs(x.mean(axis=0) - n * p) <= 5 * sd / 2000**0.5 + 1e-9).all() and np.allclose(x.std(axis=0)[[0, 2, 3, 5]], sd[[0, 2, 3, 5]], rtol=0.08)
    one = shards.split(rng, np.array([2 * 10**9]), 5)
    assert one.tolist() == [5] and shards.split(rng, np.array([10**9, 10**9, 10**9]), 0).tolist() == [0, 0, 0]


def test_order_is_shuffled(spark):
    df = spark.range(4000, numPartitions=4).withColumnRenamed("id", "doc_id")
    got = [r.doc_id for r in shards.shuffle(df, shards=1).orderBy("slot").collect()]
    assert abs(np.corrcoef(got, np.arange(4000))[0, 1]) < 0.08 and sorted(got) == list(range(4000))
    assert shards.shuffle(df).groupBy("shard").agg(F.avg("doc_id").alias("m")).where("abs(m - 2000) > 250").count() == 0
