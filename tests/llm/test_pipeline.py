"""The pipeline against what its stages should keep, each judged on its own input."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from lexpack.llm import decontaminate, langid, mixing, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    """The stored rows after each stage, the input first."""
    from lexpack.session import stored

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        out.append(docs)
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns(steps):
    assert all(x.columns == steps[0].columns for x in steps[1:-1]) and steps[-1].columns == [*steps[0].columns, "shard", "slot"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "benchmark", "mix", "shard"]


def test_language(steps):
    own = {r.doc_id: r for r in langid.report(steps[0]).collect()}
    assert ids(steps[1]) == {d for d, r in own.items() if r.lang_pred != "und" and not r.ambiguous}
    assert len(ids(steps[1])) >= 0.97 * sum(langid.has_letter(r.text.encode()) for r in steps[0].collect() if r.text)


def test_near_duplicates(steps):
    prints = defaultdict(list)
    for r in steps[1].collect():
        prints[simhash.fingerprint(r.text.encode())].append(r.doc_id)
    values, kept = sorted(prints), ids(steps[2])
    groups = {v: v for v in values}
    for i, a in enumerate(values):
        for b in values[:i]:
            if bin(a ^ b).count("1") <= 2 and groups[a] != groups[b]:
                old, new = max(groups[a], groups[b]), min(groups[a], groups[b])
                groups = {k: new if x == old else x for k, x in groups.items()}
    members = defaultdict(set)
    for v, g in groups.items():
        members[g] |= set(prints[v])
    assert kept == {min(x) for x in members.values()} and len(kept) < steps[1].count()


def test_benchmark(spark, sf_dir, steps):
    flagged = {r.doc_id for r in decontaminate.report(steps[2], spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated").collect()}
    assert flagged and ids(steps[3]) == ids(steps[2]) - flagged


def test_mix(steps):
    taken = {r.doc_id: r.taken for r in mixing.report(steps[3]).collect()}
    got = Counter()
    for r in steps[4].collect():
        got[r.doc_id] += len(WORD.findall(r.text))
    assert {d: n for d, n in taken.items() if n} == {d: n for d, n in got.items() if n}


def test_shards_hold_every_row_once(steps):
    rows = steps[5].collect()
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == k) == list(range(n)) for k, n in sizes.items())
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in steps[4].collect())


def test_run(spark, sf_dir, steps):
    rows = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, sf_dir)) == rows(steps[5])


def test_empty_and_odd_tables(spark, odd, nothing, tmp_path):
    for k, df in enumerate((nothing, odd)):
        from pyspark.sql import functions as F

        folder = tmp_path / str(k)
        df.withColumn("n_chars", F.length("text").cast("long")).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([(1, "nothing of this is there")], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
        out = corpus_pipeline.run(spark, str(folder)).collect()
        assert bool(out) == bool(k) and all(r.text for r in out)
