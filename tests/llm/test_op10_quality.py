import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexpack.llm import quality, queries


def test_labels_that_it_never_saw(spark):
    """On the middle table: the small one has labels of eleven bad texts only."""
    sf_dir = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.queries()["op10_quality"](spark, sf_dir).collect()}
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    good, bad = ([rows[r.doc_id] for r in labels if r.quality == q] for q in (1, 0))
    assert np.mean([r.keep for r in good]) >= 0.95 and np.mean([not r.keep for r in bad]) >= 0.95
    assert all(r.keep == (r.score >= 0.5) and 0 <= r.posterior <= 1 and len(r.votes) == len(quality.LABELLERS) for r in rows.values())


def test_em_finds_accuracies_of_made_up_labellers():
    r = np.random.default_rng(1)
    n, k = 40_000, len(quality.LABELLERS)
    truth = r.random(n) < 0.7
    accuracy, cover = np.linspace(0.65, 0.95, k), np.linspace(0.9, 0.5, k)
    right = r.random((n, k)) < accuracy
    votes = np.where(r.random((n, k)) < cover, np.where(right == truth[:, None], quality.GOOD, quality.BAD), quality.ABSTAIN)
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    share, rates, good = quality.fit_labels(patterns, counts.astype(float))
    assert share == pytest.approx(0.7, abs=0.02)
    for j in range(k):
        assert rates[j, 1, quality.GOOD] / (1 - rates[j, 1, quality.ABSTAIN]) == pytest.approx(accuracy[j], abs=0.02)
    assert ((good[at.ravel()] > 0.5) == truth).mean() > 0.95


def test_votes():
    v = lambda t: dict(zip(quality.LABELLERS, quality.votes(None if t is None else t.encode()), strict=True))
    assert set(v(None).values()) == set(v("").values()) == set(v(" \n").values()) == {quality.ABSTAIN}
    assert v("buy $$$ !!! ### now @@@ %%%")["symbols"] == quality.BAD and v("again " * 50)["distinct_words"] == quality.BAD
    assert v("SHOUTING ALL THE TIME")["capitals"] == quality.BAD and v("a line.\n" * 9)["repeated_lines"] == quality.BAD
    clean = v("These are some plain words of a sentence that ends here. And there is another one after that.")
    assert quality.BAD not in clean.values() and clean["line_ends"] == quality.GOOD


def test_distinct_words_count_over_whole_texts():
    """A long text that turns into one repeated word is seen as such however late that is."""
    fresh = " ".join(f"w{i}" for i in range(3000))
    long = fresh + " same" * 60_000
    at = quality.LABELLERS.index("distinct_words")
    assert quality.votes(fresh.encode())[at] == quality.GOOD and quality.votes(long.encode())[at] == quality.BAD
    assert quality.votes((" ".join(f"w{i}" for i in range(200_000))).encode())[at] == quality.GOOD


def test_edges(spark, odd, clash, nothing):
    rows = quality.classify(odd).collect()
    assert len(rows) == odd.count() and all(r.score == 0 and not r.keep for r in rows if r.doc_id in (1, 2, 3))
    assert len({(r.score, r.posterior) for r in rows if r.doc_id == 5}) == 1
    assert quality.classify(clash).count() == odd.count() and quality.classify(nothing).count() == 0


def test_same_result_however_rows_are_dealt(spark, documents):
    rows = lambda df: sorted((r.doc_id, r.votes, round(r.score, 9)) for r in quality.classify(df).collect())
    assert rows(documents) == rows(documents.repartition(5))


def brute(rows, sample):
    """All of it on collected rows: (votes, posterior, score) of each text."""
    own = {t: quality.votes(None if t is None else t.encode()) for _, t in rows}
    patterns, at, n = np.unique([own[t] for _, t in rows], axis=0, return_inverse=True, return_counts=True)
    _, _, good = quality.fit_labels(patterns, n.astype(float))
    posterior = {t: good[k] for (_, t), k in zip(rows, at.ravel(), strict=True)}
    digest = lambda t: 42 if t is None else (xxhash.xxh64_intdigest(t.encode(), 42) + (1 << 63)) % (1 << 64) - (1 << 63)
    chosen = sorted(set(own), key=digest)[:sample]
    scorer = quality.fit_scorer([quality.features(None if t is None else t.encode(), own[t]) for t in chosen], np.array([posterior[t] for t in chosen]))
    return {t: ("".join("-bg"[v] for v in own[t]), posterior[t], scorer.score(None if t is None else t.encode(), own[t])) for t in own}


def held_against_brute_force(df, sample):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = brute(rows, sample)
    got = quality.classify(df, sample=sample).collect()
    line = lambda d, v, p, s: (str(d), v, round(p, 6), round(s, 6))
    assert sorted(line(r.doc_id, r.votes, r.posterior, r.score) for r in got) == sorted(line(d, *want[t]) for d, t in rows)


@pytest.mark.parametrize("sample", [50, 100_000])
def test_brute_force(spark, documents, sample):
    held_against_brute_force(documents, sample)


@pytest.mark.parametrize("ids", ["cast(null AS long)", "7L", "if(doc_id % 2 = 0, doc_id, null)"])
def test_ids_do_not_matter(spark, documents, ids):
    """Null ids, one id for all rows, and half of them null: the sample is that of the texts."""
    as_is = quality.classify(documents, sample=60).select("votes", "score").collect()
    got = quality.classify(documents.withColumn("doc_id", F.expr(ids)), sample=60).select("votes", "score").collect()
    key = lambda rows: sorted((r.votes, round(r.score, 9)) for r in rows)
    assert key(got) == key(as_is)


def test_one_row_and_copies(spark, documents):
    one = documents.where("text is not null").limit(1)
    assert quality.classify(one).count() == 1
    held_against_brute_force(one, 10)
    held_against_brute_force(one.unionByName(one).unionByName(documents.limit(40)), 5)


def test_cutoff(spark):
    df = spark.createDataFrame([(h,) for h in [5, 5, -9, 3, 3, 3, 1 << 62, -(1 << 63)]], "h long")
    for estimate in (1, 5, 10**9):
        assert [quality.cutoff(df, k, estimate) for k in (1, 2, 3, 4, 5, 99)] == [-(1 << 63), -9, 3, 5, 1 << 62, 1 << 62]
