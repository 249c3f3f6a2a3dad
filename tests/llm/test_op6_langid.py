import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexpack.llm import langid, queries


def test_held_out_accuracy(spark, sf_dir, plain):
    rows = {r.doc_id: r for r in queries.queries()["op6_language"](spark, sf_dir).collect()}
    assert len(rows) == len(plain)
    right = n = 0
    for d, text, lang, _ in plain:
        r = rows[d]
        assert r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not langid.has_letter(None if text is None else text.encode()))
        if r.held_out and lang is not None and r.lang_pred != "und":
            n, right = n + 1, right + (r.lang_pred == lang)
    assert n > 20 and right / n >= 0.95


def test_only_the_text_of_others_counts(spark, documents):
    """Neither a held-out row's language nor source and doc_id change any prediction."""
    held = langid.held_out()
    other = documents.withColumns({"lang": F.when(held, F.lit("zz")).otherwise(F.col("lang")), "source": F.lit("q")})
    rows = lambda df: sorted((r.doc_id, r.lang_pred, r.score) for r in langid.report(df).collect())
    assert rows(documents) == rows(other)


def test_edges(spark, odd, clash, nothing):
    rows = langid.report(odd).collect()
    assert len(rows) == odd.count() and all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (1, 2, 3, 9))
    assert langid.report(nothing).count() == 0
    kept = langid.select(clash)
    assert kept.columns == clash.columns and {r.lang_pred for r in kept.collect()} <= {"own lang_pred"}
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.report(unlabelled).collect()} == {"und"}
    one = langid.report(odd.withColumn("lang", F.lit("only"))).collect()
    assert {r.lang_pred for r in one} == {"und", "only"} and {r.score for r in one if r.lang_pred == "only"} == {1.0}


def test_counts_do_not_depend_on_partitions(spark, documents):
    a, b = (langid.count_grams(documents.repartition(n), "text", "lang") for n in (1, 7))
    assert a.keys() == b.keys() and all((a[k] == b[k]).all() for k in a)


def test_pieces_of_a_long_text_count_like_the_whole():
    raw = ("the words of a text that is cut " * 200).encode()
    whole = np.bincount(langid.gram_codes(raw), minlength=1 << 15)
    parts = sum(np.bincount(langid.gram_codes(p), minlength=1 << 15) for p in langid.pieces(raw, 500))
    assert abs(whole - parts).sum() < 0.02 * whole.sum()


@pytest.mark.parametrize("n", [2, 3, 4, 6, 7, 30, 100])
def test_codewords_correct_errors(n):
    codes = langid.codewords(n).astype(int)
    apart = [(codes[i] != codes[j]).sum() for i in range(n) for j in range(i)]
    assert min(apart) >= (1 if n == 2 else 2 if n == 3 else 4) and all(0 < c.sum() < n for c in codes.T)


def test_many_languages_and_wrong_bits():
    r = np.random.default_rng(2)
    texts = {f"l{k:02d}": "".join(chr(97 + x) for x in r.integers(0, 26, 6)) for k in range(12)}
    make = lambda k, n: " ".join("".join(r.permutation(list(texts[k]))[:4]) for _ in range(n)).encode()
    counts = {k: np.bincount(langid.gram_codes(make(k, 400)), minlength=1 << 15) for k in texts}
    model = langid.fit(counts)
    assert np.mean([model.predict(make(k, 30))[0] == k for k in texts for _ in range(5)]) >= 0.95
    model.weights[:, 0] *= -1  # a classifier that is always wrong
    model.trust[:] = 1 / len(model.trust)
    assert np.mean([model.predict(make(k, 30))[0] == k for k in texts for _ in range(5)]) >= 0.9


def test_mixed_text_is_ambiguous(spark, documents):
    model = langid.train(documents)
    by = {x: next(r.text for r in documents.where(F.col("lang") == x).where("length(text) > 900").collect()) for x in model.langs[:2]}
    a, b = (t[:800].encode() for t in by.values())
    assert model.predict(a)[2] is False and model.predict(b)[2] is False
    scores = [model.predict(a[: 8 * i] + b" " + b[: 8 * (100 - i)]) for i in range(101)]
    assert any(x[2] for x in scores) or min(x[1] for x in scores) < 0.9
