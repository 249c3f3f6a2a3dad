import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexpack.llm import ngram, queries

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def tokens(text):
    return [*WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())), "end"]


def brute(rows, order=2, mu=20.0):
    counts = defaultdict(int)
    for i, t in rows:
        if not held(i):
            seq = ["start", *tokens(t)]
            for k in range(1, order + 1):
                for j in range(len(seq) - k + 1):
                    counts[tuple(seq[j : j + k])] += 1
    single = {g[0]: c for g, c in counts.items() if len(g) == 1 and g[0] != "start"}
    n, v = sum(single.values()), len(single)

    def p(h, w):
        if not h:
            return (single.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))
        return (counts.get((*h, w), 0) + mu * p(h[1:], w)) / (counts.get(h, 0) + mu)

    out = []
    for i, t in rows:
        seq = ["start", *tokens(t)]
        base = sum(math.log10(p((), w)) for w in seq[1:])
        score = sum(math.log10(p(tuple(seq[max(0, j - order + 1) : j]), seq[j])) for j in range(1, len(seq)))
        out.append((i, held(i), len(seq) - 1, sum(w in single for w in seq[1:]), n, base, score))
    return out


def key(r):
    return [(x is None, x) for x in r[:4]] + [round(r[5], 6)]


def check(df, want):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in df.collect()), key=key)
    want = sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


def test_whole_table(spark, sf_dir, plain):
    df = queries.queries()["op3_ngram"](spark, sf_dir)
    check(df, brute([r[:2] for r in plain]))
    sums = df.where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert sums.s > sums.b


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_orders_and_chunks(spark, plain, order):
    rows = [r[:2] for r in plain[:40]] + [(None, "a a b"), (3, None), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    cut = spark.createDataFrame(df.collect(), df.schema)
    check(ngram.report(cut, order=order, chunk_bytes=3000), brute(rows, order))
    check(ngram.report(cut, order=order, mu=3.5), brute(rows, order, 3.5))


def test_edges(spark, odd, clash, nothing):
    check(ngram.report(odd), brute([(r.doc_id, r.text) for r in odd.collect()]))
    assert ngram.report(clash).count() == odd.count() and ngram.report(nothing).count() == 0
    none = ngram.score(odd, F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score == pytest.approx(0) for r in none)
    with pytest.raises(ValueError):
        ngram.score(odd, F.lit(True), order=0)


def test_probabilities_of_all_words_add_up(spark):
    """The automaton's next-word probabilities after any history sum to 1 with the unknown word's."""
    texts = [b"a b a c", b"b a b", b"c"]
    import numpy as np

    vocabulary = [b"a", b"b", b"c", b"unseen"]
    chunk = ngram.Chunk([*texts, *(h + b" " + w for h in vocabulary[:3] for w in vocabulary), *(h for h in vocabulary[:3])], 2)
    training = np.array([True] * 3 + [False] * 15)
    counts = chunk.counts(training)
    n, v = 11, 4
    _, _, s = chunk.score(counts, n, v)
    prefix = {}
    counter = Counter()
    for k, h in enumerate(vocabulary[:3]):
        first = ngram.Chunk([*texts, h], 2)
        # P(h) . P(end | h) is the score of the text h alone; divide by P(end | h) through the pair counts.
        ends = s[15 + k]
        own = sum(x.split()[-1] == h for x in texts)
        seen = sum(x.split().count(h) for x in texts)
        p_end = (own + 20 * (3 + 0.1) / (n + 0.1 * (v + 1))) / (seen + 20)
        prefix[h] = 10 ** ends / p_end
        for j, w in enumerate(vocabulary):
            at = 3 + 4 * k + j
            after = sum(x.split()[-1] == w for x in texts)
            total = sum(x.split().count(w) for x in texts)
            p_last = (after + 20 * (3 + 0.1) / (n + 0.1 * (v + 1))) / (total + 20)
            counter[h] += 10 ** s[at] / p_last / prefix[h]
        counter[h] += p_end
        assert first.n_words >= 4
    assert all(x == pytest.approx(1, abs=1e-9) for x in counter.values())


def test_rounds():
    for most in (2, 3, 256):
        for chunks in (1, 2, 3, 4, 5, 100, 256, 257, 65_536, 65_537, 10**7):
            rounds, fan = ngram.rounds_for(chunks, most)
            assert fan**rounds >= chunks and fan <= most and (rounds == 1 or most ** (rounds - 1) < chunks)


@pytest.mark.parametrize("most_fan", [2, 3])
def test_many_rounds_give_what_one_does(spark, plain, most_fan):
    rows = [r[:2] for r in plain[:60]] + [(None, "a a b"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(ngram.report(df, order=3, chunk_bytes=2000, most_fan=most_fan), brute(rows, 3))


def test_messages_grow_as_the_input(spark, plain, monkeypatch):
    """A round has about ``fan`` messages for each chunk, at one size and at four times it."""
    kept, ratios = [], []
    stored = ngram.stored
    monkeypatch.setattr(ngram, "stored", lambda df, name: kept.append(stored(df, name)) or kept[-1])
    text = " ".join(t for _, t, _, _ in plain if t)
    for size in (40, 160):
        kept.clear()
        words = text.split()[: size * 60]
        rows = [(i, " ".join(words[60 * i : 60 * i + 60])) for i in range(size)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        ngram.report(df, chunk_bytes=1500, most_fan=4).count()
        chunks = kept[0].select("fs").distinct().count()
        rounds, fan = ngram.rounds_for(chunks, 4)
        most = max(x.count() for x in kept)
        ratios.append(most / chunks)
        assert rounds >= 2 and len(kept) in (2 * rounds - 1, 2 * rounds + 1) and most <= fan * max(chunks, fan**rounds)
    assert ratios[1] <= 1.5 * ratios[0]


def test_a_changed_chunk_fails(spark):
    """Texts that come out otherwise the second time, with as many n-grams, are found out."""
    import uuid

    fresh = F.udf(lambda i: f"same words {uuid.uuid4().hex}").asNondeterministic()
    shaky = spark.range(50).select(F.col("id").alias("doc_id"), fresh("id").alias("text"))
    with pytest.raises(Exception, match="not those that were counted"):
        ngram.report(shaky).collect()
