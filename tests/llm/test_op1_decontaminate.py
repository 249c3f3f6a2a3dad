import hashlib
import random
import re

import duckdb
import pytest

from lexpack.llm import decontaminate, queries

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return [] if text is None else WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))


def brute(docs, items, window=10):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    sizes = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                own = windows.get(tuple(w[k : k + n]))
                if own:
                    hit.update(range(k, k + n))
                    found |= {str(i) for i in own if i is not None}
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def key(r):
    return [(x is None, x) for x in r]


def found(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()), key=key)


def test_whole_table_and_sql(spark, sf_dir, plain):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = found(queries.queries()["op1_decontaminate"](spark, sf_dir))
    assert got == sorted(brute([r[:2] for r in plain], items), key=key) and any(r[-1] for r in got) and not all(r[-1] for r in got)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert sorted(con.execute(f"SELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated FROM ({queries.OP1_SQL})").fetchall(), key=key) == got


@pytest.mark.parametrize("k", [1, 4, 10])
def test_random_texts_in_blocks(spark, k):
    r = random.Random(k)
    text = lambda n: " ".join(r.choice("abc") for _ in range(n))
    items = [(i, text(r.choice((0, 1, 3, 9, 10, 11, 25)))) for i in range(12)] + [(3, text(14)), (None, text(10)), (99, None)]
    docs = [(i, text(r.choice((0, 2, 12, 80)))) for i in range(40)] + [(1, items[6][1]), (None, items[5][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute(docs, items), key=key)
    assert found(decontaminate.report(d, b, k=k)) == want
    assert found(decontaminate.report(d, b, k=k, block_bytes=60)) == want


def test_edges(spark, odd, clash, nothing):
    bench = spark.createDataFrame([(1, "one"), (2, "SAME text, in two rows of a table"), (3, None), (4, "!!!"), (5, " ".join(["word"] * 12))], "item_id long, text string")
    got = {(r.doc_id, r.n_words): r for r in decontaminate.report(odd, bench).collect()}
    assert got[4, 1].contaminated and got[11, 8].n_items == 1 and got[8, 60000].n_hit == 60000 and not got[7, 1].contaminated and got[None, 0].n_items == 0
    kept = decontaminate.decontaminate(clash, bench)
    assert kept.columns == clash.columns and {r.spans for r in kept.collect()} == {"own spans"}
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 1, 2, 3, 7, 9, 10]
    assert decontaminate.report(nothing, bench).count() == 0 and decontaminate.decontaminate(odd, bench.limit(0)).count() == odd.count()
    with pytest.raises(ValueError):
        decontaminate.hits(odd, bench, k=11)


def test_every_long_shared_span_has_a_common_fingerprint():
    import numpy as np

    r = np.random.default_rng(1)
    for _ in range(200):
        span = r.integers(0, 4, 10)
        a, b = (np.concatenate([r.integers(0, 4, n), span, r.integers(0, 4, 15 - n)]) for n in r.integers(0, 15, 2))
        prints = []
        for x in (a, b):
            h = decontaminate.gram_hashes(x, 5)
            prints.append(set(h[decontaminate.winnowed(h, np.arange(len(x) - 9), 6)].tolist()))
        assert prints[0] & prints[1]


def test_long_text_across_pieces(spark):
    needle = " ".join(f"n{i}" for i in range(10))
    text = "filler " * 200_000 + needle + " filler" * 10
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    b = spark.createDataFrame([(7, needle)], "item_id long, text string")
    r = decontaminate.report(d, b).first()
    assert (r.n_hit, r.n_items, r.n_words) == (10, 1, 200_020)
    assert decontaminate.hits(d, b).first().spans[0].asDict() == {"start": 200_000, "end": 200_010}


def test_windows_of_equal_hashes_are_told_apart_by_their_bytes(monkeypatch):
    import numpy as np

    items = [("a", b"1 2 3"), ("b", b"1 2 3 4 5 6 7 8 9 10 11"), ("c", b"4 2 3"), ("a", b"3 2 1 3 2 1"), ("d", b"4 2 3"), ("e", b"")]
    texts = [b"0 1 2 3 0 4 2 3", None, b"1 2 3 4 5 6 7 8 9 10 11 3 2 1 3 2 1", b"", b"2 3 1"]
    want = None
    for constant in (False, True):
        if constant:
            real = decontaminate.gram_hashes
            monkeypatch.setattr(decontaminate, "gram_hashes", lambda *a: np.zeros_like(real(*a)))
        index, words = decontaminate.build_index(items), decontaminate.Words.of(texts)
        found = sorted((s, n, tuple(index.items[i] for i in own)) for s, n, own in decontaminate.scan(words, index))
        assert want is None or found == want
        want = found
    assert (1, 3, ("a",)) in want and (5, 3, ("c", "d")) in want and len(want) == 1 + 1 + 1 + 2 + 1


def test_index_is_a_few_times_its_text():
    import pickle
    import random

    r = random.Random(3)
    items = [(str(i), " ".join(f"{r.getrandbits(24):x}" for _ in range(80)).encode()) for i in range(4000)]
    assert len(pickle.dumps(decontaminate.build_index(items))) < 7 * sum(len(t) for _, t in items)


def test_hashes_of_words_depend_on_the_word_alone():
    r = __import__("random").Random(5)
    texts = [" ".join("".join(r.choice("abé") for _ in range(r.choice((1, 2, 30)))) for _ in range(r.randrange(50))).encode() for _ in range(60)]
    w = decontaminate.Words.of([*texts, b"x" * (3 << 20), b" ", None])
    flat = [x for t in texts for x in words(t.decode())]
    known = dict(zip(flat, w.hashes.tolist()))
    assert [known[x] for x in flat] == w.hashes[: len(flat)].tolist() and len(set(known.values())) == len(known)
    assert len(w.hashes) == len(flat) + 1 and w.first.tolist()[-3:] == [len(flat) + 1] * 3
