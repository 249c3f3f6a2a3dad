import numpy as np
import pytest

from lexpack.llm import queries, tokencount
from lexpack.llm.text import pieces


def brute(rows):
    e = tokencount.encoder(tokencount.TOKENIZER)
    return sorted(((d, len(e.encode_ordinary(t or ""))) for d, t in rows), key=lambda r: (r[0] is None, r))


def got(df):
    return sorted(((r.doc_id, r.n_tokens) for r in df.collect()), key=lambda r: (r[0] is None, r))


def test_whole_table(spark, sf_dir, plain):
    assert got(queries.queries()["op5_token_counts"](spark, sf_dir)) == brute([r[:2] for r in plain])


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_blocks_of_any_size(spark, plain, block):
    rows = [(d, (t or "")[:300]) for d, t, _, _ in plain[:30]] + [(None, None), (-1, ""), (-1, ""), (-2, "x" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(tokencount.report(df, block_bytes=block)) == brute(rows)


def test_edges(spark, odd, clash, nothing):
    want = brute([(r.doc_id, r.text) for r in odd.collect()])
    assert got(tokencount.report(odd)) == want and got(tokencount.report(clash)) == want
    assert tokencount.report(nothing).count() == 0


@pytest.mark.parametrize("block", [2, 4, 10, 1000])
def test_flat_files(spark, tmp_path, block):
    r = np.random.default_rng(block)
    want, paths = [], []
    for k, lengths in enumerate(([0, 0, 3], [70], [], [1, 0, 25, 2, 0], [5, 40])):
        ids = np.concatenate([np.append(r.integers(0, 50000, n), tokencount.END) for n in lengths] or [np.zeros(0)]).astype("<u2")
        if k in (1, 4):
            ids = ids[:-1]  # the last document isn't closed
        p = tmp_path / f"{k}.bin"
        p.write_bytes(ids.tobytes())
        paths.append(str(p))
        want += [(str(p), i, n) for i, n in enumerate(lengths)]
    found = tokencount.count_files(spark, spark.createDataFrame([(p,) for p in paths], "path string"), block_bytes=block)
    assert sorted((x.path, x.ordinal, x.n_tokens) for x in found.collect()) == sorted(want)


def test_files_of_odd_size_are_refused(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"123")
    with pytest.raises(Exception, match="multiple"):
        tokencount.count_files(spark, spark.createDataFrame([(str(tmp_path / "a.bin"),)], "path string")).collect()
    four = tmp_path / "b.bin"
    four.write_bytes(np.array([1, 2, 9, 3, 9, 9], "<u4").tobytes())
    found = tokencount.count_files(spark, spark.createDataFrame([(str(four),)], "path string"), end=9, dtype="<u4", block_bytes=8)
    assert sorted(x.n_tokens for x in found.collect()) == [0, 1, 2]


@pytest.mark.parametrize("run", ["   ", " \n\t ", "\u00a0 \u00a0", " \u3000 ", "\u2028 \x0b", "\x85  "])
def test_cuts_at_every_offset_of_a_run_of_blanks(run):
    """A text in pieces has as many tokens as the whole one, wherever the limit falls."""
    e = tokencount.encoder(tokencount.TOKENIZER)
    for text in (f"some words{run}é{run}and more{run}日本{run}.{run}", f"{run}it's{run}here {run} 12{run}é é"):
        raw, whole = text.encode(), e.encode_ordinary(text)
        for limit in range(len(raw) + 1):
            parts = list(pieces(raw, limit)) if limit else [raw]
            assert b"".join(parts) == raw
            assert [x for p in parts for x in e.encode_ordinary(p.decode())] == whole


def test_long_texts_with_runs_of_blanks(spark):
    rows = [(k, "word " * ((1 << 20) // 5 - 1) + "x" * k + " " * 7 + "tail of words " * 20) for k in range(9)]
    assert got(tokencount.report(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
