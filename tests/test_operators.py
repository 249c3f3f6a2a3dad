"""Tokens, profiles, tables, training and codec columns on small tables."""

import lzma
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexpack import api
from lexpack.functions import lz, stream
from lexpack.functions.vocabulary import Vocabulary
from lexpack.operators import codec, containers, dictionary, profile, regimes, tables, tokens, training

RECORDS = [f'{{"user":"u{i % 13}","action":"click","page":"/home","ts":{1700000000 + i * 37}}}' for i in range(120)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, r.encode()) for i, r in enumerate(RECORDS)], "id long, data binary").cache()


def test_pieces_join_to_the_text(spark):
    texts = ["", " ", "it's  we'll x1 22\t\n--ok", "naïve café 日本 x", None, "a b c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = {r.i: r.p for r in df.select("i", tokens.pieces(F.col("t")).alias("p")).collect()}
    for i, t in enumerate(texts):
        assert (found[i] is None) if t is None else "".join(found[i]) == t


def test_byte_ids_and_invalid_text(spark):
    data = [bytes(range(256)), b"", b"\xff\xfe", "é".encode(), None]
    df = spark.createDataFrame([(i, None if d is None else bytearray(d)) for i, d in enumerate(data)], "i int, d binary")
    made = df.select("i", tokens.byte_ids(F.col("d")).alias("x"), tokens.from_byte_ids(tokens.byte_ids(F.col("d"))).alias("b"), tokens.byte_pieces(F.col("d")).alias("p"))
    for r in made.collect():
        if data[r.i] is None:
            assert r.x is None
        else:
            assert r.x == list(data[r.i]) and bytes(r.b) == data[r.i] and b"".join(bytes(p) for p in r.p) == data[r.i]


def test_records_of_files(spark):
    raw = ["a\nb\r\n\nc", "a\nb", "", None, "x\n\n\n", "\r\n\r\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "i int, t string")
    found = {r.i: r.r for r in df.select("i", tokens.records(F.col("t")).alias("r")).collect()}
    assert found == {0: ["a", "b", "c"], 1: ["a\nb"], 2: [""], 3: None, 4: ["x"], 5: []}


def test_profile_is_that_of_one_record(spark):
    data = [("a", b"abracadabra"), ("b", b""), ("c", b"zz"), (None, b"nulls have keys too")]
    df = spark.createDataFrame(data, "k string, d binary")
    for r in profile.profile(df, ["k"], tokens.byte_ids(F.col("d")), F.octet_length("d")).collect():
        want = api.token_stats(dict(data)[r.k])
        for name, value in want.items():
            assert r[name] == pytest.approx(value, abs=1e-6), (r.k, name)
    one = api.token_stats(b"abab" * 50)
    assert one["h0"] >= one["h1"] >= 0


def test_normalised_tables_are_those_of_the_coder(spark):
    from lexpack.functions.ans import normalise

    cases = {"one": [7], "few": [500, 300, 150, 50], "lifted": [10**7] + [1] * 900, "even": [1] * 1000, "large": [3 * 10**12, 5, 1]}
    df = spark.createDataFrame([(k, i, c) for k, x in cases.items() for i, c in enumerate(x)], "k string, s int, n long")
    found = tables.cumulative(tables.normalised(df, ["k"], "s", "n"), ["k"], "s").collect()
    for k, counts in cases.items():
        own = sorted((r for r in found if r.k == k), key=lambda r: r.s)
        assert [r.freq for r in own] == normalise(counts).tolist()
        assert [r.start for r in own] == [sum(x.freq for x in own[:i]) for i in range(len(own))] or len(own) > 1000


def test_top_and_contexts_have_fixed_ties(spark):
    df = spark.createDataFrame([("k", s, n) for s, n in ((5, 3), (1, 3), (9, 4), (2, 1))], "k string, s int, n long")
    assert [r.s for r in tables.top(df, ["k"], "s", "n", 3).orderBy("rank").collect()] == [9, 1, 5]
    pairs = spark.createDataFrame([(1, 2, 19), (2, 1, 20), (3, 1, 30), (3, 2, 5), (4, 4, 20)], "a int, b int, n long")
    assert {(r.a, r.total, r.escape) for r in tables.contexts(pairs, 20, 2).collect()} == {(3, 35, 2), (2, 20, 1)}


def test_code_length_is_near_the_coded_size(spark):
    data = b"the cat sat on the mat and the dog sat on the cat " * 40
    df = spark.createDataFrame([(1, b) for b in data], "id int, s int")
    table = tables.normalised(df.groupBy("id", "s").count(), ["id"], "s", "count").withColumnRenamed("count", "n")
    bits = tables.code_length(df, table, ["id"], ["id"], "s").first().bits
    from lexpack.functions import ans

    counts = Counter(data)
    t = ans.Table.of(sorted(counts), [counts[s] for s in sorted(counts)])
    assert abs(len(ans.flush([t.interval(s) for s in data])) - bits / 8) < 14


def test_codec_columns(spark, rows):
    wide = rows.select("id", "data", codec.compress()("data").alias("b")).unionByName(spark.createDataFrame([(-1, None, None), (-2, bytearray(b""), bytearray(api.compress(b"")))], "id long, data binary, b binary"))
    out = wide.select("id", "data", codec.decompress()("b").alias("x"), codec.parse_header()("b").alias("h")).collect()
    assert all(r.x == r.data for r in out) and {r.h.mode for r in out if r.id == -2} == {"empty"}
    bad = wide.where("id >= 0").select(codec.try_decompress()(F.expr("substring(b, 1, octet_length(b) - 3)")).alias("x")).collect()
    assert all(r.x.data is None and r.x.error for r in bad)
    with pytest.raises(ValueError):
        codec.compress(dictionary=object(), fast=True)


def test_sql_functions(spark):
    codec.register(spark)
    r = spark.sql("SELECT lex_decompress(lex_compress(encode('abcabcabc', 'UTF-8'))) AS d, lex_tokens(encode('ab', 'UTF-8')) AS t, lex_header(lex_compress(encode('x', 'UTF-8'))).size AS n").first()
    assert bytes(r.d) == b"abcabcabc" and r.t == [97, 98] and r.n == 1


def test_events_as_columns(spark, rows):
    made = rows.select("data", codec.lz_events()("data").alias("e"))
    split = made.select("data", codec.lz_replay()("e").alias("back"), codec.literals(F.col("e")).alias("l"), codec.matches(F.col("e")).alias("m"), "e").collect()
    for r in split:
        own = lz.parse(list(r.data))
        assert r.back == r.data and len(r.l) == sum(not x[0] for x in own) and [(m.high * 256 + m.low, m.length) for m in r.m] == [x[1:] for x in own if x[0]]


@pytest.mark.parametrize("picker", dictionary.PICKERS)
def test_dictionaries(spark, rows, picker, tmp_path):
    train, held = regimes.side(rows, 1)
    assert train.join(held, "id").count() == 0 and train.count() + held.count() == rows.count()
    d = dictionary.train(train, picker=picker, max_priming=1024)
    again = dictionary.train(train.repartition(3), picker=picker, max_priming=1024)
    assert d.fingerprint == again.fingerprint
    out = held.select("data", codec.compress(dictionary=d)("data").alias("with"), codec.compress()("data").alias("without")).collect()
    assert sum(len(r["with"]) for r in out) < sum(len(r["without"]) for r in out)
    assert all(stream.decompress(bytes(r["with"]), Vocabulary(), d) == r.data for r in out)
    d.save(spark, str(tmp_path / "d"))
    loaded = dictionary.Dictionary.load(spark, str(tmp_path / "d"))
    assert loaded.fingerprint == d.fingerprint and loaded.info() == d.info() and d.info()["priming"] <= 1024
    blob = stream.compress(b"x" * 3 + RECORDS[0].encode(), Vocabulary(), d, mode=stream.DICTIONARY)
    with pytest.raises(ValueError, match="dictionary"):
        stream.decompress(blob, Vocabulary())


def test_dictionary_corners(spark):
    short = spark.createDataFrame([(i, f"u{i}".encode()) for i in range(20)], "id long, data binary")
    assert dictionary.train(short).priming == []
    for data in ([], [(1, bytearray(b""))], [(1, None)]):
        d = dictionary.train(spark.createDataFrame(data, "id long, data binary"))
        assert stream.decompress(stream.compress(b"anything", Vocabulary(), d), Vocabulary(), d) == b"anything"
    with pytest.raises(ValueError):
        dictionary.train(short, picker="best")


def test_unknown_dictionaries_are_found_before_decoding(spark, rows):
    d = dictionary.train(rows)
    blobs = rows.select("id", codec.compress(dictionary=d)("data").alias("blob"))
    empty = spark.createDataFrame([], "fingerprint string")
    known = spark.createDataFrame([(d.fingerprint.hex(),)], "fingerprint string")
    assert codec.unknown(blobs, empty).count() > 0 and codec.unknown(blobs, known).count() == 0


def test_vocabulary_training(spark, rows):
    v = training.train(rows, 400, sample_bytes=None)
    assert len(v.ranks) == 400 and training.train(rows.repartition(5), 400, sample_bytes=None).fingerprint == v.fingerprint
    ranks = spark.createDataFrame([(t, i) for t, i in v.ranks.items()], "token binary, rank int")
    assert training.broken(ranks).count() == 0
    assert training.broken(ranks.unionByName(spark.createDataFrame([(bytearray(b"\x00\x01\x02"), 400)], "token binary, rank int"))).count() == 1
    head = training.train(rows, 300, sample_bytes=500)
    assert len(head.ranks) <= 300
    for size in (256, 65537):
        with pytest.raises(ValueError):
            training.train(rows, size)


def test_head_is_a_prefix_of_the_corpus(spark, rows):
    whole = b"".join(r.encode() for r in RECORDS)
    got = b"".join(bytes(r.data) for r in training.head(rows, "data", "id", 1000).orderBy("id").collect())
    assert got == whole[:1000]


def test_pair_counts(spark):
    df = spark.createDataFrame([(1, bytearray(b"aab aab")), (2, bytearray(b"\xff\xfe\xfd"))], "id long, data binary")
    assert {r.pair: r.n for r in training.pair_counts(df).collect()} == {"6161": 2, "6162": 2, "6220": 1, "FFFE": 1, "FEFD": 1}


def test_coverage_and_segments_by_hand(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "b", "c"]), (3, [])], "id long, tokens array<string>")
    assert {r.id: r.score for r in dictionary.coverage(df).collect()} == {1: round(math.log(2) + math.log(3), 6), 2: round(math.log(3) + math.log(2), 6)}
    long = spark.createDataFrame([(1, list(range(600))), (2, list(range(256))), (3, [])], "id long, tokens array<int>")
    assert {(r.id, r.start, len(r.tokens)) for r in dictionary.segments(long, ["id"]).collect()} == {(1, 0, 256), (1, 128, 256), (1, 256, 256), (1, 384, 216), (2, 0, 256)}


def test_containers(spark, rows):
    keyed = rows.withColumn("k", F.when(F.col("id") < 100, F.lit("hot")).otherwise(F.lit("b"))).unionByName(spark.createDataFrame([(500, None, "b"), (501, bytearray(b""), None)], "id long, data binary, k string"))
    for kind in ("batch", "index"):
        packed = containers.pack(keyed, ["k"], "data", "id", kind=kind, most_bytes=2000).cache()
        assert packed.where("n_bytes > 2000 and n_records > 1").count() == 0 and packed.where("k = 'hot'").count() >= 4
        back = containers.unpack(packed.select("k", "first", "blob"), "blob").collect()
        want = [(r.k, bytes(r.data)) for r in keyed.where("data is not null").orderBy("k", "id").collect()]
        assert [(r.k, bytes(r.data)) for r in sorted(back, key=lambda r: (r.k is not None, r.k or "", r.first, r.ordinal))] == want
        assert packed.select(F.sum(containers.count()("blob"))).first()[0] == len(want)
    first = packed.select("first", containers.read(0)("blob").alias("d")).collect()
    assert all(bytes(r.d) == (RECORDS[r.first].encode() if r.first < 500 else b"") for r in first)


def test_container_bytes():
    from lexpack.functions import container

    v, records = Vocabulary(), [b"", b"\0", b"\xff" * 500, RECORDS[0].encode(), "😀".encode(), b"x" * 4000]
    batch, index = api.pack(records), api.index(records)
    assert list(api.unpack(batch)) == list(api.unpack(index)) == records and list(api.unpack(api.compress(b"one"))) == [b"one"]
    assert container.count(batch) == container.count(index) == 6 and [api.read_at(index, i) for i in range(6)] == records
    for i in (-1, 6):
        with pytest.raises(IndexError):
            api.read_at(index, i)
    lengths, inner = container.batch_lengths(batch)
    wrong = batch[:9] + bytes([1]) + batch[10:]
    with pytest.raises(ValueError):
        list(container.unpack(wrong, v))
    for blob in (batch[:7], index[:12], index[:-1], b"nothing", index[:4] + b"\x07" + index[5:]):
        with pytest.raises(ValueError):
            list(container.unpack(blob, v))
    many = [r.encode() for r in RECORDS]
    assert len(api.pack(many)) < sum(map(len, api.compress_each(many)))
    assert list(api.unpack(api.pack([]))) == [] and list(api.unpack(api.index([]))) == []


def test_index_table(spark, rows):
    t = containers.index_table(rows.withColumn("k", F.lit(1)), ["k"], "id", F.col("data")).orderBy("ordinal").collect()
    assert [r.ordinal for r in t] == list(range(120)) and all(a.offset + a.n_bytes == b.offset for a, b in zip(t, t[1:], strict=False))
    assert containers.record(rows.withColumn("k", F.lit(1)), ["k"], "id", 7).first().id == 7
    with pytest.raises(IndexError):
        containers.record(rows, ["id"], "id", -1)


def test_regimes(spark, rows):
    out = regimes.each(rows, "logs", fast=True).unionByName(regimes.batches(rows, "logs")).unionByName(regimes.trained(rows, "logs", (1, 2), max_priming=512)).unionByName(regimes.ablation(rows, "logs"))
    found = {(r.regime, r.backend): r for r in regimes.summary(out).collect()}
    assert found["records", "gzip"].ratio < 1.5 and found["dictionary", "lexpack+dictionary"].ratio < found["dictionary", "lexpack"].ratio
    assert found["batch", "lexpack"].ratio < found["records", "lexpack"].ratio and found["dictionary", "lexpack"].splits == 2
    assert found["ablation", "+contexts"].ratio <= found["ablation", "order0"].ratio <= found["ablation", "none"].ratio
    assert out.columns == list(regimes.COLUMNS)


def test_direct_coding_beside_ids_under_lzma(spark, rows):
    v = training.train(rows, 300, sample_bytes=None)
    out = regimes.direct(rows, "logs", v)
    found = {r.backend: r for r in out.collect()}
    ids = [lzma.compress(b"".join(i.to_bytes(3, "big") for i in v.encode(r.encode())), preset=9 | lzma.PRESET_EXTREME) for r in RECORDS]
    assert found["ids+lzma"].bytes_out == sum(map(len, ids)) and found["lexpack"].bytes_out == sum(len(stream.compress(r.encode(), v)) for r in RECORDS)
    won = regimes.winners(out).first()
    assert won.winner == min(found, key=lambda b: found[b].bytes_out) and math.isclose(won.delta, won.first - won.second)
    assert regimes.winners(out, "lexpack", "lexpack").first().winner == "tie" and regimes.winners(out, "lexpack", "none").first().winner is None
    odd = spark.createDataFrame([(None,), (b"",)], "data binary").select(codec.ids_lzma()("data").alias("n")).collect()
    assert odd[0].n is None and odd[1].n == len(lzma.compress(b"", preset=9 | lzma.PRESET_EXTREME))


def test_attribution_of_a_batch(spark, rows):
    found = {r.backend: r for r in regimes.attribution(rows, "logs", max_priming=512).collect()}
    held = [bytes(r.data) for r in regimes.side(rows, 1)[1].orderBy("id").collect()]
    assert len(found) == 7 and all((r.n, r.bytes_in) == (len(held), sum(map(len, held))) for r in found.values())
    out = {k: r.bytes_out for k, r in found.items()}
    assert out["record"] == sum(len(stream.compress(r, Vocabulary())) for r in held)
    assert out["record+dictionary"] <= min(out["record"], out["record, dictionary layout"])
    assert out["batch+dictionary"] <= min(out["batch"], out["batch, dictionary layout"]) < out["record"]
    assert 0 < out["batch header"] < out["batch+dictionary"]


def test_schemas(spark, rows):
    other = spark.createDataFrame([(i, f"name={i % 7};size={i}".encode()) for i in range(80)], "id long, data binary")
    found = regimes.schemas({"logs": rows, "fields": other}, max_priming=256).collect()
    assert {r.corpus for r in found} == {"logs", "fields"} and {r.regime for r in found} == {"schemas"} and len(found) == 8


def test_benchmark_and_stats():
    r = api.benchmark("\n".join(RECORDS))
    assert r["lossless"] and 0 < r["ratio"] < 1
    assert api.token_stats(b"")["h0"] == 0 and api.decompress_each(api.compress_each(RECORDS)) == [r.encode() for r in RECORDS]


def slow_cover(rows, most, length, d, discount):
    """Every segment scored anew before each pick."""
    segs = []
    for i, t in sorted(rows):
        at = 0
        while t:
            segs.append((i, at, t[at : at + length]))
            if at + length >= len(t):
                break
            at += max(1, length // 2)
    freq = Counter(tuple(t[k : k + d]) for _, t in rows for k in range(len(t) - d + 1))
    first = {}
    for i, at, t in segs:
        first.setdefault(tuple(t), (i, at))
    segs.sort(key=lambda s: (first[tuple(s[2])], s[0], s[1]))
    out, size = [], 0
    while segs and size < most:
        score = lambda s: round(sum(math.log1p(freq[tuple(s[2][k : k + d])]) for k in range(len(s[2]) - d + 1)), 9)
        best = max(segs, key=score)
        if score(best) <= 0:
            break
        segs.remove(best)
        out += best[2]
        size += len(best[2])
        for k in range(len(best[2]) - d + 1):
            freq[tuple(best[2][k : k + d])] = int(freq[tuple(best[2][k : k + d])] * discount)
    return out[:most]


def slow_diverse(rows, most):
    df, covered, left, out = Counter(t for _, x in rows for t in set(x)), set(), sorted(rows), []
    size = 0
    while left and size < most:
        gain = lambda r: round(sum(math.log1p(df[t]) for t in dict.fromkeys(r[1]) if t not in covered), 9)
        best = max(left, key=gain)
        if gain(best) <= 0:
            break
        left.remove(best)
        covered |= set(best[1])
        out += best[1]
        size += len(best[1])
    return out[:most]


@pytest.mark.parametrize("pool", [1, 4, 1000])
def test_greedy_pickers_are_those_of_all_candidates(spark, monkeypatch, pool):
    import random

    monkeypatch.setattr(dictionary, "POOL", pool)
    r = random.Random(pool)
    rows = [(i, [r.randrange(6) for _ in range(r.choice((0, 3, 9, 20, 40)))]) for i in range(30)] + [(30 + i, [1, 2, 3, 4, 5] * 4) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, tokens array<int>")
    for most in (12, 60, 10_000):
        assert dictionary.priming(df, "cover", most, 16, 4, 0.3) == slow_cover(rows, most, 16, 4, 0.3)
        assert dictionary.priming(df, "diverse", most) == slow_diverse(rows, most)
    concat = [t for _, x in rows for t in x]
    assert dictionary.priming(df, "concat", 50) == concat[:50]


def test_greedy_pickers_go_on_beyond_the_largest_pool(spark, monkeypatch):
    import random

    monkeypatch.setattr(dictionary, "POOL", 2)
    monkeypatch.setattr(dictionary, "MOST_POOL", 4)
    r = random.Random(11)
    rows = [(i, [r.randrange(6) for _ in range(r.choice((3, 9, 20, 40)))]) for i in range(30)] + [(30 + i, [1, 2, 3, 4, 5] * 4) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, tokens array<int>")
    assert dictionary.priming(df, "cover", 160, 16, 4, 0.3) == slow_cover(rows, 160, 16, 4, 0.3)
    assert dictionary.priming(df, "diverse", 60) == slow_diverse(rows, 60)


def test_candidates_reach_the_driver_once_at_most(spark, monkeypatch):
    rows = [(i, list(f"{i}|{'click' if i % 2 else 'purchase'}|{i % 7}".encode())) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, tokens array<int>")
    monkeypatch.setattr(dictionary, "MOST_POOL", 16)
    sent, receive = [], dictionary.Pool.receive
    monkeypatch.setattr(dictionary.Pool, "receive", lambda self, group, found, more, hot: (sent.append(len(found)), receive(self, group, found, more, hot))[1])
    assert dictionary.priming(df, "cover", 200) == slow_cover(rows, 200, 256, 8, 0.3)
    assert sum(sent) <= len(rows)


def test_small_scans_are_dealt_out(spark, tmp_path):
    from lexpack.session import spread

    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    df = spark.read.parquet(str(tmp_path / "one"))
    cores = spark.sparkContext.defaultParallelism
    for steady in (False, True):
        out = spread(df, steady)
        assert out.rdd.getNumPartitions() == cores and sorted(r.id for r in out.collect()) == list(range(100))
    wide = df.repartition(cores + 1)
    assert spread(wide) is wide


@pytest.mark.parametrize(("block", "bucket", "length", "d"), [(1 << 20, 1 << 21, 16, 4), (40, 30, 16, 4), (1, 5, 7, 3), (100, 1000, 3, 5), (25, 50, 1, 1)])
def test_segment_scores_by_blocks(spark, block, bucket, length, d):
    """Keys that repeat or are null, rows of few tokens and copies; sums do not depend on how rows are cut into blocks."""
    r = __import__("random").Random(6)
    rows = [(r.choice([None, *range(60)]), None if r.random() < 0.1 else [r.choice("abc") for _ in range(r.choice((0, 1, 3, 4, 5, 16, 17, 40, 90)))]) for _ in range(150)]
    rows += [(100 + i, list("abcabcabca") * 4) for i in range(30)]
    freq = __import__("collections").Counter(tuple(t[i : i + d]) for _, t in rows if t for i in range(len(t) - d + 1))
    want: dict = {}
    step = max(1, length // 2)
    for key, t in rows:
        for k in range(0 if not t else 1 if len(t) <= length else -(-(len(t) - length) // step) + 1):
            own = t[k * step : k * step + length]
            if len(own) >= d:
                want[key, k * step] = want.get((key, k * step), 0) + sum(math.log1p(freq[tuple(own[i : i + d])]) for i in range(len(own) - d + 1))
    df = spark.createDataFrame(rows, "id long, tokens array<string>").repartition(5, "id")
    made = dictionary.segment_scores(df, length=length, d=d, block=block, bucket=bucket)
    found = {(x.id, x.start): x.score for x in made.collect()}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k], abs=2e-6) for k in want)
    assert made.dtypes == [("id", "bigint"), ("start", "int"), ("score", "double")]


def test_segment_scores_exchange_arrays(spark, sf_dir):
    """No row a d-mer, no join; a block whose answers don't come fails the job."""
    import numpy as np
    import pyarrow as pa

    from lexpack.plans import queries

    plan = queries.queries()["segment_scores"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "explode" not in plan and "Join" not in plan
    row = dictionary._rows([(0, "0-0", -3, dictionary._planes(np.arange(3, dtype=np.int32)), [10])], pa.array([7]), pa.int64())
    with pytest.raises(RuntimeError, match="missing"):
        list(dictionary._scores(iter([row]), 256, 128, 8))


def test_one_row_group_of_many_splits_is_dealt_out(spark, tmp_path):
    """Splits beyond the number of cores, of which one has all rows."""
    from lexpack.session import spread

    path, cores, key = str(tmp_path / "group"), spark.sparkContext.defaultParallelism, "spark.sql.files.maxPartitionBytes"
    spark.range(20000).selectExpr("id", "sha2(cast(id as string), 256) as x").coalesce(1).write.parquet(path)
    spark.conf.set(key, "65536")
    try:
        df = spark.read.parquet(path)
        assert df.rdd.getNumPartitions() > cores
        for steady in (False, True):
            each = spread(df, steady).groupBy(F.spark_partition_id().alias("p")).count().collect()
            assert sum(r["count"] for r in each) == 20000 and max(r["count"] for r in each) * cores <= 2 * 20000
    finally:
        spark.conf.unset(key)


def test_merges_on_the_cluster_are_those_on_the_driver(spark):
    r = __import__("random").Random(4)
    words = ["".join(r.choice("abcde") for _ in range(r.randint(1, 9))) for _ in range(300)] + ["aaaaaaa", "bb"] * 5
    df = spark.createDataFrame([(i, bytearray(w.encode())) for i, w in enumerate(words)], "id long, data binary")
    here, there = (training.train(df, 290, sample_bytes=None, few_pieces=k) for k in (10**6, 0))
    assert here.ranks == there.ranks and len(here.ranks) == 290


def test_merges_foretold_wrong_are_mended(spark, monkeypatch):
    monkeypatch.setattr(training, "FORETELL", 20)
    r = __import__("random").Random(5)
    words = ["".join(r.choice("abcde") for _ in range(r.randint(2, 7))) for _ in range(200)]
    df = spark.createDataFrame([(i, bytearray(w.encode())) for i, w in enumerate(words)], "id long, data binary")
    rounds, copy = [], training.Text.copy
    monkeypatch.setattr(training.Text, "copy", lambda self: (rounds.append(1), copy(self))[1])
    here, there = (training.train(df, 270, sample_bytes=None, few_pieces=k) for k in (10**6, 0))
    assert here.ranks == there.ranks and 1 < len(rounds)


def test_code_length_with_null_and_empty_keys(spark):
    events = spark.createDataFrame([(1, None, 7), (1, None, 7), (2, "", 7)], "id int, source string, symbol int")
    own = spark.createDataFrame([(None, 7, 1 << 15), ("", 7, 1 << 14)], "source string, symbol int, freq long")
    assert {x.id: x.bits for x in tables.code_length(events, own, ["source"], ["id"], "symbol").collect()} == {1: 2.0, 2: 2.0}


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    from lexpack import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
