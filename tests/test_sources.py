"""Files, the data source, streams and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from lexpack import cli
from lexpack.operators import codec, dictionary
from lexpack.sources import container, files, store
from lexpack.streaming import streams

RECORDS = [f'{{"id":{i},"user":"u{i % 7}","status":"ok","ms":{i * 31 % 400}}}'.encode() for i in range(80)]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(i, r) for i, r in enumerate(RECORDS)], "id long, data binary")


def options(path, **more):
    return {"path": str(path)} | more


def test_write_and_read(spark, rows, tmp_path):
    container.register(spark)
    for kind in ("index", "batch"):
        path = tmp_path / kind
        for _ in range(2):
            rows.repartition(3).sortWithinPartitions("id").select("data").write.format("lexpack").options(**options(path, kind=kind)).mode("overwrite").save()
        back = spark.read.format("lexpack").options(**options(path, records=7)).load()
        assert sorted(bytes(r.data) for r in back.collect()) == sorted(RECORDS)
        assert container.counts(spark, str(path)).agg(F.sum("records")).first()[0] == 80
        names = {p for p, _ in store.listed(str(path))}
        wanted = spark.read.format("lexpack").options(**options(path, ordinals="0,3,100000")).load().collect()
        assert len(wanted) == 2 * len(names) and {r.ordinal for r in wanted} == {0, 3}
        assert back.where("ordinal = 5").count() <= len(names) and back.count() == 80
        with pytest.raises(Exception, match="negative"):
            spark.read.format("lexpack").options(**options(path, ordinals="-1")).load().collect()
    (tmp_path / "none").mkdir()
    assert spark.read.format("lexpack").options(**options(tmp_path / "none")).load().count() == 0


def test_wanted_ordinals_read_only_their_streams(tmp_path, spark, rows):
    container.register(spark)
    path = tmp_path / "i"
    rows.coalesce(1).select("data").write.format("lexpack").options(**options(path)).mode("append").save()
    (name, size), = store.listed(str(path))
    blob = bytearray(store.get(name))
    blob[-5] ^= 255  # the last record is damaged: the byte before its checksum
    store.put(name, bytes(blob))
    back = spark.read.format("lexpack").options(**options(path)).load()
    assert bytes(spark.read.format("lexpack").options(**options(path, ordinals=5)).load().first().data) == RECORDS[5]
    with pytest.raises(Exception, match="vocabulary"):
        back.collect()


def test_dictionary_through_the_source(spark, rows, tmp_path):
    container.register(spark)
    d = container.handle(dictionary.train(rows))
    rows.select("data").write.format("lexpack").options(**options(tmp_path / "d", dictionary=d)).mode("append").save()
    back = spark.read.format("lexpack").options(**options(tmp_path / "d", dictionary=d)).load()
    assert sorted(bytes(r.data) for r in back.collect()) == sorted(RECORDS)


def test_streams(spark, rows, tmp_path):
    source, out, check = tmp_path / "in", tmp_path / "out", tmp_path / "check"
    rows.where("id < 50").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("id long, data binary").parquet(str(source))
    streams.to_containers(stream, str(out), str(check)).awaitTermination()
    rows.where("id >= 50").coalesce(1).write.mode("append").parquet(str(source))
    streams.to_containers(spark.readStream.schema("id long, data binary").parquet(str(source)), str(out), str(check)).awaitTermination()
    assert sorted(bytes(r.data) for r in spark.read.format("lexpack").options(**options(out)).load().collect()) == sorted(RECORDS)
    again = streams.from_containers(spark, str(out))
    again.writeStream.format("parquet").option("path", str(tmp_path / "back")).option("checkpointLocation", str(tmp_path / "check2")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(bytes(r.data) for r in spark.read.parquet(str(tmp_path / "back")).collect()) == sorted(RECORDS)
    shrunk = streams.compressed(spark.readStream.schema("id long, data binary").parquet(str(source)), "data")
    streams.decompressed(shrunk, "blob", name="again").select("id", "again", "error").writeStream.format("memory").queryName("again").trigger(availableNow=True).start().awaitTermination()
    assert {r.id: bytes(r.again) for r in spark.table("again").collect()} == dict(enumerate(RECORDS))
    streams.packed_batches(spark.readStream.schema("id long, data binary").parquet(str(source)).withColumn("k", F.lit(1)), ["k"], "data", "id", str(tmp_path / "packed"), str(tmp_path / "check3")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "packed")).agg(F.sum("n_records")).first()[0] == 80


def test_running_counts_drop_late_rows(spark, tmp_path):
    def put(name, values):
        spark.createDataFrame(values, "t string, w array<string>").select(F.to_timestamp("t").alias("t"), "w").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("t timestamp, w array<string>").parquet(str(tmp_path / "in"))
        q = streams.token_counts(stream, F.col("w"), "t", "10 minutes", "10 minutes").select("window.start", "token", "n")
        q.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    put("a", [("2024-01-01 00:01:00", ["x", "x"]), ("2024-01-01 00:05:00", ["x", "y"])])
    put("b", [("2024-01-01 02:00:00", ["z"])])
    put("c", [("2024-01-01 00:02:00", ["x"]), ("2024-01-01 04:00:00", ["z"])])
    found = {(str(r.start)[11:16], r.token): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found[("00:00", "x")] == 3 and found[("00:00", "y")] == 1


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    contents = {"a.bin": bytes(range(256)) * 4, "b.txt": b"hello\nworld\n", "c": b"only"}
    for n, d in contents.items():
        (tmp_path / "in" / n).write_bytes(d)
    assert files.compress_files(spark, str(tmp_path / "in"), str(tmp_path / "z")) == 3
    assert files.decompress_files(spark, str(tmp_path / "z"), str(tmp_path / "back")) == 3
    assert {p.name: p.read_bytes() for p in (tmp_path / "back").iterdir()} == contents
    (tmp_path / "s.jsonl").write_bytes(b"\n".join(RECORDS) + b"\r\n")
    assert [bytes(r.data) for r in files.samples(spark, str(tmp_path / "s.jsonl")).orderBy("ordinal").collect()] == RECORDS
    assert files.samples(spark, str(tmp_path / "in" / "a.bin")).count() >= 1
    from lexpack.functions.vocabulary import Vocabulary

    v = Vocabulary({**{bytes([b]): b for b in range(256)}, b"ab": 256})
    files.save_vocabulary(spark, v, str(tmp_path / "v"))
    assert files.vocabulary(spark, str(tmp_path / "v")).fingerprint == v.fingerprint
    assert files.write_records(spark.createDataFrame([(7, bytearray(b"x")), (12345, bytearray(b"y"))], "ordinal long, data binary"), str(tmp_path / "r")) == 2
    assert sorted(p.name for p in (tmp_path / "r").iterdir()) == ["0007.rec", "12345.rec"]


def test_command_line(spark, tmp_path, capsys):
    source = tmp_path / "s.jsonl"
    source.write_bytes(b"\n".join(RECORDS) + b"\n")
    run = lambda *a: cli.main([str(x) for x in a])
    run("fit", source, "-o", tmp_path / "m", "--size", 300)
    run("train-dict", source, "-o", tmp_path / "d")
    run("train-vocab", source, "-o", tmp_path / "v", "--size", 280, "--all")
    run("dict-info", tmp_path / "d")
    assert "context_tables" in capsys.readouterr().out
    for more in ([], ["--dict", tmp_path / "m" / "dictionary", "--vocab", tmp_path / "m" / "vocabulary"], ["--dict", tmp_path / "d"]):
        run("compress", source, "-o", tmp_path / "x.lxp", *more)
        run("decompress", tmp_path / "x.lxp", "-o", tmp_path / "x.out", *more)
        assert (tmp_path / "x.out").read_bytes() == source.read_bytes()
    run("c", source, "--fast")
    run("d", str(source) + ".lxp")
    assert (tmp_path / "s.jsonl.out").read_bytes() == source.read_bytes()
    run("pack", source, "-o", tmp_path / "p", "--indexed", "--partitions", 1)
    (one,) = (tmp_path / "p").iterdir()
    run("read", one, 5, "-o", tmp_path / "five")
    assert (tmp_path / "five").read_bytes() == RECORDS[5]
    with pytest.raises(SystemExit):
        run("read", one, 80)
    run("unpack", one, "-o", tmp_path / "u")
    assert [p.read_bytes() for p in sorted((tmp_path / "u").iterdir())] == RECORDS
    run("pack", source, "-o", tmp_path / "pb")
    run("bench", source, "--records")
    run("tokenize-stats", source)
    assert "mutual_information" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        run("compress", source, "--no-such-option")
    with pytest.raises(ValueError):
        run("compress", source, "--fast", "--dict", tmp_path / "d")


def test_store(tmp_path):
    store.put(str(tmp_path / "a" / "b.lxc"), b"1")
    store.put(f"file://{tmp_path}/a/c.lxc", b"22")
    assert [s for _, s in store.listed(str(tmp_path / "a"), ".lxc")] == [1, 2] and store.listed(str(tmp_path / "no")) == []
    assert store.get(f"file://{tmp_path}/a/c.lxc") == b"22" and json.dumps(store.listed(str(tmp_path / "a" / "b.lxc")))


def test_header_columns(spark, rows):
    h = rows.select(codec.parse_header()(codec.compress()("data")).alias("h")).select("h.*").first()
    assert h.size == len(RECORDS[0]) and h.crc and h.error is None
