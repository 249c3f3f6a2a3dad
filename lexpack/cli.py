"""The command line: ``python -m lexpack COMMAND ...``. An unknown option is an error."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexpack.functions import container
from lexpack.functions.vocabulary import Vocabulary
from lexpack.operators import codec, containers, dictionary, profile, tokens, training
from lexpack.operators.dictionary import Dictionary
from lexpack.session import ship
from lexpack.sources import files, store

SUFFIX = ".lxp"


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.appName("lexpack").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def models(spark: SparkSession, a: argparse.Namespace) -> tuple[Vocabulary | None, Dictionary | None]:
    v = files.vocabulary(spark, a.vocab) if getattr(a, "vocab", None) else None
    d = Dictionary.load(spark, a.dict) if getattr(a, "dict", None) else None
    return v, d


def one(df: DataFrame) -> bytes:
    rows = df.collect()
    if len(rows) != 1:
        raise SystemExit("exactly one input file is needed")
    return bytes(rows[0][0])


def corpus(spark: SparkSession, paths: list[str]) -> DataFrame:
    return files.numbered(files.samples(spark, paths))


def do_compress(spark, a) -> None:
    v, d = models(spark, a)
    raw = files.binary(spark, a.input)
    out = a.output or a.input + SUFFIX
    blob = one(raw.select(codec.compress(v, d, not a.no_integrity, a.fast)("data")))
    store.put(out, blob)
    n = raw.agg(F.sum(F.octet_length("data"))).first()[0]
    print(f"{out}: {n} -> {len(blob)} bytes ({len(blob) / max(1, n):.4f})")


def do_decompress(spark, a) -> None:
    v, d = models(spark, a)
    out = a.output or (a.input[: -len(SUFFIX)] + ".out" if a.input.endswith(SUFFIX) else a.input + ".decompressed")
    data = one(files.binary(spark, a.input).select(codec.decompress(v, d)("data")))
    store.put(out, data)
    print(f"{out}: {len(data)} bytes")


def do_bench(spark, a) -> None:
    v, d = models(spark, a)
    rows = corpus(spark, a.input) if a.records else files.binary(spark, a.input).select(F.col("path").alias("id"), "data")
    codec.compare(rows.withColumn("corpus", F.lit("all")), ["corpus"], "data", v, d).orderBy("ratio").drop("corpus").show(truncate=False)


def do_train_dict(spark, a) -> None:
    v, _ = models(spark, a)
    rows = corpus(spark, a.input)
    if v is None and a.vocab_size:
        raise SystemExit("--vocab-size belongs to fit")
    made = dictionary.train(rows, vocabulary=v, picker=a.priming, max_priming=a.max_priming, segment=a.segment, dmer=a.dmer, discount=a.discount, use_priming=not a.no_priming, use_contexts=not a.no_contexts)
    made.save(spark, a.output)
    print(made.info())


def do_dict_info(spark, a) -> None:
    for k, x in Dictionary.load(spark, a.input).info().items():
        print(f"{k}: {x}")


def do_pack(spark, a) -> None:
    v, d = models(spark, a)
    rows = corpus(spark, a.input).withColumn("g", F.lit(0))
    kind = "index" if a.indexed else "batch"
    packed = containers.pack(rows, ["g"], "data", "id", kind, v, d, not a.no_integrity, most_bytes=a.most_bytes, partitions=a.partitions)
    # Partitions are in the order of the records, so these numbers are too; numbering without gaps would bring all to one task.
    found = packed.select(F.format_string("%s-%016d.lxc", F.lit(kind), F.monotonically_increasing_id()).alias("name"), F.col("blob").alias("data"))
    n = files._each(found, F.col("name"), a.output)
    print(f"{a.output}: {n} containers")


def do_unpack(spark, a) -> None:
    v, d = models(spark, a)
    each = containers.unpack(files.binary(spark, a.input), "data", ["path"], v, d)
    print(f"{a.output}: {files.write_records(each, a.output)} records")


def do_read(spark, a) -> None:
    v, d = models(spark, a)
    blob = one(files.binary(spark, a.input).select("data"))
    try:
        data = container.read(blob, a.index, v or Vocabulary(), d)
    except IndexError as e:
        raise SystemExit(str(e)) from None
    if a.output:
        store.put(a.output, data)
    else:
        sys.stdout.buffer.write(data)


def do_train_vocab(spark, a) -> None:
    made = training.train(corpus(spark, a.input), a.size, sample_bytes=None if a.all else a.sample_bytes, progress=_progress if a.verbose else None)
    files.save_vocabulary(spark, made, a.output)
    print(f"{a.output}: {len(made.ranks)} tokens, {made.fingerprint.hex()}")


def _progress(done: int, of: int) -> None:
    if done % 500 == 0:
        print(f"{done} of {of} merges", file=sys.stderr)


def do_fit(spark, a) -> None:
    rows = corpus(spark, a.input)
    v = training.train(rows, a.size, sample_bytes=None if a.all else a.sample_bytes)
    d = dictionary.train(rows, vocabulary=v, picker=a.priming, max_priming=a.max_priming)
    files.save_vocabulary(spark, v, os.path.join(a.output, "vocabulary"))
    d.save(spark, os.path.join(a.output, "dictionary"))
    print(f"{a.output}: {len(v.ranks)} tokens; {d.info()}")


def do_tokenize_stats(spark, a) -> None:
    v, _ = models(spark, a)
    rows = files.binary(spark, a.input)
    ids = tokens.byte_ids(F.col("data")) if v is None else tokens.encode(v)("data")
    profile.profile(rows, ["path"], ids, F.octet_length("data")).show(truncate=False, vertical=True)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexpack", allow_abbrev=False)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, f, *aliases, many=False, output=True, need=False, models=True):
        c = sub.add_parser(name, aliases=aliases, help=f.__name__[3:].replace("_", " "), allow_abbrev=False)
        c.add_argument("input", nargs="+" if many else None)
        if output:
            c.add_argument("-o", "--output", required=need)
        if models:
            c.add_argument("--dict", help="a saved dictionary")
            c.add_argument("--vocab", help="a rank file")
        c.set_defaults(run=f)
        return c

    c = command("compress", do_compress, "c")
    c.add_argument("--fast", action="store_true")
    c.add_argument("--no-integrity", action="store_true")
    command("decompress", do_decompress, "d")
    command("bench", do_bench, "b", many=True, output=False).add_argument("--records", action="store_true", help="lines as records")
    for name, f in (("train-dict", do_train_dict), ("fit", do_fit)):
        c = command(name, f, many=True, need=True, models=name == "train-dict")
        c.add_argument("--priming", choices=dictionary.PICKERS, default="cover")
        c.add_argument("--max-priming", type=int, default=dictionary.PRIMING)
        if name == "train-dict":
            c.add_argument("--segment", type=int, default=dictionary.SEGMENT)
            c.add_argument("--dmer", type=int, default=dictionary.DMER)
            c.add_argument("--discount", type=float, default=dictionary.DISCOUNT)
            c.add_argument("--no-priming", action="store_true")
            c.add_argument("--no-contexts", action="store_true")
            c.set_defaults(vocab_size=None)
    for c in (sub.choices["fit"], command("train-vocab", do_train_vocab, many=True, need=True, models=False)):
        c.add_argument("--size", type=int, default=4096)
        c.add_argument("--sample-bytes", type=int, default=training.SAMPLE_BYTES)
        c.add_argument("--all", action="store_true", help="count pieces of the whole corpus")
    sub.choices["train-vocab"].add_argument("--verbose", action="store_true")
    command("dict-info", do_dict_info, output=False, models=False)
    c = command("pack", do_pack, many=True, need=True)
    c.add_argument("--indexed", action="store_true")
    c.add_argument("--no-integrity", action="store_true")
    c.add_argument("--most-bytes", type=int, default=containers.MOST_BYTES)
    c.add_argument("--partitions", type=int)
    command("unpack", do_unpack, need=True)
    command("read", do_read).add_argument("index", type=int)
    command("tokenize-stats", do_tokenize_stats, many=True, output=False)
    return p


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    a.run(ship(session()), a)
    return 0
