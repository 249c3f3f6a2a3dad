"""Comparisons of compressors as one long table: (corpus, regime, backend, split, n, bytes_in, bytes_out).

Training and test records never overlap: a record is on one side by the hash of its id and the split's seed.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexpack.functions import stream
from lexpack.functions.vocabulary import Vocabulary
from lexpack.operators import codec, containers, dictionary
from lexpack.session import ship

COLUMNS = ("corpus", "regime", "backend", "split", "n", "bytes_in", "bytes_out")
ZSTD_SAMPLE_BYTES = 16 << 20


def _long(each: DataFrame, corpus: str, regime: str, split: int, sizes: dict[str, Column]) -> DataFrame:
    """Sums over rows (n records, n_in bytes) of each backend's sizes."""
    backends = F.array(*(F.struct(F.lit(k).alias("backend"), c.cast("long").alias("out")) for k, c in sizes.items()))
    rows = each.select("n_records", "n_in", F.explode(backends).alias("x"))
    summed = rows.groupBy("x.backend").agg(F.sum("n_records").alias("n"), F.sum("n_in").alias("bytes_in"), F.sum("x.out").alias("bytes_out"))
    return summed.select(F.lit(corpus).alias("corpus"), F.lit(regime).alias("regime"), "backend", F.lit(split).alias("split"), "n", "bytes_in", "bytes_out")


def _sized(rows: DataFrame) -> DataFrame:
    return rows.select("data", F.lit(1).cast("long").alias("n_records"), F.octet_length("data").cast("long").alias("n_in"))


def _own(**how) -> Column:
    return F.octet_length(codec.compress(**how)("data"))


def each(rows: DataFrame, corpus: str, regime: str = "records", vocabulary: Vocabulary | None = None, fast: bool = False) -> DataFrame:
    """Every row of ``data`` on its own (a row may be a whole file) under every backend; ``fast`` adds the fast coding."""
    sizes = {b: codec.baseline(b)("data") for b in codec.BASELINES} | {"lexpack": _own(vocabulary=vocabulary)} | ({"lexpack-fast": _own(vocabulary=vocabulary, fast=True)} if fast else {})
    return _long(_sized(rows), corpus, regime, 0, sizes)


def batches(rows: DataFrame, corpus: str, vocabulary: Vocabulary | None = None, trained=None, most_bytes: int = containers.MOST_BYTES) -> DataFrame:
    """Records (id, data) in batches, beside zstd over the same runs of records."""
    packed = containers.pack(rows.withColumn("g", F.lit(0)), ["g"], "data", "id", vocabulary=vocabulary, dictionary=trained, most_bytes=most_bytes)
    data = packed.select("blob", F.col("n_records"), F.col("n_bytes").alias("n_in"), _joined(vocabulary, trained)("blob").alias("data"))
    return _long(data, corpus, "batch" if trained is None else "batch+dictionary", 0, {"lexpack": F.octet_length("blob"), "zstd": codec.baseline("zstd")("data")})


def _joined(vocabulary, trained):
    from lexpack.functions import container
    from lexpack.functions.vocabulary import _plain

    @F.pandas_udf("binary")
    def run(blob: pd.Series) -> pd.Series:
        v = vocabulary or _plain()
        return blob.map(lambda b: b"".join(container.unpack(bytes(b), v, trained)))

    return run


def side(rows: DataFrame, seed: int, train: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(training, test) rows by the hash of ``id``."""
    h = F.pmod(F.xxhash64(F.lit(seed), F.col("id").cast("string")), F.lit(1000))
    return rows.where(h < int(train * 1000)), rows.where(h >= int(train * 1000))


def zstd_dictionary(rows: DataFrame, size: int = 110 << 10, sample_bytes: int = ZSTD_SAMPLE_BYTES) -> bytes:
    """A zstd dictionary of the first records by hash of the id, up to ``sample_bytes``; empty where there are too few to train on."""
    import zstandard

    mean = rows.agg(F.avg(F.octet_length("data"))).first()[0] or 1
    found = [bytes(r.data) for r in rows.orderBy(F.xxhash64("id"), "id").limit(max(1, int(sample_bytes / max(1.0, mean)))).select("data").toLocalIterator()]
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, found)) // 10)), found).as_bytes()
    except zstandard.ZstdError:
        return b""


def zstd_with(trained: bytes):
    @F.pandas_udf("long")
    def run(data: pd.Series) -> pd.Series:
        import zstandard

        c = zstandard.ZstdCompressor(level=19, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
        return data.map(lambda b: None if b is None else len(c.compress(bytes(b))))

    return run


def trained(rows: DataFrame, corpus: str, seeds: Iterable[int] = (1,), vocabulary: Vocabulary | None = None, test: DataFrame | None = None, regime: str = "dictionary", **how) -> DataFrame:
    """Held-out records with and without a dictionary of the training side, a split for each seed; ``test``: records of another schema instead."""
    out = []
    for seed in seeds:
        train, held = side(rows, seed)
        held = held if test is None else side(test, seed)[1]
        d = dictionary.train(train, vocabulary=vocabulary, **how)
        z = zstd_dictionary(train)
        sizes = {"lexpack": _own(vocabulary=vocabulary), "lexpack+dictionary": _own(vocabulary=vocabulary, dictionary=d), "zstd": codec.baseline("zstd")("data"), "zstd+dictionary": zstd_with(z)("data")}
        out.append(_long(_sized(held), corpus, regime, seed, sizes))
    return reduce(DataFrame.unionByName, out)


def ablation(rows: DataFrame, corpus: str, seed: int = 1, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Held-out records with no dictionary, its order-0 table, with priming too, and with contexts too."""
    train, held = side(rows, seed)
    steps = {"none": None} | {k: dictionary.train(train, vocabulary=vocabulary, use_priming=p, use_contexts=c) for k, p, c in (("order0", False, False), ("+priming", True, False), ("+contexts", True, True))}
    return _long(_sized(held), corpus, "ablation", seed, {k: _own(vocabulary=vocabulary, dictionary=d) for k, d in steps.items()})


def pickers(rows: DataFrame, corpus: str, seeds: Iterable[int] = (1,), vocabulary: Vocabulary | None = None, **how) -> DataFrame:
    """Held-out records under dictionaries of every way to choose priming text."""
    out = []
    for seed in seeds:
        train, held = side(rows, seed)
        made = {p: dictionary.train(train, vocabulary=vocabulary, picker=p, **how) for p in dictionary.PICKERS}
        out.append(_long(_sized(held), corpus, "pickers", seed, {p: _own(vocabulary=vocabulary, dictionary=d) for p, d in made.items()}))
    return reduce(DataFrame.unionByName, out)


def direct(rows: DataFrame, corpus: str, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Every record with its tokens coded directly, and with the same tokens as fixed-width ids under lzma."""
    return _long(_sized(rows), corpus, "direct", 0, {"lexpack": _own(vocabulary=vocabulary), "ids+lzma": codec.ids_lzma(vocabulary)("data")})


def winners(results: DataFrame, first: str = "lexpack", second: str = "ids+lzma") -> DataFrame:
    """(corpus, regime, split, first, second, delta, winner): two backends' ratios beside each other; ``tie`` where they are equal."""
    ratio = lambda b: F.sum(F.when(F.col("backend") == b, F.col("bytes_out"))) / F.sum(F.when(F.col("backend") == b, F.col("bytes_in")))
    both = results.groupBy("corpus", "regime", "split").agg(ratio(first).alias("first"), ratio(second).alias("second")).withColumn("delta", F.col("first") - F.col("second"))
    return both.withColumn("winner", F.when(F.col("delta") < 0, F.lit(first)).when(F.col("delta") > 0, F.lit(second)).when(F.col("delta") == 0, F.lit("tie")))


def attribution(rows: DataFrame, corpus: str, seed: int = 1, vocabulary: Vocabulary | None = None, most_bytes: int = containers.MOST_BYTES, **how) -> DataFrame:
    """Held-out records (id, data) step by step from streams of their own to batches, so that neighbouring steps show what each part of a batch gains.

    ``record`` and ``record+dictionary``: a stream a record; ``record, dictionary layout``: that layout alone, so its tables are the
    trained ones; ``batch, dictionary layout``: the same tables over a batch, which adds matches across records and saves frames;
    ``batch+dictionary``: the smallest layout, which adds tables that adapt to the batch; ``batch``: that without a dictionary.
    ``batch header``: what a batch's counts and lengths take, included in the three before.
    """
    train, held = side(rows, seed)
    d = dictionary.train(train, vocabulary=vocabulary, **how)
    forced = {"dictionary": d, "mode": stream.DICTIONARY}
    each = {"record": _own(vocabulary=vocabulary), "record+dictionary": _own(vocabulary=vocabulary, dictionary=d), "record, dictionary layout": _own(vocabulary=vocabulary, **forced)}
    packed = containers.pack(held.withColumn("g", F.lit(0)), ["g"], "data", "id", vocabulary=vocabulary, dictionary=d, most_bytes=most_bytes)
    runs = packed.select("n_records", F.col("n_bytes").alias("n_in"), F.octet_length("blob").alias("whole"), _joined(vocabulary, d)("blob").alias("data"))
    # A batch is its header and one stream over the joined records.
    runs = runs.withColumn("head", F.col("whole") - _own(vocabulary=vocabulary, dictionary=d))
    many = {"batch": F.col("head") + _own(vocabulary=vocabulary), "batch, dictionary layout": F.col("head") + _own(vocabulary=vocabulary, **forced), "batch+dictionary": F.col("whole"), "batch header": F.col("head")}
    return _long(_sized(held), corpus, "attribution", seed, each).unionByName(_long(runs, corpus, "attribution", seed, many))


def schemas(named: dict[str, DataFrame], seeds: Iterable[int] = (1,), vocabulary: Vocabulary | None = None, **how) -> DataFrame:
    """The dictionary regime on records of several schemas, each with a dictionary of its own training side."""
    return reduce(DataFrame.unionByName, (trained(rows, corpus, seeds, vocabulary, regime="schemas", **how) for corpus, rows in named.items()))


def vocabularies(rows: DataFrame, corpus: str, named: dict[str, Vocabulary]) -> DataFrame:
    """Every record under several vocabularies."""
    return _long(_sized(rows), corpus, "vocabularies", 0, {k: _own(vocabulary=v) for k, v in named.items()})


def sweep(spark, sizes: Iterable[int] = (64, 128, 256, 512, 1024, 2048, 4096), n: int = 40, seed: int = 1) -> DataFrame:
    """Made-up records of given sizes: the same fields and a filler that a hash gives, without and with a dictionary."""
    ship(spark)
    out = []
    for size in sizes:
        i = F.col("id").cast("string")
        fields = F.concat(F.lit('{"id":'), i, F.lit(',"action":"'), F.element_at(F.array(*map(F.lit, ("view", "click", "buy"))), (F.pmod(F.xxhash64("id"), F.lit(3)) + 1).cast("int")), F.lit('","region":"r'), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(5)).cast("string"), F.lit('","payload":"'))
        filler = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(size // 64)), lambda k: F.sha2(F.concat(i, F.lit("-"), k.cast("string")).cast("binary"), 256)), "")
        rows = spark.range(n).select("id", F.encode(F.concat(F.substring(F.concat(fields, filler), 1, max(1, size - 2)), F.lit('"}')), "UTF-8").alias("data"))
        out.append(trained(rows, f"{size} bytes", (seed,), regime="sweep"))
    return reduce(DataFrame.unionByName, out)


def summary(results: DataFrame) -> DataFrame:
    """(corpus, regime, backend, splits, ratio, deviation): mean and deviation of the splits' ratios."""
    ratio = F.col("bytes_out") / F.col("bytes_in")
    return results.groupBy("corpus", "regime", "backend").agg(F.count(F.lit(1)).alias("splits"), F.round(F.avg(ratio), 6).alias("ratio"), F.round(F.stddev_samp(ratio), 6).alias("deviation"))
