"""Compression of binary columns: vectorised functions for DataFrames and SQL."""

from __future__ import annotations

import importlib.util
import lzma
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexpack.functions import lz, stream
from lexpack.functions.vocabulary import Vocabulary, _plain
from lexpack.operators import jvm
from lexpack.session import ship

HEADER = "mode string, size long, crc boolean, vocabulary string, dictionary string, error string"
EVENTS = "array<struct<role:tinyint,token:int,distance:int,length:int>>"


def _is_plain(vocabulary: Vocabulary | None, dictionary=None) -> bool:
    """Whether the JVM has the codec for these."""
    return dictionary is None and (vocabulary is None or vocabulary.plain)


def _each(f):
    return lambda column: column.map(lambda x: None if x is None else f(bytes(x)))


def compress(vocabulary: Vocabulary | None = None, dictionary=None, integrity: bool = True, fast: bool = False, mode: int | None = None):
    """A function from binary records to streams; null stays null. Conflicting options fail here, not in a task."""
    if fast and dictionary is not None:
        raise ValueError("fast and a dictionary exclude each other")
    if dictionary is not None and vocabulary is not None and dictionary.vocabulary != vocabulary.fingerprint:
        raise ValueError("the dictionary was trained with another vocabulary")

    @F.pandas_udf("binary")
    def run(data: pd.Series) -> pd.Series:
        v = vocabulary or _plain()
        return _each(lambda b: stream.compress(b, v, dictionary, integrity, fast, mode))(data)

    if _is_plain(vocabulary, dictionary) and mode not in (stream.EMPTY, stream.DICTIONARY):
        return jvm.either(run, "Compress", "binary", fast, -1 if mode is None else mode, integrity)
    return run


def decompress(vocabulary: Vocabulary | None = None, dictionary=None):
    """A function from streams to records; a bad stream fails the job."""

    @F.pandas_udf("binary")
    def run(blob: pd.Series) -> pd.Series:
        v = vocabulary or _plain()
        return _each(lambda b: stream.decompress(b, v, dictionary))(blob)

    return jvm.either(run, "Decompress", "binary", _plain().fingerprint.hex()) if _is_plain(vocabulary, dictionary) else run


def try_decompress(vocabulary: Vocabulary | None = None, dictionary=None):
    """As ``decompress``, but a bad stream gives a null record and the reason."""

    @F.pandas_udf("data binary, error string")
    def run(blob: pd.Series) -> pd.DataFrame:
        v = vocabulary or _plain()
        out = []
        for b in blob:
            try:
                out.append((None if b is None else stream.decompress(bytes(b), v, dictionary), None))
            except (ValueError, OverflowError, MemoryError) as e:
                out.append((None, str(e) or type(e).__name__))
        return pd.DataFrame(out, columns=["data", "error"])

    return jvm.either(run, "TryDecompress", "data binary, error string", _plain().fingerprint.hex()) if _is_plain(vocabulary, dictionary) else run


def parse_header():
    """A function from streams to their header fields; ``error`` says what is wrong with one that can't be read."""

    @F.pandas_udf(HEADER)
    def run(blob: pd.Series) -> pd.DataFrame:
        out = []
        for b in blob:
            try:
                h = stream.header(bytes(b))
                out.append((stream.NAMES[h["mode"]], h["size"], h["crc"], h["vocabulary"].hex(), _dictionary_of(h), None))
            except (ValueError, TypeError) as e:
                out.append((None, None, None, None, None, str(e)))
        return pd.DataFrame(out, columns=["mode", "size", "crc", "vocabulary", "dictionary", "error"])

    return jvm.either(run, "Header", HEADER, _plain().fingerprint.hex())


def _dictionary_of(h: dict) -> str | None:
    if h["mode"] != stream.DICTIONARY:
        return None
    source = stream.Source(h["payload"])
    source.varint()
    return source.take(8).hex()


def lz_events(vocabulary: Vocabulary | None = None, priming: list[int] | None = None):
    """A function from records to typed match events."""

    @F.pandas_udf(EVENTS)
    def run(data: pd.Series) -> pd.Series:
        v = vocabulary or _plain()
        return _each(lambda b: [{"role": r, "token": None if r else a, "distance": a if r else None, "length": n if r else None} for r, a, n in lz.parse(v.encode(b), priming)])(data)

    return jvm.either(run, "Events", EVENTS) if _is_plain(vocabulary) and not priming else run


def lz_replay(vocabulary: Vocabulary | None = None, priming: list[int] | None = None):
    @F.pandas_udf("binary")
    def run(events: pd.Series) -> pd.Series:
        v = vocabulary or _plain()
        return events.map(lambda x: None if x is None else v.decode(lz.replay([(1, e["distance"], e["length"]) if e["role"] else (0, e["token"], 0) for e in x], priming)))

    return jvm.either(run, "Replay", "binary") if _is_plain(vocabulary) and not priming else run


def literals(events: Column) -> Column:
    """One column of the split view; see also ``distances``."""
    return F.transform(F.filter(events, lambda e: e["role"] == 0), lambda e: e["token"])


def matches(events: Column) -> Column:
    """(high, low, length) of the matches."""
    return F.transform(F.filter(events, lambda e: e["role"] == 1), lambda e: F.struct(F.shiftright(e["distance"], 8).alias("high"), e["distance"].bitwiseAND(255).alias("low"), e["length"].alias("length")))


def unknown(streams: DataFrame, registry: DataFrame, blob: str = "blob") -> DataFrame:
    """The streams whose dictionary isn't in ``registry`` (column fingerprint): to be found before any is decoded."""
    parsed = streams.withColumn("_h", parse_header()(F.col(blob)))
    return parsed.where("_h.dictionary is not null").join(registry.select("fingerprint").distinct(), F.col("_h.dictionary") == F.col("fingerprint"), "left_anti").drop("_h")


BASELINES = {
    "gzip": lambda b: _gzip(b),
    "bz2": lambda b: __import__("bz2").compress(b, 9),
    "lzma": lambda b: _lzma(b),
    "zstd": lambda b: __import__("zstandard").ZstdCompressor(level=19).compress(b),
}
# Compressors that not every installation has take part where they can be imported.
OPTIONAL = {
    "brotli": ("brotli", lambda b: __import__("brotli").compress(b, quality=11)),
    "lz4": ("lz4", lambda b: importlib.import_module("lz4.frame").compress(b)),
}
BASELINES |= {k: f for k, (module, f) in OPTIONAL.items() if importlib.util.find_spec(module)}


def _lzma(b: bytes, preset: int = 9) -> bytes:
    """xz by the preset, with no more dictionary than the record has bytes: the preset's 64 MB take longer to set up than to use."""
    most = min(64 << 20, max(4096, 1 << (len(b) - 1).bit_length())) if b else 4096
    return lzma.compress(b, format=lzma.FORMAT_XZ, filters=[{"id": lzma.FILTER_LZMA2, "preset": preset, "dict_size": most}])


def _gzip(b: bytes) -> bytes:
    c = zlib.compressobj(9, zlib.DEFLATED, 31)
    return c.compress(b) + c.flush()


def baseline(name: str):
    """The size of each record under a general-purpose compressor."""

    @F.pandas_udf("long")
    def run(data: pd.Series) -> pd.Series:
        f = BASELINES[name]
        return data.map(lambda b: None if b is None else len(f(bytes(b))))

    return run


def ids_lzma(vocabulary: Vocabulary | None = None):
    """The size of each record as token ids of three bytes each under lzma: tokens without an entropy coder of their own."""

    @F.pandas_udf("long")
    def run(data: pd.Series) -> pd.Series:
        v = vocabulary or _plain()
        ids = _each(lambda b: np.asarray(v.encode(b), ">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes())(data)
        return ids.map(lambda b: None if b is None else len(_lzma(b, 9 | lzma.PRESET_EXTREME)))

    return run


def compare(records: DataFrame, keys: list[str], data: str, vocabulary: Vocabulary | None = None, dictionary=None, backends=(*BASELINES, "lexpack")) -> DataFrame:
    """(keys, backend, n, bytes_in, bytes_out, ratio) of compressing every record on its own."""
    own = compress(vocabulary, dictionary)
    sizes = {b: F.octet_length(own(F.col(data))).cast("long") if b == "lexpack" else baseline(b)(F.col(data)) for b in backends}
    wide = records.select(*keys, F.octet_length(data).cast("long").alias("_in"), *(c.alias(f"_{b}") for b, c in sizes.items()))
    long = wide.select(*keys, "_in", F.explode(F.array(*(F.struct(F.lit(b).alias("backend"), F.col(f"_{b}").alias("out")) for b in backends))).alias("x"))
    return long.groupBy(*keys, "x.backend").agg(F.count("_in").alias("n"), F.sum("_in").alias("bytes_in"), F.sum("x.out").alias("bytes_out")).withColumn("ratio", F.round(F.col("bytes_out") / F.col("bytes_in"), 6))


def register(spark: SparkSession, vocabulary: Vocabulary | None = None, dictionary=None) -> None:
    """SQL functions lex_compress, lex_decompress, lex_tokens, lex_events, lex_header."""
    from lexpack.operators.tokens import encode

    ship(spark)
    for name, f in (("lex_compress", compress(vocabulary, dictionary)), ("lex_decompress", decompress(vocabulary, dictionary)), ("lex_tokens", encode(vocabulary or _plain())), ("lex_events", lz_events(vocabulary)), ("lex_header", parse_header())):
        spark.udf.register(name, getattr(f, "python", f))
