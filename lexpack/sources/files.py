"""Whole files in and out: sample files, rank files, compressed files, unpacked records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexpack.functions.vocabulary import PATTERN, Vocabulary
from lexpack.operators import codec, tokens
from lexpack.session import ship
from lexpack.sources.store import put


def binary(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, data) of whole files, through Spark's readers, which leave out empty files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("data"))


def samples(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, ordinal, data): the records of UTF-8 files: the non-empty lines of one with two newlines or more, else the whole file."""
    raw = binary(spark, path).select("path", F.col("data").cast("string").alias("t"))
    each = raw.select("path", F.posexplode(tokens.records(F.col("t"))).alias("ordinal", "r"))
    return each.select("path", F.col("ordinal").cast("long"), F.encode("r", "UTF-8").alias("data"))


def numbered(samples: DataFrame) -> DataFrame:
    """(id, data): samples with one id for all files, in the order of path and ordinal."""
    return samples.select(F.concat_ws("/", "path", F.lpad(F.col("ordinal").cast("string"), 20, "0")).alias("id"), "data")


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    """(token, rank) of a rank file: base64 of the token, a blank, the rank."""
    parts = F.split(F.trim("value"), " ")
    return spark.read.text(path).where(F.trim("value") != "").select(F.unbase64(parts[0]).alias("token"), parts[1].cast("int").alias("rank"))


def write_ranks(ranks: DataFrame, path: str) -> None:
    """A rank file in rank order (65,536 lines at most, so one task writes it)."""
    ranks.orderBy("rank").select(F.concat_ws(" ", F.base64("token"), F.col("rank").cast("string")).alias("value")).coalesce(1).write.text(path)


def vocabulary(spark: SparkSession, path: str, pattern: str = PATTERN) -> Vocabulary:
    """The checked vocabulary of a rank file; the driver gets at most 65,536 tokens."""
    v = Vocabulary({bytes(r.token): r.rank for r in read_ranks(spark, path).limit(65537).collect()}, pattern)
    v.check()
    return v


def save_vocabulary(spark: SparkSession, v: Vocabulary, path: str) -> None:
    write_ranks(spark.createDataFrame([(t, i) for t, i in v.ranks.items()], "token binary, rank int"), path)


def _each(df: DataFrame, name, folder: str) -> int:
    """Write every row's ``data`` to the file that ``name`` (a column) gives, from the tasks; how many."""
    ship(df.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for n, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                put(f"{folder.rstrip('/')}/{n}", d)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return df.select(name.alias("name"), "data").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def base_name(path: str = "path"):
    return F.element_at(F.split(path, "/"), -1)


def compress_files(spark: SparkSession, source: str | list[str], folder: str, vocabulary: Vocabulary | None = None, dictionary=None, integrity: bool = True, fast: bool = False, suffix: str = ".lxp") -> int:
    """Compress every file of ``source`` into ``folder``, by its name and ``suffix``; how many. File names must differ."""
    made = binary(spark, source).select("path", codec.compress(vocabulary, dictionary, integrity, fast)("data").alias("data"))
    return _each(made, F.concat(base_name(), F.lit(suffix)), folder)


def decompress_files(spark: SparkSession, source: str | list[str], folder: str, vocabulary: Vocabulary | None = None, dictionary=None, suffix: str = ".lxp") -> int:
    """The inverse; a name loses ``suffix``, or gets ``.out`` where it hasn't any."""
    made = binary(spark, source).select("path", codec.decompress(vocabulary, dictionary)("data").alias("data"))
    name = F.when(base_name().endswith(suffix), F.expr(f"substring(element_at(split(path, '/'), -1), 1, length(element_at(split(path, '/'), -1)) - {len(suffix)})")).otherwise(F.concat(base_name(), F.lit(".out")))
    return _each(made, name, folder)


def write_records(rows: DataFrame, folder: str, ordinal: str = "ordinal", data: str = "data") -> int:
    """Every record to a file of its own: its number in four digits or more, ``.rec``; how many."""
    digits = F.col(ordinal).cast("string")
    name = F.concat(F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits), F.lit(".rec"))
    return _each(rows.select(name.alias("__n"), F.col(data).alias("data")), F.col("__n"), folder)
