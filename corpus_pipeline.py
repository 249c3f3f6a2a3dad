"""The corpus pipeline: language ID, SimHash near-dedup, benchmark decontamination, source mixing, sharding.

Every stage works on all rows that the one before kept. ``run`` writes each stage's rows as Parquet into the shared folder and
gives them to the next; the last stage adds shard and slot to the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexpack.llm import decontaminate, langid, mixing, shards, simhash
from lexpack.session import ship, spread, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language was identified; those without a letter or between two languages go."""
    return langid.select(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints."""
    return simhash.deduplicate(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs, n_chars="n_chars" if "n_chars" in docs.columns else None)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in random order over shards of equal size."""
    return shards.shuffle(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("mix", mix), ("shard", shard)]

#: Fingerprints (XXH64) and trained classifiers have no SQL form; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), steady=True)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
