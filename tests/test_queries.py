"""Every query against its SQL, and those without SQL against what they claim."""

import duckdb
import pytest

import __spark_entry__ as entry
from lexpack.plans import oracle, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    own = frame[sorted(frame.columns)]
    return sorted(tuple("null" if v is None or v != v else str(float(v)) if isinstance(v, float) else str(v) for v in r) for r in own.itertuples(index=False))


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query(spark, sf_dir, sql, name):
    got, want = queries.queries()[name](spark, sf_dir).toPandas(), sql.execute(oracle.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_without_sql(spark, sf_dir):
    ratios = {(r.source, r.backend): r for r in queries.compression_ratios(spark, sf_dir).collect()}
    assert {b for _, b in ratios} == {"gzip", "bz2", "lzma", "zstd", "lexpack"} and all(0 < r.ratio < 3 for r in ratios.values())
    info = queries.dictionary_summary(spark, sf_dir).first()
    assert info.alphabet == 257 and 0 < info.priming <= 4096 and info.context_tables <= 64


def test_entry(spark):
    assert set(oracle.oracle_sql()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns[0] == "source"
