import pytest


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def plain(documents):
    """(doc_id, text, lang, source) of the small table."""
    return [(r.doc_id, r.text, r.lang, r.source) for r in documents.select("doc_id", "text", "lang", "source").collect()]


ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, "  \n\t ", None, None), (4, "one", "en", None), (5, "one", "en", None), (5, "one", "en", None),
    (None, "the null id has words too", "fr", "b"), (None, None, None, None), (7, "x" * 300_000, "en", "a"), (8, "word " * 60_000, "en", "b"), (9, "1234 5678 !!! ---", "en", "a"),
    (10, "Ünïcödé straße 日本語 текст", "de", "c"), (11, "same text in two rows of a table", "en", "a"), (12, "same text in two rows of a table", "en", "b"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows and ids."""
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="session")
def clash(odd):
    """As ``odd``, with further columns whose names operators use for themselves."""
    from pyspark.sql import functions as F

    names = ("spans", "item_ids", "n_words", "fingerprint", "size", "shard", "slot", "lang_pred", "score", "ambiguous", "votes", "h", "t", "d", "row", "chunk", "Source_Size", "n_lines", "node", "v")
    return odd.withColumns({n: F.lit(f"own {n}") for n in names}).withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
