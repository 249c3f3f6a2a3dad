"""Statistics of token sequences as DataFrame queries: histograms, entropies, mutual information, sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexpack.operators import jvm


def exploded(df: DataFrame, keys: list[str], tokens: Column) -> DataFrame:
    """(keys, pos, token)."""
    return df.select(*keys, F.posexplode(tokens).alias("pos", "token"))


def histogram(df: DataFrame, keys: list[str], tokens: Column) -> DataFrame:
    """(keys, token, n): combined before the shuffle, so a hot token is one row a task."""
    return df.select(*keys, F.explode(tokens).alias("token")).groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("n"))


def bigrams(df: DataFrame, keys: list[str], tokens: Column) -> DataFrame:
    """(keys, a, b, n): neighbours within a row."""
    t = df.select(*keys, tokens.alias("t"))
    pair = F.arrays_zip(F.expr("slice(t, 1, greatest(size(t) - 1, 0))").alias("a"), F.expr("slice(t, 2, greatest(size(t) - 1, 0))").alias("b"))
    pairs = t.select(*keys, F.explode(pair).alias("p"))
    return pairs.select(*keys, F.col("p")["a"].alias("a"), F.col("p")["b"].alias("b")).groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("n"))


def byte_pairs(df: DataFrame, keys: list[str], data: str) -> DataFrame | None:
    """(keys, a, b, n): neighbouring bytes of each record, counted in it; its first byte's a is -1. None where the JVM can't."""
    found = jvm.function("Pairs", "array<struct<a:int,b:int,n:bigint>>")
    return found and df.select(*keys, F.explode(found(data)).alias("p")).select(*keys, "p.*")


def profile(df: DataFrame, keys: list[str], tokens: Column, n_bytes: Column, digits: int = 6) -> DataFrame:
    """For each key: bytes, tokens, distinct tokens, order-0 entropy, order-1 conditional entropy, their difference, and rates.

    The pair share divides by the number of tokens, not of pairs, and the context's share is that among all tokens. A key without
    tokens gets zeros.

    All of it follows from one count of neighbours in which a record's last token has the neighbour null: summed by first token
    it gives the tokens' counts n, and with c for the pairs' counts, N for their sum and the entropies written out,
    H0 = log N - sum(n log n) / N and H1 = (sum(c log n) - sum(c log c)) / N. So tokens are cut once, and no counts are joined.
    """
    base = df.groupBy(*keys).agg(F.coalesce(F.sum(n_bytes), F.lit(0)).cast("long").alias("n_bytes"))
    t = df.select(*keys, tokens.alias("t"))
    pairs = t.select(*keys, F.explode(F.arrays_zip(F.col("t").alias("a"), F.expr("slice(t, 2, greatest(size(t) - 1, 0))").alias("b"))).alias("p"))
    counted = pairs.select(*keys, F.col("p")["a"].alias("a"), F.col("p")["b"].alias("b")).groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("c"))
    c, inner = F.col("c"), F.col("b").isNotNull()
    first = counted.groupBy(*keys, "a").agg(F.sum("c").alias("n"), F.coalesce(F.sum(F.when(inner, c)), F.lit(0)).alias("m"), F.coalesce(F.sum(F.when(inner, c * F.log2(c))), F.lit(0.0)).alias("s"))
    n = F.col("n")
    sums = first.groupBy(*keys).agg(F.sum("n").alias("n_tokens"), F.count(F.lit(1)).alias("n_distinct"), F.sum(n * F.log2(n)).alias("s0"), F.sum("s").alias("s1"), F.sum(F.col("m") * F.log2(n)).alias("s2"))
    sums = sums.withColumnsRenamed({k: f"_{k}" for k in keys})
    n = F.col("n_tokens")
    out = base.join(sums, [base[k].eqNullSafe(sums[f"_{k}"]) for k in keys], "left").withColumns({"h0": F.log2(n) - F.col("s0") / n, "h1": (F.col("s2") - F.col("s1")) / n}).na.fill(0, ["n_tokens", "n_distinct", "h0", "h1"])
    rate = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), digits) + 0.0  # noqa: E731  -0 is 0
    exact = lambda x: F.round(x, digits) + 0.0
    size_of = F.col("n_bytes")
    return out.select(
        *keys, "n_bytes", "n_tokens", "n_distinct", exact(F.col("h0")).alias("h0"), exact(F.col("h1")).alias("h1"), exact(F.col("h0") - F.col("h1")).alias("mutual_information"),
        rate(F.col("h0") * n, size_of).alias("bits_per_byte"), rate(n * 1000.0, size_of).alias("tokens_per_kb"), rate(size_of * 1.0, n).alias("bytes_per_token"),
    )
