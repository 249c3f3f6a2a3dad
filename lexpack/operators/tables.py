"""Frequency tables and the exact cost of coding with them, as DataFrame queries.

A table is the rows of one key: at most 65,536 symbols, so the windows here hold bounded partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOG = 16
SLOTS = 1 << LOG


def top(df: DataFrame, keys: list[str], symbol: str, n: str, k: int) -> DataFrame:
    """The k most frequent symbols of each key, lower symbols first among equals."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(n).desc(), symbol))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def normalised(df: DataFrame, keys: list[str], symbol: str, n: str) -> DataFrame:
    """(keys, symbol, n, freq): counts scaled to the sum 65,536, each 1 at least.

    The rounded-down shares' shortfall or excess is dealt out in rounds of one unit in symbol order, as far as each symbol has
    room. That is a water level: found from prefix sums over the rooms in ascending order.
    """
    table = Window.partitionBy(*keys)
    total, m = F.sum(n).over(table), F.count(F.lit(1)).over(table)
    share = F.when(m == 1, F.lit(SLOTS)).otherwise(F.least(F.greatest(F.expr(f"`{n}` * {SLOTS}L div _total"), F.lit(1)), F.lit(SLOTS - 1)))
    f = df.withColumns({"_total": total, "_m": m}).withColumn("_f", share.cast("long")).withColumn("_short", SLOTS - F.sum("_f").over(table))
    f = f.withColumn("_room", F.greatest(F.when(F.col("_short") > 0, SLOTS - (F.col("_m") - 1) - F.col("_f")).otherwise(F.col("_f") - 1), F.lit(0)))
    f = f.withColumn("_need", F.abs("_short"))
    level = Window.partitionBy(*keys).orderBy("_room")
    below, more = F.sum("_room").over(level), F.col("_m") - F.count(F.lit(1)).over(level)
    f = f.withColumns({"_more": more, "_moved": below + F.col("_room") * more})
    # The largest room up to which all can be filled, 0 included, and how many whole rounds go on from there.
    fits = F.col("_moved") <= F.col("_need")
    f = f.withColumns({"_base": F.coalesce(F.max(F.when(fits, F.col("_room"))).over(table), F.lit(0)), "_at": F.coalesce(F.max(F.when(fits, F.col("_moved"))).over(table), F.lit(0)), "_open": F.coalesce(F.min(F.when(fits, F.col("_more"))).over(table), F.col("_m"))})
    f = f.withColumn("_level", F.col("_base") + F.when(F.col("_open") > 0, F.expr("(_need - _at) div _open")).otherwise(F.lit(0)))
    f = f.withColumn("_left", F.col("_need") - F.sum(F.least("_room", "_level")).over(table))
    order = F.sum((F.col("_room") > F.col("_level")).cast("long")).over(table.orderBy(symbol).rowsBetween(Window.unboundedPreceding, 0))
    move = F.least("_room", "_level") + ((F.col("_room") > F.col("_level")) & (order <= F.col("_left"))).cast("long")
    return f.withColumn("freq", F.col("_f") + F.signum("_short").cast("long") * move).select(*keys, symbol, n, "freq")


def cumulative(df: DataFrame, keys: list[str], symbol: str, freq: str = "freq") -> DataFrame:
    """Adds ``start``: the slots of all lower symbols."""
    before = Window.partitionBy(*keys).orderBy(symbol).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("start", F.coalesce(F.sum(freq).over(before), F.lit(0)))


def varint_size(x: Column) -> Column:
    """Bytes of a non-negative number as LEB128."""
    return sum(((x >= (1 << 7 * i)).cast("int") for i in range(1, 9)), F.lit(1))


def id_list_size(df: DataFrame, keys: list[str], symbol: str) -> DataFrame:
    """(keys, n_ids, n_bytes) of each key's distinct ids as a count and differences."""
    ids = df.select(*keys, symbol).distinct()
    step = F.col(symbol) - F.lag(symbol, 1, 0).over(Window.partitionBy(*keys).orderBy(symbol))
    sized = ids.withColumn("_size", varint_size(step)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_ids"), F.sum("_size").alias("_bytes"))
    return sized.select(*keys, "n_ids", (F.col("_bytes") + varint_size(F.col("n_ids"))).cast("long").alias("n_bytes"))


def code_length(events: DataFrame, tables: DataFrame, keys: list[str], by: list[str], symbol: str, escape_bits: float = 0.0) -> DataFrame:
    """(by, bits): the ideal length of each record's symbols under the tables of their keys; a missing symbol costs ``escape_bits``.

    events: (by, keys, symbol) a row a symbol, counted before the join, so the join sees distinct symbols only. A null key is a key.
    """
    counted = events.groupBy(*by, *(k for k in keys if k not in by), symbol).agg(F.count(F.lit(1)).alias("_n"))
    return counted_length(counted, tables, keys, by, symbol, escape_bits)


def counted_length(counted: DataFrame, tables: DataFrame, keys: list[str], by: list[str], symbol: str, escape_bits: float = 0.0) -> DataFrame:
    """As ``code_length``, of symbols with their numbers ``_n`` in a record."""
    bits = F.coalesce(LOG - F.log2("freq"), F.lit(escape_bits))
    own = tables.select(*(F.col(k).alias(f"_t{i}") for i, k in enumerate([*keys, symbol])), "freq")
    same = [F.col(k).eqNullSafe(F.col(f"_t{i}")) for i, k in enumerate([*keys, symbol])]
    return counted.join(own, same, "left").groupBy(*by).agg(F.sum(F.col("_n") * bits).alias("bits"))


def contexts(pairs: DataFrame, support: int = 20, most: int = 64) -> DataFrame:
    """(a, b, n, total, escape) of the ``most`` contexts with the most transitions (``support`` at least; lower ids first among equals).

    pairs: (a, b, n). ``escape``: the distinct successors.
    """
    size = pairs.groupBy("a").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("escape")).where(F.col("total") >= support)
    best = size.orderBy(F.col("total").desc(), "a").limit(most)
    return pairs.join(F.broadcast(best), "a")


def order0_escape(total: Column) -> Column:
    """1.5 % of the counts, rounded half to even, 1 at least."""
    return F.greatest(F.lit(1), F.bround(total * 0.015).cast("long"))


def chunk_history(events: DataFrame, by: list[str], symbol: str, pos: str, size: int) -> DataFrame:
    """(by, chunk, symbol, n, history): counts in each chunk of ``size`` symbols, and one plus those in all chunks before."""
    counted = events.groupBy(*by, F.floor(F.col(pos) / size).cast("long").alias("chunk"), symbol).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*by, symbol).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("history", F.coalesce(F.sum("n").over(before), F.lit(0)) + 1)
