"""Mixing sources to target weights with hash-threshold histograms.

A source's target is met by whole copies of all its documents and, for the rest, by the documents whose key lies below a
threshold. A key is a 60-bit hash of the id, then one of the text, then the row's place, so no two rows tie. Thresholds come from
nested histograms: sizes are summed by source and the leading 10 bits of the id's hash; the bucket in which the running sum passes
the budget is opened by the next 10 bits, and so on until it holds a single row. Nothing is sorted but at most 1024 sums a
source. Where rows share an id (null, say), the search goes on in the texts' hashes, and among equal rows in their places. The
row at the threshold is taken in part, so that the budget is met to the word.

Texts are never exchanged: keys and sizes are, and the thresholds, one row a source, are broadcast while they are few (counted first).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexpack.session import cut, ship, stored
from lexpack.llm.text import encoded, extended, word_counts

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Parts of a key, each of so many bits, and the bits of a histogram level.
KEY, BITS, STEP = ("h", "t", "p"), 60, 10
#: Sources whose limits are broadcast, and the bytes of their names; beyond, they are joined by shuffles, a source's rows dealt out over SALT parts.
FEW_SOURCES, FEW_BYTES, SALT = 100_000, 16 << 20, 64


def doc_hash(doc_id):
    """60 bits of the MD5 of the id as text (null: empty)."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame, text: str = "text", keep: list[str] | None = None, name: str = "size") -> DataFrame:
    """``docs`` with the number of runs of ``[^\\x20\\x09-\\x0D]`` in the text (null: 0)."""

    def make():
        return lambda batch: [word_counts(encoded(batch.column(batch.schema.get_field_index(text))))]

    return extended(docs, text, [T.StructField(name, T.LongType())], make, keep)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources in code-point order, null last, weigh as ``weights`` repeats. Together they get ``share`` of all sizes; a target
    stops at ``most`` times its source's size and the excess is shared again by weight until none is above. That closes sources in
    the order of size by weight, so a source's fate follows from sums over those before it. The windows see one row a source.
    """
    per = cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    by_name = F.col("source").asc_nulls_last()
    place = F.row_number().over(Window.orderBy(by_name)) - 1
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.pmod(place, F.lit(len(weights))) + 1).cast("double"))
    size, w, most = F.col("source_size").cast("double"), F.col("w"), float(most)
    before = Window.orderBy(most * size / w, by_name).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(most * size / w, by_name).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything).cast("double")
    closed, open_w = F.coalesce(F.sum("source_size").over(before), F.lit(0)).cast("double"), F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    per = per.withColumns({"total": total, "capped": most * size < w * (share * total - most * closed) / open_w})
    rest = F.coalesce(F.sum(F.when(F.col("capped"), F.col("source_size"))).over(everything), F.lit(0)).cast("double")
    fair = w * (share * F.col("total") - most * rest) / F.sum(F.when(~F.col("capped"), w)).over(everything)
    return cut(per.select("source", "source_size", F.when(F.col("capped"), size * most).otherwise(fair).alias("target")))


def with_keys(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``docs`` with the parts of each row's key as __h, __t and __p. Spark numbers partitions by 31 bits; 27 are enough here."""
    return docs.withColumns({"__h": doc_hash(F.col(doc_id)), "__t": F.shiftrightunsigned(F.xxhash64(F.col(text).cast("string")), 4), "__p": F.monotonically_increasing_id()})


def by_source(rows: DataFrame, source: str, other: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``other``, one row a source (column s; null is a source) and free of ``rows``' names; s is dropped.

    ``rows`` stay where they are while the sources are few, else each source's rows meet its one row in SALT places.
    """
    n, size = other.agg(F.count(F.lit(1)), F.sum(F.coalesce(F.octet_length("s"), F.lit(0)))).first()
    same = F.col(source).eqNullSafe(F.col("s"))
    if n <= FEW_SOURCES and (size or 0) <= FEW_BYTES:
        return rows.join(F.broadcast(other), same, how).drop("s")
    salted = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALT)).cast("int"))
    copies = other.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return salted.join(copies, same & (F.col("__salt") == F.col("__s")), how).drop("s", "__s", "__salt")


def thresholds(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """(source, source_size, target, copies, limit, part): whole copies, the key below which one more is taken, words of the row at it.

    rows: (source, size, h, t, p), with no two alike in a source's keys; goal: as ``targets`` gives. ``limit`` is null where whole
    copies do, or where the rows fall short of the budget by a fraction of a word.
    """
    whole = F.when(F.col("target") >= F.col("source_size"), F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")))).otherwise(0)
    goal = goal.withColumn("copies", F.coalesce(whole, F.lit(0)).cast("long")).withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))
    live = goal.where("budget > 0").select(F.col("source").alias("s"), "budget", F.lit(0).cast("long").alias("prefix"))
    done, key = None, F.struct(*KEY)
    for part in KEY:
        for level in range(BITS // STEP):
            shift = BITS - (level + 1) * STEP
            # Bits above the level's are alike in what is left, as are the key's parts before.
            inside = by_source(rows, "source", live).where(F.shiftright(part, shift + STEP) == F.col("prefix"))
            if part != KEY[0]:
                inside = inside.where(F.struct(*KEY[: KEY.index(part)]) == F.col("tied"))
            tied = [F.first("tied").alias("tied")] if part != KEY[0] else []
            sums = inside.groupBy("source", F.shiftright(part, shift).alias("b")).agg(F.sum("size").alias("size"), F.first("budget").alias("budget"), F.count("*").alias("n"), F.min(key).alias("low"), F.max(part).alias("high"), *tied)
            running = F.sum("size").over(Window.partitionBy("source").orderBy("b"))
            first = F.row_number().over(Window.partitionBy("source").orderBy("b"))
            left = F.col("budget") - (F.col("running") - F.col("size"))
            cross = cut(sums.withColumn("running", running).where(F.col("running") > F.col("budget")).withColumn("k", first).where("k = 1").withColumn("left", left))
            ended = cross.where("n = 1").select(F.col("source").alias("s"), F.col("low").alias("limit"), F.floor("left").cast("long").alias("part"))
            done = ended if done is None else done.unionByName(ended)
            tied = [F.col("tied")] if part != KEY[0] else []
            live = cross.where("n > 1").select(F.col("source").alias("s"), F.col("left").alias("budget"), F.col("b").alias("prefix"), *tied, "low", (F.col(f"low.{part}") == F.col("high")).alias("alike"))
            if live.where("not alike").isEmpty():
                break
            live = live.drop("low", "alike")
        if live.isEmpty():
            break
        # A source whose rows are told apart no further by this part goes on with the next.
        upto = KEY[: KEY.index(part) + 1]
        live = live.select("s", "budget", F.lit(0).cast("long").alias("prefix"), F.struct(*(F.col(f"low.{x}").alias(x) for x in upto)).alias("tied"))
    return cut(by_source(goal, "source", done, "left").select("source", "source_size", "target", "copies", "limit", F.coalesce("part", F.lit(0)).alias("part")))


def plan(rows: DataFrame, **how) -> DataFrame:
    return thresholds(rows, targets(rows, **how))


def _joined(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows (__source, __size, __h, __t, __p, ...) with their source's limits, all named with two underscores, the place against the limit (__at: below,
    at or above: -1, 0, 1) and the words taken beside whole copies (__extra)."""
    other = limits.select(F.col("source").alias("s"), *(F.col(c).alias(f"__l_{c}") for c in limits.columns if c != "source"))
    key = F.struct(*(F.col(f"__{c}").alias(c) for c in KEY))
    at = F.when(key < F.col("__l_limit"), -1).when(key == F.col("__l_limit"), 0).otherwise(1)
    extra = F.when(F.col("__at") < 0, F.col("__size")).when(F.col("__at") == 0, F.col("__l_part")).otherwise(0)
    return by_source(rows, "__source", other, "left").withColumn("__at", at).withColumn("__extra", extra)


def _light(table: DataFrame) -> DataFrame:
    return stored(table.select(F.col("__source").alias("source"), F.col("__size").alias("size"), *(F.col(f"__{c}").alias(c) for c in KEY)), "mixing")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row a document row: doc_id, size, source_size, target, taken.

    Null texts have size 0; the null source is a source of its own. A repeated row is a document of its own. Sources without words get target 0.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("__source"))
    rows = stored(sized(with_keys(rows, "doc_id", "text"), keep=["doc_id", "__source", *(f"__{c}" for c in KEY)], name="__size"), "mixing")
    limits = plan(rows.select(F.col("__source").alias("source"), F.col("__size").alias("size"), *(F.col(f"__{c}").alias(c) for c in KEY)))
    rows = _joined(rows, limits)
    return rows.select("doc_id", F.col("__size").alias("size"), F.col("__l_source_size").alias("source_size"), F.col("__l_target").alias("target"), (F.col("__l_copies") * F.col("__size") + F.col("__extra")).alias("taken"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", n_chars: str | None = None) -> DataFrame:
    """The documents of the mix, with their own columns: a row for each whole copy taken, and the boundary document's leading words.

    ``n_chars`` names a column that holds the length of the text; it is set anew where a text was cut. Documents without
    words weigh nothing: they come as often as their source's whole copies, but once at least if the mix takes anything. The input's
    partitions must come out alike when recomputed, as those of a file scan do, if equal rows are to be told apart by place.
    """
    ship(docs.sparkSession)
    table = sized(with_keys(docs, doc_id, text).withColumn("__source", F.col(source)), text, name="__size")
    rows = _joined(table, plan(_light(table)))
    whole = F.col("__l_copies") + F.when(F.col("__at") < 0, 1).otherwise(0)
    whole = F.when((F.col("__size") == 0) & (F.col("__l_target") > 0), F.greatest(whole, F.lit(1))).otherwise(whole)
    cut_to = F.when(F.col("__at") == 0, F.col("__extra")).otherwise(0)
    taken = F.filter(F.concat(F.array_repeat(F.lit(-1).cast("long"), whole.cast("int")), F.array(cut_to.cast("long"))), lambda n: n != 0)
    rows = rows.withColumn("__n", F.explode(taken))
    words = F.split(F.regexp_replace(F.col(text), r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+")
    short = F.when(F.col("__n") < 0, F.col(text)).otherwise(F.concat_ws(" ", F.slice(words, 1, F.greatest(F.col("__n"), F.lit(1)).cast("int"))))
    changed = {text: short}
    if n_chars:
        changed[n_chars] = F.when(F.col("__n") < 0, F.col(n_chars)).otherwise(F.length(short)).cast(docs.schema[n_chars].dataType)
    return rows.withColumns(changed).select(*docs.columns)
