"""The operators as queries over whole tables.

Texts become records by UTF-8; rows of other tables by a fixed concatenation of columns. Round trips return what decoding gives, so
they match their SQL only if the codec loses nothing; the tests also hold the streams' modes and damage reports.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexpack.functions import stream
from lexpack.functions.ans import Table
from lexpack.functions.vocabulary import Vocabulary
from lexpack.operators import codec, containers, dictionary, jvm, profile, tables, tokens, training
from lexpack.session import cut, shared_dir, ship, spread
from lexpack.sources import container as source
from lexpack.sources import files

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str, steady: bool = False) -> DataFrame:
    return spread(ship(spark).read.parquet(f"{sf_dir}/{name}.parquet"), steady)


def records(spark: SparkSession, sf_dir: str, steady: bool = False) -> DataFrame:
    """Documents as (id, source, text, data); null texts are empty records."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents", steady).select(F.col("doc_id").alias("id"), "source", text.alias("text"), F.encode(text, "UTF-8").alias("data"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as small alike records (id, type, data)."""
    data = F.concat_ws("|", F.col("event_id").cast("string"), F.col("user_id").cast("string"), "event_type", "props")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.encode(data, "UTF-8").alias("data"))


def line_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as alike records (type, id, data)."""
    columns = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    data = F.concat_ws(",", *(F.col(c).cast("string") for c in columns))
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", F.encode(data, "UTF-8").alias("data"))


def bytes_column(rows: DataFrame) -> Column:
    return tokens.byte_ids(rows["data"])


def byte_histogram(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, token, n) of the bytes, counted in each record first."""
    each = profile.byte_pairs(rows, keys, "data")
    if each is None:
        return profile.histogram(rows, keys, bytes_column(rows))
    return each.groupBy(*keys, F.col("b").alias("token")).agg(F.sum("n").alias("n"))


def byte_bigrams(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b, n) of neighbouring bytes, counted in each record first."""
    each = profile.byte_pairs(rows, keys, "data")
    if each is None:
        return profile.bigrams(rows, keys, bytes_column(rows))
    return each.where("a >= 0").groupBy(*keys, "a", "b").agg(F.sum("n").alias("n"))


# Tokens and profiles.


def pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each piece occurs in each source."""
    rows = records(spark, sf_dir)
    return profile.histogram(rows, ["source"], tokens.pieces(F.col("text"))).withColumnRenamed("token", "piece")


def piece_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of each document; joined, they are the text."""
    rows = records(spark, sf_dir).select("id", "text", tokens.pieces(F.col("text")).alias("p"))
    return rows.select("id", F.size("p").cast("long").alias("n_pieces"), (F.array_join("p", "") == F.col("text")).alias("whole"))


def token_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy, mutual information and sizes of the documents' pieces by source."""
    rows = records(spark, sf_dir)
    return profile.profile(rows, ["source"], tokens.pieces(F.col("text")), F.octet_length("data"))


def event_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of event records as bytes, by type."""
    rows = events(spark, sf_dir)
    return profile.profile(rows, ["type"], bytes_column(rows), F.octet_length("data"))


def bigram_mi_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 neighbouring pieces of each source with the most pointwise information in sum; among equals by piece."""
    rows = records(spark, sf_dir)
    t = tokens.pieces(F.col("text"))
    one = cut(profile.histogram(rows, ["source"], t))
    total = one.groupBy("source").agg(F.sum("n").alias("total"))
    two = profile.bigrams(rows, ["source"], t)
    first, second = (one.select(F.col("source").alias(f"s_{k}"), F.col("token").alias(f"t_{k}"), F.col("n").alias(f"n_{k}")) for k in "ab")
    total = total.withColumnRenamed("source", "s")
    joined = two.join(first, F.col("source").eqNullSafe(F.col("s_a")) & (F.col("a") == F.col("t_a"))).join(second, F.col("source").eqNullSafe(F.col("s_b")) & (F.col("b") == F.col("t_b")))
    joined = joined.join(total, F.col("source").eqNullSafe(F.col("s")))
    pmi = F.round(F.col("n") * F.log2(F.col("n").cast("double") * F.col("total") / F.col("n_a") / F.col("n_b")), 4)
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.col("information").desc(), "a", "b"))
    return joined.select("source", "a", "b", "n", pmi.alias("information")).withColumn("k", rank).where("k <= 50").drop("k")


def symbol_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 most frequent bytes of each source, lower ones first among equals."""
    rows = records(spark, sf_dir)
    return tables.top(profile.histogram(rows, ["source"], bytes_column(rows)), ["source"], "token", "n", 100).select("source", F.col("token").alias("symbol"), "n", F.col("rank").cast("long").alias("rank"))


# Tables and costs.


def _byte_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    counts = byte_histogram(rows, ["source"]).withColumnRenamed("token", "symbol")
    return tables.normalised(counts, ["source"], "symbol", "n")


def freq_table_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte counts of each source scaled to 65,536."""
    return _byte_table(spark, sf_dir)


def cum_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with each symbol's first slot."""
    return tables.cumulative(_byte_table(spark, sf_dir), ["source"], "symbol").select("source", "symbol", "freq", "start")


def varint_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the documents' lengths as LEB128."""
    rows = records(spark, sf_dir)
    n = F.octet_length("data").cast("long")
    return rows.groupBy(tables.varint_size(n).alias("n_varint")).agg(F.count(F.lit(1)).alias("n"), F.sum(n).alias("n_bytes"))


def symbol_list_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document's distinct byte values as a delta list."""
    rows = records(spark, sf_dir)
    return tables.id_list_size(rows.select("id", F.explode(bytes_column(rows)).alias("symbol")), ["id"], "symbol")


def raw_token_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits and bytes of each document's bytes at nine bits each, the width of an alphabet with a match flag."""
    n = F.octet_length("data").cast("long")
    return records(spark, sf_dir).select("id", (n * 9).alias("n_bits"), F.ceil(n * 9 / 8).cast("long").alias("n_bytes"))


def sparse_code_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ideal bits of each document under its source's table."""
    rows = records(spark, sf_dir)
    found = cut(_byte_table(spark, sf_dir))
    each = profile.byte_pairs(rows, ["id", "source"], "data")
    if each is None:
        cost = tables.code_length(rows.select("id", "source", F.explode(bytes_column(rows)).alias("symbol")), found, ["source"], ["id"], "symbol")
    else:
        cost = tables.counted_length(each.withColumnsRenamed({"b": "symbol", "n": "_n"}), found, ["source"], ["id"], "symbol")
    return cost.select("id", F.round("bits", 4).alias("bits"))


def chunk_history_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each document's bytes by chunk of 4,096, and one plus those of all chunks before."""
    rows = records(spark, sf_dir)
    each = profile.exploded(rows, ["id"], bytes_column(rows)).withColumnRenamed("token", "symbol")
    return tables.chunk_history(each, ["id"], "symbol", "pos", 4096)


def context_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next-byte frequencies, scaled to 65,536, after each of the 64 bytes with the most transitions."""
    rows = records(spark, sf_dir)
    pairs = tables.contexts(cut(byte_bigrams(rows, [])))
    with_escape = pairs.select("a", "b", "n").unionByName(pairs.groupBy("a").agg(F.lit(257).alias("b"), F.first("escape").alias("n")))
    return tables.normalised(with_escape, ["a"], "b", "n").select(F.col("a").alias("context"), F.col("b").alias("symbol"), "n", "freq")


def context_escape_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions and distinct successors of each byte with 20 or more, by source; and the order-0 escape of the source."""
    rows = records(spark, sf_dir)
    t = bytes_column(rows)
    size = profile.bigrams(rows, ["source"], t).groupBy("source", "a").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("escape")).where("total >= 20")
    whole = profile.histogram(rows, ["source"], t).groupBy("source").agg(F.sum("n").alias("t")).withColumnRenamed("source", "s")
    return size.join(whole, F.col("source").eqNullSafe(F.col("s"))).select("source", F.col("a").alias("context"), "total", "escape", tables.order0_escape(F.col("t")).alias("order0_escape"))


def chunk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols between two table updates for each document's bytes: the fixed least, or more where tables are large."""
    rows = records(spark, sf_dir)
    n, k = F.octet_length("data").cast("long"), F.size(F.array_distinct(bytes_column(rows))).cast("long")
    return rows.select("id", F.greatest(F.lit(256).cast("long"), F.floor(n * k / F.lit(2_000_000)).cast("long")).alias("size"))


def match_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By document: places whose two bytes occurred before, within 32,768 places, and the sum of distances to the latest of those."""
    rows = records(spark, sf_dir)
    if back := jvm.function("Back", "n bigint, distance bigint"):
        own = rows.select("id", back("data", F.lit(32768)).alias("x")).where("x.n > 0")
        return own.groupBy("id").agg(F.sum("x.n").alias("n"), F.sum("x.distance").alias("distance"))
    each = profile.exploded(rows, ["id"], bytes_column(rows))
    w = Window.partitionBy("id").orderBy("pos")
    pairs = each.withColumn("b", F.lead("token").over(w)).where("b is not null")
    back = F.col("pos") - F.lag("pos").over(Window.partitionBy("id", "token", "b").orderBy("pos"))
    return pairs.withColumn("back", back).where("back <= 32768").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("back").cast("long").alias("distance"))


def cascade_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits of each document under tables by previous byte where it has one of the 64 best contexts, else under the common table."""
    rows = records(spark, sf_dir)
    each = profile.byte_pairs(rows, ["id"], "data")
    if each is None:
        each = profile.exploded(rows, ["id"], bytes_column(rows)).withColumnRenamed("token", "symbol")
        each = each.withColumn("context", F.coalesce(F.lag("symbol").over(Window.partitionBy("id").orderBy("pos")), F.lit(-1)))
        counted = each.groupBy("id", "context", "symbol").agg(F.count(F.lit(1)).alias("k"))
    else:
        counted = each.select("id", F.col("a").alias("context"), F.col("b").alias("symbol"), F.col("n").alias("k"))
    found = cut(context_tables(spark, sf_dir))
    order1 = found.where("symbol < 257").select(F.col("context").alias("c"), F.col("symbol").alias("s"), F.col("freq").alias("f1"))
    escape = found.where("symbol = 257").select(F.col("context").alias("c"), F.col("freq").alias("fe"))
    one = counted.groupBy("symbol").agg(F.sum("k").alias("n")).withColumn("t", F.lit(0))
    order0 = cut(tables.normalised(one, ["t"], "symbol", "n").select(F.col("symbol").alias("s"), F.col("freq").alias("f0")))
    joined = counted.join(F.broadcast(order1), (F.col("context") == F.col("c")) & (F.col("symbol") == F.col("s")), "left").drop("c", "s")
    joined = joined.join(F.broadcast(escape), F.col("context") == F.col("c"), "left").drop("c").join(F.broadcast(order0), F.col("symbol") == F.col("s"))
    bits = F.coalesce(16 - F.log2("f1"), F.coalesce(16 - F.log2("fe"), F.lit(0.0)) + 16 - F.log2("f0"))
    return joined.groupBy("id").agg(F.round(F.sum(F.col("k") * bits), 3).alias("bits"))


# Choice of priming text.


def priming_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces each document gives to the first 4,096 of all documents in order; the running sum sees as many rows as can matter."""
    rows = _pieces(spark, sf_dir).select("id", F.size("tokens").cast("long").alias("n")).where("n > 0").orderBy("id").limit(dictionary.PRIMING)
    before = F.coalesce(F.sum("n").over(Window.orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = F.least(F.col("n"), dictionary.PRIMING - F.col("before"))
    return rows.withColumn("before", before).where(F.col("before") < dictionary.PRIMING).select("id", taken.cast("long").alias("taken"))


def _pieces(spark: SparkSession, sf_dir: str, steady: bool = False) -> DataFrame:
    return records(spark, sf_dir, steady).select("id", tokens.pieces(F.col("text")).alias("tokens"))


def doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents each piece occurs."""
    return dictionary.doc_frequency(_pieces(spark, sf_dir)).withColumnRenamed("token", "piece")


def coverage_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 documents whose pieces occur in the most others, higher ids first among equals."""
    scored = dictionary.coverage(_pieces(spark, sf_dir))
    return scored.orderBy(F.col("score").desc(), F.col("id").desc()).limit(100)


def dmer_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 500 most frequent runs of eight pieces."""
    each = dictionary.dmers(_pieces(spark, sf_dir), []).select(F.array_join("dmer", "").alias("dmer"))
    return dictionary.most_frequent(each, "dmer", 500)


def segment_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-overlapping segments of 256 pieces of every document."""
    return dictionary.segments(_pieces(spark, sf_dir), ["id"]).select("id", F.col("start").cast("long").alias("start"), F.size("tokens").cast("long").alias("n"))


def segment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each segment's score by the frequency of its runs of eight pieces."""
    found = dictionary.segment_scores(_pieces(spark, sf_dir, steady=True))
    return found.select("id", F.col("start").cast("long").alias("start"), "score")


def bpe_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring bytes within pieces over all documents: the first round of merges."""
    return training.pair_counts(records(spark, sf_dir))


# Records, containers, registries.


def jsonl_record_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' HTML as files: records by the line rule."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(tokens.records(F.col("html"))).alias("ordinal", "record"))
    return rows.select("page_id", F.col("ordinal").cast("long").alias("ordinal"), "record")


def container_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinals and byte offsets of conversation turns in one container a conversation."""
    rows = table(spark, sf_dir, "conversations")
    return containers.offsets(rows, ["conv_id"], "turn", F.octet_length(F.coalesce("text", F.lit(""))))


def indexed_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record with ordinal 1 of every conversation, read out of an index of its turns without decoding others."""
    data = F.concat_ws("|", F.col("turn").cast("string"), F.coalesce("text", F.lit("")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.encode(data, "UTF-8").alias("data"))
    packed = cut(_whole_indexes(rows, "conv_id", "turn"))
    # Where a conversation was cut between two tasks, its record 1 may be the first of the second part.
    parts = [packed.where(f"at = {k} and n_records > {1 - k}").select("conv_id", containers.read(1 - k)("blob").cast("string").alias("r")) for k in (0, 1)]
    return parts[0].unionByName(parts[1]).select("conv_id", F.substring_index("r", "|", 1).cast("long").alias("turn"), F.expr("substring(r, locate('|', r) + 1)").alias("text"))


def _whole_indexes(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Indexes of each key's records (data); ``at``: the records in those before, where a key was cut between two tasks."""
    packed = containers.pack(rows, [key], "data", order, kind="index", fast=True, most_bytes=1 << 62)
    before = F.sum("n_records").over(Window.partitionBy(key).orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    return packed.withColumn("at", F.coalesce(before, F.lit(0)))


def record_size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by power of two of their size and source."""
    n = F.octet_length("data").cast("long")
    bucket = F.when(n == 0, F.lit(0)).otherwise(F.length(F.conv(n.cast("string"), 10, 2))).cast("long")
    return records(spark, sf_dir).groupBy("source", bucket.alias("bits")).agg(F.count(F.lit(1)).alias("n"), F.sum(n).alias("n_bytes"))


def per_source_ratio_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ratios by source are made of: records, bytes, mean and deviation of sizes."""
    n = F.octet_length("data")
    return records(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(n).cast("long").alias("n_bytes"), F.round(F.avg(n), 4).alias("mean"), F.round(F.stddev_samp(n), 4).alias("deviation"))


def fingerprint_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event streams whose dictionary a registry lacks, found by parsing their headers: events with odd ids are coded with the one that it doesn't know."""
    rows = events(spark, sf_dir).select("id", "data")
    known, other = (_flat_dictionary(text) for text in (b"click|view", b"purchase"))
    streams = [rows.where(f"id % 2 = {k}").select("id", codec.compress(dictionary=d, mode=stream.DICTIONARY)("data").alias("blob")) for k, d in enumerate((known, other))]
    registry = spark.createDataFrame([(known.fingerprint.hex(),)], "fingerprint string")
    return codec.unknown(streams[0].unionByName(streams[1]), registry).select("id")


def _flat_dictionary(priming: bytes) -> dictionary.Dictionary:
    """A dictionary of priming text and a table of all bytes and the match flag alike."""
    return dictionary.Dictionary(list(priming), Table.of(list(range(258)), [1] * 258), {}, 257, Vocabulary().fingerprint)


# Round trips.


def _round_trip(mode: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = records(spark, sf_dir)
        blob = codec.compress(mode=mode)(F.col("data"))
        return _checked(rows.select("id", F.octet_length("data").alias("n"), blob.alias("blob")), mode)

    run.__doc__ = f"Every document after coding with the {stream.NAMES[mode]} layout and back; empty ones by the empty layout."
    return run


def _checked(rows: DataFrame, mode: int) -> DataFrame:
    """Decoded texts of streams (id, n, blob); a stream of another mode than asked gives null."""
    h = rows.withColumn("h", codec.parse_header()("blob"))
    right = F.col("h.mode") == F.when(F.col("n") == 0, F.lit("empty")).otherwise(F.lit(stream.NAMES[mode]))
    return h.select("id", F.when(right, codec.decompress()("blob").cast("string")).alias("text"))


def roundtrip_smallest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after coding with the smallest of all layouts and back."""
    rows = records(spark, sf_dir).select("id", codec.compress()("data").alias("blob"))
    return rows.select("id", codec.decompress()("blob").cast("string").alias("text"))


def roundtrip_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after fast coding and back."""
    rows = records(spark, sf_dir).select("id", codec.compress(fast=True)("data").alias("blob"))
    return rows.select("id", codec.decompress()("blob").cast("string").alias("text"))


def roundtrip_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as match events and replayed."""
    rows = records(spark, sf_dir).select("id", codec.lz_events()("data").alias("e"))
    return rows.select("id", codec.lz_replay()("e").cast("string").alias("text"))


def stream_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes that the headers of the documents' streams declare, read without decoding."""
    h = records(spark, sf_dir).select("id", codec.parse_header()(codec.compress(fast=True)("data")).alias("h"))
    return h.select("id", F.col("h.size").alias("n_bytes"), F.col("h.error").isNull().alias("readable"))


def damaged_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' streams with their last byte changed, or cut by one, and whether decoding found it out."""
    blobs = records(spark, sf_dir).select("id", codec.compress(fast=True)("data").alias("b"))
    n = F.octet_length("b")
    last = F.unhex(F.lpad(F.hex(F.conv(F.hex(F.substring("b", n, F.lit(1))), 16, 10).cast("int").bitwiseXOR(F.lit(255))), 2, "0"))
    head = F.substring("b", F.lit(1), n - 1)
    bad = blobs.select("id", F.explode(F.create_map(F.lit("changed"), F.concat(head, last), F.lit("cut"), head)).alias("damage", "b"))
    return bad.select("id", "damage", codec.try_decompress()("b").alias("x")).select("id", "damage", F.col("x.error").isNotNull().alias("found"))


def event_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that literals and matches of each document stand for."""
    e = records(spark, sf_dir).select("id", codec.lz_events()("data").alias("e"))
    covered = F.aggregate(codec.matches(F.col("e")), F.lit(0).cast("long"), lambda a, m: a + m["length"])
    return e.select("id", (F.size(codec.literals(F.col("e"))) + covered).cast("long").alias("n_bytes"))


def roundtrip_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts written through the data source to the shared folder and read back."""
    path = f"{shared_dir(spark).rstrip('/')}/lexpack/source-{uuid.uuid4().hex}"
    source.register(spark)
    table(spark, sf_dir, "benchmark").where("text is not null").select(F.encode("text", "UTF-8").alias("data")).write.format("lexpack").option("path", path).mode("append").save()
    return spark.read.format("lexpack").option("path", path).load().select(F.col("data").cast("string").alias("text"))


def roundtrip_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranks of a vocabulary trained on all documents, and whether each has the same token after a rank file was written and read back."""
    v = _vocabulary(records(spark, sf_dir))
    path = f"{shared_dir(spark).rstrip('/')}/lexpack/ranks-{uuid.uuid4().hex}"
    files.save_vocabulary(spark, v, path)
    own = spark.createDataFrame([(t, i) for t, i in v.ranks.items()], "own binary, rank int")
    return own.join(files.read_ranks(spark, path), "rank", "full").select(F.col("rank").cast("long").alias("rank"), F.col("own").eqNullSafe(F.col("token")).alias("same"))


def _vocabulary(rows: DataFrame, size: int = 1024) -> Vocabulary:
    return training.train(rows, size, sample_bytes=None)


def roundtrip_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as ids of a vocabulary of 1,024 tokens trained on all of them, and back, with its number of tokens bounded by its bytes."""
    rows = records(spark, sf_dir)
    v = _vocabulary(rows)
    ids = rows.select("id", "data", tokens.encode(v)("data").alias("ids"))
    return ids.select("id", tokens.decode(v)("ids").cast("string").alias("text"), (F.size("ids") <= F.octet_length("data")).alias("shorter"))


def roundtrip_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event records after coding with the layout of a dictionary trained on those whose id hash says so (a third), and back."""
    rows = events(spark, sf_dir)
    d = dictionary.train(rows.where(F.crc32(F.col("id").cast("string").cast("binary")) % 3 == 0))
    blob = rows.select("id", codec.compress(dictionary=d, mode=stream.DICTIONARY)("data").alias("blob"))
    return blob.select("id", codec.decompress(dictionary=d)("blob").cast("string").alias("record"), codec.parse_header()("blob")["mode"].alias("mode"))


def roundtrip_pack_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items packed by flags into batches and unpacked, in order."""
    rows = line_records(spark, sf_dir).withColumn("o", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    packed = containers.pack(rows, ["l_returnflag", "l_linestatus"], "data", "o", fast=True)
    each = containers.unpack(packed, "blob", keep=["l_returnflag", "l_linestatus"])
    return each.select("l_returnflag", "l_linestatus", F.col("data").cast("string").alias("record"))


def roundtrip_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns packed into an index a conversation and unpacked, with the order of turns."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    each = containers.unpack(_whole_indexes(rows, "conv_id", "turn"), "blob", keep=["conv_id", "at"])
    return each.select("conv_id", (F.col("at") + F.col("ordinal")).alias("ordinal"), F.col("data").cast("string").alias("text"))


def vocabulary_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranks beyond the single bytes of a vocabulary trained on all documents, and whether two tokens of lower rank make each token."""
    v = _vocabulary(records(spark, sf_dir))
    ranks = spark.createDataFrame([(t, i) for t, i in v.ranks.items()], "token binary, rank int")
    bad = training.broken(ranks).select("rank", F.lit(False).alias("joined"))
    return ranks.where("octet_length(token) > 1").join(bad, "rank", "left").select(F.col("rank").cast("long").alias("rank"), F.coalesce("joined", F.lit(True)).alias("joined"))


def compression_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes in and out of every document on its own by source: this codec beside four general-purpose compressors."""
    return codec.compare(records(spark, sf_dir), ["source"], "data")


def dictionary_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a dictionary trained on the event records holds."""
    info = dictionary.train(events(spark, sf_dir)).info()
    return spark.createDataFrame([(info["id"], info["alphabet"], info["priming"], info["order0_symbols"], info["context_tables"])], "id string, alphabet int, priming int, order0_symbols int, context_tables int")


def queries() -> dict[str, Query]:
    named = (
        pretoken_counts, piece_lengths, token_profile, event_profile, bigram_mi_top, symbol_topk, freq_table_normalized, cum_freq, varint_sizes, symbol_list_bytes, raw_token_bits,
        sparse_code_length, chunk_history_counts, context_tables, context_escape_mass, doc_frequency, coverage_rank, dmer_top, segment_candidates, segment_scores,
        bpe_pair_counts, jsonl_record_split, container_offsets, indexed_read, record_size_histogram, per_source_ratio_inputs, fingerprint_antijoin,
        chunk_sizes, match_candidates, cascade_cost, priming_budget, stream_headers, damaged_streams, event_lengths, roundtrip_source, roundtrip_ranks,
        roundtrip_smallest, roundtrip_fast, roundtrip_events, roundtrip_vocab, roundtrip_dictionary, roundtrip_pack_unpack, roundtrip_index, vocabulary_chain,
        compression_ratios, dictionary_summary,
    )
    modes = [m for m in range(len(stream.NAMES)) if m not in (stream.EMPTY, stream.DICTIONARY)]
    return {f.__name__: f for f in named} | {f"roundtrip_{stream.NAMES[m]}": _round_trip(m) for m in modes}
