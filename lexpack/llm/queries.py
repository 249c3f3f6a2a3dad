"""The ten operators as queries over whole tables, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexpack.session import ship, spread
from lexpack.llm import decontaminate, embeddings, langid, lines, mixing, ngram, quality, shards, simhash, tokencount


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(ship(spark).read.parquet(f"{sf_dir}/{name}.parquet"), steady=True)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.report(_table(spark, sf_dir, "embeddings"))


def op3_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.report(_table(spark, sf_dir, "documents"))


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.report(_table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.report(_table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(_table(spark, sf_dir, "documents"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(_table(spark, sf_dir, "documents"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_embeddings, op3_ngram, op4_shards, op5_token_counts, op6_language, op7_mix, op8_simhash, op9_lines, op10_quality)}


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP1_SQL = rf"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM benchmark WHERE text IS NOT NULL
), win AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)
), doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents
), gram AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM win))
), hit AS (
  SELECT r, gram.n, i, item FROM gram JOIN win ON gram.g = win.g AND gram.n = win.n
), words AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r
), items AS (
  SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY r
)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w FROM s
), o AS (
  SELECT *, coalesce(sum(source_size) OVER before, 0) AS closed, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS open_w, sum(source_size) OVER () AS total
  FROM w WINDOW before AS (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (
  SELECT *, 2.0 * CAST(source_size AS DOUBLE) < w * (1.5 * CAST(total AS DOUBLE) - 2.0 * CAST(closed AS DOUBLE)) / open_w AS capped FROM o
), t AS (
  SELECT source, source_size, CASE WHEN capped THEN source_size * CAST(2 AS DOUBLE) ELSE w * (1.5 * CAST(total AS DOUBLE) - CAST(2 AS DOUBLE) * rest) / rest_w END AS target
  FROM c, (SELECT CAST(coalesce(sum(source_size) FILTER (capped), 0) AS DOUBLE) AS rest, sum(w) FILTER (NOT capped) AS rest_w FROM c)
), g AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies FROM t
), b AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.copies, g.target - g.copies * g.source_size AS budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.h) AS own, count(*) OVER (PARTITION BY d.source, d.h) AS n
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       CAST(copies * size + CASE WHEN upto <= budget THEN size WHEN upto - own <= budget THEN least(size, floor((budget - (upto - own)) / n)) ELSE 0 END AS BIGINT) AS taken
FROM b
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1_SQL, "op7_mix": OP7_SQL}
