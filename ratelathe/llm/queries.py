"""Queries of the operators in this subpackage, with their SQL counterparts where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelathe.llm import lookalikes, mojibake, packing, terms, together, tokenize

RARE_RECORDS, COMMON_SHARE = 2, 0.1
MIN_TOGETHER, MIN_RATIO = 10, 10
CAPACITY = 1_024


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = _table(spark, sf_dir, "tags").select(F.lit("tags.tag").alias("field_name"), terms.clean_terms(F.array("tag")).alias("terms"))
    genres = _table(spark, sf_dir, "movies").select(F.lit("movies.genres").alias("field_name"), terms.clean_terms(F.split("genres", r"\|")).alias("terms"))
    counts = terms.term_counts(tags.unionByName(genres))
    return terms.mark_terms(counts, RARE_RECORDS, COMMON_SHARE).select("field_name", "term", "occurrences", "records", "mark")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_terms(spark, sf_dir).filter("mark is not null").select("field_name", "term", "mark")


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return together.pair_counts(_table(spark, sf_dir, "ratings"), "raw_user_id", "raw_item_id", MIN_TOGETHER, MIN_RATIO)


def p3_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of movies with a shared user; ``p3_pairs`` has those that are cases of ``p3_found`` only."""
    return together.pair_counts(_table(spark, sf_dir, "ratings"), "raw_user_id", "raw_item_id")


def p3_pairs_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair again, with chunks so small and items so hot that baskets are split and items' stripes counted in parts."""
    return together.pair_counts(_table(spark, sf_dir, "ratings"), "raw_user_id", "raw_item_id", block_items=256, key_baskets=1_000)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_pairs(spark, sf_dir).select("item_a", "item_b")


def p4_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = _table(spark, sf_dir, "movies").select(F.struct(F.lit("movies").alias("name"), F.col("raw_item_id").cast("long").alias("id")).alias("key"), F.col("title").alias("text"))
    tags = _table(spark, sf_dir, "tags").select(F.struct(F.lit("tags").alias("name"), F.col("tag_id").alias("id")).alias("key"), F.col("tag").alias("text"))
    found = mojibake.repaired(titles.unionByName(tags), "key", "text")
    return found.select(F.col("id.name").alias("table_name"), F.col("id.id").alias("record_id"), "text", "restored", "kind")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_repaired(spark, sf_dir).select("table_name", "record_id")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode(_table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p7_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts had back from their token ids."""
    return tokenize.decode(p7_ids(spark, sf_dir), "ids", "text").select("doc_id", "text")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = p7_ids(spark, sf_dir).select("doc_id", F.size("ids").alias("size"))
    placed = packing.fill_containers(sizes, "doc_id", "size", CAPACITY)
    return placed.withColumnRenamed("id", "doc_id")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_summary(p8_containers(spark, sf_dir), CAPACITY)


def p9_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.normal_forms(_table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "form")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = lookalikes.look_alikes(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return pairs.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p9_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookalikes.look_alike_classes(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), F.col("class_id").alias("class_doc_id"), "links")


QUERIES = {f.__name__: f for f in (p2_found, p2_terms, p3_all_pairs, p3_found, p3_pairs, p3_pairs_in_parts, p4_found, p4_repaired, p7_ids, p7_text, p8_containers, p8_fill, p9_classes, p9_found, p9_forms)}

_TERMS = """
WITH v AS (SELECT 'tags.tag' AS field_name, tag_id AS id, lower(trim(tag, ' ')) AS term FROM tags
  UNION ALL SELECT 'movies.genres', raw_item_id, lower(trim(unnest(string_split(genres, '|')), ' ')) FROM movies),
t AS (SELECT * FROM v WHERE term <> ''),
f AS (SELECT field_name, count(DISTINCT id) AS n FROM t GROUP BY ALL),
c AS (SELECT field_name, term, count(*) AS occurrences, count(DISTINCT id) AS records, any_value(n) AS n FROM t JOIN f USING (field_name) GROUP BY ALL),
m AS (SELECT *, CASE WHEN records <= 2 THEN 'rare' WHEN records * 10 > n THEN 'common' END AS mark FROM c)
"""
_PAIRS = """
WITH s AS (SELECT DISTINCT raw_user_id AS u, raw_item_id AS i FROM ratings WHERE raw_user_id IS NOT NULL AND raw_item_id IS NOT NULL),
n AS (SELECT count(DISTINCT u) AS n FROM s), c AS (SELECT i, count(*) AS k FROM s GROUP BY i),
p AS (SELECT a.i AS item_a, b.i AS item_b, count(*) AS together FROM s a JOIN s b ON a.u = b.u AND a.i < b.i GROUP BY ALL HAVING count(*) >= 10)
SELECT item_a, item_b, together, ca.k AS baskets_a, cb.k AS baskets_b, n AS baskets, together::DOUBLE * n / ca.k / cb.k AS ratio
FROM p JOIN c ca ON ca.i = item_a JOIN c cb ON cb.i = item_b, n WHERE together * n >= 10 * ca.k * cb.k"""
_ALL_PAIRS = """
WITH s AS (SELECT DISTINCT raw_user_id AS u, raw_item_id AS i FROM ratings WHERE raw_user_id IS NOT NULL AND raw_item_id IS NOT NULL),
n AS (SELECT count(DISTINCT u) AS n FROM s), c AS (SELECT i, count(*) AS k FROM s GROUP BY i),
p AS (SELECT a.i AS item_a, b.i AS item_b, count(*) AS together FROM s a JOIN s b ON a.u = b.u AND a.i < b.i GROUP BY ALL)
SELECT item_a, item_b, together, ca.k AS baskets_a, cb.k AS baskets_b, n AS baskets, together::DOUBLE * n / ca.k / cb.k AS ratio
FROM p JOIN c ca ON ca.i = item_a JOIN c cb ON cb.i = item_b, n"""

SQL = {
    "p2_found": _TERMS + "SELECT field_name, term, mark FROM m WHERE mark IS NOT NULL",
    "p2_terms": _TERMS + "SELECT field_name, term, occurrences, records, mark FROM m",
    "p3_all_pairs": _ALL_PAIRS,
    "p3_found": f"SELECT item_a, item_b FROM ({_PAIRS})",
    "p3_pairs": _PAIRS,
    "p3_pairs_in_parts": _ALL_PAIRS,
    "p7_text": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
