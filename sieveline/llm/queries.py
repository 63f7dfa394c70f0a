"""The registered queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import knn, language, mixing, packing, quality, simhash, suffix_dedup, syncmers, toxicity, url_rules
from sieveline.llm.common import table

#: The rules that op7 applies: verdict, host, path.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op1_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = knn.top_k(table(spark, sf_dir, "embeddings"), lambda key: key % 50 == 0, k=5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op2_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_text(F.col("print")).alias("fingerprint"), "component_id")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(table(spark, sf_dir, "documents"), length=200)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return url_rules.judge(table(spark, sf_dir, "pages"), rules)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_voronoi_knn": op1_voronoi_knn,
    "op2_closed_syncmers": op2_closed_syncmers,
    "op3_source_mixing": op3_source_mixing,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_language_id": op6_language_id,
    "op7_url_rules": op7_url_rules,
    "op8_quality": op8_quality,
    "op9_toxicity": op9_toxicity,
    "op10_best_two_fit": op10_best_two_fit,
}

SQL = {
    "op3_source_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS hash FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM d GROUP BY source),
o AS (SELECT *, sum(weight) OVER w AS upto_weight, sum(source_size) OVER w AS upto_size, sum(weight) OVER () AS weights, sum(source_size) OVER () AS total,
             row_number() OVER w AS place FROM s WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
-- how many sources, from the smallest size by weight, are capped: each of them is above its cap at the level that those before it leave
c AS (SELECT coalesce(max(place), 0) AS capped FROM o
      WHERE weight * (total - 3 * (upto_size - source_size))::DOUBLE / (weights - (upto_weight - weight)) > 3 * source_size),
t AS (SELECT source, source_size, CASE WHEN place <= capped THEN (3 * source_size)::DOUBLE ELSE weight::DOUBLE * (total - spent)::DOUBLE / free::DOUBLE END AS target
      FROM o, c, (SELECT coalesce(sum(CASE WHEN place <= capped THEN 3 * source_size END), 0) AS spent, sum(CASE WHEN place > capped THEN weight END) AS free FROM o, c)),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
r AS (SELECT d.doc_id, d.size, d.hash, e.source, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
h AS (SELECT source, hash, sum(size) AS size, any_value(rest) AS rest FROM r GROUP BY source, hash),
u AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY hash ROWS UNBOUNDED PRECEDING) AS upto FROM h)
SELECT r.doc_id, r.size, r.source_size, r.target,
       (r.size * (r.epochs + CASE WHEN u.upto <= u.rest OR (u.upto - u.size <= u.rest AND 2 * (u.rest - (u.upto - u.size)) >= u.size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r JOIN u ON r.source IS NOT DISTINCT FROM u.source AND r.hash = u.hash
""",
    "op7_url_rules": r"""
WITH rules(verdict, host, path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
m AS (SELECT u.page_id, max(struct_pack(n := length(r.host) + length(r.path), r := r.host || r.path, v := r.verdict)) AS best
      FROM u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY u.page_id)
SELECT u.page_id, u.host, u.path, m.best.r AS rule, coalesce(m.best.v, 'allow') AS verdict FROM u LEFT JOIN m ON u.page_id = m.page_id
""",
}
