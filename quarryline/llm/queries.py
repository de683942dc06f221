"""Queries of the training-data operators tagged llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import documented, mixing, overlap, packing, sources, splits, subjects
from quarryline.session import cut, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.pairs(table(spark, sf_dir, "merged_dataset"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.report(table(spark, sf_dir, "merged_dataset"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.invalid(table(spark, sf_dir, "source_files")).select("file_id")


def p2_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.checked(table(spark, sf_dir, "source_files"))


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.rates(table(spark, sf_dir, "source_files"), table(spark, sf_dir, "parse_errors"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documented.documented(table(spark, sf_dir, "source_files")).select("file_id", "name", "start_line")


def p6_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documented.pairs(table(spark, sf_dir, "source_files"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.found(table(spark, sf_dir, "merged_dataset"), table(spark, sf_dir, "repositories"))


def p5_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.assign(table(spark, sf_dir, "merged_dataset"), table(spark, sf_dir, "repositories"), table(spark, sf_dir, "split_targets"))


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = cut(p5_assign(spark, sf_dir).groupBy("split").agg(F.count("*").alias("records"), F.countDistinct("component").alias("components")))
    total = got.agg(F.sum("records")).first()[0] or 1
    return got.select("split", "records", "components", (F.col("records") / F.lit(total)).alias("share"))


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "containers"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(p7_pack(spark, sf_dir), table(spark, sf_dir, "containers"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.assigned(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subjects"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).distinct()


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).groupBy("subject").agg(F.countDistinct("doc_id").alias("documents"))


QUERIES = {
    "p1_found": p1_found, "p1_report": p1_report, "p2_found": p2_found, "p2_files": p2_files, "p2_rates": p2_rates,
    "p6_found": p6_found, "p6_pairs": p6_pairs, "p5_found": p5_found, "p5_assign": p5_assign, "p5_shares": p5_shares, "p7_pack": p7_pack, "p7_fill": p7_fill,
    "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_composition": p9_composition,
}
def _key_sql(name: str) -> str:
    plain = f"lower(trim({name}))"
    for pattern in (r"^[a-z+]+://[^/]+/", r"/+$", r"\.git$", r"^.*/"):
        plain = f"regexp_replace({plain}, '{pattern}', '')"
    return f"nullif(regexp_replace({plain}, '[-_.\\s]', '', 'g'), '')"


SQL = {
    "p5_found": f"""WITH RECURSIVE up AS (SELECT repository_id AS id, repository_id AS root, fork_of FROM repositories
 UNION ALL SELECT u.id, p.repository_id, p.fork_of FROM up u JOIN repositories p ON u.fork_of = p.repository_id),
 ends AS (SELECT id, root FROM up WHERE fork_of IS NULL OR fork_of NOT IN (SELECT repository_id FROM repositories)),
 n AS (SELECT repository_id AS id, {_key_sql("repository_id")} AS key, 0 AS r FROM repositories UNION ALL SELECT repository_id, {_key_sql("f")}, 1 FROM (SELECT repository_id, unnest(former_names) AS f FROM repositories)),
 k AS (SELECT key, first(id ORDER BY r, id) AS id FROM n WHERE key IS NOT NULL GROUP BY key), x AS (SELECT lower(query_prefix) AS prefix, min(repository_id) AS id FROM repositories GROUP BY ALL),
 m AS (SELECT record_id, repository_id, query_id FROM merged_dataset WHERE record_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY ingested_at NULLS FIRST) = 1),
 j AS (SELECT record_id, repository_id, {_key_sql("repository_id")} AS key, CASE WHEN repository_id IS NULL THEN nullif(regexp_extract(lower(trim(query_id)), '^(.+?)[-_]\\d+(?:-r\\d+)?$', 1), '') END AS prefix FROM m)
 SELECT record_id, root AS root_repository_id FROM j LEFT JOIN k USING (key) LEFT JOIN x USING (prefix) JOIN ends ON ends.id = coalesce(k.id, x.id) WHERE repository_id IS DISTINCT FROM root""",
}
