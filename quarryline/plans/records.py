"""Queries of the record operators: nested payloads to flat tables (p4) and drifting schemas (p3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import nested, schema_drift
from quarryline.session import table


def _bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.occurrences(table(spark, sf_dir, "annotation_drafts"), "draft_id", "payload", order=("exported_at",))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    bridge = _bridge(spark, sf_dir)
    return bridge.select("draft_id", "node_path", "parent_path", "file_path")


def p4_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.objects(_bridge(spark, sf_dir))


def p4_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    bridge = _bridge(spark, sf_dir)
    return bridge.select("draft_id", "section", "node_path", "parent_path", "ordinal", "depth", "object_id", "parent_id")


def p4_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.fields(table(spark, sf_dir, "annotation_drafts"), "draft_id", "payload", order=("exported_at",))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.changes(table(spark, sf_dir, "draft_lines")).select(
        "source_file", "change_kind", "field_path", "previous_path"
    )


def p3_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.unified(table(spark, sf_dir, "draft_lines"))


def p3_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = schema_drift.changes(table(spark, sf_dir, "draft_lines"))
    return found.groupBy("series", "change_kind").agg(F.count("*").alias("changes"))


QUERIES = {
    "p3_found": p3_found, "p3_table": p3_table, "p3_by_kind": p3_by_kind,
    "p4_found": p4_found, "p4_objects": p4_objects, "p4_bridge": p4_bridge, "p4_fields": p4_fields,
}
SQL: dict[str, str] = {}
