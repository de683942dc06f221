"""Streaming twins of batch queries: the stream's result equals the batch's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import decide as D
from quarryline.plans import decide as P
from quarryline.streaming import ingest


def stream_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions are classified as they arrive; the first delivery of a record stands."""
    keep = ["record_id", "ingested_at", "task", "confidence", *D.FLAGS, "kind"]
    rows = ingest.run(ingest.read(spark, sf_dir, "merged_dataset"), lambda batch: D.classified(batch).select(*keep))
    first = rows.groupBy("record_id").agg(F.min(F.struct("ingested_at", *[c for c in keep if c not in ("record_id", "ingested_at")])).alias("r")).where("record_id is not null")
    return first.select("record_id", "r.task", F.round("r.confidence", 6).alias("confidence"), *[f"r.{f}" for f in D.FLAGS], "r.kind")


def stream_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ingest.statistics(ingest.read(spark, sf_dir, "events"), "event_type", "value")
    return s.select("event_type", "n", F.round("total", 4).alias("total"), "least", "greatest")


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.windowed(ingest.read(spark, sf_dir, "events"), "ts", "event_type").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


QUERIES = {"stream_classify": stream_classify, "stream_statistics": stream_statistics, "stream_windows": stream_windows}
SQL = {
    "stream_classify": P.SQL["classify_task"],
    "stream_statistics": "SELECT event_type, count(value) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS greatest FROM events GROUP BY event_type",
    "stream_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
}
