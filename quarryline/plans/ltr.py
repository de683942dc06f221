"""Ranking the candidates of all questions: feature matrix, and a ranker trained on one split and judged on the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import ltr as L
from quarryline.operators import metrics as M
from quarryline.plans.metrics import _ranked
from quarryline.plans.text import questions
from quarryline.session import cut


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions(spark, sf_dir).select("record_id", "query_text", "category", "split")
    return L.features(_ranked(spark, sf_dir).join(q, "record_id"), "record_id")


def ltr_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir).drop("query_text", "category", "file")


def ltr_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = cut(_matrix(spark, sf_dir))
    fitted = L.train(m.where("split = 'train'"))
    held = L.ranked(m.where("split in ('validation', 'test')"), fitted, "record_id")
    scores = M.ranking(held.select("record_id", "rank", "grade"), "record_id", 3).join(m.select("record_id", "split").distinct(), "record_id")
    return scores.groupBy("split").agg(F.count("precision").alias("questions"), *[F.avg(c).alias(c) for c in ("precision", "recall", "reciprocal_rank", "ndcg_exponential")])


QUERIES = {"ltr_features": ltr_features, "ltr_metrics": ltr_metrics}
SQL: dict[str, str] = {}
