"""Paired comparisons of event types per user, and agreement of graded candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import stats as S
from quarryline.plans.metrics import RANKED_SQL, _ranked
from quarryline.session import table


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.paired(table(spark, sf_dir, "events"), "user_id", "event_type", "value", "click", "view").withColumn("g", F.lit("click-view"))


def paired_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("user_id", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


def wilcoxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.with_signed_rank_p(S.signed_ranks(_pairs(spark, sf_dir), ["g"]))
    return rows.select("g", "n", F.round("statistic", 4).alias("statistic"), F.round("rank_biserial", 6).alias("rank_biserial"), F.round("p", 6).alias("p"))


def rank_biserial(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.signed_ranks(_pairs(spark, sf_dir), ["g"])
    return rows.select("g", "n", F.round("w_plus", 4).alias("w_plus"), F.round("w_minus", 4).alias("w_minus"), F.round("rank_biserial", 6).alias("rank_biserial"))


def holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's share of errors stands in for a p-value, the number of kinds of events for the family."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg((F.col("event_type") == "error").cast("double")).alias("p"), F.countDistinct("event_type").alias("family"))
    rows = S.holm(e, "family", "user_id", "p", 0.5)
    return rows.select("user_id", "family", F.round("p", 6).alias("p"), F.round("threshold", 6).alias("threshold"), "rejected")


def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max((F.col("event_type") == "purchase").cast("int")).alias("p"), F.max((F.col("event_type") == "error").cast("int")).alias("e"), F.count("*").alias("n"))
    rows = S.mcnemar(e.withColumn("g", F.when(F.col("n") > 60, "busy").otherwise("quiet")).withColumn("a", F.col("p") == 1).withColumn("b", F.col("e") == 1), "g", "a", "b")
    return rows.select("g", "only_a", "only_b", F.round("statistic", 6).alias("statistic"))


def spearman_rho(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.spearman(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice").select("n", F.round("rho", 6).alias("rho"))


def _ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question's first two candidates stand in for two raters of it."""
    r = _ranked(spark, sf_dir)
    pick = lambda k: F.max(F.when(F.col("rank") == k, F.col("grade")))
    return r.where("rank <= 2").groupBy("record_id").agg(pick(1).alias("a"), pick(2).alias("b")).withColumn("g", (F.col("record_id") % 10).cast("int"))


def weighted_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.agreement(_ratings(spark, sf_dir), "g", "a", "b")
    return rows.select("g", "n", F.round("exact", 6).alias("exact"), F.round("kappa", 6).alias("kappa"))


def judgment_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _ratings(spark, sf_dir)
    a, b = r.where("a is not null").select("record_id", F.col("a").alias("grade")), r.where("b is not null").select("record_id", F.col("b").alias("grade"))
    return S.merged_judgments(a, b, ["record_id"])


def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _pairs(spark, sf_dir).withColumn("d", F.col("a") - F.col("b"))
    return S.bootstrap_interval(d, "g", "d", rounds=500)


QUERIES = {
    "paired_sample": paired_sample, "wilcoxon": wilcoxon, "rank_biserial": rank_biserial, "holm": holm, "mcnemar": mcnemar, "spearman_rho": spearman_rho,
    "weighted_kappa": weighted_kappa, "judgment_merge": judgment_merge, "bootstrap": bootstrap,
}

_PAIRED = "m AS (SELECT user_id, avg(value) FILTER (event_type = 'click') AS a, avg(value) FILTER (event_type = 'view') AS b FROM events WHERE value IS NOT NULL GROUP BY user_id), s AS (SELECT * FROM m WHERE a IS NOT NULL AND b IS NOT NULL)"
_RATED = f"{RANKED_SQL}, t AS (SELECT record_id, max(grade) FILTER (rank = 1) AS a, max(grade) FILTER (rank = 2) AS b, (record_id % 10)::INT AS g FROM r WHERE rank <= 2 GROUP BY record_id)"
SQL = {
    "paired_sample": f"WITH {_PAIRED} SELECT user_id, round(a, 6) AS a, round(b, 6) AS b FROM s",
    "rank_biserial": f"""WITH {_PAIRED}, d AS (SELECT round(a - b, 12) AS d FROM s WHERE round(a - b, 12) <> 0), k AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS r FROM d)
 SELECT 'click-view' AS g, count(*) AS n, round(coalesce(sum(r) FILTER (d > 0), 0), 4) AS w_plus, round(coalesce(sum(r) FILTER (d < 0), 0), 4) AS w_minus, round((coalesce(sum(r) FILTER (d > 0), 0) - coalesce(sum(r) FILTER (d < 0), 0)) / sum(r), 6) AS rank_biserial FROM k""",
    "holm": """WITH e AS (SELECT user_id, avg((event_type = 'error')::INT) AS p, count(DISTINCT event_type) AS family FROM events GROUP BY user_id),
 i AS (SELECT *, 0.5::DOUBLE / (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, user_id) + 1) AS threshold FROM e)
 SELECT user_id, family, round(p, 6) AS p, round(threshold, 6) AS threshold, min((p <= threshold)::INT) OVER (PARTITION BY family ORDER BY p, user_id) = 1 AS rejected FROM i""",
    "mcnemar": """WITH e AS (SELECT max((event_type = 'purchase')::INT) = 1 AS a, max((event_type = 'error')::INT) = 1 AS b, CASE WHEN count(*) > 60 THEN 'busy' ELSE 'quiet' END AS g FROM events GROUP BY user_id),
 c AS (SELECT g, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b FROM e GROUP BY g) SELECT g, only_a, only_b, round(coalesce(pow(greatest(abs(only_a - only_b) - 1, 0), 2)::DOUBLE / nullif(only_a + only_b, 0), 0), 6) AS statistic FROM c""",
    "spearman_rho": """WITH k AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0::DOUBLE AS b FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL)
 SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM k""",
    "weighted_kappa": f"""WITH {_RATED}, b2 AS (SELECT * FROM t WHERE a IS NOT NULL AND b IS NOT NULL), n AS (SELECT g, count(*) AS n, avg((a = b)::INT) AS exact, avg(pow(a - b, 2)) AS seen FROM b2 GROUP BY g),
 ch AS (SELECT x.g, sum(pow(x.a - y.b, 2)) AS chance FROM b2 x JOIN b2 y USING (g) GROUP BY x.g) SELECT g, n, round(exact, 6) AS exact, round(coalesce(1 - seen / nullif(chance / (n * n), 0), 1), 6) AS kappa FROM n JOIN ch USING (g)""",
    "judgment_merge": f"""WITH {_RATED} SELECT record_id, CASE WHEN abs(a - b) <= 1 THEN least(a, b) END AS grade, CASE WHEN a IS NULL OR b IS NULL THEN 'missing' WHEN a = b THEN 'agreed' WHEN abs(a - b) = 1 THEN 'lesser' ELSE 'adjudicate' END AS status FROM t WHERE a IS NOT NULL OR b IS NOT NULL""",
}
