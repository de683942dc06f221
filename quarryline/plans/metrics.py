"""Metrics over the graded candidates of all questions, and aggregates over all events and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import metrics as M
from quarryline.plans.text import Q_SQL
from quarryline.session import first_delivery, table

GRADED = r"^[0-3]$"


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = first_delivery(table(spark, sf_dir, "merged_dataset").select("record_id", "category", "candidates", "ingested_at"), "record_id", ["ingested_at"])
    each = rows.select("record_id", F.posexplode("candidates").alias("at", "c"))
    return each.select("record_id", (F.col("at") + 1).alias("rank"), F.col("c.file").alias("file"), F.when(F.col("c.grade").rlike(GRADED), F.col("c.grade").cast("int")).alias("grade"))


def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.ranking(_ranked(spark, sf_dir), "record_id", 3)
    return found.select("record_id", *[F.round(c, 6).alias(c) for c in found.columns if c != "record_id"])


def pass_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _ranked(spark, sf_dir).where("grade is not null").groupBy("record_id").agg(F.count("*").alias("n"), F.sum((F.col("grade") > 0).cast("int")).alias("c"))
    return n.select("record_id", "n", "c", *[F.round(M.pass_at_k(F.col("n"), F.col("c"), k), 6).alias(f"pass_{k}") for k in (1, 2, 3)])


def _latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("value is not null").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 9).alias("latency"), (F.count("*") / 100).alias("quality"))


def utility_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.utilities(_latencies(spark, sf_dir), "user_id", "event_type", "quality", "latency")
    return rows.select("user_id", "event_type", F.round("utility", 6).alias("utility"), "rank", "tied_with", F.round("confidence", 5).alias("confidence"))


def aggregate_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("month", F.date_format("ts", "yyyy-MM"))
    sets = rows.groupingSets([["event_type", "month"], ["event_type"], ["month"], []], "event_type", "month")
    return sets.agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.count_if(F.col("event_type") == "error").alias("errors"))


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("value is not null")
    return rows.groupBy("event_type").agg(*[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)").alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)])


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.histogram(table(spark, sf_dir, "events"), "value", 10, "event_type")


def pearson_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.pearson(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return found.select("a", "b", F.round("r", 6).alias("r"))


def descriptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.described(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice")
    return found.select("l_returnflag", "n", *[F.round(c, 4).alias(c) for c in ("mean", "median", "deviation", "least", "greatest")])


def aggregate_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the metrics per category as a person would write it; ungraded questions don't count."""
    q = first_delivery(table(spark, sf_dir, "merged_dataset").select("record_id", "category", "ingested_at"), "record_id", ["ingested_at"])
    rows = M.ranking(_ranked(spark, sf_dir), "record_id", 3).join(q, "record_id").withColumn("category", F.regexp_replace(F.lower(F.trim("category")), "[- ]", "_"))
    return rows.where("category is not null").groupBy("category").agg(F.count("precision").alias("graded"), *[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "reciprocal_rank", "ndcg_linear")])


def margin_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose first candidate isn't relevant though its grade stands apart: the margin to the best other is above
    the third quartile of all margins."""
    r = _ranked(spark, sf_dir).where("grade is not null")
    best = r.groupBy("record_id").agg(F.max(F.when(F.col("rank") == 1, F.col("grade"))).alias("top"), F.max(F.when(F.col("rank") > 1, F.col("grade"))).alias("other")).where("top is not null and other is not null")
    rows = best.withColumn("margin", F.abs(F.col("top") - F.col("other")))
    edge = rows.agg(F.percentile("margin", 0.75)).first()[0]  # one number
    return rows.where((F.col("top") < F.col("other")) & (F.col("margin") > F.lit(edge if edge is not None else 0.0)))


QUERIES = {
    "ranking_metrics": ranking_metrics, "pass_at_k": pass_at_k, "utility_rank": utility_rank, "aggregate_grouping_sets": aggregate_grouping_sets, "latency_percentiles": latency_percentiles,
    "histogram": histogram, "pearson_matrix": pearson_matrix, "descriptive": descriptive, "aggregate_by_category": aggregate_by_category, "margin_failures": margin_failures,
}

RANKED_SQL = f"""u AS (SELECT record_id, unnest(candidates) AS c, unnest(range(1, len(candidates) + 1)) AS rank FROM {Q_SQL} WHERE candidates IS NOT NULL),
 r AS (SELECT record_id, rank, c.file AS file, CASE WHEN regexp_matches(c.grade, '{GRADED}') THEN try_cast(c.grade AS INT) END AS grade FROM u)"""
_METRICS = f"""{RANKED_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY grade DESC NULLS LAST, rank) AS ideal, coalesce(grade, 0)::DOUBLE AS g, (coalesce(grade, 0) > 0)::INT AS rel FROM r),
 s AS (SELECT record_id, count(grade) AS graded, sum(rel) AS relevant, count(*) AS listed, sum(rel) FILTER (rank <= 3) AS hits, min(rank) FILTER (rel = 1) AS first,
 sum(g / log2(rank + 1)) FILTER (rank <= 3) AS dcg, sum(g / log2(ideal + 1)) FILTER (ideal <= 3) AS idcg, sum((pow(2, g) - 1) / log2(rank + 1)) FILTER (rank <= 3) AS dcg2, sum((pow(2, g) - 1) / log2(ideal + 1)) FILTER (ideal <= 3) AS idcg2 FROM i GROUP BY record_id),
 m AS (SELECT record_id, CASE WHEN graded > 0 THEN hits::DOUBLE / 3 END AS precision, CASE WHEN graded > 0 THEN hits::DOUBLE / nullif(relevant, 0) END AS recall, CASE WHEN graded > 0 THEN coalesce(1.0::DOUBLE / first, 0) END AS reciprocal_rank,
 CASE WHEN graded > 0 THEN coalesce(dcg / nullif(idcg, 0), 0) END AS ndcg_linear, CASE WHEN graded > 0 THEN coalesce(dcg2 / nullif(idcg2, 0), 0) END AS ndcg_exponential, CASE WHEN graded > 0 THEN relevant::DOUBLE / listed END AS context_precision FROM s)"""
SQL = {
    "ranking_metrics": f"WITH {_METRICS} SELECT record_id, {', '.join(f'round({c}, 6) AS {c}' for c in ('precision', 'recall', 'reciprocal_rank', 'ndcg_linear', 'ndcg_exponential', 'context_precision'))} FROM m",
    "pass_at_k": f"""WITH {RANKED_SQL}, n AS (SELECT record_id, count(*) AS n, sum((grade > 0)::INT)::BIGINT AS c FROM r WHERE grade IS NOT NULL GROUP BY record_id) SELECT record_id, n, c,
 {", ".join(f"round(CASE WHEN n >= {k} THEN CASE WHEN n - c < {k} THEN 1.0::DOUBLE ELSE 1.0 - {' * '.join(f'((n - c - {i})::DOUBLE / (n - {i}))' for i in range(k))} END END, 6) AS pass_{k}" for k in (1, 2, 3))} FROM n""",
    "utility_rank": """WITH l AS (SELECT user_id, event_type, round(avg(value), 9) AS latency, count(*)::DOUBLE / 100 AS quality FROM events WHERE value IS NOT NULL GROUP BY ALL),
 u AS (SELECT *, round(quality - 0.1::DOUBLE * CASE WHEN max(latency) OVER w = min(latency) OVER w THEN 1.0 ELSE (latency - min(latency) OVER w) / nullif(max(latency) OVER w - min(latency) OVER w, 0) END, 9) AS utility FROM l WINDOW w AS (PARTITION BY user_id)),
 k AS (SELECT *, row_number() OVER o AS rank, lead(utility) OVER o AS nx FROM u WINDOW o AS (PARTITION BY user_id ORDER BY utility DESC, latency, event_type))
 SELECT a.user_id, a.event_type, round(a.utility, 6) AS utility, a.rank::INT AS rank, coalesce((SELECT string_agg(b.event_type, ',' ORDER BY b.event_type) FROM k b WHERE b.user_id = a.user_id AND b.event_type <> a.event_type AND abs(a.utility - b.utility) < 0.02::DOUBLE), '') AS tied_with,
 round(CASE WHEN a.rank = 1 THEN greatest(0::DOUBLE, least(1::DOUBLE, CASE WHEN nx IS NOT NULL THEN (a.utility - nx) / greatest(a.utility, 1e-6) ELSE 1 END)) END, 5) AS confidence FROM k a""",
    "aggregate_grouping_sets": """SELECT event_type, strftime(ts, '%Y-%m') AS month, grouping(event_type, strftime(ts, '%Y-%m'))::INT AS level, count(*) AS n, round(avg(value), 6) AS mean, (count(*) FILTER (event_type = 'error'))::BIGINT AS errors
 FROM events GROUP BY GROUPING SETS ((event_type, strftime(ts, '%Y-%m')), (event_type), (strftime(ts, '%Y-%m')), ())""",
    "latency_percentiles": "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events WHERE value IS NOT NULL GROUP BY event_type",
    "histogram": """WITH b AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events WHERE value IS NOT NULL GROUP BY event_type)
 SELECT event_type, (CASE WHEN hi = lo THEN 0 ELSE least(floor((value - lo) / nullif((hi - lo) / 10, 0)), 9) END)::INT AS bin, count(*) AS count FROM events JOIN b USING (event_type) WHERE value IS NOT NULL GROUP BY ALL""",
    "pearson_matrix": " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(coalesce(covar_pop({a}, {b}) / nullif(sqrt(var_pop({a}) * var_pop({b})), 0), 0), 6) AS r FROM lineitem"
        for i, a in enumerate(("l_quantity", "l_extendedprice", "l_discount", "l_tax")) for b in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")[i:]
    ),
    "descriptive": "SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(median(l_extendedprice), 4) AS median, round(coalesce(stddev_samp(l_extendedprice), 0), 4) AS deviation, round(min(l_extendedprice), 4) AS least, round(max(l_extendedprice), 4) AS greatest FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY l_returnflag",
    "aggregate_by_category": f"""WITH {_METRICS}, q AS (SELECT record_id, regexp_replace(lower(trim(category)), '[- ]', '_', 'g') AS category FROM {Q_SQL})
 SELECT category, count(precision) AS graded, {", ".join(f"round(avg({c}), 6) AS {c}" for c in ("precision", "recall", "reciprocal_rank", "ndcg_linear"))} FROM m JOIN q USING (record_id) WHERE category IS NOT NULL GROUP BY category""",
    "margin_failures": f"""WITH {RANKED_SQL}, b AS (SELECT record_id, max(grade) FILTER (rank = 1) AS top, max(grade) FILTER (rank > 1) AS other FROM r WHERE grade IS NOT NULL GROUP BY record_id),
 g AS (SELECT *, abs(top - other) AS margin FROM b WHERE top IS NOT NULL AND other IS NOT NULL) SELECT record_id, top, other, margin FROM g WHERE top < other AND margin > coalesce((SELECT quantile_cont(margin, 0.75) FROM g), 0)""",
}
