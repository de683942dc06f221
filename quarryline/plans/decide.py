"""Queries that classify all questions, route them and plan their retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.operators import decide as D
from quarryline.plans.text import _DISTINCT, _ID, _PATH, Q_SQL, TOKENS_SQL, questions, sql_list



def _plan_columns(*first: str) -> list:
    return [*first, "strategy", F.array_join("retrievers", ",").alias("retrievers"), "parallel", "rerank", "top_k", "candidate_limit", "graph_depth"]


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.classified(questions(spark, sf_dir))


def classify_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("record_id", "task", F.round("confidence", 6).alias("confidence"), *D.FLAGS, "kind")


def route_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.planned(_classified(spark, sf_dir), D.strategy()).select(*_plan_columns("record_id"))


def route_downgraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories without a name support neither vectors nor a graph; those of short name no graph."""
    known = F.col("repository_id").isNotNull()
    return D.planned(_classified(spark, sf_dir), D.strategy(), dense=known, graph=known & (F.length("repository_id") > 8)).select(*_plan_columns("record_id"))


def complexity_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.complexity(questions(spark, sf_dir)).select("record_id", "token_count", "identifier_count", "clause_count", "complexity_strategy")


def baseline_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.baselines(_classified(spark, sf_dir)).select(*_plan_columns("record_id", "baseline"))


def ablation_refactor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.planned(_classified(spark, sf_dir), D.strategy(refactor=False)).select(*_plan_columns("record_id"))


def ablation_no_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.planned(_classified(spark, sf_dir), D.strategy(), graph=F.lit(False)).select(*_plan_columns("record_id"))


def ablation_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.planned(_classified(spark, sf_dir), D.strategy(), top_k=10).select(*_plan_columns("record_id"))


def ablation_no_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.planned(_classified(spark, sf_dir), D.strategy(), rerank=False).select(*_plan_columns("record_id"))


def ablation_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.confidence_ablation(_classified(spark, sf_dir)).select(*_plan_columns("record_id", "threshold"))


def task_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.planned(_classified(spark, sf_dir), D.strategy())
    return rows.groupBy("task", "strategy").agg(F.count("*").alias("questions"), F.round(F.avg("confidence"), 6).alias("confidence"))


def fairness_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = D.baselines(_classified(spark, sf_dir))
    return D.uncontrolled(plans, "baseline", ["strategy", "top_k", "rerank", "graph_depth"])


QUERIES = {
    "classify_task": classify_task, "route_plan": route_plan, "route_downgraded": route_downgraded, "complexity_route": complexity_route,
    "baseline_plans": baseline_plans, "ablation_refactor": ablation_refactor, "ablation_no_graph": ablation_no_graph, "ablation_topk": ablation_topk,
    "ablation_no_rerank": ablation_no_rerank, "ablation_confidence": ablation_confidence, "task_mix": task_mix, "fairness_check": fairness_check,
}


def _sum(items: list[str]) -> str:
    return " + ".join(items) or "0"


_HIT = {r: f"list_has_any(s, {sql_list(D.KEYWORDS[r].split())})" for r, *_ in D.RULES if r != "quoted"}
_HIT["explain"] = "(" + " OR ".join([_HIT["explain"], *[f"(list_contains(s, '{a}') AND list_contains(s, '{b}'))" for a, b in D.EXPLAIN_PAIRS]]) + ")"
_HIT["quoted"] = "len(quoted) > 0"
_WEIGHT = {t: _sum([f"{w} * f_{r}::INT" for r, task, w, _ in D.RULES if task == t]) for t in D.PRIORITY}
_FLAG = {f: " OR ".join(f"f_{r}" for r, _, _, flags in D.RULES if f in flags) for f in D.FLAGS}
CLASSIFIED_SQL = f"""t0 AS (SELECT record_id, repository_id, query_text, {TOKENS_SQL} AS t, regexp_extract_all(coalesce(query_text, ''), '{X.QUOTED.replace("'", "''")}', 1) AS quoted FROM {Q_SQL}),
 t1 AS (SELECT *, list_transform(t, lambda x: lower(x)) AS s, len(list_filter(t, lambda x: regexp_matches(x, '{_ID}') AND NOT regexp_matches(x, '{_PATH}'))) + len(quoted) > 0 AS symbols FROM t0),
 t2 AS (SELECT *, {", ".join(f"{c} AS f_{r}" for r, c in _HIT.items())} FROM t1),
 t3 AS (SELECT *, {", ".join(f"{w} AS w_{t}" for t, w in _WEIGHT.items())}, {", ".join(f"{c} AS {f}0" for f, c in _FLAG.items())}, symbols AND NOT ({" OR ".join(f"f_{r}" for r in _HIT)}) AS named FROM t2),
 t4 AS (SELECT *, {_sum([f"w_{t}" for t in D.PRIORITY])} AS total, greatest({", ".join(f"w_{t}" for t in D.PRIORITY)}) AS best FROM t3),
 c AS (SELECT record_id, repository_id, CASE WHEN named THEN 'search' WHEN total > 0 THEN CASE {" ".join(f"WHEN w_{t} = best THEN '{t}'" for t in D.PRIORITY)} END ELSE 'unknown' END AS task,
 (CASE WHEN named THEN 0.3 WHEN total > 0 THEN best::DOUBLE / total::DOUBLE ELSE 0 END)::DOUBLE AS confidence, graph0 AS graph, semantic0 AS semantic, lexical0 OR named AS lexical, reasoning0 AS reasoning FROM t4)"""
_ACTIVE = "(graph::INT + semantic::INT + lexical::INT)"


def _strategy_sql(refactor: bool = True) -> str:
    whole = "(graph AND semantic AND lexical)" + (" OR task = 'refactor'" if refactor else "")
    return f"CASE WHEN {whole} THEN 'full_pipeline' WHEN graph AND semantic AND NOT lexical THEN 'graph_plus_semantic' WHEN graph AND lexical AND NOT semantic THEN 'lexical_plus_graph' WHEN graph THEN 'graph_only' WHEN lexical AND semantic THEN 'hybrid' WHEN lexical THEN 'lexical_only' ELSE 'semantic_only' END"


def _plan_sql(source: str, chosen: str, first: str = "record_id", dense: str = "true", graph: str = "true", top_k: str | None = None, rerank: str | None = None) -> str:
    has = {"lexical": "true", "dense": dense, "graph": graph}
    uses = ", ".join(f"CASE WHEN list_contains({sql_list([s for s, (rs, _) in D.STRATEGIES.items() if r in rs])}, strategy) AND {has[r]} THEN '{r}' END" for r in D.ORDER)
    size = top_k or "CASE " + " ".join(f"WHEN strategy = '{s}' THEN {k}" for s, (_, k) in D.STRATEGIES.items()) + " ELSE 10 END"
    return f"""p1 AS (SELECT *, {chosen} AS strategy FROM {source}), p2 AS (SELECT *, list_filter([{uses}], lambda x: x IS NOT NULL) AS kept FROM p1),
 p3 AS (SELECT *, CASE WHEN len(kept) > 0 THEN kept ELSE ['lexical'] END AS r FROM p2), p4 AS (SELECT *, len(r) > 1 AS parallel, ({size})::INT AS top_k FROM p3),
 p AS (SELECT *, {rerank or "parallel OR reasoning"} AS rerank FROM p4)
 SELECT {first}, strategy, array_to_string(r, ',') AS retrievers, parallel, rerank, top_k, (CASE WHEN rerank THEN top_k * 3 ELSE top_k END)::INT AS candidate_limit, (CASE WHEN list_contains(r, 'graph') THEN 3 ELSE 0 END)::INT AS graph_depth FROM p"""


def _planned_sql(chosen: str | None = None, **options) -> str:
    return f"WITH {CLASSIFIED_SQL}, {_plan_sql('c', chosen or _strategy_sql(), **options)}"


_BASE = " UNION ALL ".join(f"SELECT '{b}' AS baseline, {'NULL' if s is None else repr(s)}::VARCHAR AS fixed" for b, s in D.BASELINES.items())
_BASELINE_ROWS = f"WITH {CLASSIFIED_SQL}, b AS (SELECT c.*, v.* FROM c, ({_BASE}) v), {_plan_sql('b', 'fixed', first='record_id, baseline')}"
_BASELINES = f"SELECT record_id, baseline, strategy, CASE WHEN baseline = 'B0' THEN '' ELSE retrievers END AS retrievers, parallel, rerank, (CASE WHEN baseline = 'B0' THEN 0 ELSE top_k END)::INT AS top_k, candidate_limit, graph_depth FROM ({_BASELINE_ROWS})"
_TOKEN_ROWS = f"SELECT record_id, {TOKENS_SQL} AS t, regexp_extract_all(coalesce(query_text, ''), '{X.QUOTED.replace(chr(39), chr(39) * 2)}', 1) AS quoted FROM {Q_SQL}"
SQL = {
    "classify_task": f"WITH {CLASSIFIED_SQL} SELECT record_id, task, round(confidence, 6) AS confidence, graph, semantic, lexical, reasoning, CASE WHEN {_ACTIVE} >= 2 THEN 'hybrid' WHEN graph THEN 'graph' WHEN lexical THEN 'lexical' ELSE 'semantic' END AS kind FROM c",
    "route_plan": _planned_sql(),
    "route_downgraded": _planned_sql(dense="repository_id IS NOT NULL", graph="repository_id IS NOT NULL AND length(repository_id) > 8"),
    "complexity_route": f"""WITH q AS ({_TOKEN_ROWS}), n AS (SELECT record_id, len(t)::INT AS token_count, (len(list_filter(t, lambda x: regexp_matches(x, '{_ID}'))) + len(quoted))::INT AS identifier_count,
 (1 + len(list_filter(t, lambda x: lower(x) IN ('and', 'or', 'but'))))::INT AS clause_count FROM q)
 SELECT *, CASE WHEN token_count = 0 THEN 'lexical_only' WHEN clause_count >= 2 THEN 'full_pipeline' WHEN identifier_count >= 1 AND token_count <= 6 THEN 'lexical_only' WHEN token_count >= 12 THEN 'hybrid' ELSE 'semantic_only' END AS complexity_strategy FROM n""",
    "baseline_plans": _BASELINES,
    "ablation_refactor": _planned_sql(_strategy_sql(refactor=False)),
    "ablation_no_graph": _planned_sql(graph="false"),
    "ablation_topk": _planned_sql(top_k="10"),
    "ablation_no_rerank": _planned_sql(rerank="false"),
    "ablation_confidence": f"WITH {CLASSIFIED_SQL}, a AS (SELECT c.*, unnest([0.3, 0.4, 0.5, 0.6, 0.7])::DOUBLE AS threshold FROM c), {_plan_sql('a', f'''CASE WHEN confidence < threshold THEN 'semantic_only' ELSE {_strategy_sql()} END''', first='record_id, threshold')}",
    "task_mix": f"WITH {CLASSIFIED_SQL}, s AS (SELECT *, {_strategy_sql()} AS strategy FROM c) SELECT task, strategy, count(*) AS questions, round(avg(confidence), 6) AS confidence FROM s GROUP BY ALL",
    "fairness_check": f"""WITH p AS ({_BASELINES}), n AS (SELECT baseline, count(DISTINCT coalesce(strategy, chr(1))) AS strategy, count(DISTINCT top_k) AS top_k, count(DISTINCT rerank) AS rerank, count(DISTINCT graph_depth) AS graph_depth FROM p GROUP BY baseline)
 SELECT baseline, field FROM (SELECT baseline, unnest([CASE WHEN strategy > 1 THEN 'strategy' END, CASE WHEN top_k > 1 THEN 'top_k' END, CASE WHEN rerank > 1 THEN 'rerank' END, CASE WHEN graph_depth > 1 THEN 'graph_depth' END]) AS field FROM n) WHERE field IS NOT NULL""",
}
