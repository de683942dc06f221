"""Deciding how a question is answered: a table of rules votes for its task, a chain of policies picks the strategy, a plan
follows. Everything is one projection over the questions: no join, no shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions import text as X

# Words that a rule fires on, matched as whole tokens in lower case.
KEYWORDS = {
    "search": "find finds search searching locate lookup grep where",
    "implementation": "implemented implementation implementations implements defined definition definitions",
    "explain": "explain explains explained understand describe describes clarify",
    "debug": "debug debugging investigate investigating diagnose diagnosing troubleshoot troubleshooting",
    "bug_fix": "fix fixes fixing bug bugs broken crash crashes crashing fails failing failed error errors",
    "refactor": "refactor refactoring restructure restructuring cleanup clean simplify simplifying rename renaming reorganize reorganizing",
    "generate": "generate generating create creating implement implementing scaffold scaffolding add adding build building",
    "test": "test tests testing coverage unittest pytest",
    "documentation": "document documents documenting documentation docstring docstrings readme comment comments commenting",
    "architecture": "architecture design structure overview diagram flow flows",
    "dependency": "dependency dependencies imports depends depend requires require package packages",
    "security": "security vulnerability vulnerabilities vulnerable exploit exploits cve injection auth authentication authorization",
    "performance": "performance slow slowness latency optimize optimizing optimization bottleneck bottlenecks memory leak leaks",
    "graph_trigger": "trace tracing calls caller callers callee callees inherits inheritance path paths",
    "reasoning_trigger": "why",
}
# Pairs of words that together ask for an explanation.
EXPLAIN_PAIRS = (("what", "do"), ("what", "does"), ("what", "is"), ("how", "does"), ("how", "do"), ("how", "works"))
# Fixed values: (rule, task it votes for, weight, flags it sets).
RULES = (
    ("search", "search", 1.0, ("lexical",)),
    ("implementation", "search", 0.5, ("semantic",)),
    ("explain", "explain", 1.0, ("semantic",)),
    ("debug", "debug", 1.0, ("reasoning", "semantic")),
    ("bug_fix", "bug_fix", 1.0, ("reasoning", "semantic")),
    ("refactor", "refactor", 1.0, ("semantic",)),
    ("generate", "generate", 1.0, ("semantic",)),
    ("test", "test", 1.0, ("semantic",)),
    ("documentation", "documentation", 1.0, ("semantic",)),
    ("architecture", "architecture", 1.0, ("graph",)),
    ("dependency", "dependency_analysis", 1.0, ("graph",)),
    ("security", "security", 1.0, ("semantic",)),
    ("performance", "performance", 1.0, ("semantic",)),
    ("graph_trigger", None, 1.0, ("graph",)),
    ("reasoning_trigger", None, 1.0, ("reasoning",)),
    ("quoted", None, 1.0, ("lexical",)),
)
# Tasks in the order in which they win a tie.
PRIORITY = ("bug_fix", "debug", "security", "performance", "test", "refactor", "documentation", "dependency_analysis", "architecture", "generate", "explain", "search")
FLAGS = ("graph", "semantic", "lexical", "reasoning")
# Retrievers and results of each strategy.
STRATEGIES = {
    "lexical_only": (("lexical",), 10), "semantic_only": (("dense",), 8), "graph_only": (("graph",), 10), "hybrid": (("lexical", "dense"), 15),
    "graph_plus_semantic": (("graph", "dense"), 12), "lexical_plus_graph": (("lexical", "graph"), 12), "full_pipeline": (("lexical", "dense", "graph"), 20),
}
ORDER = ("lexical", "graph", "dense")
SYMBOL_CONFIDENCE = 0.3


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def fired(rule: str, token_set: Column, quotes: Column) -> Column:
    if rule == "quoted":
        return F.size(quotes) > 0
    hit = F.arrays_overlap(token_set, X.words(KEYWORDS[rule].split()))
    if rule == "explain":
        hit = hit | _any(F.array_contains(token_set, a) & F.array_contains(token_set, b) for a, b in EXPLAIN_PAIRS)
    return hit


def classified(questions: DataFrame, text: str = "query_text", rules=RULES) -> DataFrame:
    """Adds ``task, confidence, graph, semantic, lexical, reasoning, kind``. Empty and null questions are ``unknown``.

    The task with the most weight wins, ties by ``PRIORITY``; confidence is its share of all weight. Where no rule fires
    but the question names a symbol, it is a search. ``rules`` may be extended by the caller.
    """
    rows = questions.withColumn("_t", F.transform(X.tokens(F.col(text)), F.lower)).withColumn("_q", X.quoted(F.col(text)))
    rows = rows.withColumn("_f", F.struct(*[fired(r, F.col("_t"), F.col("_q")).alias(r) for r, *_ in rules]))
    hit = lambda r: F.col(f"_f.{r}")
    for task in PRIORITY:
        parts = [F.when(hit(r), w).otherwise(0.0) for r, t, w, _ in rules if t == task]
        rows = rows.withColumn(f"_w_{task}", reduce(lambda a, b: a + b, parts, F.lit(0.0)))
    weights = [F.col(f"_w_{t}") for t in PRIORITY]
    total, best = reduce(lambda a, b: a + b, weights), F.greatest(*weights)
    winner = F.coalesce(*[F.when(w == best, t) for t, w in zip(PRIORITY, weights)])
    rows = rows.withColumns({f: _any(hit(r) for r, _, _, flags in rules if f in flags) for f in FLAGS})
    named = ~_any(hit(r) for r, *_ in rules) & (F.size(X.symbols(F.col(text))) > 0)
    rows = rows.withColumn("task", F.when(named, "search").when(total > 0, winner).otherwise("unknown"))
    rows = rows.withColumn("confidence", F.when(named, SYMBOL_CONFIDENCE).when(total > 0, best / F.nullif(total, F.lit(0.0))).otherwise(0.0))
    rows = rows.withColumn("lexical", F.col("lexical") | named)
    active = sum((F.col(f).cast("int") for f in ("graph", "semantic", "lexical")), F.lit(0))
    kind = F.when(active >= 2, "hybrid").when(F.col("graph"), "graph").when(F.col("lexical"), "lexical").otherwise("semantic")
    return rows.withColumn("kind", kind).drop("_t", "_q", "_f", *[f"_w_{t}" for t in PRIORITY])


def strategy(refactor: bool = True) -> Column:
    """The first policy that applies; ``refactor=False`` leaves out that a refactoring takes everything."""
    g, s, lex = F.col("graph"), F.col("semantic"), F.col("lexical")
    whole = g & s & lex
    if refactor:
        whole = whole | (F.col("task") == "refactor")
    return (
        F.when(whole, "full_pipeline").when(g & s & ~lex, "graph_plus_semantic").when(g & lex & ~s, "lexical_plus_graph").when(g, "graph_only")
        .when(lex & s, "hybrid").when(lex, "lexical_only").otherwise("semantic_only")
    )


def planned(rows: DataFrame, chosen: Column, dense: Column | None = None, graph: Column | None = None, top_k: int | None = None, rerank: bool | None = None) -> DataFrame:
    """Adds ``strategy, retrievers, parallel, rerank, top_k, candidate_limit, graph_depth``.

    ``dense`` and ``graph`` say what a row's repository supports; a retriever it lacks is dropped, lexical is the last
    resort, and the results asked for stay those of the chosen strategy. ``top_k`` and ``rerank`` override the plan's own.
    """
    rows = rows.withColumn("strategy", chosen)
    has = {"lexical": F.lit(True), "dense": F.lit(True) if dense is None else dense, "graph": F.lit(True) if graph is None else graph}
    uses = {r: F.col("strategy").isin([s for s, (rs, _) in STRATEGIES.items() if r in rs]) & has[r] for r in ORDER}
    kept = F.filter(F.array(*[F.when(uses[r], r) for r in ORDER]), lambda x: x.isNotNull())
    rows = rows.withColumn("retrievers", F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit("lexical"))))
    rows = rows.withColumn("parallel", F.size("retrievers") > 1)
    rows = rows.withColumn("rerank", F.col("parallel") | F.col("reasoning") if rerank is None else F.lit(rerank))
    size = reduce(lambda e, s: e.when(F.col("strategy") == s[0], s[1][1]), STRATEGIES.items(), F.when(F.lit(False), 0)).otherwise(10)
    rows = rows.withColumn("top_k", size if top_k is None else F.lit(top_k))
    rows = rows.withColumn("candidate_limit", F.when(F.col("rerank"), F.col("top_k") * 3).otherwise(F.col("top_k")))
    return rows.withColumn("graph_depth", F.when(F.array_contains("retrievers", "graph"), 3).otherwise(0))


def complexity(questions: DataFrame, text: str = "query_text") -> DataFrame:
    """Adds ``token_count, identifier_count, clause_count, complexity_strategy``: a router that looks at length only."""
    rows = questions.withColumn("_t", X.tokens(F.col(text)))
    rows = rows.withColumn("token_count", F.size("_t")).withColumn("identifier_count", F.size(F.filter("_t", X.looks_like_identifier)) + F.size(X.quoted(F.col(text))))
    rows = rows.withColumn("clause_count", F.size(F.filter("_t", lambda t: F.lower(t).isin("and", "or", "but"))) + 1)
    n = F.col("token_count")
    choice = F.when(n == 0, "lexical_only").when(F.col("clause_count") >= 2, "full_pipeline").when((F.col("identifier_count") >= 1) & (n <= 6), "lexical_only").when(n >= 12, "hybrid").otherwise("semantic_only")
    return rows.withColumn("complexity_strategy", choice).drop("_t")


# Baselines with one strategy each; B0 retrieves nothing.
BASELINES = {"B0": None, "B1": "semantic_only", "B2": "lexical_only", "B3": "graph_only", "B4": "full_pipeline"}


def baselines(rows: DataFrame) -> DataFrame:
    """Each question under each baseline. The variants are five constants, exploded in place."""
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("baseline"), F.lit(s).cast("string").alias("fixed")) for b, s in BASELINES.items()]))
    rows = planned(rows.withColumn("_b", each).select("*", "_b.*").drop("_b"), F.col("fixed")).drop("fixed")
    none = F.col("baseline") == "B0"
    return rows.withColumn("retrievers", F.when(none, F.array().cast("array<string>")).otherwise(F.col("retrievers"))).withColumn("top_k", F.when(none, 0).otherwise(F.col("top_k")))


def confidence_ablation(rows: DataFrame, thresholds=(0.3, 0.4, 0.5, 0.6, 0.7)) -> DataFrame:
    """Each question under each threshold: below it, plain semantic retrieval replaces the policies' choice."""
    each = rows.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    return planned(each, F.when(F.col("confidence") < F.col("threshold"), "semantic_only").otherwise(strategy()))


def uncontrolled(configs: DataFrame, family: str, fields: list[str]) -> DataFrame:
    """``family, field``: fields that ought to be equal within a family of variants but aren't. Nulls count as a value."""
    distinct = [F.countDistinct(F.coalesce(F.col(f).cast("string"), F.lit("\x00"))).alias(f) for f in fields]
    counts = configs.groupBy(family).agg(*distinct)
    return counts.select(family, F.explode(F.filter(F.array(*[F.when(F.col(f) > 1, f) for f in fields]), lambda x: x.isNotNull())).alias("field"))
