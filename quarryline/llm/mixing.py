"""Mixing sources to target weights (p8) by hierarchical budgeting.

The tree is corpus, domain, source, language. A source's target is its weight, a domain's the sum of its sources'; languages
share their source's budget by their supply, tempered so that small ones get somewhat more. Budgets flow down by weight; what a
leaf can't supply, its documents repeated as often as allowed, goes to its siblings, what they can't take to the other sources
of the domain, and what these can't take to the other domains. Of each leaf whole seeded epochs and the prefix of one more, in
that epoch's own order, are taken up to its budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.sizes import sized
from quarryline.session import cut, running_start

TEMPER = 0.7
# Texts for those who use a project, and texts of the work on it; a source that isn't listed is a domain of its own.
DOMAINS = {
    "readme": "usage", "docstring": "usage", "userguide": "usage", "changelog": "usage", "faq": "usage", "forum": "usage",
    "issue": "development", "commit_message": "development", "query_notes": "development", "rationale": "development", "research_notes": "development",
}
BUCKETS = 4096


def tidy(column: Column) -> Column:
    return F.nullif(F.lower(F.trim(column)), F.lit(""))


def language_code(column: Column) -> Column:
    """Two letters, whatever the region; ``und`` where none is known."""
    code = F.regexp_extract(F.lower(F.trim(column)), r"^([a-z]{2})(?:[-_].*)?$", 1)
    return F.when(F.coalesce(code, F.lit("")) == "", "und").otherwise(code)


def poured(budget: float, weights: dict, limits: dict) -> dict:
    """Shares out ``budget`` by weight; what a limit turns back goes to those that have room, until none is left."""
    got = dict.fromkeys(weights, 0.0)
    open_ = {k for k, w in weights.items() if w > 0 and limits[k] > 0}
    while open_ and budget > 1e-6:
        total = sum(weights[k] for k in open_)
        full = {k for k in open_ if got[k] + budget * weights[k] / total >= limits[k] - 1e-9}
        if not full:
            for k in open_:
                got[k] += budget * weights[k] / total
            return got
        for k in full:
            budget -= limits[k] - got[k]
            got[k] = limits[k]
        open_ -= full
    return got


def budgets(supplies: dict[tuple[str, str], int], targets: dict[str, tuple[float, int]], total: float, domains: dict[str, str] = DOMAINS) -> dict[tuple[str, str], float]:
    """Tokens to take of each (source, language)."""
    limits = {leaf: float(n * targets[leaf[0]][1]) for leaf, n in supplies.items() if leaf[0] in targets}
    by_source = {s: sum(v for leaf, v in limits.items() if leaf[0] == s) for s in targets}
    members: dict[str, list[str]] = {}
    for s in targets:
        members.setdefault(domains.get(s, s), []).append(s)
    top = poured(total, {d: sum(targets[s][0] for s in ms) for d, ms in members.items()}, {d: sum(by_source[s] for s in ms) for d, ms in members.items()})
    out: dict[tuple[str, str], float] = {}
    for d, budget in top.items():
        for s, own in poured(budget, {s: targets[s][0] for s in members[d]}, by_source).items():
            out |= poured(own, {leaf: supplies[leaf] ** TEMPER for leaf in limits if leaf[0] == s}, limits)
    return out


def _parts(documents: DataFrame, source_targets: DataFrame, path: str | None) -> tuple[DataFrame, dict, dict]:
    """(measured documents of listed sources, targets, supplies)."""
    rows = source_targets.where("source is not null").groupBy(tidy(F.col("source")).alias("source")).agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("repeats")).collect()
    targets = {r["source"]: (float(r["share"] or 0), int(r["repeats"] or 0)) for r in rows}  # one row a listed source
    listed = documents.withColumn("_source", tidy(F.col("source"))).withColumn("_lang", language_code(F.col("lang"))).where(F.col("_source").isin(*targets) if targets else F.lit(False))
    measured = cut(sized(listed, "_source", "_lang", path=path).withColumnsRenamed({"_source": "source", "_lang": "lang"}))
    # listed sources times two-letter codes
    supplies = {(r["source"], r["lang"]): r["n"] for r in measured.groupBy("source", "lang").agg(F.sum("tokens").alias("n")).collect() if r["n"]}
    return measured, targets, supplies


def mixed(documents: DataFrame, source_targets: DataFrame, total: int | None = None, seed: int = 42, path: str | None = None) -> DataFrame:
    """``doc_id, source, lang, tokens, copies``: the documents taken and how often.

    ``total`` is the size aimed at, by default all tokens of the listed sources. Documents of other sources, without source
    or without tokens aren't taken. A leaf falls short of its budget by less than one document.
    """
    measured, targets, supplies = _parts(documents, source_targets, path)
    spark = documents.sparkSession
    taken = budgets(supplies, targets, float(total if total is not None else sum(supplies.values())))
    plan = [(s, lang, int(b // supplies[s, lang]), int(b - b // supplies[s, lang] * supplies[s, lang] + 1e-6)) for (s, lang), b in taken.items()]
    leaves = spark.createDataFrame(plan, "source string, lang string, epochs int, rest long")
    order = F.xxhash64(F.lit(seed), "epochs", "doc_id")
    rows = measured.where("tokens > 0").join(F.broadcast(leaves), ["source", "lang"]).withColumn("_order", order)
    spread = F.shiftrightunsigned("_order", 52)
    placed = running_start(rows, ["source", "lang"], spread, [F.shiftrightunsigned("_order", 1), F.col("_order"), F.col("doc_id")], F.col("tokens"), BUCKETS)
    copies = F.col("epochs") + (F.col("start") + F.col("tokens") <= F.col("rest")).cast("int")
    return placed.select("doc_id", "source", "lang", "tokens", copies.alias("copies")).where("copies > 0")


def shares(documents: DataFrame, source_targets: DataFrame, **options) -> DataFrame:
    """Per listed source: target and actual share of all tokens taken, tokens, documents, and the most copies of one."""
    rows = mixed(documents, source_targets, **options)
    got = rows.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    got = cut(got)
    total = got.agg(F.sum("tokens")).first()[0] or 1
    listed = source_targets.groupBy(tidy(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).where("source is not null")
    out = listed.join(got, "source", "left").fillna(0, ["tokens", "documents", "most_copies"])
    return out.withColumn("actual_share", F.col("tokens") / F.lit(float(total)))
