"""Fusing what several retrievers found into one context under a token budget."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 4000


def merged(candidates: DataFrame, query: str, item: str, weights: dict[str, float] | None = None) -> DataFrame:
    """``query, item, score, found_by, first_seen, sources``: each item once per query.

    ``candidates`` has ``retriever, kind_order, rank, normalised``. The score is the weighted mean over the retrievers
    that found the item, never a sum; weights of zero give 0. An item that one retriever lists twice counts with its first.
    """
    weights = weights or {}
    weight = reduce(lambda e, kv: e.when(F.col("retriever") == kv[0], float(kv[1])), weights.items(), F.when(F.lit(False), 0.0)).otherwise(1.0)
    place = F.col("kind_order") * 1_000_000 + F.col("rank")
    once = candidates.groupBy(query, item, "retriever").agg(F.min_by("normalised", place).alias("normalised"), F.min(place).alias("place"))
    rows = once.withColumn("weight", weight)
    return rows.groupBy(query, item).agg(
        F.coalesce(F.sum(F.col("weight") * F.col("normalised")) / F.nullif(F.sum("weight"), F.lit(0.0)), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_set("retriever")).alias("found_by"), F.min("place").alias("first_seen"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("retriever", "normalised")))).alias("sources"),
    )


def ordered(rows: DataFrame, query: str, item: str, rerank: bool | Column = True) -> DataFrame:
    """Adds ``rank``: by score and item where reranking is on, else as first seen."""
    on = F.lit(rerank) if isinstance(rerank, bool) else rerank
    score = F.round("score", 9)
    keys = [F.when(on, -score).otherwise(F.col("first_seen").cast("double")), F.when(on, F.lit(0)).otherwise(F.col("first_seen")), F.col(item)]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*keys)))


def within_budget(rows: DataFrame, query: str, top_k: int | Column = 15, budget: int = BUDGET) -> DataFrame:
    """The longest prefix (``rank``, ``token_count``) of the first ``top_k`` that fits; ``truncated`` says that the budget,
    not ``top_k``, cut a query's rows. ``candidate_count`` is from before any cut."""
    pool = Window.partitionBy(query)
    rows = rows.withColumn("candidate_count", F.count("*").over(pool)).where(F.col("rank") <= top_k)
    rows = rows.withColumn("used", F.sum("token_count").over(pool.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("truncated", F.max("used").over(pool) > budget)
    return rows.where(F.col("used") <= budget)


def prompts(rows: DataFrame, query: str, question: Column, header: Column, content: Column) -> DataFrame:
    """One prompt per query: the question, then each chunk under its header, by rank. A query's rows are bounded by the
    budget, so collecting them stays small."""
    part = F.struct(F.col("rank"), F.concat_ws("\n", F.concat(F.lit("## "), header), content).alias("text"))
    chunks = rows.groupBy(query).agg(F.first(question).alias("_q"), F.array_sort(F.collect_list(part)).alias("_c"))
    return chunks.select(query, F.concat_ws("\n\n", F.col("_q"), F.array_join(F.transform("_c", lambda c: c["text"]), "\n\n")).alias("prompt"))
