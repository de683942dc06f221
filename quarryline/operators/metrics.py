"""Ranking metrics, utilities and aggregates. Metrics that don't apply are null, and aggregates skip nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranking(ranked: DataFrame, query: str, k: int = 5) -> DataFrame:
    """Per query of ``ranked`` (``rank``, ``grade`` with null for ungraded): precision, recall, reciprocal rank, NDCG with
    linear and with exponential gain, share of relevant among all. A query without a graded item has nulls throughout; one
    without a relevant item has null recall and NDCG of 0."""
    pool = Window.partitionBy(query)
    rows = ranked.withColumn("_ideal", F.row_number().over(pool.orderBy(F.desc_nulls_last("grade"), "rank")))
    relevant = F.coalesce((F.col("grade") > 0).cast("int"), F.lit(0))
    gain = lambda g: F.coalesce(g, F.lit(0.0))
    linear, power = gain(F.col("grade").cast("double")), F.pow(F.lit(2.0), gain(F.col("grade").cast("double"))) - 1
    at = lambda value, place: F.sum(F.when(F.col(place) <= k, value / F.log2(F.col(place) + F.lit(1.0))))
    sums = rows.groupBy(query).agg(
        F.count("grade").alias("graded"), F.sum(relevant).alias("relevant"), F.count("*").alias("listed"),
        F.sum(F.when(F.col("rank") <= k, relevant)).alias("hits"), F.min(F.when(relevant == 1, F.col("rank"))).alias("first"),
        at(linear, "rank").alias("dcg"), at(linear, "_ideal").alias("idcg"), at(power, "rank").alias("dcg2"), at(power, "_ideal").alias("idcg2"),
    )
    some = F.col("graded") > 0
    ratio = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0.0)), F.lit(0.0))
    return sums.select(
        query, F.when(some, F.col("hits") / k).alias("precision"), F.when(some, F.col("hits") / F.nullif("relevant", F.lit(0))).alias("recall"),
        F.when(some, F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("reciprocal_rank"), F.when(some, ratio("dcg", "idcg")).alias("ndcg_linear"),
        F.when(some, ratio("dcg2", "idcg2")).alias("ndcg_exponential"), F.when(some, F.col("relevant") / F.col("listed")).alias("context_precision"),
    )


def utilities(rows: DataFrame, query: str, strategy: str, quality: str, latency: str, penalty: float = 0.1, tie: float = 0.02) -> DataFrame:
    """Per query and strategy: quality less a penalty for latency (min-max within the query, all equal counts 1), rank, the
    strategies tied with it and, for the best, how clearly it leads."""
    pool = Window.partitionBy(query)
    low, high = F.min(latency).over(pool), F.max(latency).over(pool)
    slow = F.when(high == low, 1.0).otherwise((F.col(latency) - low) / F.nullif(high - low, F.lit(0.0)))
    rows = rows.withColumn("utility", F.round(F.col(quality) - penalty * slow, 9))
    order = pool.orderBy(F.desc("utility"), latency, strategy)
    rows = rows.withColumn("rank", F.row_number().over(order)).withColumn("_next", F.lead("utility").over(order))
    everyone = F.collect_list(F.struct(F.col(strategy).alias("s"), F.col("utility").alias("u"))).over(pool)  # as many as strategies
    tied = F.transform(F.filter(everyone, lambda x: (x["s"] != F.col(strategy)) & (F.abs(x["u"] - F.col("utility")) < tie)), lambda x: x["s"])
    lead = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("utility") - F.col("_next")) / F.greatest(F.col("utility"), F.lit(1e-6))))
    return rows.withColumn("tied_with", F.array_join(F.array_sort(tied), ",")).withColumn("confidence", F.when(F.col("rank") == 1, lead)).drop("_next")


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Chance that one of ``k`` of ``n`` tries, ``c`` of them right, is right; null if there are fewer than ``k`` tries."""
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda acc, i: acc * (n - c - i) / (n - i))
    return F.when(n >= k, F.when(n - c < k, 1.0).otherwise(1.0 - miss))


def histogram(rows: DataFrame, value: str, bins: int, group: str) -> DataFrame:
    """``group, bin, count``: equal widths between a group's least and greatest value, the last bin closed; one bin where
    all are equal. Bounds are aggregated first, so only counts are shuffled."""
    bounds = rows.where(F.col(value).isNotNull()).groupBy(group).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col(value) - F.col("_lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1)))
    return rows.where(F.col(value).isNotNull()).join(bounds, group).groupBy(group, at.cast("int").alias("bin")).agg(F.count("*").alias("count"))


def pearson(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``a, b, r`` for every pair of columns in one pass over the rows; 0 where a column doesn't vary."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    c = {x: F.col(x).cast("double") for x in columns}
    sums = rows.agg(*[F.struct(F.covar_pop(c[a], c[b]).alias("c"), F.var_pop(c[a]).alias("va"), F.var_pop(c[b]).alias("vb")).alias(f"{a}|{b}") for a, b in pairs])
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.coalesce(F.col(f"`{a}|{b}`.c") / F.nullif(F.sqrt(F.col(f"`{a}|{b}`.va") * F.col(f"`{a}|{b}`.vb")), F.lit(0.0)), F.lit(0.0)).alias("r")) for a, b in pairs]))
    return sums.select(each.alias("x")).select("x.*")


def described(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Count, mean, median, sample deviation (0 for one value), least and greatest per group."""
    return rows.where(F.col(value).isNotNull()).groupBy(group).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("deviation"), F.min(value).alias("least"), F.max(value).alias("greatest")
    )


def plan_coverage(pool: DataFrame, relevant: DataFrame, query: str, item: str) -> DataFrame:
    """``query, relevant, covered, coverage``: the share of a query's relevant items that stand anywhere in its pool, before any
    cut. Queries without a relevant item have no row; repeated rows count once."""
    wanted = relevant.select(query, item).where(F.col(item).isNotNull()).distinct()
    held = wanted.join(pool.select(query, item).distinct().withColumn("_in", F.lit(1)), [query, item], "left")
    return held.groupBy(query).agg(F.count("*").alias("relevant"), F.count("_in").alias("covered"), (F.count("_in") / F.count("*")).alias("coverage"))


def invocations(retrievers: Column) -> Column:
    """How many retrievers a plan calls; none without a plan."""
    return F.coalesce(F.size(retrievers), F.lit(0))


def embedding_calls(retrievers: Column) -> Column:
    """A dense retriever embeds the question once."""
    return F.coalesce(F.array_contains(retrievers, "dense").cast("int"), F.lit(0))


def cost(calls: Column, prompt_tokens: Column, completion_tokens: Column, prices: Column) -> Column:
    """Linear in a map of prices for ``embedding_call``, ``prompt_token`` and ``completion_token``; a price that is missing is 0,
    and without prices the cost isn't known (null)."""
    price = lambda name: F.coalesce(F.try_element_at(prices, F.lit(name)), F.lit(0.0))
    return F.when(prices.isNotNull(), calls * price("embedding_call") + prompt_tokens * price("prompt_token") + completion_tokens * price("completion_token"))
