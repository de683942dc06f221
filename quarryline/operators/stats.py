"""Paired comparisons and agreement. Statistics are windows and aggregates; p-values come from their sums by small functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.session import cut, running_start

RANGES = 4096
EXACT = 50  # differences up to which a p-value is exact


def paired(rows: DataFrame, unit: str, variant: str, value: str, a: str, b: str) -> DataFrame:
    """``unit, a, b``: units that have a value under both variants, averaged where they have several."""
    means = rows.where(F.col(variant).isin(a, b) & F.col(value).isNotNull()).groupBy(unit).agg(F.avg(F.when(F.col(variant) == a, F.col(value))).alias("a"), F.avg(F.when(F.col(variant) == b, F.col(value))).alias("b"))
    return means.where("a is not null and b is not null")


def ranked_counts(rows: DataFrame, value: Column, keep: list[str]) -> DataFrame:
    """``keep, value, n, mean_rank`` per distinct number. Ranks come from the counts of distinct values, and their running sum
    from buckets of equal width between the least and the greatest, so no group is sorted in one task."""
    counts = cut(rows.select(*keep, value.cast("double").alias("_v")).groupBy(*keep, "_v").agg(F.count("*").alias("n")))
    ends = counts.groupBy(*keep).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    spread = F.coalesce(F.least(F.floor((F.col("_v") - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)) * RANGES), F.lit(RANGES - 1)), F.lit(0))
    spans = counts.join(ends, keep).withColumn("_spread", spread)
    placed = running_start(spans, keep, F.col("_spread"), [F.col("_v")], F.col("n"), RANGES)
    return placed.select(*keep, "_v", "n", (F.col("start") + (F.col("n") + 1) / 2).alias("mean_rank"))


def signed_ranks(pairs: DataFrame, group: list[str]) -> DataFrame:
    """Per group: ``n, w_plus, w_minus, statistic, rank_biserial, ties, ranks``; differences of 0 are dropped. ``ties`` sums
    n**3 - n over equal differences; ``ranks`` holds the doubled mean ranks with their counts of groups of at most ``EXACT``
    differences, else null: these are all that a p-value needs."""
    d = pairs.withColumn("_d", F.round(F.col("a") - F.col("b"), 12)).where("_d <> 0").withColumn("_abs", F.abs("_d"))
    ranks = ranked_counts(d, F.col("_abs"), group)
    signs = d.groupBy(*group, F.col("_abs").alias("_v")).agg(F.sum((F.col("_d") > 0).cast("int")).alias("up"))
    both = cut(ranks.join(signs, [*group, "_v"]))
    cubes = F.pow(F.col("n").cast("double"), 3) - F.col("n")
    sums = both.groupBy(*group).agg(F.sum("n").alias("n"), F.sum(F.col("mean_rank") * F.col("up")).alias("w_plus"), F.sum(F.col("mean_rank") * (F.col("n") - F.col("up"))).alias("w_minus"), F.sum(cubes).alias("ties"))
    few = both.join(sums.where(F.col("n") <= EXACT).select(*group), group, "left_semi").groupBy(*group).agg(F.collect_list(F.struct((F.col("mean_rank") * 2).cast("int").alias("r"), F.col("n").alias("n"))).alias("ranks"))
    total = F.col("w_plus") + F.col("w_minus")
    return sums.join(few, group, "left").withColumn("statistic", F.least("w_plus", "w_minus")).withColumn("rank_biserial", F.coalesce((F.col("w_plus") - F.col("w_minus")) / F.nullif(total, F.lit(0.0)), F.lit(0.0)))


def signed_rank_p(ranks: list[tuple[int, int]] | None, w_plus: float, n: int, ties: float) -> float:
    """Two-sided; exact over all signs where the single ranks are known, ties included, else the normal approximation."""
    if not n:
        return 1.0
    if ranks is not None:
        each = [r for r, k in ranks for _ in range(k)]
        ways = np.zeros(sum(each) + 1)
        ways[0] = 1
        for r in each:
            ways[r:] = ways[r:] + ways[: len(ways) - r]
        ways /= ways.sum()
        at = int(round(2 * w_plus))
        return float(min(1.0, 2 * min(ways[: at + 1].sum(), ways[at:].sum())))
    spread = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return math.erfc(abs(w_plus - n * (n + 1) / 4) / math.sqrt(spread) / math.sqrt(2)) if spread > 0 else 1.0


def with_signed_rank_p(stats: DataFrame) -> DataFrame:
    @F.pandas_udf(T.DoubleType())
    def p(ranks: pd.Series, w_plus: pd.Series, n: pd.Series, ties: pd.Series) -> pd.Series:
        known = [None if r is None else [(int(x["r"]), int(x["n"])) for x in r] for r in ranks]
        return pd.Series([signed_rank_p(*row) for row in zip(known, w_plus, n, ties)])

    return stats.withColumn("p", p("ranks", "w_plus", "n", "ties"))


def compared(rows: DataFrame, group: str, unit: str, variant: str, value: str, a: str, b: str) -> DataFrame:
    """Per group: ``n``, means, deviations and mean difference of the paired values, and the signed-rank statistic with its
    effect size and p. Groups with fewer than two pairs, and null groups, are left out; without any difference p is 1."""
    means = rows.where(F.col(variant).isin(a, b) & F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group, unit).agg(F.avg(F.when(F.col(variant) == a, F.col(value))).alias("a"), F.avg(F.when(F.col(variant) == b, F.col(value))).alias("b"))
    pairs = cut(means.where("a is not null and b is not null"))
    described = pairs.groupBy(group).agg(F.count("*").alias("pairs"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.stddev_samp("a").alias("std_a"), F.stddev_samp("b").alias("std_b"), F.avg(F.col("a") - F.col("b")).alias("mean_difference")).where("pairs > 1")
    tested = with_signed_rank_p(signed_ranks(pairs, [group])).select(group, "statistic", "rank_biserial", "p")
    return described.join(tested, group, "left").fillna({"statistic": 0.0, "rank_biserial": 0.0, "p": 1.0})


def holm(tests: DataFrame, family: str, test: str, p: str, alpha: float = 0.05) -> DataFrame:
    """Adds ``threshold, rejected``: step-down, stopping at the first that isn't below its threshold; ties by name."""
    w = Window.partitionBy(family)
    rows = tests.withColumn("_i", F.row_number().over(w.orderBy(p, test)) - 1).withColumn("threshold", F.lit(alpha) / (F.count("*").over(w) - F.col("_i")))
    passed = F.min((F.col(p) <= F.col("threshold")).cast("int")).over(w.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("rejected", passed == 1).drop("_i")


def mcnemar(rows: DataFrame, group: str, a: str, b: str, corrected: bool = True) -> DataFrame:
    """``group, only_a, only_b, statistic, p`` of two boolean outcomes per row; no discordant rows give p = 1."""
    counts = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(group).agg(F.count_if(F.col(a) & ~F.col(b)).alias("only_a"), F.count_if(~F.col(a) & F.col(b)).alias("only_b"))
    off = F.abs(F.col("only_a") - F.col("only_b")) - (1 if corrected else 0)
    statistic = F.coalesce(F.pow(F.greatest(off, F.lit(0)), 2) / F.nullif(F.col("only_a") + F.col("only_b"), F.lit(0)), F.lit(0.0))

    @F.pandas_udf(T.DoubleType())
    def p(x: pd.Series) -> pd.Series:
        return x.map(lambda v: math.erfc(math.sqrt(v / 2)))

    return counts.withColumn("statistic", statistic).withColumn("p", p("statistic"))


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """``n, rho`` over all rows that have both values; ranks come from the counts of distinct values."""
    both = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"), F.lit(0).alias("g"))
    ra, rb = (ranked_counts(both, F.col(c), ["g"]).select(F.col("_v").alias(c), F.col("mean_rank").alias(f"r{c}")) for c in ("a", "b"))
    ranks = both.join(ra, "a").join(rb, "b")
    return ranks.agg(F.count("*").alias("n"), F.coalesce(F.covar_pop("ra", "rb") / F.nullif(F.sqrt(F.var_pop("ra") * F.var_pop("rb")), F.lit(0.0)), F.lit(0.0)).alias("rho"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x in (0.0, 1.0):
        return x
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_fraction(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / ((1 + step * d) or 1e-300), (1 + step / c) or 1e-300
            f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * f


def correlation_p(rho: float, n: int) -> float:
    """Two-sided p of a correlation by Student's t with n - 2 degrees of freedom."""
    if n < 3 or abs(rho) >= 1:
        return 0.0 if n >= 3 else 1.0
    t2 = rho * rho * (n - 2) / (1 - rho * rho)
    return _beta_fraction((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def bootstrap_interval(differences: DataFrame, group: str, value: str, rounds: int = 2000, level: float = 0.95, seed: int = 7) -> DataFrame:
    """``group, mean, low, high``: percentile bootstrap of the mean, by Poisson weights that each row draws per round from a
    generator seeded by its partition; rounds are summed where the rows are, so no group is gathered in one task."""
    slots = 64

    def draw(batches):
        for n, batch in enumerate(batches):
            rng = np.random.default_rng([seed, TaskContext.get().partitionId(), n])
            for key, part in batch.groupby(group):
                w = rng.poisson(1.0, (rounds, len(part)))
                yield pd.DataFrame({group: key, "round": np.arange(rounds), "n": w.sum(axis=1).astype(float), "s": w @ part[value].to_numpy()})

    schema = f"{group} {differences.schema[group].dataType.simpleString()}, round int, n double, s double"
    sums = differences.where(F.col(value).isNotNull()).select(group, value).repartition(slots).mapInPandas(draw, schema)
    means = sums.groupBy(group, "round").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0.0))).alias("m"))
    tail = (1 - level) / 2
    interval = means.groupBy(group).agg(F.percentile("m", tail).alias("low"), F.percentile("m", 1 - tail).alias("high"))
    return differences.groupBy(group).agg(F.avg(value).alias("mean")).join(interval, group)


def agreement(ratings: DataFrame, group: str, a: str, b: str, most: int = 3) -> DataFrame:
    """``group, n, exact, kappa``: two raters' grades from 0 to ``most``, with quadratic weights; kappa is 1 where no
    disagreement could be expected. The table of counts is at most ``(most + 1) ** 2`` rows a group."""
    both = ratings.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    n = both.groupBy(group).agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("exact"), F.avg(F.pow(F.col(a) - F.col(b), 2)).alias("seen"))
    ma = both.groupBy(group, F.col(a).alias("i")).agg(F.count("*").alias("na"))
    mb = both.groupBy(group, F.col(b).alias("j")).agg(F.count("*").alias("nb"))
    chance = ma.join(mb, group).groupBy(group).agg((F.sum(F.col("na") * F.col("nb") * F.pow(F.col("i") - F.col("j"), 2))).alias("chance"))
    return n.join(chance, group).select(group, "n", "exact", F.coalesce(1 - F.col("seen") / F.nullif(F.col("chance") / (F.col("n") * F.col("n")), F.lit(0.0)), F.lit(1.0)).alias("kappa"))


def merged_judgments(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, grade, status`` of two annotators' ``grade``: equal stands, one apart takes the lesser, more needs an
    adjudicator; a judgment that only one made is missing."""
    rows = a.withColumnRenamed("grade", "ga").join(b.withColumnRenamed("grade", "gb"), keys, "full")
    gap = F.abs(F.col("ga") - F.col("gb"))
    status = F.when(gap.isNull(), "missing").when(gap == 0, "agreed").when(gap == 1, "lesser").otherwise("adjudicate")
    return rows.select(*keys, F.when(gap <= 1, F.least("ga", "gb")).alias("grade"), status.alias("status"))
