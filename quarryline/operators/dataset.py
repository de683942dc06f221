"""Building, validating and splitting ranking datasets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_fraction(*parts: Column) -> Column:
    """A number in [0, 1) from the top 52 bits of a hash over the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def hash_split(fraction: Column, train: float = 0.7, validation: float = 0.15) -> Column:
    return F.when(fraction < train, "train").when(fraction < train + validation, "validation").otherwise("test")


def flat(rows: DataFrame, items: str, *keep: str) -> DataFrame:
    """A row per item of an array of structs, with its place from 1; rows without items have none."""
    each = rows.select(*keep, F.posexplode(items).alias("_at", "_x"))
    return each.select(*keep, (F.col("_at") + 1).alias("place"), "_x.*")


def grouped(rows: DataFrame, keys: list[str], place: str, *fields: str) -> DataFrame:
    """A row per key with its items as JSON, in order of ``place``. Items of one key are as many as one question has."""
    packed = F.array_sort(F.collect_list(F.struct(place, *fields)))
    return rows.groupBy(*keys).agg(F.to_json(packed).alias("rows"), F.count("*").alias("n"))


def current(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row per key, found by aggregation."""
    rest = [c for c in rows.columns if c != key]
    newest = rows.groupBy(key).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("_r"))
    return newest.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def pending(todo: DataFrame, done: DataFrame, keys: list[str], stale: Column) -> DataFrame:
    """What isn't done yet; if any done row is stale, everything is to be done again."""
    if not done.where(stale).isEmpty():
        return todo
    return todo.join(done.select(*keys), keys, "left_anti")


def issues(rows: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """``key, issue``: one row per violated check; a check that can't be decided (null) counts as violated."""
    named = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items()])
    return rows.select(key, F.explode(F.filter(named, lambda x: x.isNotNull())).alias("issue"))


def repeated(rows: DataFrame, key: Column, issue: str) -> DataFrame:
    """``value, issue, n``: values of ``key`` that stand more than once; nulls don't count."""
    return rows.select(key.cast("string").alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n")).where("n > 1").withColumn("issue", F.lit(issue))


def leakage(rows: DataFrame, value: str, split: str) -> DataFrame:
    """``value, splits, n``: values that stand in more than one split."""
    known = rows.where(F.col(value).isNotNull() & F.col(split).isNotNull())
    return known.groupBy(value).agg(F.array_join(F.array_sort(F.collect_set(split)), ",").alias("splits"), F.count("*").alias("n"), F.countDistinct(split).alias("k")).where("k > 1").drop("k")


def profile(files: DataFrame, group: str, language: str, size: str) -> DataFrame:
    """Files, bytes and languages per group; the primary language has most bytes, ties go to the lesser name."""
    by = files.groupBy(group, language).agg(F.count("*").alias("n"), F.sum(size).alias("b"))
    first = F.min(F.when(F.col(language).isNotNull(), F.struct((-F.col("b")).alias("b"), F.col(language).alias("l"))))
    return by.groupBy(group).agg(F.sum("n").alias("files"), F.sum("b").alias("bytes"), F.count(language).alias("languages"), first["l"].alias("primary_language"))


def statistics(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Mergeable statistics: counts, sums and bounds, from which means follow."""
    return rows.groupBy(group).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("greatest"))


def merge_statistics(parts: DataFrame, group: str) -> DataFrame:
    return parts.groupBy(group).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))


def feature_rows(rows: DataFrame, features: dict[str, Column], *keep: str) -> DataFrame:
    """Numeric features as doubles, null as 0, and the sum of their absolute values as a check."""
    made = rows.select(*keep, *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in features.items()])
    return made.withColumn("magnitude", reduce(lambda a, b: a + b, [F.abs(F.col(n)) for n in features]))


def pilot_checks(rows: DataFrame, query: list[str], strategy: str, expected: int = 4) -> DataFrame:
    """``check, violations, passed``: rows with a null, exact copies, repeated pairs of query and strategy, and queries that don't
    have exactly ``expected`` rows. Counts are aggregated before the totals, so repeated rows don't gather."""
    some_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in rows.columns])
    extra = F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations")
    parts = {
        "missing_values": rows.agg(F.count_if(some_null).alias("violations")),
        "duplicate_rows": rows.groupBy(*rows.columns).agg(F.count("*").alias("n")).agg(extra),
        "duplicate_pairs": rows.groupBy(*query, strategy).agg(F.count("*").alias("n")).agg(extra),
        "unexpected_rows": rows.groupBy(*query).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") != expected).alias("violations")),
    }
    named = [df.select(F.lit(name).alias("check"), F.col("violations").cast("long").alias("violations")) for name, df in parts.items()]
    return reduce(DataFrame.unionByName, named).withColumn("passed", F.col("violations") == 0)
