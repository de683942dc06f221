"""Splits that keep related records together (p5).

Records are led to a repository by whatever spelling, by a former name or by the prefix of their query id, and on to the
root of its forks. Records that share a root form a component; a component's label vector counts its records per label.
Grouped iterative stratification then places components, those of the rarest outstanding label first: they are taken from the
largest down in waves of like size, each wave laid end to end in units of the label and dealt to the splits by what they still
need of it, the neediest first. So every component follows one rule, later waves even out what earlier ones left, and the
number of steps depends on labels and sizes, never on the number of records or components.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.session import cut, first_delivery, freed, new_folder, running_start

BUCKETS = 1024


def name_key(name: Column) -> Column:
    """One key for all spellings of a repository's name: address, owner, ending, case and separators don't count."""
    plain = F.lower(F.trim(name))
    plain = F.regexp_replace(plain, r"^[a-z+]+://[^/]+/", "")
    plain = F.regexp_replace(plain, r"/+$", "")
    plain = F.regexp_replace(plain, r"\.git$", "")
    plain = F.regexp_replace(plain, r"^.*/", "")
    return F.nullif(F.regexp_replace(plain, r"[-_.\s]", ""), F.lit(""))


def query_prefix(query_id: Column) -> Column:
    """What stands before the number of a query id."""
    found = F.regexp_extract(F.lower(F.trim(query_id)), r"^(.+?)[-_]\d+(?:-r\d+)?$", 1)
    return F.nullif(found, F.lit(""))


def roots(repositories: DataFrame) -> DataFrame:
    """``repository_id, root_repository_id``: each repository with the end of its chain of forks, by pointer doubling, so
    a chain of length n takes log n joins. A fork of an unknown repository ends there; a cycle takes its least name."""
    known = repositories.where("repository_id is not null").groupBy("repository_id").agg(F.min("fork_of").alias("fork_of"))
    at = known.select("repository_id", F.coalesce("fork_of", "repository_id").alias("up"))
    ids = known.select(F.col("repository_id").alias("up"))
    at = cut(at.join(ids, "up", "left_semi").unionByName(at.join(ids, "up", "left_anti").withColumn("up", F.col("repository_id"))))
    ends = at.where("up = repository_id").select(F.col("up").alias("end"))
    at = at.withColumn("least", F.least("repository_id", "up"))
    for _ in range(at.count().bit_length()):
        further = at.alias("a").join(at.alias("b"), F.col("a.up") == F.col("b.repository_id"))
        moved = cut(further.select(F.col("a.repository_id"), F.col("b.up"), F.least("a.least", "b.least").alias("least"), (F.col("a.up") != F.col("b.up")).alias("moved")))
        at = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    known_end = at.join(ends, F.col("up") == F.col("end"), "left").select("repository_id", "up", "end")
    circle = at.select(F.col("repository_id").alias("up"), F.col("least").alias("_least"))
    return known_end.join(circle, "up", "left").select("repository_id", F.coalesce("end", "_least").alias("root_repository_id"))


def led(records: DataFrame, repositories: DataFrame) -> DataFrame:
    """Every record once, with ``root_repository_id`` (null where it leads nowhere). The name of a repository beats a
    former name of another; a former name that two repositories had goes to the least of them. Other columns are left out. Records number many per
    repository, the lookup is as small as ``repositories``."""
    ends = roots(repositories)
    own = repositories.select("repository_id", name_key(F.col("repository_id")).alias("key"), F.lit(0).alias("rank"))
    former = repositories.select("repository_id", F.explode("former_names").alias("_n")).select("repository_id", name_key(F.col("_n")).alias("key"), F.lit(1).alias("rank"))
    names = own.unionByName(former).where("key is not null").groupBy("key").agg(F.min(F.struct("rank", "repository_id")).alias("m"))
    names = names.select("key", F.col("m.repository_id").alias("repository_id")).join(ends, "repository_id").select("key", F.col("root_repository_id").alias("_by_name"))
    prefixes = repositories.select("repository_id", F.lower("query_prefix").alias("prefix")).where("prefix is not null").groupBy("prefix").agg(F.min("repository_id").alias("repository_id"))
    prefixes = prefixes.join(ends, "repository_id").select("prefix", F.col("root_repository_id").alias("_by_prefix"))
    named = [c for c in ("record_id", "repository_id", "query_id", "category", "difficulty", "ingested_at") if c in records.columns]
    once = first_delivery(records.select(*named), "record_id", ["ingested_at"])
    keyed = once.withColumn("key", name_key(F.col("repository_id"))).withColumn("prefix", F.when(F.col("repository_id").isNull(), query_prefix(F.col("query_id"))))
    found = keyed.join(names, "key", "left").join(prefixes, "prefix", "left")
    return found.withColumn("root_repository_id", F.coalesce("_by_name", "_by_prefix")).drop("key", "prefix", "_by_name", "_by_prefix")


def labels(category: Column, difficulty: Column) -> Column:
    tidy = lambda c: F.coalesce(F.nullif(F.regexp_replace(F.lower(F.trim(c)), r"[-\s]+", "_"), F.lit("")), F.lit("none"))
    return F.array(F.concat(F.lit("category="), tidy(category)), F.concat(F.lit("difficulty="), tidy(difficulty)))


ALL = "\x00all"  # the label of every record


def stratify(records: DataFrame, component: str, label_list: str, targets: DataFrame) -> DataFrame:
    """``component, split`` for each component of ``records``, near the shares of ``targets`` overall and per label.

    Null components aren't placed (give each its own name first); records without labels count for the total only. One row
    per label, size class and split goes to the driver.
    """
    spark = records.sparkSession
    shares = {r["split"]: float(r["target_share"] or 0) for r in targets.where("split is not null").collect()}  # one row a split
    known = records.where(F.col(component).isNotNull())
    every = F.concat(F.coalesce(label_list, F.array().cast("array<string>")), F.array(F.lit(ALL)))
    path = new_folder(spark)
    left = cut(known.select(F.col(component).alias("component"), F.explode(every).alias("label")).groupBy("component", "label").agg(F.count("*").alias("n")), path)
    outstanding = {r["label"]: r["n"] for r in left.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    empty = left.select("component", F.lit(None).cast("string").alias("split")).limit(0)
    if not outstanding or not shares:
        return empty
    need = {(s, label): share * n for s, share in shares.items() for label, n in outstanding.items()}
    made, parts = new_folder(spark), 0
    while outstanding[ALL] > 0:
        rare = min((label for label, n in outstanding.items() if n > 0), key=lambda label: (label == ALL, outstanding[label], label))
        own = left.where(F.col("label") == rare).select("component", "n", F.floor(F.log2("n")).cast("int").alias("k"))
        waves = {r["k"]: r["n"] for r in own.groupBy("k").agg(F.sum("n").alias("n")).collect()}
        for k in sorted(waves, reverse=True):
            order = running_start(own.where(F.col("k") == k), [], F.pmod(F.xxhash64("component"), F.lit(BUCKETS)), [F.col("component")], F.col("n"), BUCKETS)
            wanted = {s: max(need[s, rare], 0.0) if need[s, ALL] > 0 else 0.0 for s in shares}
            if sum(wanted.values()) <= 0:
                wanted = {s: max(need[s, ALL], 0.0) for s in shares}
            if sum(wanted.values()) <= 0:
                wanted = {s: share or 1e-9 for s, share in shares.items()}
            ranked = sorted(wanted, key=lambda s: (-wanted[s], s))
            at, choice, edge = F.col("start") / F.lit(float(waves[k])), F.lit(ranked[-1]), sum(wanted.values())
            for i in range(len(ranked) - 2, -1, -1):
                choice = F.when(at < sum(wanted[s] for s in ranked[: i + 1]) / edge, ranked[i]).otherwise(choice)
            chosen, parts = cut(order.select("component", choice.alias("split")), f"{made}/{parts:04d}"), parts + 1
            for r in chosen.join(left, "component").groupBy("split", "label").agg(F.sum("n").alias("n")).collect():
                need[r["split"], r["label"]] -= r["n"]
                outstanding[r["label"]] -= r["n"]
        last, path = path, new_folder(spark)
        left = cut(left.join(own.select("component"), "component", "left_anti"), path)
        freed(spark, last)
    return spark.read.schema(empty.schema).parquet(f"{made}/*") if parts else empty


def assign(records: DataFrame, repositories: DataFrame, targets: DataFrame) -> DataFrame:
    """``record_id, component, split`` for every record: records of one root share a split; a record that leads to no
    repository is a component of its own. Re-delivered records count once; an empty table gives no rows."""
    rows = led(records, repositories).select(
        "record_id",
        F.coalesce(F.concat(F.lit("repository:"), F.col("root_repository_id")), F.concat(F.lit("record:"), F.col("record_id").cast("string"))).alias("component"),
        labels(F.col("category"), F.col("difficulty")).alias("labels"),
    )
    rows = cut(rows)
    chosen = stratify(rows, "component", "labels", targets)
    return rows.select("record_id", "component").join(chosen, "component").select("record_id", "component", "split")


def found(records: DataFrame, repositories: DataFrame) -> DataFrame:
    """Records whose repository_id isn't literally that of their root."""
    rows = led(records, repositories)
    other = ~F.col("repository_id").eqNullSafe(F.col("root_repository_id"))
    return rows.where(F.col("root_repository_id").isNotNull() & other).select("record_id", "root_repository_id")
