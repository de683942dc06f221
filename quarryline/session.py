"""Session helpers: opening a local session, reading tables, cutting lineage and counting ranks without a single hot task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a folder of our own only where it is unset in a local session, as in
    tests: on a cluster executors couldn't share it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="spark-"))
    return _own_folder[0]


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared folder; it goes when the application ends."""
    path = f"{shared_folder(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def cut(df: DataFrame, path: str | None = None) -> DataFrame:
    """Cuts the lineage: writes a compressed table to the shared folder and reads it back, so any executor can be lost
    and the planner sees true sizes. The table goes when the application ends, or with its folder if ``path`` is given."""
    spark = df.sparkSession
    path = path or new_folder(spark)
    df.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def freed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of cut tables that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def first_delivery(df: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """One row per non-null key: the earliest by ``order``, ties broken by the other scalar columns, so that the choice
    is deterministic. Aggregates map-side, so a key that is delivered very often doesn't gather in one task."""
    rest = [c for c in df.columns if c != key]
    lead = [c for c in (order or []) if c in rest]
    packed = F.struct(*lead, *[c for c in rest if c not in lead])
    kept = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(packed).alias("_row"))
    return kept.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def running_start(df: DataFrame, keys: list[str], spread: Column, order: list[Column], size: Column, buckets: int = 256) -> DataFrame:
    """Adds ``start``: the sum of ``size`` over the rows before this one, per group of ``keys``.

    Rows are ordered by ``spread`` (an integer in [0, ``buckets``), monotone in the wanted order), then by ``order``.
    The sums of the buckets are gathered first (partial aggregation, at most ``buckets`` rows a group), so only a bucket
    is ever sorted in one task and a group that holds most rows is spread over all tasks.
    """
    rows = df.withColumn("_b", spread.cast("int")).withColumn("_s", size.cast("long"))
    sums = rows.groupBy(*keys, "_b").agg(F.sum("_s").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_o", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    within = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_w", F.coalesce(F.sum("_s").over(within), F.lit(0)))
    names = [*keys, "_b"]
    joined = rows.alias("r").join(
        sums.alias("o"), [F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}")) for k in names], "left"
    )
    return joined.select("r.*", (F.col("r._w") + F.col("o._o")).alias("start")).drop("_b", "_s", "_w")
