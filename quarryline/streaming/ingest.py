"""Streams over growing folders of rows: stateless decisions, mergeable statistics, and windows that keep late rows.

Each runs to the end of what is there and stops (``availableNow``), keeps its progress in a checkpoint, and writes by
batch, so that a batch that is run again replaces its own rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import dataset as D
from quarryline.session import shared_folder


def read(spark: SparkSession, folder: str, name: str, files_per_batch: int = 8) -> DataFrame:
    """A stream of the parquet table ``name`` in ``folder``, whether it is one file or a folder of files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    single = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(path).isFile()
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if single:
        return source.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return source.parquet(f"{folder}/{name}.parquet")


def run(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """Applies ``transform`` to every batch and returns all that was written. Batch ``n`` owns the folder ``batch=n``."""
    spark = stream.sparkSession
    home = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, n: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{home}/out/batch={n}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/progress").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.parquet(f"{home}/out")


def statistics(stream: DataFrame, group: str, value: str) -> DataFrame:
    """Exact statistics per group: each batch writes partial sums, which merge into the same result in any order."""
    parts = run(stream, lambda batch: D.statistics(batch, group, value))
    return D.merge_statistics(parts.drop("batch"), group)


def windowed(stream: DataFrame, time: str, group: str, size: str = "1 day") -> DataFrame:
    """Rows per window and group: each batch writes partial counts, which merge by sum in any order. No watermark closes a
    window, so a row counts however late its batch comes; rows without a time have no window."""
    stream = stream.withColumn(time, F.col(time).cast("timestamp"))  # tables may hold times without zone
    counted = lambda batch: batch.groupBy(F.window(time, size), group).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), group, "n")
    return run(stream, counted).groupBy("start", group).agg(F.sum("n").alias("n"))
