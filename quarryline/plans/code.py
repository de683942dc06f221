"""Queries over the Python sources of all repositories."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.functions import text as X
from quarryline.operators import code as C
from quarryline.plans.retrieve import _symbols
from quarryline.plans.text import files


def _python(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where("lang = 'python'")


def parse_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.parsed(_python(spark, sf_dir)).where("fact in ('class', 'function', 'method', 'error')")


def call_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _python(spark, sf_dir)
    return C.call_graph(C.parsed(f), f, "repository_id")


def inheritance_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _python(spark, sf_dir)
    return C.inheritance(C.parsed(f), f, "repository_id")


def comment_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _python(spark, sf_dir)
    return C.parsed(f).where("fact = 'file'").join(f.select("file_id", "repository_id"), "file_id").groupBy("repository_id").agg(F.avg("number").alias("coverage"), F.count("*").alias("files"))


def docstring_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the parser's stripped docstrings are from those that the language defines."""

    @F.pandas_udf(T.DoubleType())
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([C.edit_similarity(x, y) for x, y in zip(a, b)])

    facts = C.parsed(_python(spark, sf_dir)).where("fact in ('function', 'method', 'class') and detail is not null").select("file_id", "name", (F.col("line") - 1).alias("start_line"), "detail")
    seen = _symbols(spark, sf_dir).where("docstring is not null").select("symbol_id", "file_id", "name", "start_line", "docstring")
    both = seen.join(facts, ["file_id", "name", "start_line"])
    return both.select("symbol_id", similar("docstring", "detail").alias("edit_similarity"), (X.collapsed(F.col("docstring")) == X.collapsed(F.col("detail"))).alias("exact_match"))


QUERIES = {"parse_python": parse_python, "call_graph": call_graph, "inheritance_graph": inheritance_graph, "comment_coverage": comment_coverage, "docstring_similarity": docstring_similarity}
SQL: dict[str, str] = {}
