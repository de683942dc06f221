"""Learning to rank candidates: a feature matrix, a pointwise ranker trained by gradient-boosted trees, and its metrics.

Labels that are placeholders are refused: only graded candidates train, and a set without grades raises an error.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions import text as X


def features(candidates: DataFrame, query: str) -> DataFrame:
    """``candidates`` (``rank, file, grade, query_text, category``) with numeric features of the path and the question.
    Nulls give zeros; categories are coded by their place in the alphabet, unknown ones by -1."""
    path, words = F.coalesce("file", F.lit("")), X.expanded(X.search_tokens(F.col("query_text")))
    parts = X.expanded(X.search_tokens(F.regexp_replace(F.coalesce("file", F.lit("")), r"[/\\.]", " ")))
    shared = F.size(F.array_intersect(words, parts))
    rows = candidates.withColumns({
        "f_place": 1.0 / F.col("rank"), "f_depth": F.size(F.split(path, "/")).cast("double"), "f_length": F.length(path).cast("double"),
        "f_test": F.lower(path).contains("test").cast("double"), "f_doc": (F.lower(path).contains("doc") | path.endswith(".md")).cast("double"),
        "f_shared": shared.cast("double"), "f_share": F.coalesce(shared / F.nullif(F.size(parts), F.lit(0)), F.lit(0.0)), "f_words": F.size(words).cast("double"),
        "f_listed": F.count("*").over(Window.partitionBy(query)).cast("double"),
    })
    return rows.withColumn("f_category", code(F.col("category")))


def code(category: Column) -> Column:
    known = ("api_usage", "bug_fix", "code_search", "documentation", "feature_implementation", "refactoring", "testing")
    tidy = F.regexp_replace(F.lower(F.trim(category)), "[- ]", "_")
    return F.coalesce(F.array_position(F.array(*map(F.lit, known)), tidy).cast("double") - 1, F.lit(-1.0))


def train(matrix: DataFrame, depth: int = 3, rounds: int = 10):
    """A model over the columns that start with ``f_``; trees are fitted by Spark over all graded rows."""
    graded = matrix.where("grade is not null")
    if graded.isEmpty():
        raise ValueError("no graded candidates: placeholder labels can't train a ranker")
    names = sorted(c for c in matrix.columns if c.startswith("f_"))
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    model = GBTRegressor(featuresCol="features", labelCol="grade", maxDepth=depth, maxIter=rounds, maxBins=32, seed=7, cacheNodeIds=False)
    return assembler, model.fit(assembler.transform(graded.withColumn("grade", F.col("grade").cast("double"))))


def ranked(matrix: DataFrame, fitted, query: str) -> DataFrame:
    """Candidates by predicted grade; ties keep their given order."""
    assembler, model = fitted
    rows = model.transform(assembler.transform(matrix)).drop("features")
    w = Window.partitionBy(query).orderBy(F.desc("prediction"), "rank")
    return rows.withColumn("given", F.col("rank")).withColumn("rank", F.row_number().over(w))


def importance(fitted) -> dict[str, float]:
    assembler, model = fitted
    return dict(zip(assembler.getInputCols(), (float(x) for x in model.featureImportances.toArray())))
