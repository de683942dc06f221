import pytest
from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.operators import decide as D


def questions(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "record_id long, query_text string")


def test_tokens_and_expansion(spark):
    df = questions(spark, "Where is tara/a_b.py's parse_tree?", "", None, "  ,;! ")
    rows = df.select("record_id", X.tokens(F.col("query_text")).alias("t"), X.expanded(X.search_tokens(F.col("query_text"))).alias("e")).orderBy("record_id").collect()
    assert rows[0].t == ["Where", "is", "tara/a_b.py", "s", "parse_tree"]
    assert rows[0].e == ["tara/a_b.py", "tara", "b", "py", "s", "parse_tree", "parse", "tree"]  # "a" is a stop word
    assert [r.t for r in rows[1:]] == [[], [], []]


@pytest.mark.parametrize(("token", "shape"), [("RepositoryParser", "pascal"), ("parseRepository", "camel"), ("max_file_size", "snake"), ("MAX_SIZE", "constant"), ("JWT", "acronym")])
def test_shapes(spark, token, shape):
    row = spark.range(1).select(*[X.has_shape(F.lit(token), s).alias(s) for s in X.SHAPES], X.looks_like_identifier(F.lit("Find")).alias("word")).first()
    assert [s for s in X.SHAPES if row[s]] == [shape]
    assert not row.word


def test_paths_and_language(spark):
    df = questions(spark, 'Open `x.y` in utils.py and "My Name", golang or C?', None)
    row = df.select(X.file_paths(F.col("query_text")).alias("p"), X.symbols(F.col("query_text")).alias("s"), X.language(F.col("query_text")).alias("l")).collect()
    assert row[0].p == ["utils.py"] and row[0].s == ["x.y", "My Name"] and row[0].l == "go"
    assert row[1].p == [] and row[1].l is None


def test_imports_and_spans(spark):
    lines = [("from .a.b import c", "python", "b"), ('import x from "./lib/y"', "javascript", "y"), ("import java.util.List;", "java", "List"), ("#include <sys/types.h>", "c", "h"), ("no", "java", None)]
    df = spark.createDataFrame(lines, "line string, lang string, want string")
    for r in df.withColumn("stem", X.module_stem(X.import_target(F.col("line"), F.col("lang")))).collect():
        assert r.stem == r.want
    row = spark.createDataFrame([("héllo", 1, 3), ("héllo", 3, 1)], "t string, a long, b long").select(X.byte_span(F.col("t"), F.col("a"), F.col("b")).alias("s")).collect()
    assert bytes(row[0].s).decode() == "é" and row[1].s is None


@pytest.mark.parametrize(
    ("text", "strategy"),
    [
        ("Find parse_repository", "lexical_only"), ("Explain RepositoryContextExtractor", "semantic_only"), ("Trace login flow", "graph_only"),
        ("Where is JWT implemented?", "hybrid"), ("Refactor RepositoryParser", "full_pipeline"), ("", "semantic_only"), ("?!", "semantic_only"),
    ],
)
def test_worked_examples(spark, text, strategy):
    row = D.planned(D.classified(questions(spark, text)), D.strategy()).first()
    assert row.strategy == strategy


def test_plan_details_and_downgrade(spark):
    rows = D.classified(questions(spark, "Refactor RepositoryParser", "Trace login flow", None))
    full = D.planned(rows, D.strategy()).orderBy("record_id").collect()
    assert (full[0].retrievers, full[0].rerank, full[0].top_k, full[0].candidate_limit, full[0].graph_depth) == (["lexical", "graph", "dense"], True, 20, 60, 3)
    assert full[2].task == "unknown" and full[2].confidence == 0.0
    bare = D.planned(rows, D.strategy(), dense=F.lit(False), graph=F.lit(False)).orderBy("record_id").collect()
    assert bare[1].retrievers == ["lexical"] and bare[1].strategy == "graph_only" and bare[1].top_k == 10


def test_symbol_fallback_and_empty(spark):
    row = D.classified(questions(spark, "RepositoryParser")).first()
    assert (row.task, row.lexical, row.confidence, row.kind) == ("search", True, 0.3, "lexical")
    assert D.classified(questions(spark, "x").limit(0)).count() == 0
    assert D.baselines(D.classified(questions(spark, "x"))).count() == 5
