import json

import pytest
from pyspark.sql import functions as F

from quarryline.operators import code as C
from quarryline.operators import dataset as D
from quarryline.operators import ltr as L
from quarryline.session import cut, first_delivery, running_start
from quarryline.sources import io
from quarryline.streaming import ingest


def test_running_start_equals_plain_sum(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 3 < 2, F.col("id") % 3).alias("g"), "id", (F.col("id") % 7).alias("n"))
    got = running_start(df, ["g"], F.col("id") / 50, [F.col("id")], F.col("n"), 16).collect()
    for g in (0, 1, None):
        total = 0
        for r in sorted((r for r in got if r.g == g), key=lambda r: r.id):
            assert r.start == total
            total += r.n
    assert running_start(df.limit(0), [], F.lit(0), [F.col("id")], F.col("n")).count() == 0


def test_first_delivery(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (None, "x", 0), (2, None, None)], "id long, v string, at int")
    assert {(r.id, r.v) for r in first_delivery(df, "id", ["at"]).collect()} == {(1, "a"), (2, None)}


def test_cut_survives_in_shared_folder(spark):
    df = cut(spark.range(10).withColumn("x", F.col("id") * 2))
    assert df.agg(F.sum("x")).first()[0] == 90


def test_split_pending_issues(spark):
    df = spark.createDataFrame([(1, "train", "q"), (2, "test", "q"), (3, "test", "r"), (4, None, "s")], "id long, split string, t string")
    assert [(r.t, r.splits, r.n) for r in D.leakage(df, "t", "split").collect()] == [("q", "test,train", 2)]
    done = spark.createDataFrame([(1, "ok"), (2, "ok")], "id long, digest string")
    assert {r.id for r in D.pending(df, done, ["id"], F.col("digest") != "ok").collect()} == {3, 4}
    assert D.pending(df, done, ["id"], F.col("digest") != "new").count() == 4
    found = {(r.id, r.issue) for r in D.issues(df, "id", {"no split": F.col("split").isNotNull()}).collect()}
    assert found == {(4, "no split")}
    parts = D.hash_split(F.col("f"))
    assert [r[0] for r in spark.createDataFrame([(0.0,), (0.7,), (0.86,)], "f double").select(parts).collect()] == ["train", "validation", "test"]


def test_python_facts(spark):
    base = "class Animal:\n    def speak(self):\n        return 1\n"
    app = "import os\nfrom base import Animal\n\ndef helper():\n    '''Help.'''\n    return unique_callee()\n\n@dec\ndef main():\n    helper()\n    len([])\n\nclass Dog(Animal, object):\n    pass\n"
    files = spark.createDataFrame([(1, "r", base), (2, "r", app), (3, "r", "def unique_callee():\n  pass # c\n"), (4, "r", "def broken(:\n"), (5, "r", None)], "file_id long, repository_id string, content string")
    facts = C.parsed(files)
    kinds = {(r.fact, r.qualified) for r in facts.where("fact in ('class', 'method', 'function')").collect()}
    assert kinds == {("class", "Animal"), ("method", "Animal.speak"), ("function", "helper"), ("function", "main"), ("class", "Dog"), ("function", "unique_callee")}
    assert [r.file_id for r in facts.where("fact = 'error'").collect()] == [4]
    assert {(r.src, r.dst) for r in C.call_graph(facts, files, "repository_id").collect()} == {("helper", "unique_callee"), ("main", "helper")}
    assert {(r.src, r.dst) for r in C.inheritance(facts, files, "repository_id").collect()} == {("Dog", "Animal")}
    assert C.edit_similarity("a b c", "a x c") == pytest.approx(2 / 3) and C.edit_similarity("", " ") == 1.0 and C.edit_similarity(None, "") is None


def test_stream_equals_batch(spark, tmp_path):
    df = spark.range(40).select(F.timestamp_seconds(F.col("id") * 7000).alias("ts"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("g"), F.col("id").cast("double").alias("v"))
    df.repartition(5).write.parquet(f"{tmp_path}/t.parquet")
    batch = {(r.g, r.n, r.total) for r in D.statistics(df, "g", "v").collect()}
    assert {(r.g, r.n, r.total) for r in ingest.statistics(ingest.read(spark, str(tmp_path), "t", 2), "g", "v").collect()} == batch
    windows = ingest.windowed(ingest.read(spark, str(tmp_path), "t", 50), "ts", "g").agg(F.sum("n")).first()[0]
    assert windows == 40


def test_sources(spark, tmp_path):
    root = tmp_path / "src"
    for name, text in {"a.py": "x = 1\n", "pkg/b.TS": "let x", "node_modules/c.js": "1", ".venv/d.py": "", "notes.txt": "n", "big.go": "x" * 200}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    assert {(r.path, r.language) for r in io.source_tree(spark, str(root), largest=100).collect()} == {("a.py", "python"), ("pkg/b.TS", "typescript")}
    (tmp_path / "m.json").write_text(json.dumps([{"repository_id": "a"}, {"repository_id": "a"}]))
    with pytest.raises(ValueError, match="twice"):
        io.manifest(spark, str(tmp_path / "m.json"))
    (tmp_path / "q.jsonl").write_text('{"repository_id": "a", "query_text": "t"}\nnot json\n')
    good, bad = io.tolerant_lines(spark, str(tmp_path / "q.jsonl"), io.QUERIES)
    assert good.count() == 1 and [r.line for r in bad.collect()] == ["not json"]
    with pytest.raises(Exception):
        io.query_lines(spark, str(tmp_path / "q.jsonl")).collect()
    rows = spark.createDataFrame([("train", 1)], "split string, x int")
    io.export_splits(rows, f"{tmp_path}/splits")
    assert spark.read.parquet(f"{tmp_path}/splits/test").schema.simpleString() == "struct<x:int>"


def test_placeholders_are_refused(spark):
    rows = spark.createDataFrame([(1, 1, "a.py", None, "q", "bug fix")], "record_id long, rank int, file string, grade int, query_text string, category string")
    with pytest.raises(ValueError, match="placeholder"):
        L.train(L.features(rows, "record_id"))
    graded = spark.createDataFrame([(i, k, f"src/{'test' if k == 2 else 'x'}_{i}.py", 3 if k == 2 else 0, "find it", "bug-fix") for i in range(30) for k in (1, 2, 3)], "record_id long, rank int, file string, grade int, query_text string, category string")
    m = L.features(graded, "record_id")
    fitted = L.train(m, rounds=3)
    assert {r.given for r in L.ranked(m, fitted, "record_id").where("rank = 1").collect()} == {2}
    assert abs(sum(L.importance(fitted).values()) - 1) < 1e-6
