import math

import numpy as np
from pyspark.sql import functions as F

from quarryline.operators import fuse as U
from quarryline.operators import retrieve as R


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id string, tokens array<string>")


def asked(spark, *rows):
    return spark.createDataFrame(list(rows), "q long, tokens array<string>")


def test_bm25_needle_and_formula(spark):
    many = [(f"d{i:05d}", ["common", "term", "words"]) for i in range(500)] + [("needle", ["common", "unique"]), ("empty", []), ("none", None)]
    found = R.bm25(docs(spark, *many), asked(spark, (1, ["unique"]), (2, []), (3, ["nowhere"])), "doc_id", "q").collect()
    assert [(r.q, r.doc_id) for r in found] == [(1, "needle")] and found[0].score > 0
    corpus = {"a": ["x", "y", "x"], "b": ["y"], "c": []}
    got = {(r.doc_id): r.score for r in R.bm25(docs(spark, *corpus.items()), asked(spark, (1, ["x", "x", "y"])), "doc_id", "q").collect()}
    n, mean = 3, 4 / 3
    def one(tf, df, dl):
        return math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))
    assert abs(got["a"] - (2 * one(2, 1, 3) + one(1, 2, 3))) < 1e-9 and abs(got["b"] - one(1, 2, 1)) < 1e-9
    assert R.bm25(docs(spark, *corpus.items()).limit(0), asked(spark, (1, ["x"])), "doc_id", "q").count() == 0


def test_lists_in_blocks_equal_plain_bm25(spark):
    import random

    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    d = docs(spark, *[(f"d{i:03d}", rng.choices(words, k=rng.randint(0, 12))) for i in range(120)], ("none", None))
    q = asked(spark, *[(i, rng.choices([*words, "absent"], k=4)) for i in range(9)], (20, []), (21, None))
    plain = {}
    for r in R.top_k(R.bm25(d, q, "doc_id", "q"), "q", "doc_id", 5).collect():
        plain[r.q, r.rank] = (r.doc_id, round(r.score, 6), round(r.normalised, 6))
    terms = R._asked(q, "q")
    found, n = R.postings(d, "doc_id")
    got = R.lists({"text": R.bm25_weights(found, n, terms.select("term").distinct(), "doc_id")}, terms, "doc_id", "q", 5, query_block=4, item_block=30).collect()
    assert {(r.q, r["rank"]): (r.doc_id, round(r.score, 6), round(r.normalised, 6)) for r in got} == plain
    assert R.bm25_lists(d.limit(0), q, "doc_id", "q", 5).count() == 0 and R.bm25_lists(d, q.limit(0), "doc_id", "q", 5).count() == 0


def test_top_k_normalises_before_cut(spark):
    s = spark.createDataFrame([(1, "b", 2.0), (1, "a", 2.0), (1, "c", 1.0), (2, "z", 5.0)], "q long, i string, score double")
    rows = {(r.q, r.i): (r.rank, r.normalised) for r in R.top_k(s, "q", "i", 2).collect()}
    assert rows == {(1, "a"): (1, 1.0), (1, "b"): (2, 1.0), (2, "z"): (1, 1.0)}


def test_cosine_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(200, 8))
    v[7] = 0
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(500, None), (501, [1.0])], "i long, embedding array<double>")
    q = df.where("i % 50 = 0 and i < 200").withColumnRenamed("i", "q")
    got = {(r.q, r.rank): r.i for r in R.cosine_top_k(df, q, "i", "q", 3, query_block=2, item_block=30).collect()}
    unit = v / np.where(np.linalg.norm(v, axis=1, keepdims=True) > 0, np.linalg.norm(v, axis=1, keepdims=True), 1)
    for qi in (0, 50, 100, 150):
        best = np.argsort(-(unit @ unit[qi]), kind="stable")[:3]
        assert [got[qi, k] for k in (1, 2, 3)] == list(best)


def test_graph_operators(spark):
    edges = spark.createDataFrame([("r", "f"), ("f", "s"), ("f", "s"), ("s", "t"), ("t", "u"), (None, "x"), ("p", "q")], "src string, dst string")
    seeds = spark.createDataFrame([("f",), (None,), ("lone",)], "node string")
    down = {r.node: r.distance for r in R.reached(edges, seeds, 2).collect()}
    assert down == {"f": 0, "lone": 0, "s": 1, "t": 2}
    assert {r.node: r.distance for r in R.reached(edges, seeds, 1, undirected=True).collect()} == {"f": 0, "lone": 0, "s": 1, "r": 1}
    nodes = spark.createDataFrame([(c,) for c in "rfstupqx"], "node string")
    parts = {r.node: r.component for r in R.components(edges, nodes).collect()}
    assert parts == {"r": "f", "f": "f", "s": "f", "t": "f", "u": "f", "p": "p", "q": "p", "x": "x"}
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "src long, dst long")
    assert {r.component for r in R.components(chain, spark.range(61).withColumnRenamed("id", "node")).collect()} == {0}


def test_fusion(spark):
    rows = [(1, "lexical", 0, 1, "a", 1.0), (1, "lexical", 0, 2, "b", 0.5), (1, "dense", 1, 1, "b", 1.0), (1, "dense", 1, 2, "c", 0.0)]
    c = spark.createDataFrame(rows, "q long, retriever string, kind_order int, rank int, chunk string, normalised double")
    m = U.merged(c, "q", "chunk", {"lexical": 1.0, "dense": 3.0})
    got = {r.chunk: r for r in m.collect()}
    assert got["b"].score == (0.5 + 3) / 4 and got["b"].found_by == ["dense", "lexical"] and got["a"].score == 1.0
    assert [r.chunk for r in U.ordered(m, "q", "chunk", True).orderBy("rank").collect()] == ["a", "b", "c"]
    assert [r.chunk for r in U.ordered(m, "q", "chunk", False).orderBy("rank").collect()] == ["a", "b", "c"]
    zero = U.merged(c, "q", "chunk", {"lexical": 0.0, "dense": 0.0}).collect()
    assert {r.score for r in zero} == {0.0}
    sized = U.ordered(m, "q", "chunk", True).withColumn("token_count", F.lit(3))
    kept = U.within_budget(sized, "q", top_k=3, budget=7).collect()
    assert len(kept) == 2 and kept[0].truncated and kept[0].candidate_count == 3
    assert not U.within_budget(sized, "q", top_k=2, budget=7).first().truncated
    p = U.prompts(sized, "q", F.lit("why?"), F.col("chunk"), F.lit("body")).first().prompt
    assert p == "why?\n\n## a\nbody\n\n## b\nbody\n\n## c\nbody"
