import math

import pytest
from pyspark.sql import functions as F

from quarryline.operators import metrics as M
from quarryline.operators import stats as S


def test_ranking_by_hand(spark):
    rows = [(1, 1, 0), (1, 2, 3), (1, 3, None), (1, 4, 1), (2, 1, None), (3, 1, 0)]
    r = {x.q: x for x in M.ranking(spark.createDataFrame(rows, "q long, rank int, grade int"), "q", 3).collect()}
    assert r[1].precision == pytest.approx(1 / 3) and r[1].recall == pytest.approx(0.5) and r[1].reciprocal_rank == 0.5
    assert r[1].ndcg_linear == pytest.approx((3 / math.log2(3)) / (3 + 1 / math.log2(3)))
    assert r[1].ndcg_exponential == pytest.approx((7 / math.log2(3)) / (7 + 1 / math.log2(3)))
    assert r[2].precision is None and r[3].recall is None and r[3].ndcg_linear == 0.0


def test_utilities(spark):
    rows = [(1, "a", 0.9, 1.0), (1, "b", 0.9, 1.0), (1, "c", 0.1, 1.0), (2, "a", -0.5, 1.0), (2, "b", -0.9, 2.0)]
    u = {(x.q, x.s): x for x in M.utilities(spark.createDataFrame(rows, "q long, s string, quality double, latency double"), "q", "s", "quality", "latency").collect()}
    assert u[1, "a"].utility == pytest.approx(0.8) and u[1, "a"].tied_with == "b" and u[1, "a"].confidence == 0.0 and u[1, "b"].confidence is None
    assert u[2, "a"].confidence == 1.0  # a best that isn't positive but strictly ahead


def test_pass_at_k_and_histogram(spark):
    row = spark.range(1).select(M.pass_at_k(F.lit(5), F.lit(2), 2).alias("a"), M.pass_at_k(F.lit(2), F.lit(1), 3).alias("b"), M.pass_at_k(F.lit(3), F.lit(2), 2).alias("c")).first()
    assert row.a == pytest.approx(1 - 3 / 10) and row.b is None and row.c == 1.0
    v = spark.createDataFrame([("g", float(x)) for x in range(11)] + [("h", 2.0), ("h", 2.0), ("h", None)], "g string, v double")
    h = {(r.g, r.bin): r["count"] for r in M.histogram(v, "v", 5, "g").collect()}
    assert h == {("g", 0): 2, ("g", 1): 2, ("g", 2): 2, ("g", 3): 2, ("g", 4): 3, ("h", 0): 2}
    one = {r.g: r for r in M.described(v.where("g = 'h' and v is not null").limit(1), "g", "v").collect()}
    assert one["h"].deviation == 0.0
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert {(r.a, r.b): r.r for r in M.pearson(flat, ["a", "b"]).collect()} == {("a", "a"): 0.0, ("a", "b"): 0.0, ("b", "b"): pytest.approx(1.0)}


def test_wilcoxon_constants(spark):
    rows = [(float(a), float(b), "g") for a, b in zip([5.0, 8, 3, 10, 6], [6.0, 7, 3, 8, 9])]
    r = S.with_signed_rank_p(S.signed_ranks(spark.createDataFrame(rows, "a double, b double, g string"), ["g"])).first()
    assert (r.statistic, r.n) == (4.5, 4) and r.rank_biserial == pytest.approx(-0.1) and r.p == pytest.approx(1.0)


def test_mcnemar_and_spearman_constants(spark):
    rows = [("g", True, False)] * 10 + [("g", False, True)] * 2 + [("g", True, True)] * 5 + [("h", True, True)]
    m = {r.g: r for r in S.mcnemar(spark.createDataFrame(rows, "g string, a boolean, b boolean"), "g", "a", "b").collect()}
    assert m["g"].statistic == pytest.approx(49 / 12) and m["g"].p == pytest.approx(0.04330814281, abs=1e-9) and m["h"].p == 1.0
    assert S.mcnemar(spark.createDataFrame(rows, "g string, a boolean, b boolean"), "g", "a", "b", corrected=False).where("g = 'g'").first().statistic == pytest.approx(64 / 12)
    assert S.correlation_p(0.8, 5) == pytest.approx(0.10408803866, abs=1e-9)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip([1, 2, 3, 4, 5], [2, 1, 4, 3, 5])], "a double, b double")
    assert S.spearman(df, "a", "b").first().rho == pytest.approx(0.8)


def test_holm_steps_down(spark):
    t = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03), ("f", "d", 0.005)], "f string, t string, p double")
    r = {x.t: (x.rejected, x.threshold) for x in S.holm(t, "f", "t", "p").collect()}
    assert {k: v[0] for k, v in r.items()} == {"a": True, "b": False, "c": False, "d": True}
    assert r["d"][1] == pytest.approx(0.05 / 4) and r["b"][1] == pytest.approx(0.05)


def test_agreement_and_merge(spark):
    a = spark.createDataFrame([("q", "f1", 3), ("q", "f2", 1), ("q", "f3", 0), ("q", "f4", 2)], "q string, f string, grade int")
    b = spark.createDataFrame([("q", "f1", 3), ("q", "f2", 2), ("q", "f3", 3), ("q", "f5", 2)], "q string, f string, grade int")
    got = {r.f: (r.grade, r.status) for r in S.merged_judgments(a, b, ["q", "f"]).collect()}
    assert got == {"f1": (3, "agreed"), "f2": (1, "lesser"), "f3": (None, "adjudicate"), "f4": (None, "missing"), "f5": (None, "missing")}
    same = spark.createDataFrame([("g", 2, 2), ("g", 2, 2)], "g string, a int, b int")
    assert S.agreement(same, "g", "a", "b").first().kappa == 1.0


def test_bootstrap_holds_the_mean(spark):
    d = spark.createDataFrame([("g", float(i % 7)) for i in range(300)], "g string, v double")
    r = S.bootstrap_interval(d, "g", "v", rounds=300).first()
    assert r.low < r["mean"] < r.high and r.high - r.low < 1


def test_compared_groups_and_family(spark):
    import itertools
    import random

    rng = random.Random(1)
    rows, pairs = [], {}
    for g in "abcd":
        for u in range({"a": 12, "b": 70, "c": 1, "d": 9}[g]):
            x, y = rng.randint(0, 9), rng.randint(0, 9) + (3 if g == "b" else 0)
            rows += [(g, u, "new", float(x)), (g, u, "old", float(y)), (g, u, "other", None)]
            pairs.setdefault(g, []).append(x - y)
    rows += [("d", 99, "new", 1.0), (None, 1, "new", 1.0), (None, 1, "old", 2.0)]
    got = {r.g: r for r in S.compared(spark.createDataFrame(rows, "g string, u int, v string, x double"), "g", "u", "v", "x", "new", "old").collect()}
    assert set(got) == {"a", "b", "d"} and got["d"].pairs == 9
    for g in "ad":
        d = [v for v in pairs[g] if v]
        rank = {v: sum(abs(w) < v for w in d) + (sum(abs(w) == v for w in d) + 1) / 2 for v in map(abs, d)}
        plus, total = sum(rank[abs(v)] for v in d if v > 0), sum(rank[abs(v)] for v in d)
        sums = [sum(rank[abs(v)] for v, up in zip(d, ups) if up) for ups in itertools.product((0, 1), repeat=len(d))]
        p = min(1.0, 2 * min(sum(s <= plus for s in sums), sum(s >= plus for s in sums)) / len(sums))
        assert abs(got[g].p - p) < 1e-9 and got[g].statistic == min(plus, total - plus)
    assert got["b"].p < 0.001
    same = spark.createDataFrame([("e", u, v, 1.0) for u in range(3) for v in ("new", "old")], "g string, u int, v string, x double")
    assert [(r.p, r.statistic) for r in S.compared(same, "g", "u", "v", "x", "new", "old").collect()] == [(1.0, 0.0)]


def test_cost_and_coverage(spark):
    df = spark.createDataFrame([(["lexical", "dense"], {"prompt_token": 2.0}), (None, None)], "r array<string>, p map<string,double>")
    rows = df.select(M.invocations(M.F.col("r")).alias("n"), M.embedding_calls(M.F.col("r")).alias("e"), M.cost(M.F.lit(1), M.F.lit(3), M.F.lit(5), M.F.col("p")).alias("c")).collect()
    assert [tuple(r) for r in rows] == [(2, 1, 6.0), (0, 0, None)]
    pool = spark.createDataFrame([(1, "a"), (1, "a"), (2, "x")], "q int, i string")
    wanted = spark.createDataFrame([(1, "a"), (1, "b"), (2, "y"), (3, None)], "q int, i string")
    assert {r.q: (r.covered, r.coverage) for r in M.plan_coverage(pool, wanted, "q", "i").collect()} == {1: (1, 0.5), 2: (0, 0.0)}
