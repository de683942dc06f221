import random

from pyspark.sql import functions as F

from quarryline.llm import mixing, packing, sizes, splits


def repositories(spark):
    rows = [("big-kit", "own", "bigk", None, ["old_name"]), ("Fork2", "own", "fork2", "big-kit", []), ("fork-of-fork", "x", "fof", "Fork2", None), ("solo", "x", "solo", "gone", []), ("ring-a", "x", "ra", "ring-b", []), ("ring-b", "x", "rb", "ring-a", [])]
    return spark.createDataFrame(rows, "repository_id string, owner string, query_prefix string, fork_of string, former_names array<string>")


def test_led(spark):
    names = ["big-kit", "BigKit", " big_kit ", "own/big-kit", "https://c.x/own/big-kit.git", "big-kit/", "old-name", "fork2", "fork-of-fork", "solo", "ring-b", "unknown", "", None, None, None, None]
    ids = [None] * 13 + ["bigk-00001", "BIGK_17-r2", "bigkit-1", None]
    df = spark.createDataFrame([(i, n, q, "k", "p") for i, (n, q) in enumerate(zip(names, ids))], "record_id long, repository_id string, query_id string, key string, prefix string")
    got = {r.record_id: r.root_repository_id for r in splits.led(df, repositories(spark)).collect()}
    assert [got[i] for i in range(len(names))] == ["big-kit"] * 9 + ["solo", "ring-a", None, None, "big-kit", "big-kit", None, None]
    found = {r.record_id for r in splits.found(df, repositories(spark)).collect()}
    assert found == {1, 2, 3, 4, 5, 6, 7, 8, 10, 13, 14}


def test_assign_keeps_components_and_shares(spark):
    rng = random.Random(1)
    rows = []
    for i in range(4000):
        r = "big-kit" if i % 3 == 0 else "Fork2" if i % 50 == 1 else None  # a third of all rows is one component
        rows.append((i, r, None, rng.choice(["bug_fix", "Bug-fix", "testing", None]), rng.choice(["easy", "hard"])))
    df = spark.createDataFrame(rows, "record_id long, repository_id string, query_id string, category string, difficulty string")
    targets = spark.createDataFrame([("train", 0.7), ("validation", 0.15), ("test", 0.15)], "split string, target_share double")
    got = splits.assign(df.unionByName(df), repositories(spark), targets)
    assert got.count() == 4000 and got.groupBy("component").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    share = {r.split: r["count"] / 4000 for r in got.groupBy("split").count().collect()}
    assert abs(share["train"] - 0.7) < 0.03 and abs(share["test"] - 0.15) < 0.03
    testing = {r.split: r["count"] for r in got.join(df.where("category = 'testing'"), "record_id").groupBy("split").count().collect()}
    assert abs(testing["train"] / sum(testing.values()) - 0.7) < 0.05
    assert splits.assign(df.limit(0), repositories(spark), targets).count() == 0


def documents(spark, texts, source="s", lang="en"):
    return spark.createDataFrame([(i, t, source, lang) for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")


CONTAINERS = [("small", 40), ("large", 200), (None, 5), ("none", 0)]


def check_packing(rows, counts, capacity):
    total = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.tokens
        if r.container_id is None:
            assert r.tokens == 0
    assert total == counts
    held = {}
    for r in rows:
        if r.container_id is not None:
            held.setdefault(r.container_id, []).append(r)
    for pieces in held.values():
        assert sum(p.tokens for p in pieces) <= capacity
    per_doc = {}
    for r in rows:
        per_doc.setdefault(r.doc_id, []).append(r)
    for d, pieces in per_doc.items():
        if counts[d] <= capacity:
            assert len(pieces) == 1
        else:
            assert sorted(p.tokens for p in pieces)[-(counts[d] // capacity) :] == [capacity] * (counts[d] // capacity)
    return len(held)


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(2)
    texts = ["word " * rng.choice([1, 2, 3, 8, 15, 20, 33, 33, 33, 90, 410]) for _ in range(600)] + ["", None, "word " * 39, "x"]
    df = documents(spark, texts)
    counts = {r.doc_id: r.tokens for r in sizes.sized(df).collect()}
    assert counts[600] == counts[601] == 0
    containers = spark.createDataFrame(CONTAINERS, "container_kind string, capacity_tokens int")
    rows = packing.packed(df, containers).collect()
    assert {r.container_kind for r in rows} == {"small", "large"}
    for kind, capacity in (("small", 40), ("large", 200)):
        n = check_packing([r for r in rows if r.container_kind == kind], counts, capacity)
        assert n <= sum(counts.values()) / capacity * 1.05 + 1
    narrow = packing.fitted(spark.createDataFrame([("k", 100, str(i), 1 + i * 37 % 70) for i in range(400)], "kind string, capacity int, id string, value int")).collect()
    assert len(narrow) == 400
    load = {}
    for r in narrow:
        load[r.container] = load.get(r.container, 0) + 1 + int(r.id) * 37 % 70
    assert max(load.values()) <= 100 and len(load) <= sum(load.values()) / 100 * 1.1 + 1
    assert packing.packed(df.limit(0), containers).count() == 0
    assert packing.packed(df, containers.limit(0)).count() == 0


def test_packing_opens_only_where_no_gap_fits(spark):
    # the small units lie in other ranges of values than the gaps that hold them
    values = [60] * 100 + [10] * 200 + [9] * 200
    units = spark.createDataFrame([("k", 100, str(i), v) for i, v in enumerate(values)], "kind string, capacity int, id string, value int")
    rows = packing.fitted(units).collect()
    load = {}
    for r in rows:
        load[r.container] = load.get(r.container, 0) + values[int(r.id)]
    assert len(rows) == 500 and max(load.values()) <= 100 and len(load) == 100
    assert "bisect" not in vars(packing)  # no best fit in one Python task at any size


def test_budgets():
    supplies = {("a", "en"): 1000, ("a", "de"): 10, ("b", "en"): 100, ("z", "en"): 5}
    targets = {"a": (0.5, 1), "b": (0.4, 2), "c": (0.1, 9)}
    got = mixing.budgets(supplies, targets, 1000)
    assert got[("b", "en")] == 200 and got[("a", "de")] == 10 and abs(sum(got.values()) - 1000) < 1e-6 and ("z", "en") not in got
    assert sum(mixing.budgets(supplies, targets, 1e9).values()) == 1000 + 10 + 200


def test_budgets_fill_shortages_inside_the_domain_first():
    supplies = {("readme", "en"): 10, ("faq", "en"): 1000, ("issue", "en"): 1000}
    targets = {"readme": (0.4, 1), "faq": (0.1, 1), "issue": (0.5, 1)}
    got = mixing.budgets(supplies, targets, 1000)
    assert {k: round(v, 6) for k, v in got.items()} == {("readme", "en"): 10, ("faq", "en"): 490, ("issue", "en"): 500}
    plain = mixing.budgets(supplies, targets, 1000, domains={})
    assert plain[("issue", "en")] > 500


def test_labels_are_spread_like_targets(spark):
    rng = random.Random(8)
    rows = []
    for c in range(120):
        for _ in range(rng.choice([1, 1, 2, 5, 40, 200])):
            rows.append((f"c{c}", [rng.choice("aaaaabbbc"), rng.choice(["x", "y"])]))
    rows += [(f"s{i}", [rng.choice("abbbd")]) for i in range(3000)] + [(None, ["a"]), ("bare", None)]
    df = spark.createDataFrame(rows, "component string, labels array<string>")
    targets = spark.createDataFrame([("train", 0.7), ("validation", 0.15), ("test", 0.15)], "split string, target_share double")
    chosen = splits.stratify(df, "component", "labels", targets)
    assert chosen.count() == chosen.select("component").distinct().count() == 3121
    got = df.join(chosen, "component").select("split", F.explode("labels").alias("label")).groupBy("label").pivot("split").count().fillna(0).collect()
    for r in got:
        total = r["train"] + r["validation"] + r["test"]
        assert abs(r["train"] / total - 0.7) < 0.03 and abs(r["test"] / total - 0.15) < 0.03, r
    assert splits.stratify(df.limit(0), "component", "labels", targets).count() == 0


def test_mixing_respects_repeats_and_prefix(spark):
    rng = random.Random(3)
    a = documents(spark, ["w " * rng.randint(1, 30) for _ in range(400)], "Readme ", "en-GB")
    b = documents(spark, ["w " * rng.randint(1, 30) for _ in range(40)] + ["", None], "issue", None).withColumn("doc_id", F.col("doc_id") + 1000)
    c = documents(spark, ["w w"], "other").withColumn("doc_id", F.col("doc_id") + 2000)
    df = a.unionByName(b).unionByName(c)
    targets = spark.createDataFrame([("readme", 0.5, 1), ("issue", 0.4, 3), ("ghost", 0.1, 2)], "source string, target_share double, max_repeats int")
    rows = mixing.mixed(df, targets).collect()
    assert {r.source for r in rows} == {"readme", "issue"} and max(r.copies for r in rows if r.source == "readme") == 1
    issue = [r.copies for r in rows if r.source == "issue"]
    assert len(issue) == 40 and max(issue) <= 3 and max(issue) - min(issue) <= 1
    again = {(r.doc_id, r.copies) for r in mixing.mixed(df, targets).collect()}
    assert again == {(r.doc_id, r.copies) for r in rows}
    report = {r.source: r for r in mixing.shares(df, targets).collect()}
    assert report["ghost"].tokens == 0 and abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9
    small = mixing.mixed(df, targets, total=100).agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0]
    assert 40 <= small <= 100
    assert mixing.mixed(df.limit(0), targets).count() == 0


def test_sweeps_join_runs_and_run_one_job_each(spark):
    rows = [("unit", "k", 10, 6, None, 0, 5, None), ("gap", "k", 10, 4, "r", 0, 9, None), ("gap", "k", 10, 2, "q", 0, 3, None), ("unit", "k", 10, 3, None, 0, 2, None)]
    got = {tuple(r) for r in packing._swept(spark.createDataFrame(rows, packing._RUNS)).collect()}
    # units and gaps that nothing met stay in one piece
    assert got == {("unit", "k", 10, 6, None, 0, 5, None), ("gap", "k", 10, 4, "r", 0, 7, None), ("gap", "k", 10, 1, "r", 7, 2, None), ("placed", "k", 10, 3, "r", 0, 2, 7), ("gap", "k", 10, 2, "q", 0, 3, None)}
    sizes = spark.createDataFrame([("k", 100, v, 7) for v in range(3, 70, 4)], "kind string, capacity int, value int, n long")
    asked = []
    plain, swept = packing._plain, packing._swept
    packing._plain = lambda *a: asked.append(plain(*a)) or asked[0]
    packing._swept = lambda runs: swept(runs) if runs.sparkSession is asked[0] else None
    try:
        placed = packing.placements(sizes).collect()
    finally:
        packing._plain, packing._swept = plain, swept
    assert sum(r.n for r in placed) == 17 * 7 and asked[0].conf.get("spark.sql.adaptive.enabled") == "false"
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
