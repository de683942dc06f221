import json

from quarryline.operators import nested, schema_drift


def drafts(spark, *payloads):
    return spark.createDataFrame(list(enumerate(payloads)), "draft_id long, payload string")


def brute(payload):
    """Plain recursion as the definition reads."""
    out = []

    def objects(v):
        if isinstance(v, str):
            v = json.loads(v)
        if isinstance(v, dict):
            v = [v[k] for k in sorted(v, key=int)] if v and all(k.isdigit() for k in v) else [v]
        return [x for x in v or [] if isinstance(x, dict)]

    def below(node, path):
        for i, x in enumerate(objects(node.get("alternatives"))):
            out.append((f"{path}.alternatives[{i}]", path, x.get("file_path") or ""))
            below(x, f"{path}.alternatives[{i}]")

    def search(o):
        for k, v in (o.items() if isinstance(o, dict) else enumerate(o) if isinstance(o, list) else ()):
            if k in nested.SECTIONS:
                for i, x in enumerate(objects(v)):
                    out.append((f"{k}[{i}]", "", x.get("file_path") or ""))
                    below(x, f"{k}[{i}]")
            else:
                search(v)

    search(json.loads(payload))
    return sorted(out)


def test_nested_equals_brute_force(spark):
    leaf = {"file_path": "x.py", "reason": "r"}
    payloads = [
        json.dumps({"primary_candidates": [{"file_path": "a", "alternatives": [leaf, None, {"alternatives": [leaf]}]}, None], "review": {"secondary_candidates": leaf}}),
        json.dumps({"judgment": {"candidates": {"regression_tests": json.dumps([leaf, leaf])}}, "primary_candidates": {"1": {"file_path": None}, "0": leaf}}),
        json.dumps({"primary_candidates": None, "secondary_candidates": [], "notes": '{"file_path": "no"}'}),
    ]
    got = nested.occurrences(drafts(spark, *payloads), "draft_id", "payload").collect()
    for i, p in enumerate(payloads):
        assert sorted((r.node_path, r.parent_path, r.file_path) for r in got if r.draft_id == i) == brute(p)
    same = {r.object_id for r in got if r.body == json.dumps(leaf, sort_keys=True, separators=(",", ":"))}
    assert len(same) == 1  # equal subtrees share one identity, whatever their place and the order of keys


def test_nested_shares_objects_and_takes_the_first_delivery(spark):
    leaf, wrapped = {"file_path": "x", "why": 1}, {"file_path": "y"}
    for _ in range(6):
        wrapped = json.dumps(wrapped)
    pair = {"file_path": "p", "alternatives": [leaf, leaf]}
    rows = [(1, json.dumps({"primary_candidates": [pair, pair], "note": {"by": ["a", None]}}), "2024-01-01"), (1, json.dumps({"primary_candidates": []}), "2024-01-02"), (2, json.dumps({"secondary_candidates": [pair, wrapped]}), "2024-01-01")]
    df = spark.createDataFrame(rows, "draft_id long, payload string, exported_at string")
    bridge = nested.occurrences(df, "draft_id", "payload", order=("exported_at",))
    assert {r.file_path: r.occurrences for r in nested.objects(bridge).collect()} == {"p": 3, "x": 6, "y": 1}
    assert {(r.node_path, r.parent_path) for r in bridge.where("draft_id = 1 and depth = 1").collect()} == {(f"primary_candidates[{i}].alternatives[{j}]", f"primary_candidates[{i}]") for i in (0, 1) for j in (0, 1)}
    assert {(r.path, r.value) for r in nested.fields(df, "draft_id", "payload", order=("exported_at",)).collect()} == {("note.by[0]", '"a"'), ("note.by[1]", "null")}


def test_nested_bad_input(spark):
    bad = drafts(spark, None, "", "[1]", '{"primary_candidates": [', "null", '{"a": 1}')
    assert nested.occurrences(bad, "draft_id", "payload").count() == 0
    twice = drafts(spark, '{"primary_candidates": [{"file_path": "a"}]}').withColumn("_row", nested.F.lit(1))
    twice = twice.unionByName(twice)
    assert nested.occurrences(twice, "draft_id", "payload").count() == 1
    assert nested.objects(nested.occurrences(twice, "draft_id", "payload")).first().occurrences == 1
    deep = '{"primary_candidates": [' + '{"alternatives": [' * 6000 + "]}" * 6000 + "]}"
    assert nested.occurrences(drafts(spark, deep), "draft_id", "payload").count() == 6000


def lines(spark, files):
    rows, n = [], 0
    for series, file, day, objs in files:
        for i, o in enumerate(objs):
            n += 1
            rows.append((n, series, file, i, f"2024-01-{day:02d}", o if isinstance(o, str) or o is None else json.dumps(o)))
    df = spark.createDataFrame(rows, "line_id long, series string, source_file string, line_no int, at string, payload string")
    return df.selectExpr("line_id", "series", "source_file", "line_no", "timestamp(at) as exported_at", "payload")


def test_drift_kinds(spark):
    a = [{"query_id": f"q{i}", "query": f"text {i}", "n": i, "old": "x", "primary_candidates": [{"classes": [f"C{i}"], "file_path": "f"}]} for i in range(4)]
    b = [{"query_id": f"q{i}", "prompt": f"text {i}", "n": str(i), "fresh": i, "primary_candidates": [{"key_classes": [f"C{i}"], "file_path": "f"}]} for i in range(4)]
    df = lines(spark, [("s", "z.jsonl", 1, [*a, "# note", None, "{"]), ("s", "a.jsonl", 2, b), ("s", "b.jsonl", 3, [{"query_id": "q1", "prompt": None, "n": None, "fresh": 1}])])
    got = {(r.source_file, r.change_kind, r.field_path, r.previous_path) for r in schema_drift.changes(df.unionByName(df)).collect()}
    assert got == {
        ("a.jsonl", "renamed", "prompt", "query"), ("a.jsonl", "renamed", "primary_candidates.key_classes", "primary_candidates.classes"), ("a.jsonl", "retyped", "n", ""),
        ("a.jsonl", "removed", "old", ""), ("a.jsonl", "added", "fresh", ""), ("b.jsonl", "removed", "primary_candidates.key_classes", ""), ("b.jsonl", "removed", "primary_candidates.file_path", ""),
    }
    table = {(r.line_id, r["item"]): r for r in schema_drift.unified(df).collect()}
    named = {c for c in table[1, -1].asDict() if c in ("query", "prompt")}
    assert len(named) == 1 and table[1, -1][named.pop()] == "text 0"
    assert table[1, 0]["primary_candidates__file_path"] == "f"
    assert table[1, -1]["n"] == 0.0 or table[1, -1]["n"] == "0"


def test_flooding_decides_by_what_objects_contain(spark):
    # the moved object's value changes as a whole and its name is unlike; only the fields inside it agree
    old = [{"query_id": f"q{i}", "meta": {"owner": f"o{i}", "place": f"p{i}", "rev": i}, "keep": i} for i in range(5)]
    new = [{"query_id": f"q{i}", "origin": {"owner": f"o{i}", "place": f"p{i}", "rev": i + 1}, "metal": {"x": [i]}, "keep": i} for i in range(5)]
    df = lines(spark, [("s", "1", 1, old), ("s", "2", 2, new)])
    got = {(r.change_kind, r.field_path, r.previous_path) for r in schema_drift.changes(df).collect()}
    assert got == {("renamed", "origin", "meta"), ("added", "metal", "")}
    all_cells = schema_drift.cells(df)
    at = schema_drift.steps(df)
    nodes = [r.asDict() for r in schema_drift._correspondences(at, all_cells, schema_drift._analysis(at, all_cells)).collect()]
    start = {n["new"]: 0.2 * n["name"] + 0.8 * n["agreement"] for n in nodes if n["old"] == "meta"}
    end = {n["new"]: s for n, s in zip(nodes, schema_drift.flooded(nodes)) if n["old"] == "meta"}
    assert max(start, key=start.get) == "metal" and max(end, key=end.get) == "origin"


def test_table_keeps_every_value(spark):
    files = [
        ("s", "1", 1, [{"query_id": f"q{i}", "a": f"v{i}", "b": i, "primary_candidates": [{"x": [f"{i}", "y"], "z": f"z{i}"}]} for i in range(4)]),
        ("s", "2", 2, [{"query_id": f"q{i}", "c": f"v{i}", "b": i, "a": f"fresh{i}", "primary_candidates": {"k": [f"{i}", "y"], "x": None, "z": f"z{i}"}} for i in range(4)]),
        ("t", "3", 1, [{"query_id": f"q{i}", "c": f"w{i}", "b": "many", "d": {"e": i}} for i in range(4)]),
        ("t", "4", 2, [{"query_id": f"q{i}", "a": f"w{i}", "c": True, "b": i} for i in range(4)]),
        (None, "5", 1, [{"query_id": None, "a": "lone"}]),
    ]
    df = lines(spark, files)
    table = schema_drift.unified(df.withColumn("column", schema_drift.F.lit("clash")).unionByName(df.withColumn("column", schema_drift.F.lit("clash"))))
    fixed = ("line_id", "series", "source_file", "query_id", "item", "uncast")
    kept = sum(sum(v is not None for k, v in r.asDict().items() if k not in fixed) + len(r.uncast) for r in table.collect())
    cells = schema_drift.cells(df).where("depth = 0 and value is not null and series is not null").count()
    assert kept == cells and dict(table.dtypes)["b"] == "double"
    rows = {(r.line_id, r["item"]): r for r in table.collect()}
    assert rows[9, -1].uncast == {"b": '"many"'}


def test_table_follows_renames_inside_objects_and_keeps_every_line(spark):
    old = [{"query_id": f"q{i}", "meta": {"owner": f"o{i}", "place": f"p{i}", "rev": i}, "keep": i} for i in range(5)]
    new = [{"query_id": f"q{i}", "origin": {"owner": f"o{i}", "place": f"p{i}", "rev": i + 1}, "keep": i} for i in range(5)]
    odd = [{"query_id": "q7", "primary_candidates": [{}, "lone", None]}, {}, {"a.b": 1, "a": {"b": 2}, "Item": 3, "uncast": 4, "none": {}}]
    df = lines(spark, [("s", "1", 1, old), ("s", "2", 2, new), ("t", "3", 1, odd)])
    assert ("renamed", "origin", "meta") in {(r.change_kind, r.field_path, r.previous_path) for r in schema_drift.changes(df).collect()}
    table = schema_drift.unified(df)
    assert len({c.lower() for c in table.columns}) == len(table.columns)
    rows = {(r.line_id, r["item"]): r.asDict() for r in table.collect()}
    for name in ("owner", "place"):
        column = [c for c in table.columns if c.endswith(f"__{name}")]
        assert len(column) == 1 and all(r[column[0]] is not None for k, r in rows.items() if k[0] <= 10)
    assert set(rows) == {*((i, -1) for i in range(1, 14)), (11, 0), (11, 1)}
    assert rows[11, 1]["primary_candidates"] == "lone" and rows[11, -1]["query_id"] == "q7"
    assert sorted(map(str, (v for k, v in rows[13, -1].items() if k not in ("line_id", "series", "source_file", "query_id", "item", "uncast") and v is not None))) == ["1.0", "2.0", "3.0", "4.0", "{}"]


def test_drift_empty(spark):
    df = lines(spark, [("s", "z.jsonl", 1, ["x"])])
    assert schema_drift.changes(df).count() == 0
    assert schema_drift.changes(df.limit(0)).count() == 0
