"""Schemas that drift between the files of a series, found by similarity flooding, and one consistent table out of all.

Each file's schema is a graph: fields, the object each stands in, their types and their contents (the values of the drafts that
both files hold, or the fields of an object). A field of the file before and one of this file make a node of the similarity
graph; it starts with how alike the names are and receives, round after round, the scores of the nodes around it: the objects
they stand in, their types, what they contain. Each round shrinks the distance to the fixed point by ``FLOW``, so the scores
converge whatever the graph. Correspondences are then taken one to one, the best first, inside of objects that correspond; what
is left over was removed or added.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.functions.jsontext import canonical, parsed
from quarryline.session import cut, first_delivery

NESTED = "primary_candidates"
IDENTITY = "query_id"
FLOW = 0.8  # the share of a score that comes from around
ACCEPTED = 0.53  # with equal types and unlike names, contents that agree in more than half
SETTLED = 1e-6
PARENT, TYPE, CONTENT = 0.15, 0.15, 0.7
_JSON_TYPES = {bool: "boolean", int: "number", float: "number", str: "string", list: "array", dict: "object"}
_DOT = "\u2024"  # stands for a dot inside a key, so that no key looks like a path
_CELLS = "line_id long, series string, source_file string, draft string, item int, level string, depth int, parent string, field string, json_type string, value string"


def _below(value: dict, parent: str, depth: int) -> Iterator[tuple[int, str, str, object]]:
    """(depth, parent, path, value) of all keys, and of the keys of objects below them."""
    stack = [(depth, parent, value)]
    while stack:
        at, path, node = stack.pop()
        for key, x in node.items():
            own = key.replace(".", _DOT)
            inner = f"{path}.{own}" if path else own
            yield at, path, inner, x
            if isinstance(x, dict):
                stack.append((at + 1, inner, x))


def cells(lines: DataFrame, whole: bool = False) -> DataFrame:
    """One row per readable line, nested item and field; ``item`` is -1 for the fields of the line itself, ``value`` is
    canonical JSON. Fields of objects that are values follow with a ``depth`` above 0.

    Lines that aren't one JSON object have no rows; re-delivered lines count once; null values keep their row (the field
    is there) with a null type. Nesting may be of any depth. If ``whole``, rows of ``depth`` -1 follow for what has no field:
    lines and items that are empty (without ``field``), and items that aren't objects (under the name of the list).
    """
    names = [c.split()[0] for c in _CELLS.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for line, series, file, text in zip(batch.line_id, batch.series, batch.source_file, batch.payload):
                obj = parsed(text)
                if not isinstance(obj, dict):
                    continue
                draft = obj.get(IDENTITY)
                draft = draft if draft is None or isinstance(draft, str) else canonical(draft)
                own = {k: v for k, v in obj.items() if k not in (IDENTITY, NESTED)}
                rows.extend((line, series, file, draft, -1, "", d, p, f, _JSON_TYPES.get(type(v)), None if v is None else canonical(v)) for d, p, f, v in _below(own, "", 0))
                if whole and not own:
                    rows.append((line, series, file, draft, -1, "", -1, "", None, None, None))
                below = obj.get(NESTED)
                for i, x in enumerate(below if isinstance(below, list) else [below]):
                    if isinstance(x, dict):
                        rows.extend((line, series, file, draft, i, NESTED, d, p, f, _JSON_TYPES.get(type(v)), None if v is None else canonical(v)) for d, p, f, v in _below(x, NESTED, 0))
                    if whole and x is not None and (x == {} or not isinstance(x, dict)):
                        field, kind, value = (None, None, None) if x == {} else (NESTED, _JSON_TYPES.get(type(x)), canonical(x))
                        rows.append((line, series, file, draft, i, NESTED, -1, NESTED, field, kind, value))
            yield pd.DataFrame(rows, columns=names)

    once = first_delivery(lines.select("line_id", "series", "source_file", "exported_at", "payload"), "line_id", ["exported_at"])
    return once.select("line_id", "series", "source_file", "payload").mapInPandas(parse, _CELLS)


def steps(lines: DataFrame) -> DataFrame:
    """Every file with the file before it in its series, by time of export, ties by name. Files number far fewer than
    lines; a series' files are sorted in one task."""
    files = lines.where(F.col("source_file").isNotNull()).groupBy("series", "source_file").agg(F.min("exported_at").alias("exported_at"))
    w = Window.partitionBy("series").orderBy("exported_at", "source_file")
    return files.withColumn("before", F.lag("source_file").over(w)).withColumn("step", F.row_number().over(w))


def _similar_names(a: Column, b: Column) -> Column:
    a, b = (F.regexp_replace(F.lower(F.element_at(F.split(x, f"[.{_DOT}]"), -1)), "[^a-z0-9]", "") for x in (a, b))
    return F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def _analysis(at: DataFrame, all_cells: DataFrame) -> DataFrame:
    """Per file with a file before it: every field of either, with its types there and here (null where it isn't)."""
    fields = all_cells.groupBy("series", "source_file", "level", "depth", "parent", "field").agg(F.array_sort(F.collect_set("json_type")).alias("types"))
    fields = cut(fields)
    later = at.where("before is not null").select("series", "source_file", "before")
    new = later.select("series", "source_file").join(fields, ["series", "source_file"]).withColumnRenamed("types", "new_types")
    old = later.join(fields.withColumnsRenamed({"source_file": "before", "types": "old_types"}), ["series", "before"]).drop("before")
    return old.join(new, ["series", "source_file", "level", "depth", "parent", "field"], "full")


def _correspondences(at: DataFrame, all_cells: DataFrame, both: DataFrame) -> DataFrame:
    """The similarity graph's nodes: a field that went with one that came at the same level and depth, and each field that
    stayed with itself. ``shared`` counts the drafts and items where both have a value, ``agreement`` is the share of
    equal ones among them."""
    went, came = both.where("new_types is null"), both.where("old_types is null")
    key = ["series", "source_file", "level", "depth"]
    pairs = went.select(*key, F.col("parent").alias("old_parent"), F.col("field").alias("old"), "old_types").join(
        came.select(*key, F.col("parent").alias("new_parent"), F.col("field").alias("new"), "new_types"), key
    )
    # values travel as hashes, and only those of fields that went or came
    known = all_cells.where("value is not null and draft is not null").select("series", "source_file", "level", "depth", "draft", "item", "field", F.xxhash64("value").alias("v"))
    later = at.where("before is not null").select("series", "source_file", "before")
    was = later.join(known.withColumnRenamed("source_file", "before"), ["series", "before"]).drop("before").join(went.select(*key, "field"), [*key, "field"], "left_semi")
    now = known.join(came.select(*key, "field"), [*key, "field"], "left_semi")
    met = was.select(*key, "draft", "item", F.col("field").alias("old"), F.col("v").alias("_old")).join(now.select(*key, "draft", "item", F.col("field").alias("new"), F.col("v").alias("_new")), [*key, "draft", "item"])
    agree = met.groupBy("series", "source_file", "old", "new").agg(F.count("*").alias("shared"), F.avg((F.col("_old") == F.col("_new")).cast("double")).alias("agreement"))
    changed = pairs.join(agree, ["series", "source_file", "old", "new"], "left").fillna({"shared": 0, "agreement": 0.0}).withColumn("name", _similar_names(F.col("old"), F.col("new")))
    stayed = both.where("old_types is not null and new_types is not null").select(
        *key, F.col("parent").alias("old_parent"), F.col("parent").alias("new_parent"), F.col("field").alias("old"), F.col("field").alias("new"), "old_types", "new_types",
        F.lit(1).cast("long").alias("shared"), F.lit(1.0).alias("agreement"), F.lit(1.0).alias("name"),
    )
    return changed.unionByName(stayed)


def flooded(nodes: list[dict]) -> list[float]:
    """The scores of a file's nodes at the fixed point, in their order.

    ``nodes`` have old, new, old_parent, new_parent, old_types, new_types, name, shared and agreement. A node whose fields are
    objects contains the nodes of their fields: its content is how well these match one to one from either side; else its
    content is the agreement of values, or of names where no draft is in both files.
    """
    score = {(n["old"], n["new"]): n["name"] for n in nodes}
    inside = defaultdict(list)
    for n in nodes:
        inside[n["old_parent"], n["new_parent"]].append((n["old"], n["new"]))
    kids = {(s, p): {k for pair in inside if pair[s] == p for kid in inside[pair] for k in [kid[s]]} for pair in inside for s, p in enumerate(pair)}

    def types(n: dict) -> float:
        a, b = set(n["old_types"]), set(n["new_types"])
        return len(a & b) / len(a | b) if a and b else 0.5

    def contained(pair: tuple[str, str]) -> float | None:
        members = inside.get(pair)
        if not members:
            return None
        best: dict[tuple[int, str], float] = defaultdict(float)
        for m in members:
            for s in (0, 1):
                best[s, m[s]] = max(best[s, m[s]], score[m])
        return sum(best.values()) / (len(kids[0, pair[0]]) + len(kids[1, pair[1]]))

    roots = {p: 1.0 for p in inside if p not in score}
    while True:
        moved, now = 0.0, {}
        for p in roots:
            roots[p] = (1 - FLOW) * (p[0] == p[1]) + FLOW * (contained(p) or 0.0)
        for n in nodes:
            pair, above = (n["old"], n["new"]), (n["old_parent"], n["new_parent"])
            content = contained(pair)
            if content is None:
                content = n["agreement"] if n["shared"] else n["name"]
            elif n["shared"]:
                content = max(content, n["agreement"])
            around = PARENT * (score[above] if above in score else roots[above]) + TYPE * types(n) + CONTENT * content
            now[pair] = (1 - FLOW) * n["name"] + FLOW * around
            moved = max(moved, abs(now[pair] - score[pair]))
        score.update(now)
        if moved < SETTLED:
            return [score[n["old"], n["new"]] for n in nodes]


def _chosen(nodes: list[dict]) -> list[tuple[str, str, float]]:
    """(old, new, score) of the accepted correspondences of fields that changed their name."""
    scored = sorted(zip(flooded(nodes), nodes), key=lambda x: (-x[0], x[1]["depth"], x[1]["old"], x[1]["new"]))
    taken = {(0, n["old"]) for n in nodes if n["old"] == n["new"]} | {(1, n["new"]) for n in nodes if n["old"] == n["new"]}
    out = []
    for s, n in scored:
        a, b = (0, n["old"]), (1, n["new"])
        if n["old"] != n["new"] and s > ACCEPTED and a not in taken and b not in taken:
            taken |= {a, b}
            out.append((n["old"], n["new"], float(s)))
    fit = {(old, new) for old, new, _ in out} | {(n["old"], n["new"]) for n in nodes if n["old"] == n["new"]}
    above = {(n["old"], n["new"]): (n["old_parent"], n["new_parent"]) for n in nodes}
    return [x for x in out if above[x[:2]][0] == above[x[:2]][1] or above[x[:2]] in fit]


_NODE = ("level", "depth", "old_parent", "new_parent", "old", "new", "old_types", "new_types", "shared", "agreement", "name")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("old", T.StringType()), T.StructField("new", T.StringType()), T.StructField("score", T.DoubleType())])))
def _renamed(graphs: pd.Series) -> pd.Series:
    return pd.Series([_chosen([dict(n) for n in nodes]) for nodes in graphs])


def renames(at: DataFrame, all_cells: DataFrame, both: DataFrame) -> DataFrame:
    """``series, source_file, level, depth, old, new, score``. A file's graph is as large as its schema, not as its rows, so
    it is flooded in one piece; files are spread over the tasks."""
    nodes = _correspondences(at, all_cells, both)
    graphs = nodes.groupBy("series", "source_file").agg(F.collect_list(F.struct(*_NODE)).alias("nodes")).where(F.exists("nodes", lambda n: n["old"] != n["new"]))
    found = graphs.select("series", "source_file", F.explode(_renamed("nodes")).alias("r")).select("series", "source_file", "r.old", "r.new", "r.score")
    depths = both.where("old_types is not null").select("series", "source_file", F.col("field").alias("old"), "level", "depth")
    return found.join(depths, ["series", "source_file", "old"])


def _report(lines: DataFrame, all_cells: DataFrame) -> DataFrame:
    at = cut(steps(lines))
    both = cut(_analysis(at, all_cells))
    named = cut(renames(at, all_cells, both).where("depth = 0"))
    both = both.where("depth = 0")
    key = ["series", "source_file"]
    plain = (
        both.where("new_types is null or old_types is null")
        .withColumn("change_kind", F.when(F.col("new_types").isNull(), "removed").otherwise("added"))
        .join(named.select(*key, F.col("old").alias("field"), F.lit("removed").alias("change_kind")).unionByName(named.select(*key, F.col("new").alias("field"), F.lit("added").alias("change_kind"))), [*key, "field", "change_kind"], "left_anti")
        .select(*key, "change_kind", F.col("field").alias("field_path"), F.lit("").alias("previous_path"))
    )
    moved = named.select(*key, F.lit("renamed").alias("change_kind"), F.col("new").alias("field_path"), F.col("old").alias("previous_path"))
    typed = both.where("size(old_types) > 0 and size(new_types) > 0 and old_types <> new_types")
    typed = typed.select(*key, F.lit("retyped").alias("change_kind"), F.col("field").alias("field_path"), F.lit("").alias("previous_path"))
    ends = both.select(*key, F.col("field"), "old_types", "new_types")
    turned = (
        named.join(ends.select(*key, F.col("field").alias("old"), "old_types"), [*key, "old"])
        .join(ends.select(*key, F.col("field").alias("new"), "new_types"), [*key, "new"])
        .where("size(old_types) > 0 and size(new_types) > 0 and old_types <> new_types")
        .select(*key, F.lit("retyped").alias("change_kind"), F.col("new").alias("field_path"), F.lit("").alias("previous_path"))
    )
    return plain.unionByName(moved).unionByName(typed).unionByName(turned)


def changes(lines: DataFrame) -> DataFrame:
    """The changes of each file against the one before it: ``series, source_file, change_kind, field_path, previous_path``.

    Null file names or identities are left aside; a file without readable lines counts as a file without fields; empty
    input gives no rows.
    """
    found = _report(lines, cut(cells(lines)))
    return found.withColumns({c: F.translate(c, _DOT, ".") for c in ("field_path", "previous_path")})


def _families(pairs: list, apart: set[frozenset], seen: dict[str, int]) -> dict[str, str]:
    """The field names that renames connect, strongest first, by the most frequent of them; two names that stand in one file
    never come together."""
    root = {f: f for f in seen}
    members = {f: {f} for f in seen}
    for r in sorted(pairs, key=lambda r: (-r["n"], r["a"], r["b"])):
        if r["a"] not in root or r["b"] not in root or root[r["a"]] == root[r["b"]]:
            continue
        a, b = sorted((root[r["a"]], root[r["b"]]), key=lambda f: (-seen[f], f))
        if any(frozenset((x, y)) in apart for x in members[a] for y in members[b]):
            continue
        for f in members.pop(b):
            root[f] = a
            members[a].add(f)
    return root


def _columns_of_series(rows: list[dict], family: dict[str, str]) -> list[tuple[str, str, str]]:
    """(source_file, field, column) for the fields of one series, ``rows`` with step, source_file, field, previous and n.

    A field that is renamed keeps its column through the series. The column is the family of most of its cells, unless another
    field has it in one of the same files; then its own name, or that with a number."""
    lineage: dict[tuple[int, str], int] = {}
    where: dict[int, list[dict]] = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["step"], r["field"])):
        at = lineage.get((r["step"] - 1, r["previous"] or r["field"]))
        if at is None:
            at = len(where)
        lineage[r["step"], r["field"]] = at
        where[at].append(r)
    held: dict[str, set[int]] = defaultdict(set)
    out = []
    for own in sorted(where.values(), key=lambda own: (-sum(r["n"] for r in own), own[0]["field"])):
        files, votes = {r["step"] for r in own}, Counter()
        for r in own:
            votes[family[r["field"]]] += r["n"]
        wanted = [f for f, _ in sorted(votes.items(), key=lambda v: (-v[1], v[0]))] + sorted({r["field"] for r in own})
        column = next((f for f in wanted if not held[f] & files), None)
        number = 2
        while column is None:
            column = f"{wanted[0]}_{number}" if not held[f"{wanted[0]}_{number}"] & files else None
            number += 1
        held[column] |= files
        out.extend((r["source_file"], r["field"], column) for r in own)
    return out


def columns(at: DataFrame, all_cells: DataFrame, renamed: DataFrame) -> DataFrame:
    """``series, source_file, field, column``, for ``renamed`` with series, source_file, old and new: no two fields of a file
    share a column. Names of fields go to the driver, never rows; a series' fields are resolved in one task."""
    counts = cut(all_cells.where("field is not null").groupBy("series", "source_file", "level", "field").agg(F.count("*").alias("n")))
    seen = {r["field"]: r["n"] for r in counts.groupBy("field").agg(F.sum("n").alias("n")).collect()}
    pairs = renamed.groupBy(F.col("new").alias("a"), F.col("old").alias("b")).agg(F.count("*").alias("n")).collect()
    a, b = counts.select("series", "source_file", "level", F.col("field").alias("a")), counts.select("series", "source_file", "level", F.col("field").alias("b"))
    apart = {frozenset((r["a"], r["b"])) for r in a.join(b, ["series", "source_file", "level"]).where("a < b").select("a", "b").distinct().collect()}
    family = _families(pairs, apart, seen)
    previous = renamed.select("series", "source_file", F.col("new").alias("field"), F.col("old").alias("previous"))
    rows = counts.join(at.select("series", "source_file", "step"), ["series", "source_file"]).join(previous, ["series", "source_file", "field"], "left")
    gathered = rows.groupBy("series").agg(F.collect_list(F.struct("step", "source_file", "field", "previous", "n")).alias("rows"))

    @F.pandas_udf("array<struct<source_file:string,field:string,column:string>>")
    def resolve(series: pd.Series) -> pd.Series:
        return pd.Series([_columns_of_series([dict(r) for r in rows], family) for rows in series])

    return gathered.select("series", F.explode(resolve("rows")).alias("c")).select("series", "c.source_file", "c.field", "c.column")


def _cast(value: Column, kind: Column, to: str) -> Column:
    """A JSON value as the column's type; null where it can't be."""
    plain = F.when(kind == "string", F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>")[0]).otherwise(value)
    if to == "number":
        return F.when(kind != "boolean", plain.try_cast("double"))
    if to == "boolean":
        return F.when(kind.isin("boolean", "string"), plain.try_cast("boolean"))
    if to == "array":
        return F.when(kind == "array", F.from_json(value, "array<string>")).when(kind.isNotNull(), F.array(plain))
    return F.when(kind == "array", F.array_join(F.from_json(value, "array<string>"), ", ")).otherwise(plain)


def _labels(paths: list[str], taken: list[str]) -> list[str]:
    """A column name per path, other than ``taken`` and each other in any case of letters."""
    used, out = {t.lower() for t in taken}, []
    for path in paths:
        plain = path.replace(".", "__").replace(_DOT, "__")
        label, number = plain, 2
        while label.lower() in used:
            label, number = f"{plain}_{number}", number + 1
        used.add(label.lower())
        out.append(label)
    return out


def unified(lines: DataFrame) -> DataFrame:
    """All lines in one table: a row per line and nested item (-1 for the line itself), a column per consistent field.

    Fields inside of objects have columns of their own, and all columns follow the same correspondences as ``changes``. A
    column has the JSON type of most of its values: double, boolean, array of texts, else text. A value that can't be cast is
    null there and stands as JSON in ``uncast``, a map by path; lists joined with commas become text columns. Two fields of
    one line never share a column, so no value is lost. Lines and items without fields keep their row, items that aren't
    objects stand under the name of the list. Lines without a series or a file are left aside.
    """
    return _united(lines, cut(cells(lines, whole=True)))


def _united(lines: DataFrame, all_cells: DataFrame) -> DataFrame:
    order = cut(steps(lines))
    fields = all_cells.where("depth >= 0")
    renamed = cut(renames(order, fields, cut(_analysis(order, fields))).select("series", "source_file", "old", "new").distinct())
    leaves = all_cells.where("json_type is null or json_type <> 'object' or value = '{}'")  # an object is what its fields hold
    at = order.select("series", "source_file", "step")
    bare = leaves.where("field is null and series is not null and source_file is not null").withColumn("column", F.lit(None).cast("string"))
    known = leaves.join(columns(at, leaves, renamed), ["series", "source_file", "field"])
    named = cut(known.unionByName(bare))
    kinds: dict[str, Counter] = defaultdict(Counter)
    for r in named.where("json_type is not null").groupBy("column", "json_type").agg(F.count("*").alias("n")).collect():  # names times types
        kinds[r["column"]][r["json_type"]] = r["n"]
    every = sorted(r["column"] for r in named.where("column is not null").select("column").distinct().collect())
    target = {c: max(sorted(kinds[c]), key=lambda t: kinds[c][t]) if kinds[c] else "string" for c in every}
    target = {c: "string" if t == "object" else t for c, t in target.items()}
    cell = F.struct(F.col("value").alias("value"), F.col("json_type").alias("kind"))
    held = named.groupBy("line_id", "series", "source_file", F.col("draft").alias(IDENTITY), "item").agg(
        *[F.max(F.when(F.col("column") == c, cell)).alias(f"_{i}") for i, c in enumerate(every)]
    )
    made = [_cast(F.col(f"_{i}.value"), F.col(f"_{i}.kind"), target[c]) for i, c in enumerate(every)]
    failed = [F.when(F.col(f"_{i}.value").isNotNull() & m.isNull(), F.struct(F.lit(c).alias("key"), F.col(f"_{i}.value").alias("value"))) for i, (c, m) in enumerate(zip(every, made))]
    uncast = F.map_from_entries(F.array_compact(F.array(*failed))) if failed else F.create_map().cast("map<string,string>")
    fixed = ["line_id", "series", "source_file", IDENTITY, "item"]
    return held.select(*fixed, *[m.alias(c) for c, m in zip(_labels(every, [*fixed, "uncast"]), made)], uncast.alias("uncast"))
