"""Answers for annotation drafts: what a draft's text names is looked up, followed through the graph and searched for among all
files; and checks, comparisons and costs over whole tables. Searches take every draft whose id is divisible by 50."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.operators import dataset as D
from quarryline.operators import decide as C
from quarryline.operators import metrics as M
from quarryline.operators import retrieve as R
from quarryline.operators import stats as S
from quarryline.plans.decide import _classified, _planned_sql
from quarryline.plans.retrieve import _EDGES, _IMPORTS, S_SQL, _symbols, bm25_sql, expanded_sql, graph_edges, import_graph, search_tokens_sql, unique_name_edges
from quarryline.plans.text import _ID, _PATH, _SUFFIX, F_SQL, Q_SQL, files, questions
from quarryline.session import cut, first_delivery, table

SEARCHED = "draft_id % 50 = 0"
LISTED = 10
PRICES = {"embedding_call": 0.0001, "prompt_token": 0.000002, "completion_token": 0.000008}


def _drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_delivery(table(spark, sf_dir, "annotation_drafts").select("draft_id", "payload", "exported_at"), "draft_id", ["exported_at"])


def _file_node(file_id: Column) -> Column:
    return F.concat(F.lit("file::"), file_id.cast("string"))


def _named(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = _drafts(spark, sf_dir)
    names = d.select("draft_id", F.explode(X.symbols(F.col("payload"))).alias("name"))
    return names, d.select("draft_id", F.explode(X.file_paths(F.col("payload"))).alias("path"))


def draft_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact lookups of four forms: symbols and classes by name, files by path and by last name."""
    names, paths = _named(spark, sf_dir)
    s, f = _symbols(spark, sf_dir), files(spark, sf_dir)
    base = lambda c: F.regexp_extract(c, r"([^/]+)$", 1)
    by_name = names.join(s.select("name", "symbol_id", F.lower(F.trim("kind")).alias("kind")), "name")
    symbol = by_name.select("draft_id", F.lit("symbol").alias("form"), F.col("symbol_id").alias("target"))
    named_class = by_name.where("kind = 'class'").select("draft_id", F.lit("class").alias("form"), F.col("symbol_id").alias("target"))
    path = paths.join(f, "path").select("draft_id", F.lit("path").alias("form"), F.col("file_id").alias("target"))
    file = paths.select("draft_id", base("path").alias("b")).join(f.select("file_id", base("path").alias("b")), "b").select("draft_id", F.lit("file").alias("form"), F.col("file_id").alias("target"))
    return symbol.unionByName(named_class).unionByName(path).unionByName(file).distinct()


def graph_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, paths = _named(spark, sf_dir)
    symbols = names.join(_symbols(spark, sf_dir).select("name", F.concat(F.lit("symbol::"), F.col("symbol_id").cast("string")).alias("node")), "name").select("draft_id", "node")
    found = R.path_seeds(paths, files(spark, sf_dir).where("path is not null").select(_file_node(F.col("file_id")).alias("node"), "path"), "draft_id")
    return symbols.unionByName(found).distinct()


def graph_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest nodes of a draft's seeds, then enriched: nodes without a file, the repositories, fall out after ranking."""
    reached = R.reached_by(graph_edges(spark, sf_dir), graph_seeds(spark, sf_dir).where(SEARCHED), "draft_id", 3)
    best = reached.withColumn("rank", F.row_number().over(Window.partitionBy("draft_id").orderBy("distance", "node"))).where(F.col("rank") <= LISTED)
    f, s = files(spark, sf_dir), _symbols(spark, sf_dir)
    span = F.make_valid_utf8(X.byte_span(F.col("content"), F.col("start_byte"), F.col("end_byte")).cast("string"))
    kind = F.element_at(F.split("node", "::"), 1)
    at = F.element_at(F.split("node", "::"), 2).cast("long")
    best = best.withColumn("kind", kind).withColumn("at", F.when(kind != "repository", at))
    of_file = best.where("kind = 'file'").join(f.select(F.col("file_id").alias("at"), F.col("path").alias("file_path")), "at").select("draft_id", "rank", "node", "distance", "file_path", F.col("file_path").alias("name"), F.lit(None).cast("int").alias("start_line"), F.col("file_path").alias("content"))
    own = best.where("kind = 'symbol'").join(s.withColumnRenamed("symbol_id", "at").drop("kind"), "at").join(f.select("file_id", F.col("path").alias("file_path"), "content"), "file_id")
    of_symbol = own.select("draft_id", "rank", "node", "distance", "file_path", "name", "start_line", F.coalesce(F.nullif(span, F.lit("")), "name").alias("content"))
    return of_file.unionByName(of_symbol).select("draft_id", "rank", "node", "distance", "file_path", "name", "start_line", F.md5("content").alias("content_digest"))


def embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of which a symbol's vector is made: file, name, signature (first line), docstring and code, empty parts left out."""
    own = _symbols(spark, sf_dir).groupBy("file_id").agg(F.collect_list(F.struct("symbol_id", "name", "docstring", "start_byte", "end_byte")).alias("symbols"))
    spans = F.transform("symbols", lambda x: F.struct(x.alias("s"), F.make_valid_utf8(X.byte_span(F.col("content"), x["start_byte"], x["end_byte"]).cast("string")).alias("code")))
    rows = files(spark, sf_dir).select("file_id", "path", "content").join(own, "file_id").select("path", F.explode(spans).alias("x")).select("path", "x.s.symbol_id", "x.s.name", "x.s.docstring", "x.code")
    part = lambda label, c: F.when(F.length(c) > 0, F.concat(F.lit(label), c))
    signature = F.trim(F.regexp_extract("code", r"^([^\r\n]*)", 1))
    text = F.concat_ws("\n", part("File: ", F.col("path")), part("Symbol: ", F.col("name")), part("Signature: ", signature), part("Docstring: ", F.col("docstring")), part("Code:\n", F.col("code")))
    return rows.select("symbol_id", F.md5(text).alias("digest"), F.length(text).cast("long").alias("characters"))


# files as answers: three lists and their mixture


def _file_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _symbols(spark, sf_dir).groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_list("name")), " ").alias("names"))
    docs = files(spark, sf_dir).select("file_id", "path").join(names, "file_id", "left")
    return docs.select("file_id", X.expanded(X.search_tokens(F.concat_ws(" ", "path", "names"))).alias("tokens"))


def _searching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drafts(spark, sf_dir).where(SEARCHED).select("draft_id", X.expanded(X.search_tokens(F.col("payload"))).alias("tokens"))


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = R.hashed_arrays(_file_texts(spark, sf_dir), "file_id"), R.hashed_arrays(_searching(spark, sf_dir), "draft_id")
    return R.cosine_top_k(cut(v), cut(q), "file_id", "draft_id", LISTED).withColumnRenamed("similarity", "score")


def file_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir).select("draft_id", "file_id", F.round("score", 6).alias("score"), "rank")


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose symbols the draft names, and files at most two steps from them by imports or by owned symbols."""
    s = _symbols(spark, sf_dir)
    names = _searching(spark, sf_dir).select("draft_id", F.explode(F.array_distinct("tokens")).alias("name"))
    seeds = names.join(s.select(F.lower("name").alias("name"), F.col("file_id").alias("node")), "name").select("draft_id", "node")
    owner = s.select(F.col("symbol_id"), F.col("file_id"))
    owned = unique_name_edges(spark, sf_dir).join(owner.withColumnsRenamed({"symbol_id": "src", "file_id": "a"}), "src").join(owner.withColumnsRenamed({"symbol_id": "dst", "file_id": "b"}), "dst")
    edges = import_graph(spark, sf_dir).select("src", "dst").unionByName(owned.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    found = R.reached_by(edges, seeds.where("node is not null"), "draft_id", 2, undirected=True).withColumnRenamed("node", "file_id")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("draft_id").orderBy("distance", "file_id"))).where(F.col("rank") <= LISTED)


def file_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).select("draft_id", "file_id", "distance", F.round("score", 6).alias("score"), "rank")


def _three(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    lexical = R.bm25_lists(_file_texts(spark, sf_dir), _searching(spark, sf_dir), "file_id", "draft_id", LISTED)
    return [cut(df.select("draft_id", "file_id", "score")) for df in (lexical, _dense(spark, sf_dir), _graph(spark, sf_dir))]


def hybrid_thirds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third each of the lexical, the dense and the graph list, each normalised over the ten files that it kept."""
    mixed = R.combined([(df, 1 / 3) for df in _three(spark, sf_dir)], "draft_id", "file_id")
    return R.top_k(mixed, "draft_id", "file_id", LISTED).select("draft_id", "file_id", F.round("score", 5).alias("score"), "rank")


def plan_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the files that a draft names by path are in the pool of all three lists."""
    a, b, c = (df.select("draft_id", "file_id") for df in _three(spark, sf_dir))
    wanted = graph_seeds(spark, sf_dir).where(F.col("node").startswith("file::")).where(SEARCHED).select("draft_id", F.substring_index("node", "::", -1).cast("long").alias("file_id"))
    return M.plan_coverage(a.unionByName(b).unionByName(c), wanted, "draft_id", "file_id").withColumn("coverage", F.round("coverage", 6))


def effective_top_k(spark: SparkSession, sf_dir: str, top_k: int = 10, least: int = 5, large: int = 100) -> DataFrame:
    """Large repositories get shorter lists."""
    n = files(spark, sf_dir).where("repository_id is not null").groupBy("repository_id").agg(F.count("*").alias("files"))
    return n.withColumn("top_k", F.when(F.col("files") >= large, min(top_k, least)).otherwise(top_k))


def plan_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each question's plan would call and cost; there are no prices for questions without a repository."""
    rows = C.planned(_classified(spark, sf_dir), C.strategy())
    prices = F.when(F.col("repository_id").isNotNull(), F.create_map(*[F.lit(x) for kv in PRICES.items() for x in kv]))
    tokens = X.estimated_tokens(F.col("query_text"))
    return rows.select(
        "record_id", M.invocations(F.col("retrievers")).alias("invocations"), M.embedding_calls(F.col("retrievers")).alias("embedding_calls"),
        F.round(M.cost(M.embedding_calls(F.col("retrievers")), tokens, F.col("top_k"), prices), 9).alias("cost"),
    )


def pilot_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "merged_dataset").select("repository_id", "query_id", "query_text", "category", "split")
    return D.pilot_checks(rows, ["repository_id", "query_text"], "category")


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("day", F.dayofweek("ts"))
    return S.compared(rows, "day", "user_id", "event_type", "value", "click", "view")


def compare_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(spark, sf_dir).select("day", "pairs", *[F.round(c, 5).alias(c) for c in ("mean_a", "mean_b", "std_a", "std_b", "mean_difference", "statistic", "rank_biserial")])


def compare_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days of the week as one family, corrected together."""
    rows = S.holm(_days(spark, sf_dir).withColumn("family", F.lit("click-view")), "family", "day", "p")
    return rows.select("family", "day", "pairs", F.round("p", 6).alias("p"), F.round("threshold", 6).alias("threshold"), "rejected")


QUERIES = {
    "draft_lookup": draft_lookup, "graph_seeds": graph_seeds, "graph_answers": graph_answers, "embedding_text": embedding_text, "file_dense": file_dense, "file_graph": file_graph,
    "hybrid_thirds": hybrid_thirds, "plan_coverage": plan_coverage, "effective_top_k": effective_top_k, "plan_costs": plan_costs, "pilot_checks": pilot_checks,
    "compare_variants": compare_variants, "compare_family": compare_family,
}

_D_SQL = "(SELECT draft_id, payload FROM annotation_drafts WHERE draft_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY draft_id ORDER BY exported_at NULLS FIRST, payload NULLS FIRST) = 1)"
_BASE = "regexp_extract({0}, '([^/]+)$', 1)"
_NAMED = f"""dt AS (SELECT draft_id, regexp_extract_all(coalesce(payload, ''), '{X.WORD}') AS t, regexp_extract_all(coalesce(payload, ''), '{X.QUOTED.replace("'", "''")}', 1) AS quoted FROM {_D_SQL}),
 nm AS (SELECT DISTINCT draft_id, unnest(list_concat(list_filter(t, lambda x: regexp_matches(x, '{_ID}') AND NOT regexp_matches(x, '{_PATH}')), quoted)) AS name FROM dt),
 pt AS (SELECT DISTINCT draft_id, unnest(list_filter(t, lambda t: regexp_matches(t, '{_PATH}') OR ({_SUFFIX.format("t")}) IS NOT NULL)) AS path FROM dt), sy AS {S_SQL}, fi AS {F_SQL}"""
_SEEDS = f"""{_NAMED}, ex AS (SELECT draft_id, path, file_id FROM pt JOIN fi USING (path)),
 lo AS (SELECT draft_id, f.file_id FROM (SELECT * FROM pt ANTI JOIN ex USING (draft_id, path)) p JOIN fi f ON {_BASE.format("p.path")} = {_BASE.format("f.path")}),
 sd AS (SELECT draft_id, 'symbol::' || symbol_id AS node FROM nm JOIN sy USING (name) UNION SELECT draft_id, 'file::' || file_id FROM ex UNION SELECT draft_id, 'file::' || file_id FROM lo)"""
_SPAN = "CASE WHEN start_byte >= 0 AND end_byte >= start_byte THEN decode(array_slice(encode(content), start_byte + 1, end_byte)) END"
_DOCS = f"""nf AS (SELECT file_id, string_agg(name, ' ' ORDER BY name) AS names FROM {S_SQL} GROUP BY file_id), d AS (SELECT file_id, {expanded_sql(search_tokens_sql("concat_ws(' ', path, names)"))} AS tokens FROM {F_SQL} LEFT JOIN nf USING (file_id)),
 a AS (SELECT draft_id, {expanded_sql(search_tokens_sql("payload"))} AS tokens FROM {_D_SQL} WHERE {SEARCHED})"""


def _vectors_sql(source: str, item: str, p: str) -> str:
    return f"""{p}h AS (SELECT {item}, sha256(unnest(tokens)) AS h FROM {source}),
 {p}b AS (SELECT {item}, (('0x' || substr(h, 1, 8))::BIGINT % 128)::INT AS bucket, sum(CASE WHEN ('0x' || substr(h, 9, 2))::INT % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS s FROM {p}h GROUP BY ALL HAVING s <> 0),
 {p}v AS (SELECT {item}, list(coalesce(s, 0.0::DOUBLE) ORDER BY bucket) AS e FROM (SELECT DISTINCT {item} FROM {p}b) CROSS JOIN (SELECT unnest(range(128))::INT AS bucket) LEFT JOIN {p}b USING ({item}, bucket) GROUP BY {item})"""


_DENSE = f"""{_vectors_sql("d", "file_id", "x")}, {_vectors_sql("a", "draft_id", "y")},
 de AS (SELECT draft_id, file_id, round(list_cosine_similarity(yv.e, xv.e), 9) AS score FROM yv, xv QUALIFY row_number() OVER (PARTITION BY draft_id ORDER BY score DESC, file_id) <= {LISTED})"""
_GRAPH = f"""{_IMPORTS}, sg AS (SELECT s.*, f.repository_id FROM {S_SQL} s JOIN {F_SQL} f USING (file_id)),
 ow AS (SELECT repository_id, name AS parent, max(symbol_id) AS dst FROM sg WHERE lower(trim(kind)) = 'class' GROUP BY ALL HAVING count(*) = 1),
 ue AS (SELECT s.file_id AS src, t.file_id AS dst FROM sg s JOIN ow USING (repository_id, parent) JOIN {S_SQL} t ON t.symbol_id = ow.dst WHERE s.symbol_id <> ow.dst AND s.file_id <> t.file_id),
 ge AS (SELECT src, dst FROM im UNION SELECT src, dst FROM ue), gs AS (SELECT src, dst FROM ge UNION SELECT dst, src FROM ge),
 gd AS (SELECT DISTINCT draft_id, file_id FROM (SELECT draft_id, unnest(tokens) AS name FROM a) JOIN (SELECT lower(name) AS name, file_id FROM {S_SQL}) USING (name) WHERE file_id IS NOT NULL),
 gr AS (SELECT draft_id, file_id, 0 AS distance FROM gd UNION SELECT draft_id, dst, distance + 1 FROM gr JOIN gs ON file_id = src WHERE distance < 2),
 gm AS (SELECT draft_id, file_id, min(distance)::INT AS distance FROM gr GROUP BY ALL), gk AS (SELECT *, 1.0::DOUBLE / (1 + distance) AS score, row_number() OVER (PARTITION BY draft_id ORDER BY distance, file_id)::INT AS rank FROM gm QUALIFY rank <= {LISTED})"""
_LEXICAL = f"{bm25_sql('d', 'a', 'file_id', 'draft_id')}, le AS (SELECT draft_id, file_id, round(score, 9) AS score FROM bm QUALIFY row_number() OVER (PARTITION BY draft_id ORDER BY round(score, 9) DESC, file_id) <= {LISTED})"
_THREE = f"{_DOCS}, {_LEXICAL}, {_DENSE}, {_GRAPH}"
_NORMAL = "CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0) END"
_PAIRS = "m AS (SELECT (dayofweek(ts) + 1)::INT AS day, user_id, avg(value) FILTER (event_type = 'click') AS a, avg(value) FILTER (event_type = 'view') AS b FROM events WHERE value IS NOT NULL GROUP BY ALL HAVING a IS NOT NULL AND b IS NOT NULL)"
SQL = {
    "draft_lookup": f"""WITH {_NAMED} SELECT DISTINCT draft_id, 'symbol' AS form, symbol_id AS target FROM nm JOIN sy USING (name) UNION SELECT draft_id, 'class', symbol_id FROM nm JOIN sy USING (name) WHERE lower(trim(kind)) = 'class'
 UNION SELECT draft_id, 'path', file_id FROM pt JOIN fi USING (path) UNION SELECT draft_id, 'file', file_id FROM pt JOIN fi ON {_BASE.format("pt.path")} = {_BASE.format("fi.path")}""",
    "graph_seeds": f"WITH {_SEEDS} SELECT draft_id, node FROM sd",
    "graph_answers": f"""WITH RECURSIVE {_SEEDS}, {_EDGES}, st AS (SELECT DISTINCT src, dst FROM e),
 r AS (SELECT draft_id, node, 0 AS distance FROM sd WHERE {SEARCHED} UNION SELECT draft_id, dst, distance + 1 FROM r JOIN st ON node = src WHERE distance < 3),
 m AS (SELECT draft_id, node, min(distance)::INT AS distance FROM r GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY draft_id ORDER BY distance, node)::INT AS rank FROM m QUALIFY rank <= {LISTED})
 SELECT draft_id, rank, node, distance, path AS file_path, path AS name, NULL::INT AS start_line, md5(path) AS content_digest FROM k JOIN fi ON node = 'file::' || file_id
 UNION ALL SELECT draft_id, rank, node, distance, path, name, start_line, md5(coalesce(nullif({_SPAN}, ''), name)) FROM k JOIN sy ON node = 'symbol::' || symbol_id JOIN fi USING (file_id)""",
    "embedding_text": f"""WITH c AS (SELECT symbol_id, path, name, docstring, {_SPAN} AS code FROM {S_SQL} JOIN {F_SQL} USING (file_id)),
 t AS (SELECT symbol_id, concat_ws(chr(10), 'File: ' || nullif(path, ''), 'Symbol: ' || nullif(name, ''), 'Signature: ' || nullif(trim(regexp_extract(code, '^([^\\r\\n]*)', 1)), ''), 'Docstring: ' || nullif(docstring, ''), 'Code:' || chr(10) || nullif(code, '')) AS text FROM c)
 SELECT symbol_id, md5(text) AS digest, length(text) AS characters FROM t""",
    "file_dense": f"WITH {_DOCS}, {_DENSE} SELECT draft_id, file_id, round(score, 6) AS score, row_number() OVER (PARTITION BY draft_id ORDER BY score DESC, file_id)::INT AS rank FROM de",
    "file_graph": f"WITH RECURSIVE {_DOCS}, {_GRAPH} SELECT draft_id, file_id, distance, round(score, 6) AS score, rank FROM gk",
    "hybrid_thirds": f"""WITH RECURSIVE {_THREE}, al AS (SELECT *, 1 AS l FROM le UNION ALL SELECT *, 2 FROM de UNION ALL SELECT draft_id, file_id, score, 3 FROM gk),
 no AS (SELECT draft_id, file_id, ({_NORMAL}) / 3 AS score FROM al WINDOW w AS (PARTITION BY draft_id, l)), su AS (SELECT draft_id, file_id, round(sum(score), 9) AS score FROM no GROUP BY ALL)
 SELECT draft_id, file_id, round(score, 5) AS score, row_number() OVER (PARTITION BY draft_id ORDER BY score DESC, file_id)::INT AS rank FROM su QUALIFY rank <= {LISTED}""",
    "plan_coverage": f"""WITH RECURSIVE {_THREE}, {_SEEDS}, pool AS (SELECT draft_id, file_id FROM le UNION SELECT draft_id, file_id FROM de UNION SELECT draft_id, file_id FROM gk),
 wa AS (SELECT draft_id, substr(node, 7)::BIGINT AS file_id FROM sd WHERE node LIKE 'file::%' AND {SEARCHED}) SELECT draft_id, count(*) AS relevant, count(pool.file_id) AS covered, round(count(pool.file_id) / count(*), 6) AS coverage FROM wa LEFT JOIN pool USING (draft_id, file_id) GROUP BY draft_id""",
    "effective_top_k": f"SELECT repository_id, count(*) AS files, (CASE WHEN count(*) >= 100 THEN 5 ELSE 10 END)::INT AS top_k FROM {F_SQL} WHERE repository_id IS NOT NULL GROUP BY repository_id",
    "plan_costs": f"""WITH pl AS ({_planned_sql()}) SELECT record_id, len(string_split(retrievers, ','))::INT AS invocations, list_contains(string_split(retrievers, ','), 'dense')::INT AS embedding_calls,
 CASE WHEN repository_id IS NOT NULL THEN round(list_contains(string_split(retrievers, ','), 'dense')::INT * 0.0001::DOUBLE + ceil(length(coalesce(query_text, '')) / 4.0) * 0.000002::DOUBLE + top_k * 0.000008::DOUBLE, 9) END AS cost FROM pl JOIN {Q_SQL} USING (record_id)""",
    "pilot_checks": """WITH r AS (SELECT repository_id, query_id, query_text, category, split FROM merged_dataset),
 c AS (SELECT 'missing_values' AS "check", count(*) FILTER (repository_id IS NULL OR query_id IS NULL OR query_text IS NULL OR category IS NULL OR split IS NULL) AS violations FROM r
 UNION ALL SELECT 'duplicate_rows', coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM r GROUP BY repository_id, query_id, query_text, category, split)
 UNION ALL SELECT 'duplicate_pairs', coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM r GROUP BY repository_id, query_text, category)
 UNION ALL SELECT 'unexpected_rows', count(*) FILTER (n <> 4) FROM (SELECT count(*) AS n FROM r GROUP BY repository_id, query_text)) SELECT "check", violations, violations = 0 AS passed FROM c""",
    "compare_variants": f"""WITH {_PAIRS}, d AS (SELECT day, round(a - b, 12) AS d FROM m), r AS (SELECT day, d, rank() OVER (PARTITION BY day ORDER BY abs(d)) + (count(*) OVER (PARTITION BY day, abs(d)) - 1) / 2.0::DOUBLE AS k FROM d WHERE d <> 0),
 w AS (SELECT day, coalesce(sum(k) FILTER (d > 0), 0)::DOUBLE AS p, coalesce(sum(k) FILTER (d < 0), 0)::DOUBLE AS n FROM r GROUP BY day),
 g AS (SELECT day, count(*) AS pairs, avg(a) AS ma, avg(b) AS mb, stddev_samp(a) AS sa, stddev_samp(b) AS sb, avg(a - b) AS md FROM m GROUP BY day HAVING count(*) > 1)
 SELECT day, pairs, round(ma, 5) AS mean_a, round(mb, 5) AS mean_b, round(sa, 5) AS std_a, round(sb, 5) AS std_b, round(md, 5) AS mean_difference, round(coalesce(least(p, n), 0), 5) AS statistic, round(coalesce((p - n) / nullif(p + n, 0), 0), 5) AS rank_biserial FROM g LEFT JOIN w USING (day)""",
}
