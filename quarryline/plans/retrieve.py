"""Retrieval queries. Searches take every question (or vector) whose id is divisible by 50, against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.operators import retrieve as R
from quarryline.plans.text import F_SQL, Q_SQL, STOP_SQL, TOKENS_SQL, _ID, _PARTS, _PATH, files, questions
from quarryline.session import first_delivery, table

SEARCHED = "record_id % 50 = 0"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).where(SEARCHED)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.search_tokens(F.col("text")).alias("tokens"))


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_delivery(table(spark, sf_dir, "code_symbols"), "symbol_id")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _asked(spark, sf_dir).select("record_id", X.search_tokens(F.col("query_text")).alias("tokens"))
    found = R.bm25_lists(_documents(spark, sf_dir), asked, "doc_id", "record_id", 10)
    return found.select("record_id", "doc_id", F.round("score", 6).alias("score"), F.round("normalised", 6).alias("normalised"), "rank")


def field_weighted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _symbols(spark, sf_dir)
    asked = _asked(spark, sf_dir).select("record_id", X.expanded(X.search_tokens(F.col("query_text"))).alias("tokens"))
    # a file's spans are gathered first, so its content is read once and never shuffled per symbol
    own = s.groupBy("file_id").agg(F.collect_list(F.struct("symbol_id", "start_byte", "end_byte")).alias("spans"))
    cuts = F.transform("spans", lambda x: F.struct(x["symbol_id"].alias("symbol_id"), F.make_valid_utf8(X.byte_span(F.col("content"), x["start_byte"], x["end_byte"]).cast("string")).alias("span")))
    spans = files(spark, sf_dir).select("file_id", "content").join(own, "file_id").select(F.explode(cuts).alias("x"))
    spans = spans.select("x.symbol_id", X.expanded(X.search_tokens(F.col("x.span"))).alias("tokens"))
    fields = {
        "name": s.select("symbol_id", X.expanded(X.search_tokens(F.col("name"))).alias("tokens")),
        "docstring": s.where("docstring is not null").select("symbol_id", X.expanded(X.search_tokens(F.col("docstring"))).alias("tokens")),
        "source": spans,
    }
    found = R.field_search(fields, asked, "symbol_id", "record_id", 10)
    return found.select("record_id", "symbol_id", F.round("score", 5).alias("score"), "matched_field", "rank")


def exact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = questions(spark, sf_dir).select("record_id", F.explode(X.symbols(F.col("query_text"))).alias("name"))
    return named.join(_symbols(spark, sf_dir).select("symbol_id", "name"), "name").select("record_id", "symbol_id", "name", F.lit(1.0).alias("score"))


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = R.cosine_top_k(v, asked, "vec_id", "query_id", 10)
    return found.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions(spark, sf_dir).select("record_id", X.search_tokens(F.col("query_text")).alias("tokens"))
    return R.hashed_vectors(q, "record_id").select("record_id", "bucket", F.round("value", 6).alias("value"))


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, s = files(spark, sf_dir), _symbols(spark, sf_dir)
    kind = F.lower(F.trim("kind"))
    repo = f.where("repository_id is not null").select(F.concat(F.lit("repository::"), F.col("repository_id")).alias("node"), F.lit("repository").alias("type")).distinct()
    file = f.select(F.concat(F.lit("file::"), F.col("file_id").cast("string")).alias("node"), F.lit("file").alias("type"))
    symbol = s.select(F.concat(F.lit("symbol::"), F.col("symbol_id").cast("string")).alias("node"), kind.alias("type"))
    return repo.unionByName(file).unionByName(symbol)


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repository contains file, file defines symbol, class contains method (the last class of that name in the file)."""
    f, s = files(spark, sf_dir), _symbols(spark, sf_dir)
    file_node, symbol_node = F.concat(F.lit("file::"), F.col("file_id").cast("string")), F.concat(F.lit("symbol::"), F.col("symbol_id").cast("string"))
    contains = f.where("repository_id is not null").select(F.concat(F.lit("repository::"), F.col("repository_id")).alias("src"), file_node.alias("dst"), F.lit("contains").alias("relation"))
    defines = s.join(f.select("file_id"), "file_id", "left_semi").select(file_node.alias("src"), symbol_node.alias("dst"), F.lit("defines").alias("relation"))
    classes = s.where(F.lower(F.trim("kind")) == "class").groupBy("file_id", F.col("name").alias("parent")).agg(F.max("symbol_id").alias("owner"))
    owned = s.join(classes, ["file_id", "parent"]).where("owner <> symbol_id").select(F.concat(F.lit("symbol::"), F.col("owner").cast("string")).alias("src"), symbol_node.alias("dst"), F.lit("contains").alias("relation"))
    return contains.unionByName(defines).unionByName(owned)


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where("file_id % 50 = 0").select(F.concat(F.lit("file::"), F.col("file_id").cast("string")).alias("node"))


def bfs_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.reached(graph_edges(spark, sf_dir), _seeds(spark, sf_dir)).select("node", "distance", F.round("score", 6).alias("score"))


def bfs_undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.reached(graph_edges(spark, sf_dir), _seeds(spark, sf_dir), undirected=True).select("node", "distance", F.round("score", 6).alias("score"))


def import_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File to file of the same repository, by the stem of what is imported; of several files with a stem the last wins."""
    f = files(spark, sf_dir).where("lang is not null and content is not null and repository_id is not null")
    lines = f.select("file_id", "repository_id", "lang", F.explode(F.split("content", r"\n")).alias("line")).where(F.col("line").rlike("^(import|from|#include) ?"))
    stems = lines.select("file_id", "repository_id", "lang", X.module_stem(X.import_target(F.col("line"), F.col("lang"))).alias("stem")).where("stem is not null").distinct()
    own = f.groupBy("repository_id", F.regexp_extract("path", r"([^/]+?)\.[^./]*$", 1).alias("stem")).agg(F.max("file_id").alias("target"))
    return stems.join(own, ["repository_id", "stem"]).where("file_id <> target").select("repository_id", F.col("file_id").alias("src"), F.col("target").alias("dst")).distinct()


def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = files(spark, sf_dir).select(F.col("file_id").alias("node"))
    return R.components(import_graph(spark, sf_dir).select("src", "dst"), nodes).select("node", "component")


def identifier_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per question and file, the symbols whose name stands in the question, whatever the case."""
    asked = questions(spark, sf_dir).select("record_id", F.explode(F.array_distinct(X.search_tokens(F.col("query_text")))).alias("name"))
    s = _symbols(spark, sf_dir).select("file_id", F.lower("name").alias("name"))
    return asked.join(s, "name").groupBy("record_id", "file_id").agg(F.count("*").alias("matches"))


def unique_name_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol to the class that its parent names, if that name is unique in the repository."""
    s = _symbols(spark, sf_dir).join(files(spark, sf_dir).select("file_id", "repository_id"), "file_id")
    once = s.where(F.lower(F.trim("kind")) == "class").groupBy("repository_id", F.col("name").alias("parent")).agg(F.count("*").alias("n"), F.max("symbol_id").alias("dst")).where("n = 1")
    return s.join(once, ["repository_id", "parent"]).where("symbol_id <> dst").select(F.col("symbol_id").alias("src"), "dst")


def hybrid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half BM25 over the names in a file, three tenths names that stand in the question, two tenths words in common."""
    asked = _asked(spark, sf_dir).select("record_id", X.search_tokens(F.col("query_text")).alias("tokens"))
    docs = files(spark, sf_dir).select("file_id", "path").join(_symbols(spark, sf_dir).groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_list("name")), " ").alias("names")), "file_id", "left")
    docs = docs.select("file_id", X.expanded(X.search_tokens(F.concat_ws(" ", "path", "names"))).alias("tokens"))
    lexical = R.bm25(docs, asked, "file_id", "record_id").withColumn("score", F.round("score", 9))
    hits = identifier_match(spark, sf_dir).where(SEARCHED).select("record_id", "file_id", F.col("matches").cast("double").alias("score"))
    words = asked.select("record_id", F.size(F.array_distinct("tokens")).alias("n"), F.explode(F.array_distinct("tokens")).alias("w"))
    shared = words.join(docs.select("file_id", F.explode(F.array_distinct("tokens")).alias("w")), "w").groupBy("record_id", "file_id", "n").agg((F.count("*") / F.first("n")).alias("score")).drop("n")
    found = R.top_k(R.combined([(lexical, 0.5), (hits, 0.3), (shared, 0.2)], "record_id", "file_id"), "record_id", "file_id", 10)
    return found.select("record_id", "file_id", F.round("score", 5).alias("score"), "rank")


QUERIES = {
    "bm25_topk": bm25_topk, "field_weighted_search": field_weighted_search, "exact_lookup": exact_lookup, "dense_topk": dense_topk, "hash_embedding": hash_embedding,
    "graph_nodes": graph_nodes, "graph_edges": graph_edges, "bfs_directed": bfs_directed, "bfs_undirected": bfs_undirected, "import_graph": import_graph,
    "connected_components": connected_components, "identifier_match": identifier_match, "unique_name_edges": unique_name_edges, "hybrid_scores": hybrid_scores,
}


def search_tokens_sql(text: str) -> str:
    return f"list_transform(list_filter(regexp_extract_all(coalesce({text}, ''), '{X.WORD}'), lambda x: NOT list_contains({STOP_SQL}, lower(x))), lambda x: lower(x))"


def expanded_sql(tokens: str) -> str:
    return f"flatten(list_transform({tokens}, lambda t: list_concat([t], {_PARTS})))"


def bm25_sql(docs: str, asked: str, item: str, query: str, p: str = "") -> str:
    """CTEs that end in ``{p}bm(query, item, score)``, of relations with ``tokens``."""
    return f"""{p}dl AS (SELECT {item}, len(tokens) AS length, tokens FROM {docs}), {p}st AS (SELECT count(*)::DOUBLE AS n, avg(length) AS mean FROM {p}dl),
 {p}qt AS (SELECT {query}, term, count(*) AS qtf FROM (SELECT {query}, unnest(tokens) AS term FROM {asked}) GROUP BY ALL),
 {p}po AS (SELECT {item}, length, term, count(*) AS tf FROM (SELECT {item}, length, unnest(tokens) AS term FROM {p}dl) GROUP BY ALL),
 {p}df AS (SELECT term, count(*) AS df FROM {p}po GROUP BY term),
 {p}bm AS (SELECT {query}, {item}, sum(qtf * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))) AS score FROM {p}qt JOIN {p}df USING (term) JOIN {p}po USING (term), {p}st GROUP BY ALL)"""


S_SQL = "(SELECT * FROM code_symbols WHERE symbol_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY file_id, name, kind, start_line) = 1)"
_EDGES = f"""e AS (SELECT 'repository::' || repository_id AS src, 'file::' || file_id AS dst, 'contains' AS relation FROM {F_SQL} WHERE repository_id IS NOT NULL
 UNION ALL SELECT 'file::' || file_id, 'symbol::' || symbol_id, 'defines' FROM {S_SQL} WHERE file_id IN (SELECT file_id FROM {F_SQL})
 UNION ALL SELECT 'symbol::' || owner, 'symbol::' || symbol_id, 'contains' FROM {S_SQL} s JOIN (SELECT file_id, name AS parent, max(symbol_id) AS owner FROM {S_SQL} WHERE lower(trim(kind)) = 'class' GROUP BY ALL) USING (file_id, parent) WHERE owner <> symbol_id)"""


def _bfs_sql(both: str) -> str:
    return f"""WITH RECURSIVE {_EDGES}, st AS ({both}),
 r AS (SELECT 'file::' || file_id AS node, 0 AS distance FROM {F_SQL} WHERE file_id % 50 = 0 UNION SELECT dst, distance + 1 FROM r JOIN st ON node = src WHERE distance < 3)
 SELECT node, min(distance)::INT AS distance, round(1.0::DOUBLE / (1 + min(distance)), 6) AS score FROM r GROUP BY node"""


_IMPORTS = f"""f AS (SELECT * FROM {F_SQL} WHERE lang IS NOT NULL AND content IS NOT NULL AND repository_id IS NOT NULL),
 l AS (SELECT * FROM (SELECT file_id, repository_id, lang, unnest(string_split(content, chr(10))) AS line FROM f) WHERE regexp_matches(line, '^(import|from|#include) ?')),
 t AS (SELECT file_id, repository_id, CASE WHEN lang = 'python' THEN coalesce(nullif(regexp_extract(line, 'from\\s+([.\\w]+)\\s+import', 1), ''), nullif(regexp_extract(line, 'import\\s+([.\\w]+)', 1), ''))
 WHEN lang IN ('javascript', 'typescript', 'go') THEN nullif(regexp_extract(line, '[''"]([^''"]+)[''"]', 1), '') WHEN lang = 'java' THEN nullif(regexp_extract(line, 'import\\s+(?:static\\s+)?([\\w.]+)\\s*;', 1), '')
 WHEN lang = 'c' THEN nullif(regexp_extract(line, '#include\\s*[<"]([^>"]+)[>"]', 1), '') END AS target FROM l),
 m AS (SELECT DISTINCT file_id, repository_id, nullif(list_last(regexp_split_to_array(regexp_replace(target, '^\\.+|\\.+$', '', 'g'), '[./\\\\:]+')), '') AS stem FROM t WHERE target IS NOT NULL),
 o AS (SELECT repository_id, regexp_extract(path, '([^/]+?)\\.[^./]*$', 1) AS stem, max(file_id) AS dst FROM f GROUP BY ALL),
 im AS (SELECT DISTINCT m.repository_id, file_id AS src, dst FROM m JOIN o USING (repository_id, stem) WHERE file_id <> dst)"""
_SQ = search_tokens_sql("query_text")
_ASKED = f"SELECT record_id, {_SQ} AS tokens FROM {Q_SQL} WHERE {SEARCHED}"
_NORM = "CASE WHEN max({0}) OVER w = min({0}) OVER w THEN 1.0 ELSE ({0} - min({0}) OVER w) / nullif(max({0}) OVER w - min({0}) OVER w, 0) END"
_MATCH = f"SELECT record_id, file_id, count(*) AS matches FROM (SELECT record_id, unnest(list_distinct({_SQ})) AS name FROM {Q_SQL}) JOIN (SELECT file_id, lower(name) AS name FROM {S_SQL}) USING (name) GROUP BY ALL"
SQL = {
    "bm25_topk": f"""WITH d AS (SELECT doc_id, {search_tokens_sql("text")} AS tokens FROM documents), a AS ({_ASKED}), {bm25_sql("d", "a", "doc_id", "record_id")},
 s AS (SELECT record_id, doc_id, round(score, 9) AS score FROM bm), n AS (SELECT *, {_NORM.format("score")} AS normalised, row_number() OVER (PARTITION BY record_id ORDER BY score DESC, doc_id) AS rank FROM s WINDOW w AS (PARTITION BY record_id))
 SELECT record_id, doc_id, round(score, 6) AS score, round(normalised, 6) AS normalised, rank::INT AS rank FROM n WHERE rank <= 10""",
    "field_weighted_search": f"""WITH s AS {S_SQL}, a AS (SELECT record_id, {expanded_sql(_SQ)} AS tokens FROM {Q_SQL} WHERE {SEARCHED}),
 d1 AS (SELECT symbol_id, {expanded_sql(search_tokens_sql("name"))} AS tokens FROM s), d2 AS (SELECT symbol_id, {expanded_sql(search_tokens_sql("docstring"))} AS tokens FROM s WHERE docstring IS NOT NULL),
 d3 AS (SELECT symbol_id, {expanded_sql(search_tokens_sql("span"))} AS tokens FROM (SELECT symbol_id, CASE WHEN start_byte >= 0 AND end_byte >= start_byte THEN decode(array_slice(encode(content), start_byte + 1, end_byte)) END AS span FROM s JOIN {F_SQL} USING (file_id))),
 {bm25_sql("d1", "a", "symbol_id", "record_id", "n")}, {bm25_sql("d2", "a", "symbol_id", "record_id", "d")}, {bm25_sql("d3", "a", "symbol_id", "record_id", "s")},
 u AS (SELECT record_id, symbol_id, round(3.0 * score, 9) AS n, 0.0::DOUBLE AS d, 0.0::DOUBLE AS s FROM nbm UNION ALL SELECT record_id, symbol_id, 0, round(2.0 * score, 9), 0 FROM dbm UNION ALL SELECT record_id, symbol_id, 0, 0, round(score, 9) FROM sbm),
 g AS (SELECT record_id, symbol_id, sum(n) AS n, sum(d) AS d, sum(s) AS s FROM u GROUP BY ALL),
 r AS (SELECT record_id, symbol_id, round(n + d + s, 9) AS score, CASE WHEN n = greatest(n, d, s) THEN 'name' WHEN d = greatest(n, d, s) THEN 'docstring' ELSE 'source' END AS matched_field FROM g),
 k AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY score DESC, symbol_id) AS rank FROM r)
 SELECT record_id, symbol_id, round(score, 5) AS score, matched_field, rank::INT AS rank FROM k WHERE rank <= 10""",
    "exact_lookup": f"""WITH t AS (SELECT record_id, {TOKENS_SQL} AS t, regexp_extract_all(coalesce(query_text, ''), '{X.QUOTED.replace("'", "''")}', 1) AS quoted FROM {Q_SQL}),
 n AS (SELECT DISTINCT record_id, unnest(list_concat(list_filter(t, lambda x: regexp_matches(x, '{_ID}') AND NOT regexp_matches(x, '{_PATH}')), quoted)) AS name FROM t)
 SELECT record_id, symbol_id, name, 1.0::DOUBLE AS score FROM n JOIN {S_SQL} USING (name)""",
    "dense_topk": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
 s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 9) AS similarity FROM v q, v WHERE q.vec_id % 50 = 0),
 k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, round(similarity, 6) AS similarity, rank::INT AS rank FROM k WHERE rank <= 10""",
    "hash_embedding": f"""WITH t AS (SELECT record_id, sha256(unnest({_SQ})) AS h FROM {Q_SQL}),
 b AS (SELECT record_id, (('0x' || substr(h, 1, 8))::BIGINT % 128)::INT AS bucket, sum(CASE WHEN ('0x' || substr(h, 9, 2))::INT % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS s FROM t GROUP BY ALL HAVING s <> 0)
 SELECT record_id, bucket, round(s / sqrt(sum(s * s) OVER (PARTITION BY record_id)), 6) AS value FROM b""",
    "graph_nodes": f"SELECT DISTINCT 'repository::' || repository_id AS node, 'repository' AS type FROM {F_SQL} WHERE repository_id IS NOT NULL UNION ALL SELECT 'file::' || file_id, 'file' FROM {F_SQL} UNION ALL SELECT 'symbol::' || symbol_id, lower(trim(kind)) FROM {S_SQL}",
    "graph_edges": f"WITH {_EDGES} SELECT * FROM e",
    "bfs_directed": _bfs_sql("SELECT DISTINCT src, dst FROM e"),
    "bfs_undirected": _bfs_sql("SELECT src, dst FROM e UNION SELECT dst, src FROM e"),
    "import_graph": f"WITH {_IMPORTS} SELECT * FROM im",
    "connected_components": f"""WITH RECURSIVE {_IMPORTS}, st AS (SELECT src, dst FROM im UNION SELECT dst, src FROM im),
 r AS (SELECT file_id AS node, file_id AS other FROM {F_SQL} UNION SELECT r.node, st.dst FROM r JOIN st ON r.other = st.src) SELECT node, min(other) AS component FROM r GROUP BY node""",
    "identifier_match": _MATCH,
    "unique_name_edges": f"""WITH s AS (SELECT s.*, f.repository_id FROM {S_SQL} s JOIN {F_SQL} f USING (file_id)),
 o AS (SELECT repository_id, name AS parent, max(symbol_id) AS dst FROM s WHERE lower(trim(kind)) = 'class' GROUP BY ALL HAVING count(*) = 1) SELECT symbol_id AS src, dst FROM s JOIN o USING (repository_id, parent) WHERE symbol_id <> dst""",
    "hybrid_scores": f"""WITH a AS ({_ASKED}), nm AS (SELECT file_id, string_agg(name, ' ' ORDER BY name) AS names FROM {S_SQL} GROUP BY file_id),
 d AS (SELECT file_id, {expanded_sql(search_tokens_sql("concat_ws(' ', path, names)"))} AS tokens FROM {F_SQL} LEFT JOIN nm USING (file_id)), {bm25_sql("d", "a", "file_id", "record_id")},
 x AS (SELECT record_id, file_id, round(score, 9) AS score, 0.5::DOUBLE AS wt, 1 AS k FROM bm UNION ALL SELECT record_id, file_id, matches::DOUBLE, 0.3, 2 FROM ({_MATCH}) WHERE {SEARCHED}
 UNION ALL SELECT record_id, file_id, count(*)::DOUBLE / n, 0.2, 3 FROM (SELECT record_id, len(list_distinct(tokens)) AS n, unnest(list_distinct(tokens)) AS w FROM a) JOIN (SELECT file_id, unnest(list_distinct(tokens)) AS w FROM d) USING (w) GROUP BY record_id, file_id, n),
 y AS (SELECT record_id, file_id, wt * ({_NORM.format("score")}) AS score FROM x WINDOW w AS (PARTITION BY record_id, k)), z AS (SELECT record_id, file_id, round(sum(score), 9) AS score FROM y GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY score DESC, file_id) AS rank FROM z) SELECT record_id, file_id, round(score, 5) AS score, rank::INT AS rank FROM r WHERE rank <= 10""",
}
