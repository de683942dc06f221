"""Queries of the scalar text functions, over all questions, files and symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.session import first_delivery, table


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record once, with its question; the common input of the query operators."""
    return first_delivery(table(spark, sf_dir, "merged_dataset").select("record_id", "repository_id", "query_text", "category", "split", "ingested_at"), "record_id", ["ingested_at"])


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = first_delivery(table(spark, sf_dir, "source_files").select("file_id", "repository_id", "commit_sha", "path", "content", "parsed_at"), "file_id", ["parsed_at"])
    return rows.withColumn("lang", file_language(F.col("path")))


def file_language(path):
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    return F.when(ext.isin("py", "pyi"), "python").when(ext.isin("js", "mjs", "cjs"), "javascript").when(ext == "ts", "typescript").when(ext.isin("c", "h"), "c").when(ext.isin("java", "go"), ext)


def sql_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


Q_SQL = "(SELECT * FROM merged_dataset WHERE record_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY ingested_at NULLS FIRST) = 1)"
F_SQL = """(SELECT *, CASE WHEN ext IN ('py','pyi') THEN 'python' WHEN ext IN ('js','mjs','cjs') THEN 'javascript' WHEN ext = 'ts' THEN 'typescript'
 WHEN ext IN ('c','h') THEN 'c' WHEN ext IN ('java','go') THEN ext END AS lang
 FROM (SELECT *, lower(regexp_extract(path, '\\.([A-Za-z]+)$', 1)) AS ext FROM source_files WHERE file_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY parsed_at NULLS FIRST) = 1))"""
STOP_SQL = sql_list(X.STOP_WORDS)
TOKENS_SQL = f"regexp_extract_all(coalesce(query_text, ''), '{X.WORD}')"


def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions(spark, sf_dir)
    found = q.select("record_id", X.tokens(F.col("query_text")).alias("t"), X.search_tokens(F.col("query_text")).alias("s"))
    return found.select("record_id", F.array_join("t", " ").alias("tokens"), F.array_join("s", " ").alias("search_tokens"), F.array_join(X.expanded(F.col("s")), " ").alias("expanded"))


def text_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = questions(spark, sf_dir).select("record_id", F.explode(X.tokens(F.col("query_text"))).alias("token"))
    flags = [F.sum(X.has_shape(F.col("token"), s).cast("int")).alias(s) for s in X.SHAPES]
    return t.groupBy("record_id").agg(*flags, F.sum(X.looks_like_identifier(F.col("token")).cast("int")).alias("identifiers"))


def text_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, c = questions(spark, sf_dir), F.col("query_text")
    return q.select("record_id", F.array_join(X.quoted(c), "|").alias("quoted"), F.array_join(X.file_paths(c), "|").alias("paths"), F.array_join(X.symbols(c), "|").alias("symbols"), F.array_join(X.keywords(c), "|").alias("keywords"), X.language(c).alias("language"))


def text_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", X.estimated_tokens(F.col("text")).cast("long").alias("estimate"), F.length(X.collapsed(F.col("text"))).cast("long").alias("collapsed_chars"))


def import_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = files(spark, sf_dir).where("lang is not null and content is not null").select("file_id", "lang", F.explode(F.split("content", r"\n")).alias("line"))
    head = F.when(F.col("lang") == "python", F.col("line").rlike(r"^(import|from) ")).when(F.col("lang") == "c", F.col("line").rlike("^#include")).otherwise(F.col("line").rlike("^import "))
    found = lines.where(head).select("file_id", "lang", X.import_target(F.col("line"), F.col("lang")).alias("target"))
    return found.where("target is not null").withColumn("stem", X.module_stem(F.col("target"))).groupBy("file_id", "lang", "target", "stem").agg(F.count("*").alias("n"))


def module_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, f = F.col("path"), files(spark, sf_dir)
    test = F.lower(p).contains("test")
    doc = F.lower(p).contains("doc") | p.endswith(".md")
    return f.select("file_id", X.module_path(p).alias("module"), X.top_level(p).alias("top"), test.alias("is_test"), doc.alias("is_doc"), X.known_extension(p).alias("extension"))


def symbol_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = first_delivery(table(spark, sf_dir, "code_symbols").select("symbol_id", "file_id", "start_byte", "end_byte"), "symbol_id")
    span = X.byte_span(F.col("content"), F.col("start_byte"), F.col("end_byte"))
    return s.join(files(spark, sf_dir).select("file_id", "content"), "file_id").select("symbol_id", F.length(span).cast("long").alias("bytes"), F.md5(span).alias("digest"))


def query_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("record_id", X.query_id(F.coalesce("repository_id", F.lit("")), F.coalesce("query_text", F.lit(""))).alias("digest"))


QUERIES = {
    "text_tokens": text_tokens, "text_shapes": text_shapes, "text_spans": text_spans, "text_estimates": text_estimates,
    "import_targets": import_targets, "module_paths": module_paths, "symbol_spans": symbol_spans, "query_ids": query_ids,
}

_ID = "|".join(f"(?:{p})" for p in X.SHAPES.values())
_PARTS = rf"list_filter(regexp_split_to_array(t, '[_./\\]+'), lambda p: p <> '' AND p <> t AND NOT list_contains({STOP_SQL}, lower(p)))"
_EXT = sql_list(X.EXTENSIONS)
_PATH = X.FILE_PATH.replace(r"[\w.\-]", "[A-Za-z0-9_.-]")
_SUFFIX = "CASE WHEN contains({0}, '.') AND list_contains(" + _EXT + ", lower(list_last(string_split({0}, '.')))) THEN lower(list_last(string_split({0}, '.'))) END"
_DISTINCT = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_LANG = "CASE " + " ".join(f"WHEN lower(t) = '{k}' THEN '{v}'" for k, v in X.LANGUAGES.items()) + " END"
SQL = {
    "text_tokens": f"""WITH q AS (SELECT record_id, {TOKENS_SQL} AS t FROM {Q_SQL}),
 s AS (SELECT record_id, t, list_transform(list_filter(t, lambda x: NOT list_contains({STOP_SQL}, lower(x))), lambda x: lower(x)) AS s FROM q)
 SELECT record_id, array_to_string(t, ' ') AS tokens, array_to_string(s, ' ') AS search_tokens,
 array_to_string(flatten(list_transform(s, lambda t: list_concat([t], {_PARTS}))), ' ') AS expanded FROM s""",
    "text_shapes": f"""WITH t AS (SELECT record_id, unnest({TOKENS_SQL}) AS token FROM {Q_SQL})
 SELECT record_id, {", ".join(f"sum(regexp_matches(token, '{p}')::INT)::BIGINT AS {n}" for n, p in X.SHAPES.items())},
 sum(regexp_matches(token, '{_ID}')::INT)::BIGINT AS identifiers FROM t GROUP BY record_id""",
    "text_spans": f"""WITH q AS (SELECT record_id, {TOKENS_SQL} AS t, regexp_extract_all(coalesce(query_text, ''), '{X.QUOTED.replace("'", "''")}', 1) AS quoted FROM {Q_SQL}),
 p AS (SELECT *, list_filter(t, lambda t: regexp_matches(t, '{_PATH}') OR ({_SUFFIX.format("t")}) IS NOT NULL) AS paths,
 list_concat(list_filter(t, lambda t: regexp_matches(t, '{_ID}') AND NOT regexp_matches(t, '{_PATH}')), quoted) AS symbols,
 list_filter(t, lambda t: NOT list_contains({STOP_SQL}, lower(t))) AS keywords, list_filter(list_transform(t, lambda t: {_LANG}), lambda x: x IS NOT NULL) AS langs FROM q)
 SELECT record_id, array_to_string(quoted, '|') AS quoted, array_to_string({_DISTINCT.format("paths")}, '|') AS paths, array_to_string({_DISTINCT.format("symbols")}, '|') AS symbols,
 array_to_string({_DISTINCT.format("keywords")}, '|') AS keywords, langs[1] AS language FROM p""",
    "text_estimates": "SELECT doc_id, ceil(length(coalesce(text, '')) / 4.0)::BIGINT AS estimate, length(regexp_replace(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), '^ | $', '', 'g'))::BIGINT AS collapsed_chars FROM documents",
    "import_targets": f"""WITH l AS (SELECT file_id, lang, unnest(string_split(content, chr(10))) AS line FROM {F_SQL} WHERE lang IS NOT NULL AND content IS NOT NULL),
 h AS (SELECT * FROM l WHERE CASE WHEN lang = 'python' THEN regexp_matches(line, '^(import|from) ') WHEN lang = 'c' THEN regexp_matches(line, '^#include') ELSE regexp_matches(line, '^import ') END),
 t AS (SELECT file_id, lang, CASE WHEN lang = 'python' THEN coalesce(nullif(regexp_extract(line, 'from\\s+([.\\w]+)\\s+import', 1), ''), nullif(regexp_extract(line, 'import\\s+([.\\w]+)', 1), ''))
 WHEN lang IN ('javascript', 'typescript', 'go') THEN nullif(regexp_extract(line, '[''"]([^''"]+)[''"]', 1), '')
 WHEN lang = 'java' THEN nullif(regexp_extract(line, 'import\\s+(?:static\\s+)?([\\w.]+)\\s*;', 1), '')
 WHEN lang = 'c' THEN nullif(regexp_extract(line, '#include\\s*[<"]([^>"]+)[>"]', 1), '') END AS target FROM h)
 SELECT file_id, lang, target, nullif(list_last(regexp_split_to_array(regexp_replace(target, '^\\.+|\\.+$', '', 'g'), '[./\\\\:]+')), '') AS stem, count(*) AS n FROM t WHERE target IS NOT NULL GROUP BY ALL""",
    "module_paths": f"""SELECT file_id, replace(regexp_replace(regexp_replace(path, '\\.pyi?$', ''), '/__init__$', ''), '/', '.') AS module,
 CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE regexp_replace(path, '\\.[^.]*$', '') END AS top, contains(lower(path), 'test') AS is_test,
 contains(lower(path), 'doc') OR ends_with(path, '.md') AS is_doc, {_SUFFIX.format("path")} AS extension FROM {F_SQL}""",
    "symbol_spans": f"""WITH s AS (SELECT DISTINCT ON (symbol_id) symbol_id, file_id, start_byte, end_byte FROM code_symbols WHERE symbol_id IS NOT NULL ORDER BY symbol_id, file_id, start_byte, end_byte)
 SELECT symbol_id, octet_length(b)::BIGINT AS bytes, md5(b) AS digest FROM (SELECT symbol_id, CASE WHEN start_byte >= 0 AND end_byte >= start_byte THEN array_slice(encode(content), start_byte + 1, end_byte) END AS b FROM s JOIN {F_SQL} USING (file_id))""",
    "query_ids": f"SELECT record_id, substr(sha256(coalesce(repository_id, '') || chr(31) || coalesce(query_text, '')), 1, 16) AS digest FROM {Q_SQL}",
}
