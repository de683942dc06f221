"""Dataset queries over all questions, candidates, files and repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.operators import dataset as D
from quarryline.plans.retrieve import S_SQL, _symbols, search_tokens_sql
from quarryline.plans.text import F_SQL, Q_SQL, TOKENS_SQL, _ID, _PATH, files, questions
from quarryline.session import first_delivery, table


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_delivery(table(spark, sf_dir, "merged_dataset"), "record_id", ["ingested_at"])


def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = D.hash_fraction(F.lit("42"), F.coalesce("repository_id", F.lit("")), F.coalesce("query_text", F.lit("")))
    return questions(spark, sf_dir).select("record_id", F.round(f, 9).alias("fraction"), D.hash_split(f).alias("assigned"))


def flat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.flat(_records(spark, sf_dir), "candidates", "record_id").select("record_id", "place", "file", "grade", "reason")


def grouped_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.grouped(D.flat(_records(spark, sf_dir), "candidates", "record_id"), ["record_id"], "place", "file", "grade")
    return rows.select("record_id", "n", F.get_json_object("rows", "$[0].file").alias("first_file"), F.get_json_object("rows", "$[0].grade").alias("first_grade"))


def current_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "merged_dataset").where("record_id is not null").select("record_id", "ingested_at", "split")
    return D.current(rows, "record_id", "ingested_at")


def checkpoint_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of repositories none of whose files were parsed."""
    done = files(spark, sf_dir).where("repository_id is not null").select("repository_id", "commit_sha").distinct()
    todo = questions(spark, sf_dir).where("repository_id is not null").select("record_id", "repository_id")
    return D.pending(todo, done, ["repository_id"], F.length("commit_sha") != 40)


def validation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = {
        "question missing": F.length(F.trim("query_text")) > 0, "split missing": F.col("split").isNotNull(), "repository missing": F.col("repository_id").isNotNull(),
        "no candidates": F.size("candidates") > 0, "grade missing": F.exists("candidates", lambda c: c["grade"].rlike("^[0-3]$")), "query id format": F.col("query_id").rlike(r"^[a-z0-9-]+-\d{5}$"),
    }
    return D.issues(_records(spark, sf_dir), "record_id", checks)


def duplicate_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.repeated(questions(spark, sf_dir), F.nullif(X.collapsed(F.lower("query_text")), F.lit("")), "question repeated")


def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.leakage(questions(spark, sf_dir), "query_text", "split")


def language_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = files(spark, sf_dir).where("repository_id is not null").withColumn("bytes", F.octet_length(F.coalesce("content", F.lit(""))).cast("long"))
    return D.profile(sizes, "repository_id", "lang", "bytes")


def manifest_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = {
        "commit isn't pinned": F.col("commit_sha").rlike("^[0-9a-f]{40}$"), "name": F.col("repository_id").rlike("^[A-Za-z0-9._-]+$"), "address": F.col("source_url").rlike("^https://[A-Za-z0-9./_-]+$"),
        "language missing": F.col("primary_language").isNotNull(), "not a fork of itself": F.coalesce(F.col("fork_of") != F.col("repository_id"), F.lit(True)),
    }
    return D.issues(table(spark, sf_dir, "repositories"), "repository_id", checks)


def dataset_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.flat(_records(spark, sf_dir), "candidates", "split").withColumn("value", F.when(F.col("grade").rlike("^[0-3]$"), F.col("grade").cast("int")).cast("double")).withColumn("split", F.coalesce("split", F.lit("none")))
    s = D.statistics(rows, "split", "value")
    return s.select("split", "n", "total", "least", "greatest", F.round(F.col("total") / F.nullif("n", F.lit(0)), 6).alias("mean"))


def repository_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).where("repository_id is not null").withColumn("lines", F.size(F.split(F.coalesce("content", F.lit("")), r"\n")))
    s = _symbols(spark, sf_dir).join(f.select("file_id", "repository_id"), "file_id").withColumn("kind", F.lower(F.trim("kind")))
    by_file = f.groupBy("repository_id").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"), F.countDistinct("lang").alias("languages"))
    by_symbol = s.groupBy("repository_id").agg(F.count("*").alias("symbols"), F.count_if(F.col("kind") == "class").alias("classes"), F.count("docstring").alias("documented"))
    rows = by_file.join(by_symbol, "repository_id", "left")
    features = {c: F.col(c) for c in ("files", "lines", "languages", "symbols", "classes", "documented")}
    features |= {"density": F.round(F.col("symbols") / F.nullif("files", F.lit(0)), 6), "coverage": F.round(F.col("documented") / F.nullif("symbols", F.lit(0)), 6)}
    made = D.feature_rows(rows, features, "repository_id")
    return made.withColumn("magnitude", F.round("magnitude", 6)).withColumn("size", F.when(F.col("files") >= 100, "large").when(F.col("files") >= 10, "medium").otherwise("small"))


def query_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("query_text")
    features = {"tokens": F.size(X.tokens(c)), "search_tokens": F.size(X.search_tokens(c)), "distinct_tokens": F.size(F.array_distinct(X.search_tokens(c))), "symbols": F.size(X.symbols(c)), "characters": F.length(c)}
    return D.feature_rows(questions(spark, sf_dir), features, "record_id")


QUERIES = {
    "hash_split": hash_split, "flat_rows": flat_rows, "grouped_nested": grouped_nested, "current_rows": current_rows, "checkpoint_pending": checkpoint_pending, "validation_issues": validation_issues,
    "duplicate_questions": duplicate_questions, "split_leakage": split_leakage, "language_profile": language_profile, "manifest_issues": manifest_issues, "dataset_statistics": dataset_statistics,
    "repository_features": repository_features, "query_features": query_features,
}

_FLAT = f"(SELECT record_id, split, i AS place, candidates[i].file AS file, candidates[i].grade AS grade, candidates[i].reason AS reason FROM (SELECT record_id, split, candidates, unnest(range(1, len(candidates) + 1)) AS i FROM {Q_SQL} WHERE candidates IS NOT NULL))"


def _issues_sql(source: str, key: str, checks: dict[str, str]) -> str:
    return f"SELECT {key}, issue FROM (SELECT {key}, unnest([{', '.join(f'''CASE WHEN NOT coalesce({ok}, false) THEN '{name.replace(chr(39), chr(39) * 2)}' END''' for name, ok in checks.items())}]) AS issue FROM {source}) WHERE issue IS NOT NULL"


SQL = {
    "hash_split": f"""WITH h AS (SELECT record_id, ('0x' || substr(sha256('42' || chr(31) || coalesce(repository_id, '') || chr(31) || coalesce(query_text, '')), 1, 13))::BIGINT / 4503599627370496::DOUBLE AS f FROM {Q_SQL})
 SELECT record_id, round(f, 9) AS fraction, CASE WHEN f < 0.7 THEN 'train' WHEN f < 0.85 THEN 'validation' ELSE 'test' END AS assigned FROM h""",
    "flat_rows": f"SELECT record_id, place::INT AS place, file, grade, reason FROM {_FLAT}",
    "grouped_nested": f"SELECT record_id, count(*) AS n, max(file) FILTER (place = 1) AS first_file, max(grade) FILTER (place = 1) AS first_grade FROM {_FLAT} GROUP BY record_id",
    "current_rows": "SELECT record_id, ingested_at, split FROM merged_dataset WHERE record_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY ingested_at DESC NULLS LAST, split DESC NULLS LAST) = 1",
    "checkpoint_pending": f"""WITH done AS (SELECT DISTINCT repository_id, commit_sha FROM {F_SQL} WHERE repository_id IS NOT NULL), todo AS (SELECT record_id, repository_id FROM {Q_SQL} WHERE repository_id IS NOT NULL)
 SELECT * FROM todo WHERE EXISTS (SELECT 1 FROM done WHERE length(commit_sha) <> 40) OR repository_id NOT IN (SELECT repository_id FROM done)""",
    "validation_issues": _issues_sql(Q_SQL, "record_id", {"question missing": "length(trim(query_text)) > 0", "split missing": "split IS NOT NULL", "repository missing": "repository_id IS NOT NULL", "no candidates": "len(candidates) > 0", "grade missing": "len(list_filter(candidates, lambda c: coalesce(regexp_matches(c.grade, '^[0-3]$'), false))) > 0", "query id format": "regexp_matches(query_id, '^[a-z0-9-]+-\\d{5}$')"}),
    "duplicate_questions": f"""WITH q AS (SELECT nullif(regexp_replace(regexp_replace(lower(query_text), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), '^ | $', '', 'g'), '') AS value FROM {Q_SQL}) SELECT value, count(*) AS n, 'question repeated' AS issue FROM q WHERE value IS NOT NULL GROUP BY value HAVING count(*) > 1""",
    "split_leakage": f"SELECT query_text, array_to_string(list_sort(list_distinct(list(split))), ',') AS splits, count(*) AS n FROM {Q_SQL} WHERE query_text IS NOT NULL AND split IS NOT NULL GROUP BY query_text HAVING count(DISTINCT split) > 1",
    "language_profile": f"""WITH b AS (SELECT repository_id, lang, count(*) AS n, sum(octet_length(encode(coalesce(content, ''))))::BIGINT AS b FROM {F_SQL} WHERE repository_id IS NOT NULL GROUP BY ALL)
 SELECT repository_id, sum(n)::BIGINT AS files, sum(b)::BIGINT AS bytes, count(lang) AS languages, first(lang ORDER BY b DESC, lang) FILTER (lang IS NOT NULL) AS primary_language FROM b GROUP BY repository_id""",
    "manifest_issues": _issues_sql("repositories", "repository_id", {"commit isn't pinned": "regexp_matches(commit_sha, '^[0-9a-f]{40}$')", "name": "regexp_matches(repository_id, '^[A-Za-z0-9._-]+$')", "address": "regexp_matches(source_url, '^https://[A-Za-z0-9./_-]+$')", "language missing": "primary_language IS NOT NULL", "not a fork of itself": "coalesce(fork_of <> repository_id, true)"}),
    "dataset_statistics": f"""WITH v AS (SELECT coalesce(split, 'none') AS split, CASE WHEN regexp_matches(grade, '^[0-3]$') THEN try_cast(grade AS DOUBLE) END AS value FROM {_FLAT}) SELECT split, count(value) AS n, sum(value) AS total, min(value) AS least, max(value) AS greatest, round(sum(value) / nullif(count(value), 0), 6) AS mean FROM v GROUP BY split""",
    "repository_features": f"""WITH f AS (SELECT *, len(string_split(coalesce(content, ''), chr(10))) AS lines FROM {F_SQL} WHERE repository_id IS NOT NULL),
 a AS (SELECT repository_id, count(*)::DOUBLE AS files, sum(lines)::DOUBLE AS lines, count(DISTINCT lang)::DOUBLE AS languages FROM f GROUP BY ALL),
 s AS (SELECT repository_id, count(*)::DOUBLE AS symbols, (count(*) FILTER (lower(trim(kind)) = 'class'))::DOUBLE AS classes, count(docstring)::DOUBLE AS documented FROM {S_SQL} JOIN f USING (file_id) GROUP BY ALL),
 j AS (SELECT repository_id, files, lines, languages, coalesce(symbols, 0) AS symbols, coalesce(classes, 0) AS classes, coalesce(documented, 0) AS documented, coalesce(round(symbols / nullif(files, 0), 6), 0) AS density, coalesce(round(documented / nullif(symbols, 0), 6), 0) AS coverage FROM a LEFT JOIN s USING (repository_id))
 SELECT *, round(files + lines + languages + symbols + classes + documented + density + coverage, 6) AS magnitude, CASE WHEN files >= 100 THEN 'large' WHEN files >= 10 THEN 'medium' ELSE 'small' END AS size FROM j""",
    "query_features": f"""WITH t AS (SELECT record_id, {TOKENS_SQL} AS t, {search_tokens_sql("query_text")} AS s, regexp_extract_all(coalesce(query_text, ''), '{X.QUOTED.replace("'", "''")}', 1) AS q, coalesce(length(query_text), 0)::DOUBLE AS characters FROM {Q_SQL}),
 n AS (SELECT record_id, len(t)::DOUBLE AS tokens, len(s)::DOUBLE AS search_tokens, len(list_distinct(s))::DOUBLE AS distinct_tokens,
 len(list_distinct(list_concat(list_filter(t, lambda x: regexp_matches(x, '{_ID}') AND NOT regexp_matches(x, '{_PATH}')), q)))::DOUBLE AS symbols, characters FROM t)
 SELECT *, tokens + search_tokens + distinct_tokens + symbols + characters AS magnitude FROM n""",
}
