"""Fusion of two retrievers over all documents: BM25, and words in common."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.operators import fuse as U
from quarryline.operators import retrieve as R
from quarryline.plans.retrieve import _ASKED, _NORM, _asked, _documents, bm25_sql, search_tokens_sql
from quarryline.session import table

LISTED = 30
WEIGHTS = {"lexical": 1.0, "overlap": 0.8}


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _asked(spark, sf_dir).select("record_id", X.search_tokens(F.col("query_text")).alias("tokens"))
    docs = _documents(spark, sf_dir)
    found, n = R.postings(docs, "doc_id")
    words = asked.select("record_id", F.explode("tokens").alias("term")).groupBy("record_id", "term").agg(F.count("*").alias("qtf"))
    lexical = R.lists({"text": R.bm25_weights(found, n, words.select("term").distinct(), "doc_id")}, words, "doc_id", "record_id", LISTED)
    overlap = R.overlap_lists(found, asked, "doc_id", "record_id", LISTED)
    cols = ["record_id", "doc_id", "rank", "normalised"]
    return lexical.select(*cols, F.lit("lexical").alias("retriever"), F.lit(0).alias("kind_order")).unionByName(overlap.select(*cols, F.lit("overlap").alias("retriever"), F.lit(1).alias("kind_order")))


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.merged(_candidates(spark, sf_dir), "record_id", "doc_id", WEIGHTS)


def dedup_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).select("record_id", "doc_id", F.round("score", 6).alias("score"), F.array_join("found_by", ",").alias("found_by"), F.col("first_seen").cast("long").alias("first_seen"), F.round(F.try_element_at("sources", F.lit("lexical")), 6).alias("lexical"), F.round(F.try_element_at("sources", F.lit("overlap")), 6).alias("overlap"))


def _context(spark: SparkSession, sf_dir: str, rerank: bool) -> DataFrame:
    rows = U.ordered(_merged(spark, sf_dir), "record_id", "doc_id", rerank)
    sizes = table(spark, sf_dir, "documents").select("doc_id", X.estimated_tokens(F.col("text")).alias("token_count"))
    return U.within_budget(rows.join(sizes, "doc_id"), "record_id")


def fused_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _context(spark, sf_dir, True).select("record_id", "doc_id", "rank", F.round("score", 6).alias("score"), "token_count", "used", "truncated", "candidate_count")


def fused_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _context(spark, sf_dir, False).select("record_id", "doc_id", "rank", "token_count", "used", "truncated", "candidate_count")


def prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _context(spark, sf_dir, True).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").join(_asked(spark, sf_dir).select("record_id", "query_text"), "record_id")
    made = U.prompts(rows, "record_id", F.col("query_text"), F.concat(F.lit("document "), F.col("doc_id").cast("string")), F.col("text"))
    return made.select("record_id", F.md5("prompt").alias("digest"), F.length("prompt").cast("long").alias("characters"))


QUERIES = {"dedup_sources": dedup_sources, "fused_context": fused_context, "fused_first_seen": fused_first_seen, "prompt_text": prompt_text}

_MERGED = f"""d AS (SELECT doc_id, {search_tokens_sql("text")} AS tokens FROM documents), a AS ({_ASKED}), {bm25_sql("d", "a", "doc_id", "record_id")},
 x AS (SELECT record_id, doc_id, round(score, 9) AS score, 'lexical' AS retriever, 0 AS kind_order, 1.0::DOUBLE AS weight FROM bm UNION ALL
 SELECT record_id, doc_id, round(count(*)::DOUBLE / n, 9), 'overlap', 1, 0.8 FROM (SELECT record_id, len(list_distinct(tokens)) AS n, unnest(list_distinct(tokens)) AS w FROM a) JOIN (SELECT doc_id, unnest(list_distinct(tokens)) AS w FROM d) USING (w) GROUP BY record_id, doc_id, n),
 y AS (SELECT *, {_NORM.format("score")} AS normalised, row_number() OVER (PARTITION BY record_id, retriever ORDER BY score DESC, doc_id) AS rank FROM x WINDOW w AS (PARTITION BY record_id, retriever)),
 c AS (SELECT * FROM y WHERE rank <= {LISTED}),
 m AS (SELECT record_id, doc_id, sum(weight * normalised) / sum(weight) AS score, string_agg(retriever, ',' ORDER BY retriever) AS found_by, min(kind_order * 1000000 + rank) AS first_seen,
 max(normalised) FILTER (retriever = 'lexical') AS lexical, max(normalised) FILTER (retriever = 'overlap') AS overlap FROM c GROUP BY ALL)"""


def _context_sql(order: str) -> str:
    return f"""{_MERGED}, o AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY {order}) AS rank, count(*) OVER (PARTITION BY record_id) AS candidate_count FROM m),
 b AS (SELECT o.*, ceil(length(coalesce(text, '')) / 4.0)::BIGINT AS token_count FROM o JOIN documents USING (doc_id) WHERE rank <= 15),
 u AS (SELECT *, sum(token_count) OVER (PARTITION BY record_id ORDER BY rank)::BIGINT AS used FROM b), v AS (SELECT *, max(used) OVER (PARTITION BY record_id) > 4000 AS truncated FROM u), f AS (SELECT * FROM v WHERE used <= 4000)"""


SQL = {
    "dedup_sources": f"WITH {_MERGED} SELECT record_id, doc_id, round(score, 6) AS score, found_by, first_seen, round(lexical, 6) AS lexical, round(overlap, 6) AS overlap FROM m",
    "fused_context": f"WITH {_context_sql('round(score, 9) DESC, doc_id')} SELECT record_id, doc_id, rank::INT AS rank, round(score, 6) AS score, token_count, used, truncated, candidate_count FROM f",
    "fused_first_seen": f"WITH {_context_sql('first_seen, doc_id')} SELECT record_id, doc_id, rank::INT AS rank, token_count, used, truncated, candidate_count FROM f",
    "prompt_text": f"""WITH {_context_sql('round(score, 9) DESC, doc_id')}, p AS (SELECT record_id, string_agg('## document ' || doc_id || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY rank) AS chunks FROM f JOIN documents USING (doc_id) GROUP BY record_id),
 t AS (SELECT record_id, query_text || chr(10) || chr(10) || chunks AS prompt FROM p JOIN merged_dataset USING (record_id) QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY ingested_at) = 1) SELECT record_id, md5(prompt) AS digest, length(prompt)::BIGINT AS characters FROM t""",
}
