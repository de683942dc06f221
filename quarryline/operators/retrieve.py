"""Retrieval as joins and windows: BM25, field-weighted search, exact lookup, cosine search in blocks, graph traversal."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.session import cut, freed, new_folder

K1, B = 1.5, 0.75
# Weights of the fields of a symbol.
FIELD_WEIGHTS = {"name": 3.0, "docstring": 2.0, "source": 1.0}


def normalised(score: Column, group: Window) -> Column:
    """To [0, 1] over the group; 1 where all are equal."""
    low, high = F.min(score).over(group), F.max(score).over(group)
    return F.when(high == low, 1.0).otherwise((score - low) / F.nullif(high - low, F.lit(0.0)))


def top_k(scored: DataFrame, query: str, item: str, k: int, score: str = "score") -> DataFrame:
    """Adds ``normalised`` over all of a query's items, then ``rank``, and keeps the first ``k``; ties go to the lesser item.
    Scores are rounded before ranking, as sums of doubles depend on the order in which partitions arrive."""
    pool = Window.partitionBy(query)
    rows = scored.withColumn(score, F.round(score, 9)).withColumn("normalised", normalised(F.col(score), pool))
    return rows.withColumn("rank", F.row_number().over(pool.orderBy(F.desc(score), item))).where(F.col("rank") <= k)


def bm25(documents: DataFrame, queries: DataFrame, item: str, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """``query, item, score`` of every pair that shares a term.

    Both sides hold ``tokens array<string>``. Terms of a query count as often as they stand; documents without tokens count
    for the mean length but never match; queries without tokens find nothing. Document frequencies are aggregated before
    the join and only postings of terms that are asked for are joined, so a term that stands everywhere costs its
    postings, spread by AQE, and nothing else.
    """
    lengths = documents.select(F.col(item), F.size(F.coalesce("tokens", F.array().cast("array<string>"))).alias("length"), "tokens")
    n, mean = lengths.agg(F.count("*"), F.avg("length")).first()  # two numbers
    if not n or not mean:
        return lengths.limit(0).select(F.lit(None).cast(queries.schema[query].dataType).alias(query), item, F.lit(0.0).alias("score"))
    asked = queries.select(query, F.explode("tokens").alias("term")).groupBy(query, "term").agg(F.count("*").alias("qtf"))
    postings = lengths.select(item, "length", F.explode("tokens").alias("term")).groupBy(item, "length", "term").agg(F.count("*").alias("tf"))
    postings = postings.join(asked.select("term").distinct(), "term", "left_semi")
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(float(mean))))
    weighted = asked.join(df, "term").join(postings, "term")
    return weighted.groupBy(query, item).agg(F.sum(F.col("qtf") * weight).alias("score"))


def postings(documents: DataFrame, item: str) -> tuple[DataFrame, int]:
    """(``item, term, tf, length`` written once, number of documents). Texts are tokenised once for all lists made of it."""
    tokens = documents.select(F.col(item), F.size("tokens").alias("length"), F.explode("tokens").alias("term"))
    return cut(tokens.groupBy(item, "length", "term").agg(F.count("*").alias("tf"))), documents.count()


def _asked(queries: DataFrame, query: str) -> DataFrame:
    return queries.select(query, F.explode("tokens").alias("term")).groupBy(query, "term").agg(F.count("*").alias("qtf"))


def bm25_weights(found: DataFrame, n: int, terms: DataFrame, item: str, k1: float = K1, b: float = B) -> DataFrame:
    """``item, term, w``: what a posting adds to the score of a query that has its term once."""
    total = found.agg(F.sum("tf")).first()[0] or 0  # one number
    known = found.join(terms, "term", "left_semi")
    df = known.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    w = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(total / max(n, 1) or 1.0)))
    return known.join(df, "term").select(item, "term", w.alias("w"))


def lists(fields: dict[str, DataFrame], asked: DataFrame, item: str, query: str, k: int, query_block: int = 8192, item_block: int = 2_500) -> DataFrame:
    """``query, item, score, normalised, rank, listed`` and a column per field: each query's ``k`` best items.

    ``fields`` have ``item, term, w`` and ``asked`` has ``query, term, qtf``; a field's score sums ``qtf * w`` over the terms in
    common, the score sums the fields. ``normalised`` and ``listed`` go over all items that share a term, ties to the lesser
    item. Items and queries are dealt into blocks of bounded size; a pair of blocks is scored in one task, which keeps ``k``
    items a query, so neither pairs of rows nor whole lists are shuffled. Terms are told apart by 64-bit hashes.
    """
    names = list(fields)
    weights = reduce(DataFrame.unionByName, [df.select(F.col(item).alias("_id"), F.lit(i).alias("f"), F.xxhash64("term").alias("h"), "w") for i, df in enumerate(fields.values())])
    weights = cut(weights)
    down = max(1, math.ceil(weights.select("_id").distinct().count() / item_block))
    across = max(1, math.ceil(asked.select(query).distinct().count() / query_block))
    left = asked.select(F.col(query).alias("_id"), F.xxhash64("term").alias("h"), F.col("qtf").cast("double").alias("w"), F.pmod(F.xxhash64(query), F.lit(across)).alias("_q"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("_i"))
    right = weights.withColumn("_i", F.pmod(F.xxhash64("_id"), F.lit(down))).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        items, at = np.unique(b["_id"].to_numpy(), return_inverse=True)
        order = np.argsort(b.h.to_numpy(), kind="stable")
        hashes, starts = np.unique(b.h.to_numpy()[order], return_index=True)
        ends = np.append(starts[1:], len(order))
        keys, w = (at * len(names) + b.f.to_numpy())[order], b.w.to_numpy()[order]
        for one, rows in a.groupby("_id") if len(items) else ():
            where = np.searchsorted(hashes, rows.h.to_numpy())
            met = (where < len(hashes)) & (hashes[np.minimum(where, len(hashes) - 1)] == rows.h.to_numpy())
            if not met.any():
                continue
            spans = [slice(starts[i], ends[i]) for i in where[met]]
            hit = np.concatenate([keys[s] for s in spans])
            part = np.concatenate([w[s] * q for s, q in zip(spans, rows.w.to_numpy()[met])])
            by_field = np.round(np.bincount(hit, part, minlength=len(items) * len(names)).reshape(-1, len(names)), 9)
            ids = np.unique(hit // len(names))
            score = np.round(by_field[ids].sum(axis=1), 9)
            few = ids[score >= np.partition(score, len(score) - k)[len(score) - k]] if len(score) > k else ids
            total = np.round(by_field[few].sum(axis=1), 9)
            few = few[np.lexsort((items[few], -total))[:k]]
            out.extend((one, items[i], round(float(by_field[i].sum()), 9), score.min(), score.max(), len(ids) if not at else 0, *by_field[i]) for at, i in enumerate(few))
        return pd.DataFrame(out, columns=["q", "i", "score", "low", "high", "n", *[f"f{j}" for j in range(len(names))]])

    schema = f"q {asked.schema[query].dataType.simpleString()}, i {weights.schema['_id'].dataType.simpleString()}, score double, low double, high double, n long, " + ", ".join(f"f{j} double" for j in range(len(names)))
    found = left.groupBy("_q", "_i").cogroup(right.groupBy("_q", "_i")).applyInPandas(best, schema)
    pool = Window.partitionBy("q")  # at most k rows a block of items
    low, high = F.min("low").over(pool), F.max("high").over(pool)
    found = found.withColumn("normalised", F.when(low == high, 1.0).otherwise((F.col("score") - low) / F.nullif(high - low, F.lit(0.0)))).withColumn("listed", F.sum("n").over(pool))
    found = found.withColumn("rank", F.row_number().over(pool.orderBy(F.desc("score"), "i"))).where(F.col("rank") <= k)
    return found.select(F.col("q").alias(query), F.col("i").alias(item), "score", "normalised", "rank", "listed", *[F.col(f"f{j}").alias(f"_{f}") for j, f in enumerate(names)])


def bm25_lists(documents: DataFrame, queries: DataFrame, item: str, query: str, k: int) -> DataFrame:
    """Each query's ``k`` best documents by BM25, see ``lists``; both sides hold ``tokens``."""
    asked = _asked(queries, query)
    found, n = postings(documents, item)
    return lists({"text": bm25_weights(found, n, asked.select("term").distinct(), item)}, asked, item, query, k)


def overlap_lists(found: DataFrame, queries: DataFrame, item: str, query: str, k: int) -> DataFrame:
    """Each query's ``k`` best documents by the share of its distinct words that they hold; ``found`` are postings."""
    words = queries.select(query, F.array_distinct("tokens").alias("t")).select(query, F.explode("t").alias("term"), (F.lit(1.0) / F.size("t")).alias("qtf"))
    return lists({"text": found.join(words.select("term").distinct(), "term", "left_semi").select(item, "term", F.lit(1.0).alias("w"))}, words, item, query, k)


def field_search(fields: dict[str, DataFrame], queries: DataFrame, item: str, query: str, k: int, weights: dict[str, float] | None = None) -> DataFrame:
    """BM25 per field, each with its own statistics, summed by weight; ``matched_field`` is the one that gives most, ties in
    the order of the fields."""
    weights, asked = weights or FIELD_WEIGHTS, cut(_asked(queries, query))
    terms, made = asked.select("term").distinct(), {}
    for f, df in fields.items():
        found, n = postings(df, item)
        made[f] = bm25_weights(found, n, terms, item).withColumn("w", F.col("w") * weights[f])
    rows = lists(made, asked, item, query, k)
    best = F.greatest(*[F.col(f"_{f}") for f in fields]) if len(fields) > 1 else F.col(f"_{next(iter(fields))}")
    return rows.withColumn("matched_field", F.coalesce(*[F.when(F.col(f"_{f}") == best, f) for f in fields]))


def cosine_top_k(vectors: DataFrame, queries: DataFrame, item: str, query: str, k: int, query_block: int = 1024, item_block: int = 20_000) -> DataFrame:
    """``query, item, similarity``, the ``k`` nearest of each query by exact cosine, in blocks of bounded size.

    Queries and items (``embedding``) are dealt into blocks; each pair of blocks is one matrix product in one task, which
    keeps ``k`` items a query, so nothing is collected and no pair of rows is shuffled. Null vectors and those of another
    length than the query's are left out; a vector of zeros has similarity 0.
    """
    items, asked = vectors.where("embedding is not null"), queries.where("embedding is not null")
    across, down = max(1, math.ceil(asked.count() / query_block)), max(1, math.ceil(items.count() / item_block))
    left = asked.select(F.col(query).alias("_id"), F.col("embedding"), F.pmod(F.xxhash64(query), F.lit(across)).alias("_q"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("_i"))
    right = items.select(F.col(item).alias("_id"), F.col("embedding"), F.pmod(F.xxhash64(item), F.lit(down)).alias("_i"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("_q"))

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for size in {len(v) for v in a.embedding}:
            x, y = a[a.embedding.map(len) == size], b[b.embedding.map(len) == size]
            if not len(y):
                continue
            p, q = (np.stack(z.embedding.to_numpy()).astype(float) for z in (x, y))
            p, q = (np.divide(z, n, out=np.zeros_like(z), where=n > 0) for z, n in ((z, np.linalg.norm(z, axis=1, keepdims=True)) for z in (p, q)))
            s, ids = np.round(p @ q.T, 9), y._id.to_numpy()
            for row, one in zip(s, x._id):
                order = np.lexsort((ids, -row))[:k]
                out.append(pd.DataFrame({"q": one, "i": ids[order], "similarity": row[order]}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "i": [], "similarity": []})

    schema = f"q {queries.schema[query].dataType.simpleString()}, i {vectors.schema[item].dataType.simpleString()}, similarity double"
    best = left.groupBy("_q", "_i").cogroup(right.groupBy("_q", "_i")).applyInPandas(nearest, schema)
    w = Window.partitionBy("q").orderBy(F.desc("similarity"), "i")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("q").alias(query), F.col("i").alias(item), "similarity", "rank")


def hashed_vectors(rows: DataFrame, item: str, buckets: int = 128) -> DataFrame:
    """``item, bucket, value``: tokens hashed into signed buckets, scaled to length 1. Items without tokens have no rows."""
    t = rows.select(item, F.explode("tokens").alias("t")).withColumn("h", F.sha2("t", 256))
    bucket = (F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % buckets).cast("int")
    sign = F.when(F.conv(F.substring("h", 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    sums = t.groupBy(item, bucket.alias("bucket")).agg(F.sum(sign).alias("s")).where("s <> 0")
    norm = F.sqrt(F.sum(F.col("s") * F.col("s")).over(Window.partitionBy(item)))
    return sums.select(item, "bucket", (F.col("s") / norm).alias("value"))


def reached(edges: DataFrame, seeds: DataFrame, depth: int = 3, undirected: bool = False) -> DataFrame:
    """``node, distance, score``: nodes within ``depth`` steps of any seed (``node``), with the least distance.

    One join per step over the frontier only; nodes seen before are dropped, so a hub is expanded once. Null nodes are no
    nodes; a seed without edges reaches itself.
    """
    steps = edges.where("src is not null and dst is not null").select("src", "dst")
    if undirected:
        steps = steps.unionByName(steps.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    steps = cut(steps.distinct())
    seen = cut(seeds.where("node is not null").select("node").distinct().withColumn("distance", F.lit(0)))
    frontier = seen
    for d in range(1, depth + 1):
        found = frontier.join(steps, frontier["node"] == steps["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = cut(found.join(seen, "node", "left_anti").withColumn("distance", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.withColumn("score", 1 / (1 + F.col("distance")))


def reached_by(edges: DataFrame, seeds: DataFrame, query: str, depth: int, undirected: bool = False) -> DataFrame:
    """``query, node, distance, score``: what each query reaches from its own seeds (``query, node``) within ``depth`` steps,
    with the least distance. Null nodes are no nodes; seeds without edges reach themselves."""
    steps = edges.where("src is not null and dst is not null").select("src", "dst")
    if undirected:
        steps = steps.unionByName(steps.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    steps = cut(steps.distinct())
    seen = cut(seeds.where("node is not null").select(query, "node").distinct().withColumn("distance", F.lit(0)))
    frontier = seen
    for d in range(1, depth + 1):
        found = frontier.join(steps, frontier["node"] == steps["src"]).select(query, F.col("dst").alias("node")).distinct()
        frontier = cut(found.join(seen, [query, "node"], "left_anti").withColumn("distance", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.withColumn("score", 1 / (1 + F.col("distance")))


def path_seeds(asked: DataFrame, paths: DataFrame, query: str) -> DataFrame:
    """``query, node``: the file of exactly the path that ``asked`` (``query, path``) names, else all files of that last name.
    ``paths`` has ``node, path``."""
    base = lambda c: F.regexp_extract(c, r"([^/]+)$", 1)
    exact = asked.join(paths, "path").select(query, "path", "node")
    rest = asked.join(exact.select(query, "path"), [query, "path"], "left_anti").withColumn("_b", base("path")).drop("path")
    loose = rest.join(paths.select("node", base("path").alias("_b")), "_b")
    return exact.select(query, "node").unionByName(loose.select(query, "node")).distinct()


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, component``: the least node that is connected with it. Labels spread along edges and jump along labels, so
    the rounds grow with the logarithm of the longest path."""
    steps = edges.where("src is not null and dst is not null and src <> dst").select("src", "dst")
    steps = cut(steps.unionByName(steps.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    spark = edges.sparkSession
    at, last = cut(nodes.where("node is not null").select("node").distinct().withColumn("component", F.col("node"))), None
    while True:
        offers = steps.join(at, steps["dst"] == at["node"]).groupBy("src").agg(F.min("component").alias("offer"))
        pulled = at.join(offers, at["node"] == offers["src"], "left").select("node", "component", F.least("component", F.coalesce("offer", "component")).alias("low"))
        far = at.select(F.col("node").alias("low"), F.col("component").alias("lower"))
        path = new_folder(spark)
        jumped = cut(pulled.join(far, "low", "left").select("node", F.least("low", F.coalesce("lower", "low")).alias("next"), "component"), path)
        at = jumped.select("node", F.col("next").alias("component"))
        if jumped.where("next <> component").isEmpty():
            return at
        if last:
            freed(spark, last)
        last = path


def combined(parts: list[tuple[DataFrame, float]], query: str, item: str) -> DataFrame:
    """Scores of several retrievers, each normalised over its own list, summed by weight; what one doesn't list counts 0."""
    rows = [df.select(query, item, (normalised(F.col("score"), Window.partitionBy(query)) * w).alias("score")) for df, w in parts]
    return reduce(DataFrame.unionByName, rows).groupBy(query, item).agg(F.sum("score").alias("score"))


def hashed_arrays(rows: DataFrame, item: str, buckets: int = 128) -> DataFrame:
    """``item, embedding`` of ``hashed_vectors``, a full vector each."""
    held = hashed_vectors(rows, item, buckets).groupBy(item).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "value"))).alias("m"))
    return held.select(item, F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("embedding"))
