"""Retrieval metrics: ranked results (query_id, rank, doc_id) against gold (query_id, doc_id)."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from lexloom.functions.metrics import f1

from .index import small


def gold_by_text(docs: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, doc_id) of the documents whose text contains the query's text.

    A query's inner words (parted by spaces) stand in such a text as they are, so its second to (k + 1)-th word are
    looked up among the runs of k words of all documents, by hash, and what is found is confirmed. Queries with fewer
    inner words use shorter runs; those without any are tried on every document.
    """
    parts = queries.select("query_id", F.col("text").alias("q"), F.split("text", " ").alias("w")).filter("q is not null")
    sized = parts.withColumn("m", F.least(F.lit(k), F.size("w") - 2))
    texts = docs.select("doc_id", "text")
    out = texts.join(sized.filter("m <= 0").select("query_id", "q"), F.contains("text", "q")).select("query_id", "doc_id")
    sizes = [r.m for r in sized.filter("m > 0").select("m").distinct().collect()]  # at most k
    for m in sorted(sizes):
        anchors = sized.filter(F.col("m") == m).select("query_id", "q", F.xxhash64(F.slice("w", 2, m)).alias("h"))
        words = texts.select("doc_id", F.split("text", " ").alias("w")).filter(F.size("w") >= m)
        found = words.select("doc_id", F.explode(F.expr(f"transform(sequence(1, size(w) - {m - 1}), i -> xxhash64(slice(w, i, {m})))")).alias("h"))
        pairs = found.join(small(anchors), "h").select("query_id", "doc_id", "q").distinct()
        out = out.unionByName(pairs.join(texts, "doc_id").filter(F.contains("text", "q")).select("query_id", "doc_id"))
    return out


def per_query(results: DataFrame, gold: DataFrame) -> DataFrame:
    """precision (over what was retrieved), recall, f1, first_hit_rank, hit_at_1 and rr of every query with gold."""
    gold = gold.select("query_id", "doc_id").distinct()
    wanted = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"))
    marked = results.join(gold.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    found = marked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first_hit_rank"))
    both = wanted.join(found, "query_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    p, r = F.col("hits") / F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)), F.col("hits") / F.col("n_gold")
    out = both.select("query_id", p.alias("precision"), r.alias("recall"), "first_hit_rank")
    return out.select(
        "query_id",
        F.round("precision", 6).alias("precision"),
        F.round("recall", 6).alias("recall"),
        F.round(f1(F.col("precision"), F.col("recall")), 6).alias("f1"),
        F.col("first_hit_rank").cast("int").alias("first_hit_rank"),
        F.coalesce((F.col("first_hit_rank") == 1).cast("int"), F.lit(0)).alias("hit_at_1"),
        F.round(F.coalesce(1 / F.col("first_hit_rank"), F.lit(0.0)), 6).alias("rr"),
    )


def means(scored: DataFrame) -> DataFrame:
    """One row: number of queries and macro means, 0 without queries."""
    cols = {"precision": "precision", "recall": "recall", "f1": "f1", "hit_at_1": "hit_at_1", "rr": "mrr"}
    return scored.agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 5).alias(n) for c, n in cols.items()])


def nested(results: DataFrame, names: DataFrame) -> DataFrame:
    """One row a query with its results as an array of structs in order of rank; names: doc_id, name and others."""
    rows = results.join(names, "doc_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "doc_id", *[c for c in names.columns if c != "doc_id"]))).alias("retrieved_contexts"))
    return rows


def write_ranked(results: DataFrame, names: DataFrame, path: str) -> None:
    """Writes nested results as JSON lines."""
    nested(results, names).write.mode("overwrite").json(path)
