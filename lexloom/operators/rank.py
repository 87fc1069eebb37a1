"""Top k, min-max normalisation and fusion of score tables (query_id, doc_id, score)."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window


def top_k(scores: DataFrame, k: int, key: str = "query_id", item: str = "doc_id") -> DataFrame:
    """Adds rank (from 1) and keeps k rows of each key: by score to six places, ties by the column first, if there is one, and by item."""
    ties = [F.col(c) for c in ("first", item) if c in scores.columns]
    order = Window.partitionBy(key).orderBy(F.desc(F.round("score", 6)), *ties)
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def ranked(scores: DataFrame, k: int) -> DataFrame:
    """The result table: query_id, rank, doc_id, score."""
    return top_k(scores, k).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def fuse(maps: list[tuple[DataFrame, float]]) -> DataFrame:
    """Weighted sum of min-max normalised maps over the union of their candidates.

    A missing score counts as 0 before normalisation; a map without spread adds nothing. One shuffle on
    (query_id, doc_id) merges all maps, whatever their number.
    """
    cols = [f"s{i}" for i in range(len(maps))]
    union = None
    for i, (scores, _) in enumerate(maps):
        own = scores.select("query_id", "doc_id", *[(F.col("score") if j == i else F.lit(None).cast("double")).alias(c) for j, c in enumerate(cols)])
        union = own if union is None else union.unionByName(own)
    merged = union.groupBy("query_id", "doc_id").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in cols])
    spread = merged.groupBy("query_id").agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))])
    total = F.lit(0.0)
    for c, (_, weight) in zip(cols, maps, strict=True):
        lo, hi = F.col(f"lo_{c}"), F.col(f"hi_{c}")
        total = total + weight * F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(0.0)
    return merged.join(spread, "query_id").select("query_id", "doc_id", total.alias("score"))
