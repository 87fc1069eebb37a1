"""Text-generation metrics over word-and-mark tokens: LCS length, ROUGE-L and an exact-match METEOR."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from .text import words_and_marks


def _lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence; one big-integer step for each token of b."""
    places: dict[str, int] = {}
    for i, t in enumerate(a):
        places[t] = places.get(t, 0) | 1 << i
    row = 0
    for t in b:
        x = places.get(t, 0) | row
        row = x & ~(x - ((row << 1) | 1))
    return row.bit_count()


def _of_pairs(f: Callable, kind: str) -> Callable[[Column, Column], Column]:
    def apply(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(list(x), list(y)) for x, y in zip(a, b, strict=True)])

    return F.pandas_udf(apply, kind)


def lcs_length(a: Column | str, b: Column | str) -> Column:
    """LCS length of two token arrays."""
    return _of_pairs(_lcs, "int")(a, b)


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))


def with_rouge_l(pairs: DataFrame) -> DataFrame:
    """Adds lcs_len and rouge_l to (id, prediction, reference)."""
    df = pairs.withColumn("p", words_and_marks("prediction")).withColumn("r", words_and_marks("reference"))
    df = df.withColumn("lcs_len", lcs_length("p", "r"))
    score = F.when((F.size("p") == 0) | (F.size("r") == 0), 0.0).otherwise(f1(F.col("lcs_len") / F.size("p"), F.col("lcs_len") / F.size("r")))
    return df.withColumn("rouge_l", score).drop("p", "r")


def with_meteor(pairs: DataFrame) -> DataFrame:
    """Adds meteor to (id, prediction, reference); id is a key.

    The n-th occurrence of a token in a prediction matches if the reference has n of it. With m matches in c runs of
    neighbouring places, P = m / prediction's length and R = m / reference's: 10 P R / (R + 9 P) (1 - (c / m) ** 3 / 2).
    """
    sized = pairs.withColumn("p", words_and_marks("prediction")).withColumn("r", words_and_marks("reference"))
    nth = Window.partitionBy("id", "token").orderBy("place")
    given = sized.select("id", F.posexplode("p").alias("place", "token")).withColumn("n", F.row_number().over(nth))
    wanted = sized.select("id", F.explode("r").alias("token")).groupBy("id", "token").agg(F.count(F.lit(1)).alias("times"))
    hits = given.join(wanted, ["id", "token"]).filter("n <= times")
    begins = F.coalesce(F.col("place") - F.lag("place").over(Window.partitionBy("id").orderBy("place")) > 1, F.lit(True))
    counted = hits.select("id", begins.cast("int").alias("begins")).groupBy("id").agg(F.count(F.lit(1)).alias("m"), F.sum("begins").alias("c"))
    p, r = F.col("m") / F.size("p"), F.col("m") / F.size("r")
    score = 10 * p * r / (r + 9 * p) * (1 - F.pow(F.col("c") / F.col("m"), F.lit(3)) / 2)
    return sized.join(counted, "id", "left").withColumn("meteor", F.when(F.col("m").isNull(), 0.0).otherwise(score)).drop("p", "r", "m", "c")


MATCHED = "struct<precision:double,recall:double,f1:double>"


def vector_match(prediction: Column | str, reference: Column | str, prediction_weights: Column | str, reference_weights: Column | str) -> Column:
    """BERTScore of given token vectors: precision, recall and f1.

    Every token of one side meets the nearest of the other by cosine; means are weighted, by idf for example. The first two are
    arrays of vectors, the others arrays of their weights. A side without tokens or weight scores 0; null gives null.
    """

    def score(predictions: pd.Series, references: pd.Series, own: pd.Series, wanted: pd.Series) -> pd.DataFrame:
        out = []
        for p, r, u, v in zip(predictions, references, own, wanted, strict=True):
            if p is None or r is None or u is None or v is None:
                out.append((None, None, None))
            elif not len(p) or not len(r):
                out.append((0.0, 0.0, 0.0))
            else:
                a, b = (_unit(np.array([np.asarray(x, float) for x in side])) for side in (p, r))
                # one block of rows at a time: two long texts have no square table of all their tokens
                nearest, best = [], np.full(len(b), -np.inf)
                for i in range(0, len(a), 1024):
                    near = a[i : i + 1024] @ b.T
                    nearest.append(near.max(axis=1))
                    best = np.maximum(best, near.max(axis=0))
                x, y = _weighted(np.concatenate(nearest), u), _weighted(best, v)
                out.append((x, y, 2 * x * y / (x + y) if x + y else 0.0))
        return pd.DataFrame(out, columns=["precision", "recall", "f1"], dtype=float)

    return F.pandas_udf(score, MATCHED)(prediction, reference, prediction_weights, reference_weights)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _weighted(x: np.ndarray, weights: np.ndarray) -> float:
    w = np.asarray(weights, float)
    return float(x @ w / w.sum()) if w.sum() else 0.0


def token_idf(references: DataFrame, key: str = "id", token: str = "token") -> DataFrame:
    """(token, idf): ln((n + 1) / (df + 1)) over reference texts (id, token)."""
    n = references.select(key).distinct().count()
    return references.select(key, token).distinct().groupBy(token).agg(F.log(F.lit(n + 1.0) / (F.count(F.lit(1)) + 1)).alias("idf"))


def metric_means(scored: DataFrame, columns: list[str]) -> DataFrame:
    """One row of means; 0 without rows."""
    return scored.agg(*[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c) for c in columns])
