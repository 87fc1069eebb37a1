"""Decoding of model outputs and selection over training epochs."""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window


def argmax(x: Column | str) -> Column:
    """First place (from 0) of the largest element."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def greedy_decode(logits: Column | str, names: Column) -> Column:
    """Text of the likeliest tokens of each step up to <eos>; <pad> and <bos> are left out, unknown ids are <unk>. names: map of id to token."""
    tokens = F.transform(logits, lambda step: F.coalesce(F.try_element_at(names, argmax(step)), F.lit("<unk>")))
    stop = F.array_position(tokens, "<eos>").cast("int")
    kept = F.when(stop > 0, F.slice(tokens, 1, F.greatest(stop - 1, F.lit(0)))).otherwise(tokens)
    return F.array_join(F.filter(kept, lambda t: ~t.isin("<pad>", "<bos>")), " ")


def span_decode(start: Column | str, end: Column | str, tokens: Column | str) -> Column:
    """Tokens between the likeliest start and end; an end before the start becomes the start, one beyond the tokens the last."""
    a = argmax(start)
    b = F.least(F.greatest(argmax(end), a), F.size(tokens) - 1)
    return F.array_join(F.when(b >= a, F.slice(tokens, a + 1, b - a + 1)).otherwise(F.array().cast("array<string>")), " ")


def best_span_pairs(windows: DataFrame, top: int = 20, most: int = 30) -> DataFrame:
    """(id, window, start, end, score): the best pair of start and end over all windows of an id.

    windows: id, window, offset, n_tokens, start_logits, end_logits. Pairs are formed from the `top` best places of
    either kind inside a row; spans lie in the window and have at most `most` tokens. Ties: the first window, then the
    better start, then the better end.
    """
    best = lambda c: F.slice(F.array_sort(F.transform(c, lambda x, i: F.struct((-x).alias("neg"), i.alias("i")))), 1, top)
    df = windows.withColumn("a", best("start_logits")).withColumn("b", best("end_logits"))
    df = df.select("id", "window", "offset", "n_tokens", F.posexplode("a").alias("ra", "a"), "b").select("id", "window", "offset", "n_tokens", "ra", "a", F.posexplode("b").alias("rb", "b"))
    start, end = F.col("a.i") - F.col("offset"), F.col("b.i") - F.col("offset")
    df = df.select("id", "window", start.alias("start"), end.alias("end"), (-F.col("a.neg") - F.col("b.neg")).alias("score"), "n_tokens", "ra", "rb")
    df = df.filter((F.col("start") >= 0) & (F.col("end") >= F.col("start")) & (F.col("end") < F.col("n_tokens")) & (F.col("end") - F.col("start") + 1 <= most))
    order = Window.partitionBy("id").orderBy(F.desc("score"), "window", "ra", "rb")
    return df.withColumn("r", F.row_number().over(order)).filter("r = 1").select("id", "window", "start", "end", "score")


def early_stopping(epochs: DataFrame, patience: int = 3) -> DataFrame:
    """(run, stop_epoch, best_epoch, best_score): a run (run, epoch, score) stops after `patience` epochs without a new best."""
    by = Window.partitionBy("run").orderBy("epoch")
    before = F.max("score").over(by.rowsBetween(Window.unboundedPreceding, -1))
    df = epochs.withColumn("better", before.isNull() | (F.col("score") > before))
    df = df.withColumn("last", F.max(F.when(F.col("better"), F.col("epoch"))).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("stop", F.col("epoch") - F.col("last") >= patience)
    df = df.withColumn("stopped", F.max(F.col("stop").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)))
    ran = df.filter(F.coalesce("stopped", F.lit(0)) == 0)
    return ran.groupBy("run").agg(F.max("epoch").alias("stop_epoch"), F.max("last").alias("best_epoch"), F.max("score").alias("best_score"))


def batch_inference(rows: DataFrame, make_model: Callable[[], Callable], schema: str, columns: list[str]) -> DataFrame:
    """Applies a model to Arrow batches of some columns. make_model runs once in each task and returns a function of a pandas frame."""

    def run(batches):
        model = make_model()
        for frame in batches:
            yield model(frame)

    return rows.select(*columns).mapInPandas(run, schema)
