"""Quality rules with risk-controlled thresholds. DataFrame functions only.

Per document, rule metrics are computed from its whole text. All rules share one cutoff, which moves along a fixed path
from lax to strict; a document is rejected if any metric exceeds it. From labelled documents the cutoff of every stratum
is chosen such that, with confidence 1 - delta over all strata together, the rules reject at most a share alpha of the
stratum's good documents that pass the base rule. A cutoff is certified if the exact binomial tail P[Bin(n, alpha) <= k]
for its k rejected among n good documents is at most delta / strata (Bonferroni); the path does not depend on the data
and is tested until the first failure, which needs no further correction and leaves alpha whole for all rules together.
Among the certified cutoffs the one with the best gain (share of bad rejected less `cost` times the share of good
rejected) is taken, the laxer of equals; a stratum without certified gain rejects nothing. With alpha 0.02, delta 0.05
and four strata, 217 good documents of which none is rejected certify a cutoff, 320 with one.

Defined results: a null or empty text has no words and fails the base rule; null strata form a stratum "none";
rows of labels without a label or document are ignored, of several labels of one document the best counts; without
labels the method rejects nothing; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from .common import WORD_SPLIT, materialize

#: Rule name -> metric, from the columns of base_metrics(). A document is rejected above the cutoff.
RULES = {
    "symbols": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "capitals": "n_upper / greatest(word_chars, 1)",
    "long_words": "word_chars / greatest(n_words, 1) / 100",
}
#: The path of cutoffs, from strict to lax; fixed, so that it does not depend on the labels.
GRID = [round(0.01 * 1.12**i, 6) for i in range(48)]


def base_metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang", window: int = 8) -> DataFrame:
    r"""doc_id, stratum and the counts over words [^\x20\x09-\x0D]+ of the whole text.

    n_repeat_words: words in windows of `window` words that occur twice or more in the text. Windows are compared by
    64-bit hashes within one text; only texts in which some hash occurs twice are looked at position by position.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    stratum = F.coalesce(F.col(stratum_col), F.lit("none")) if stratum_col else F.lit("none")
    df = docs.select(F.col(id_col).alias("doc_id"), stratum.alias("stratum"), text.alias("t"))
    df = df.select("doc_id", "stratum", "t", F.array_remove(F.split("t", WORD_SPLIT), "").alias("w"), F.expr(r"filter(split(t, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')").alias("l"))
    df = df.select(
        "doc_id",
        "stratum",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.length("t") - F.length(F.regexp_replace("t", r"\p{Lu}", ""))).cast("long").alias("n_upper"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") >= window + 1, F.transform(F.sequence(F.lit(1), F.size("w") - (window - 1)), lambda i: F.xxhash64(F.slice("w", i, window)))).alias("h"),
    )
    df = df.withColumn("repeats", F.coalesce(F.size(F.array_distinct("h")) < F.size("h"), F.lit(False)))
    # (hash, position) in order of hash: a window is repeated if a neighbour has the same hash
    df = df.withColumn("s", F.when(F.col("repeats"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    df = df.withColumn(
        "p",
        F.when(
            F.col("repeats"),
            F.sort_array(F.expr("transform(filter(s, (y, j) -> (j > 0 and s[j - 1].x = y.x) or (j + 1 < size(s) and s[j + 1].x = y.x)), y -> y.i)")),
        ),
    )
    covered = F.aggregate(
        "p",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + i + window - F.greatest(a["end"], i)).alias("n"), (i + window).alias("end")),
        lambda a: a["n"],
    )
    return df.select(
        "doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", F.when(F.col("repeats"), covered).otherwise(0).cast("long").alias("n_repeat_words")
    )


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P[Bin(n, p) <= k], summed exactly in logarithms."""
    odds = F.log(F.lit(p / (1 - p)))
    start = F.struct((n * F.log(F.lit(1 - p))).cast("double").alias("t"), F.lit(0.0).alias("s"))
    return F.aggregate(
        F.sequence(F.lit(0).cast("long"), k),
        start,
        lambda a, j: F.struct((a["t"] + F.log((n - j) / (j + 1)) + odds).alias("t"), (a["s"] + F.exp(a["t"])).alias("s")),
        lambda a: F.least(a["s"], F.lit(1.0)),
    )


def base_failed() -> Column:
    """Whether a document of base_metrics() fails the base rule."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def thresholds(metrics: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05, cost: float = 5.0, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Certified cutoffs: stratum, cutoff, n_good, k_good (rejected good), n_bad, k_bad, tail; a row for each stratum that has one.

    metrics: base_metrics() as a stored table, since its expressions would else be written into every use of them. All
    labelled documents that pass the base rule count. What leaves the join is one row per stratum, place on the path and
    label, counted before it is shuffled.
    """
    y = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    strata = metrics.select("stratum").distinct().count()
    worst = F.greatest(*[F.expr(v).cast("double") for v in RULES.values()])
    above = F.size(F.filter(F.array(*[F.lit(float(c)) for c in GRID]), lambda c: F.col("m") > c))
    cells = metrics.filter(~base_failed()).select("doc_id", "stratum", worst.alias("m")).join(y, "doc_id").select("stratum", "y", above.alias("above"))
    cells = cells.groupBy("stratum", "above").agg(F.sum(F.col("y").cast("long")).alias("good"), F.sum(1 - F.col("y").cast("long")).alias("bad"))
    # every cutoff gets a row, with what lies above it: cutoff i rejects the cells with above > i
    each = cells.select("stratum", "above", "good", "bad", F.explode(F.sequence(F.lit(0), F.lit(len(GRID) - 1))).alias("i"))
    hit = lambda c: F.sum(F.when(F.col("above") > F.col("i"), F.col(c)).otherwise(0))
    each = each.groupBy("stratum", "i").agg(F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"), hit("good").alias("k_good"), hit("bad").alias("k_bad"))
    each = each.withColumn("tail", F.when((F.col("n_good") > 0) & (F.col("k_good") <= F.col("n_good") * alpha), binomial_tail(F.col("k_good").cast("long"), F.col("n_good"), alpha)).otherwise(1.0))
    lax_first = Window.partitionBy("stratum").orderBy(F.desc("i"))
    each = each.withColumn("failed", F.max(F.when(F.col("tail") > delta / max(1, strata), 1).otherwise(0)).over(lax_first))
    each = each.withColumn("gain", F.col("k_bad") / F.greatest("n_bad", F.lit(1)) - cost * F.col("k_good") / F.greatest("n_good", F.lit(1)))
    best = Window.partitionBy("stratum").orderBy(F.desc("gain"), F.desc("i"))
    cutoff = F.element_at(F.array(*[F.lit(float(c)) for c in GRID]), F.col("i") + 1)
    return each.filter("failed = 0 and gain > 0").withColumn("b", F.row_number().over(best)).filter("b = 1").select("stratum", cutoff.alias("cutoff"), "n_good", "k_good", "n_bad", "k_bad", "tail")


def apply_rules(metrics: DataFrame, cuts: DataFrame, max_broadcast_rows: int = 20_000) -> DataFrame:
    """Adds base_failed, rejected_by (names of the rules) and kept. cuts: from thresholds(), with a row per stratum."""
    by = cuts.select("stratum", "cutoff")
    by = F.broadcast(by) if by.count() <= max_broadcast_rows else by
    hit = F.array(*[F.when(F.expr(v).cast("double") > F.col("cutoff"), F.lit(k)) for k, v in RULES.items()])
    df = metrics.join(by, "stratum", "left").withColumn("rejected_by", F.filter(hit, lambda x: x.isNotNull()))
    df = df.withColumn("base_failed", base_failed())
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("cutoff")


def quality_filter(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05, stratum_col: str | None = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Metrics, base_failed, rejected_by and kept of every document. Metrics are computed once, into a shared table."""
    metrics = materialize(base_metrics(docs, id_col, text_col, stratum_col), "quality-metrics", "doc_id")
    cuts = materialize(thresholds(metrics, labels, alpha, delta), "quality-cutoffs")
    return apply_rules(metrics, cuts)
