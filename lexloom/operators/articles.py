"""Articles of legal texts: where each one stands in its document, and the windows that references to them select."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from lexloom.functions.text import article_window

#: Before a marker: its word, white space and the article's name (fixed values).
BEFORE_MARKER = r"(?iu)(?=(?:điều|dieu)\s+[\p{L}\p{N}_])"
MARKER = r"(?iu)^(?:điều|dieu)\s+([\p{L}\p{N}_]+)"
NUMBERED, NAME = r"(?i)^\p{Nd}+[a-z]?$", r"^[\p{L}\p{N}_]+$"


def article_intervals(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, article, start, length): each article's first marker in a single-spaced text, up to the next marker of a numbered article behind white space.

    docs: the key and text. article is in lower case; length is null where the window runs to the end of the text. One pass over
    a document cuts it at all its markers, whatever the number of references to it.
    """
    parts = docs.select(key, F.posexplode(F.split("text", BEFORE_MARKER)).alias("i", "part"))
    cut = parts.select(key, "i", F.regexp_extract("part", MARKER, 1).alias("name"), F.char_length("part").cast("long").alias("n"), F.endswith("part", F.lit(" ")).alias("spaced"))
    ahead, back = Window.partitionBy(key).orderBy("i"), Window.partitionBy(key).orderBy(F.desc("i"))
    start = F.coalesce(F.sum("n").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = cut.withColumn("start", start).withColumn("behind_space", F.coalesce(F.lag("spaced").over(ahead), F.lit(False)))
    stop = F.when(F.col("behind_space") & F.rlike("name", F.lit(NUMBERED)), F.col("start") - 1)
    cut = cut.withColumn("stop", stop).withColumn("next", F.last("stop", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    first = cut.filter("name <> ''").groupBy(key, F.lower("name").alias("article")).agg(F.min(F.struct("start", (F.col("next") - F.col("start")).alias("length"))).alias("w"))
    return first.select(key, "article", "w.start", "w.length")


def windowed(found: DataFrame, intervals: DataFrame, key: str = "doc_id") -> DataFrame:
    """found (key, text, article and others) with `window`: the text of the article, or all of it where none is named or it has no marker.

    An article that is one word is joined to its interval; for any other the text is searched.
    """
    article: Column = F.trim(F.col("article"))
    own = intervals.select(F.col(key).alias("_key"), F.col("article").alias("_article"), F.col("start").alias("_start"), F.col("length").alias("_length"))
    both = found.join(own, (F.col(key) == F.col("_key")) & (F.lower(article) == F.col("_article")), "left")
    part = F.substring(F.col("text"), (F.col("_start") + 1).cast("int"), F.coalesce(F.col("_length"), F.lit(2**31 - 1)).cast("int"))
    odd = F.coalesce((article != "") & ~F.rlike(article, F.lit(NAME)), F.lit(False))
    window = F.when(F.col("_start").isNotNull(), F.trim(part)).when(odd, article_window(F.col("text"), article)).otherwise(F.col("text"))
    return both.withColumn("window", window).drop("_key", "_article", "_start", "_length")
