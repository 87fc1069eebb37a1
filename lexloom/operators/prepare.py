"""Preparation of question-answering records: chunks, spans, vocabularies, encodings."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from lexloom.functions.text import sentences, single_spaced, words_and_marks

from .draws import draws
from .store import numbered

#: Least length of an answer's part that is looked for, and limits of a window of overlap (fixed values).
LEAST_PART, LEAST_WINDOW, MOST_WINDOW = 12, 8, 160
SPECIALS = ["<pad>", "<unk>", "<bos>", "<eos>"]


def chunks(tokens: Column | str, size: int | Column) -> Column:
    """Non-overlapping runs of tokens; an empty input is one empty chunk."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    size = F.lit(size) if isinstance(size, int) else size
    last = F.greatest(F.ceil(F.size(t) / size).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(t, i * size + 1, size))


def overlap_score(query: Column, chunk: Column) -> Column:
    """Shared distinct tokens over those of the query, plus over those of the chunk."""
    shared = F.size(F.array_intersect(query, chunk))
    return F.when(F.size(chunk) == 0, 0.0).otherwise(shared / F.greatest(F.size(F.array_distinct(query)), F.lit(1)) + shared / F.greatest(F.size(F.array_distinct(chunk)), F.lit(1)))


def scored_chunks(df: DataFrame, size: int | Column) -> DataFrame:
    """Adds `scored`, an array of (score, -index, chunk), from columns context and query. Rows stay whole: no shuffle."""
    # a generator of one row keeps the optimizer from writing the tokenising into every use of the tokens
    own = F.array(F.struct(words_and_marks("query").alias("q"), words_and_marks("context").alias("t")))
    df = df.select("*", F.inline(own)).withColumn("parts", chunks("t", size))
    return df.withColumn("scored", F.transform("parts", lambda c, i: F.struct(F.round(overlap_score(F.col("q"), c), 9).alias("score"), (-i).alias("neg"), c.alias("chunk"))))


def select_within_budget(df: DataFrame, size: int | Column, budget: int) -> DataFrame:
    """Adds `selected`: the best chunks (ties: the earlier) in order, joined by spaces, cut to `budget` tokens. Rows without any leave."""
    best = F.flatten(F.transform(F.reverse(F.array_sort("scored")), lambda s: s["chunk"]))
    return scored_chunks(df, size).filter(F.size("t") > 0).withColumn("selected", F.array_join(F.slice(best, 1, budget), " ")).drop("q", "t", "parts", "scored")


def curriculum_records(examples: DataFrame, sizes: list[int], budget: int, easy_ratio: float, seed: int = 23) -> DataFrame:
    """Records with retrieved context. Each row draws its chunk size, and whether the answer is the query, in order of ids from one generator.

    examples: id, question, answer, context. Rows without context or answer draw and then leave.
    """
    rows = numbered(examples.select("id", "question", "answer", "context"), [F.asc("id")], "curriculum", "row")
    return _drawn_records(rows, draws(examples.sparkSession, rows.count(), [seed], len(sizes)), sizes, budget, F.lit(easy_ratio)).drop("seed")


def curriculum_epochs(examples: DataFrame, sizes: list[int], budget: int, start: float, decay: float, epochs: int, path: str, seed: int = 23) -> DataFrame:
    """curriculum_records() of epochs 1 to `epochs`, written below path by epoch, and read back: a filter on epoch reads that epoch's files alone.

    Epoch e draws from seed + e, with the share of answers as queries that easy_ratio() gives. The examples are read and numbered once.
    """
    rows = numbered(examples.select("id", "question", "answer", "context"), [F.asc("id")], "curriculum", "row")
    drawn = draws(examples.sparkSession, rows.count(), [seed + e for e in range(1, epochs + 1)], len(sizes)).withColumn("epoch", (F.col("seed") - seed).cast("int"))
    made = _drawn_records(rows, drawn, sizes, budget, easy_ratio("epoch", start, decay)).drop("seed")
    made.write.mode("overwrite").partitionBy("epoch").parquet(path)
    return examples.sparkSession.read.parquet(path)


def _drawn_records(rows: DataFrame, drawn: DataFrame, sizes: list[int], budget: int, share: Column) -> DataFrame:
    df = rows.withColumn("answer", single_spaced("answer")).withColumn("question", single_spaced("question")).join(drawn, "row")
    df = df.withColumn("chunk_size", F.element_at(F.array(*[F.lit(s) for s in sizes]), F.col("choice") + 1))
    df = df.withColumn("query_mode", F.when(F.col("draw") < share, "answer").otherwise("question"))
    df = df.withColumn("query", F.when(F.col("query_mode") == "answer", F.col("answer")).otherwise(F.col("question")))
    own = ["epoch"] if "epoch" in drawn.columns else []
    made = select_within_budget(df, F.col("chunk_size"), budget).filter("answer <> ''")
    return made.select("id", "question", F.col("selected").alias("context"), "answer", F.col("answer").alias("reference"), "chunk_size", "query_mode", "seed", *own)


def easy_ratio(epoch: Column | str, start: float, decay: float) -> Column:
    """max(0, start - (epoch - 1) * decay)."""
    return F.greatest(F.lit(0.0), F.lit(start) - (F.col(epoch) - 1) * decay)


def vocabulary(records: DataFrame, columns: list[str], min_freq: int = 1, most: int | None = None) -> DataFrame:
    """(token, idx, freq): specials first, then by falling count; ties by the token's first row (id), column and place.

    most: how many entries at most; without it the vocabulary grows with the records, and no task numbers all of it.
    """
    each = None
    for i, c in enumerate(columns):
        own = records.select("id", F.posexplode(words_and_marks(c)).alias("pos", "token")).select("token", F.struct("id", F.lit(i).alias("field"), "pos").alias("at"))
        each = own if each is None else each.unionByName(own)
    counted = each.groupBy("token").agg(F.count(F.lit(1)).alias("freq"), F.min("at").alias("first"))
    counted = counted.filter(F.col("freq") >= min_freq).filter(~F.col("token").isin(SPECIALS))
    if most is not None:
        counted = counted.orderBy(F.desc("freq"), "first").limit(max(0, most - len(SPECIALS)))
        place = F.row_number().over(Window.orderBy(F.desc("freq"), "first")) - 1  # `most` rows
    else:
        counted, place = numbered(counted, [F.desc("freq"), F.asc("first")], "vocabulary", "place"), F.col("place")
    ids = counted.select("token", (place + len(SPECIALS)).cast("int").alias("idx"), "freq")
    spark = records.sparkSession
    return spark.createDataFrame([(t, i, 0) for i, t in enumerate(SPECIALS)], "token string, idx int, freq long").unionByName(ids)


def encode(rows: DataFrame, vocab: DataFrame, max_len: int, bos_eos: bool = False, key: str = "id", tokens: str = "tokens", most: int = 1_000_000) -> DataFrame:
    """(key, ids): vocabulary ids, <unk> for others, cut to max_len after <bos>/<eos> were added, padded to max_len.

    A vocabulary of at most `most` rows is broadcast, a larger one joined by a shuffle.
    """
    table = vocab.select("token", "idx")
    table = F.broadcast(table) if table.count() <= most else table
    each = rows.select(key, F.posexplode_outer(tokens).alias("pos", "token")).join(table, "token", "left")
    ids = each.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("idx", F.lit(1)).alias("idx"))))).alias("a"))
    own = F.transform("a", lambda s: s["idx"])
    own = F.concat(F.array(F.lit(2)), own, F.array(F.lit(3))) if bos_eos else own
    cut = F.slice(own, 1, max_len)
    return ids.select(key, F.concat(cut, F.array_repeat(F.lit(0), F.lit(max_len) - F.size(cut))).alias("ids"))


def evidence_sentence(df: DataFrame) -> DataFrame:
    """Adds evidence, evidence_idx, evidence_score: the first sentence of `context` that overlaps `question` most; else 512 characters."""
    df = df.withColumn("q", F.array_distinct(words_and_marks("question"))).withColumn("s", sentences("context"))
    scored = F.transform("s", lambda s, i: F.struct(F.round(overlap_score(F.col("q"), words_and_marks(s)), 9).alias("score"), (-i).alias("neg"), s.alias("text")))
    best = F.array_max(F.filter(scored, lambda x: x["score"] > 0))
    df = df.withColumn("b", best)
    return df.select(
        *[c for c in df.columns if c not in ("q", "s", "b")],
        F.coalesce("b.text", F.substring("context", 1, 512)).alias("evidence"),
        F.coalesce(-F.col("b.neg"), F.when(F.length("context") > 0, 0).otherwise(-1)).alias("evidence_idx"),
        F.coalesce("b.score", F.lit(0.0)).alias("evidence_score"),
    )


def find_run(tokens: Column | str, needle: Column | str) -> Column:
    """First place (from 0) of a run of tokens; null without one."""
    t, n = (F.col(c) if isinstance(c, str) else c for c in (tokens, needle))
    starts = F.sequence(F.lit(0), F.size(t) - F.size(n))
    hits = F.filter(starts, lambda i: (F.get(t, i) == F.get(n, F.lit(0))) & (F.slice(t, i + 1, F.size(n)) == n))
    return F.when((F.size(n) > 0) & (F.size(n) <= F.size(t)), F.try_element_at(hits, F.lit(1)))


def windows(tokens: Column | str, width: int, stride: int) -> Column:
    """Overlapping windows that step by max(1, width - stride) and end with the one that reaches the end."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    step = max(1, width - stride)
    last = F.greatest(F.ceil((F.size(t) - width) / step).cast("int"), F.lit(0))
    return F.when(F.size(t) == 0, F.array().cast("array<struct<start:int,tokens:array<string>>>")).otherwise(
        F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * step).alias("start"), F.slice(t, i * step + 1, width).alias("tokens")))
    )


def span_labels(start: Column, end: Column, passages: int, length: int) -> tuple[Column, Column]:
    """0/1 labels of the tokens of a span, and of the passage in which it starts."""
    content = F.transform(F.sequence(F.lit(0), F.lit(passages * length - 1)), lambda i: ((i >= start) & (i <= end)).cast("int"))
    own = F.least(F.lit(passages - 1), F.floor(start / length).cast("int"))
    return content, F.transform(F.sequence(F.lit(0), F.lit(passages - 1)), lambda i: (i == own).cast("int"))


SPAN = "struct<start:int,end:int>"
_TOKEN = re.compile(r"\w+|[^\w\s]")
_SENTENCE, _CLAUSE, _QUOTED, _NUMBER = re.compile(r"(?<=[.!?。！？])\s+"), re.compile(r"[\n;:。!?]"), re.compile(r"[“\"]([^”\"]+)[”\"]"), re.compile(r"(?<=\d)\.[\d.]*")
Span = tuple[int, int] | None


def _tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def _answer_span(context: str | None, answer: str | None) -> Span:
    c, a = " ".join((context or "").split()), " ".join((answer or "").split())
    parts = {a, *_SENTENCE.split(a), *_CLAUSE.split(a), *_QUOTED.findall(a)}
    low = c.lower()
    for p in sorted((x for x in {p.strip() for p in parts} if len(x) >= LEAST_PART), key=lambda x: (-len(x), x)):
        at = low.find(p.lower())
        if at >= 0:
            m = _NUMBER.match(c, at + len(p))
            return at, m.end() if m else at + len(p)
    return None


def _token_span(text: str, start: int, end: int) -> Span:
    """First and last token that a span of characters touches: bounds of tokens rise, so both are found by bisection."""
    bounds = np.array([m.span() for m in _TOKEN.finditer(text.lower())], np.int64).reshape(-1, 2)
    first, last = int(np.searchsorted(bounds[:, 1], start, "right")), int(np.searchsorted(bounds[:, 0], end, "left")) - 1
    return (first, last) if first <= last else None


def _run(tokens: list[str], needle: list[str]) -> Span:
    """First run of tokens; no token holds the separator."""
    if not needle:
        return None
    text = "\n" + "\n".join(tokens) + "\n"
    at = text.find("\n" + "\n".join(needle) + "\n")
    first = text.count("\n", 0, at) if at >= 0 else -1
    return None if at < 0 else (first, first + len(needle) - 1)


def _best_overlap_span(tokens: list[str], answer: list[str]) -> Span:
    """A best window starts with a hit: one that does not is less dense than its rest."""
    wanted = {x for x in answer if len(x) > 1} or set(answer)
    if not tokens or not wanted:
        return None
    limit, hits = min(len(tokens), max(LEAST_WINDOW, min(len(answer), MOST_WINDOW))), np.array([x in wanted for x in tokens])
    best, at = 0.0, None
    for start in np.flatnonzero(hits).tolist():
        seen: set[str] = set()
        fresh = np.zeros(min(limit, len(tokens) - start), np.int64)
        for j in np.flatnonzero(hits[start : start + limit]).tolist():
            if tokens[start + j] not in seen:
                seen.add(tokens[start + j])
                fresh[j] = 1
        overlap = np.cumsum(fresh)
        score = overlap / len(wanted) + overlap / np.arange(1, len(fresh) + 1)
        j = int(score.argmax())
        if score[j] > best:
            best, at = float(score[j]), (start, start + j)
    return at


def _record_span(context: str | None, answer: str | None, start: float | None, end: float | None) -> Span:
    context, answer = context or "", " ".join((answer or "").split())
    given = not (pd.isna(start) or pd.isna(end))
    chars = (int(start), int(end)) if given else _answer_span(context, answer)
    if chars is not None and not 0 <= chars[0] < chars[1] <= len(context):
        chars = None
    tokens = _tokens(context)
    exact = _token_span(context, *chars) if chars else None
    return exact or _run(tokens, _tokens(context[slice(*chars)] if chars else answer)) or _best_overlap_span(tokens, _tokens(answer))


def _spans(f, *columns) -> Column:
    """A vectorized function that returns spans; made when it is used, since workers import this module without a session."""

    def two(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([f(*x) or (None, None) for x in zip(a, b, strict=True)], columns=["start", "end"], dtype="Int32")

    def four(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([f(*x) or (None, None) for x in zip(a, b, c, d, strict=True)], columns=["start", "end"], dtype="Int32")

    return F.pandas_udf(two if len(columns) == 2 else four, SPAN)(*columns)


def answer_span(context: Column | str, answer: Column | str) -> Column:
    """Characters of the longest part of the answer (12 or more characters: itself, its sentences, clauses, quotations) that
    the context holds, in any case; of equally long ones the first in order. Runs on over a section number."""
    return _spans(_answer_span, context, answer)


def best_overlap_span(tokens: Column | str, answer: Column | str) -> Column:
    """The window of tokens that overlaps the answer's tokens most densely; the first of equals; null without overlap."""
    return _spans(lambda t, a: _best_overlap_span(list(t), list(a)), tokens, answer)


def extractive_records(examples: DataFrame, max_passages: int = 6, passage_len: int = 256, most_chars: int = 12_000) -> DataFrame:
    """Training records with token spans: an exact span of characters, else the answer's run of tokens, else the best overlap.

    examples: id, question, answer, context, and answer_start / answer_end (null where not given).
    """
    df = examples.withColumn("context", F.substring(single_spaced("context"), 1, most_chars))
    df = df.withColumn("s", _spans(_record_span, "context", "answer", F.col("answer_start").cast("double"), F.col("answer_end").cast("double")))
    df = df.withColumn("t", words_and_marks("context")).withColumn("start", F.col("s.start")).withColumn("end", F.col("s.end"))
    df = df.filter(f"start is not null and end < {max_passages * passage_len} and trim(question) <> '' and trim(answer) <> ''")
    text = F.array_join(F.slice("t", F.col("start") + 1, F.col("end") - F.col("start") + 1), " ")
    return df.select("id", single_spaced("question").alias("question"), text.alias("answer"), text.alias("reference"), single_spaced("answer").alias("abstractive_reference"), words_and_marks("question").alias("question_tokens"), F.slice(chunks("t", passage_len), 1, max_passages).alias("passage_tokens"), "start", "end")
