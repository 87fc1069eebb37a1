"""Records of question answering: contexts looked up and joined, prompts, labels of evidence, features of readers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from lexloom.functions.text import WORD_CHARACTER, article_number, sentences, single_spaced, words_and_marks

from .articles import article_intervals, windowed
from .index import small
from .store import numbered

#: Characters of a context.
CONTEXT_CHARS = 12_000
#: Columns that each kind of model reads (fixed values).
MODEL_COLUMNS = {"abstractive": ["context", "question", "answer"], "extractive": ["question_tokens", "passage_tokens", "start", "end"]}


def context_lookup(references: DataFrame, docs: DataFrame, most: int = CONTEXT_CHARS, on: str = "doc_id") -> DataFrame:
    """(id, pos, key, passage): the single-spaced beginnings of the documents that examples refer to; blank and missing ones leave.

    references: id, pos, the key and, if windows are wanted, article; docs: the key and text. A reference that names an article
    gets that article's window. References are broadcast if they are few.
    """
    named = "article" in references.columns
    spaced = docs.select(on, single_spaced("text").alias("text"))
    found = spaced.join(small(references.select("id", "pos", on, *["article"] * named)), on)
    if named:
        wanted = references.filter("trim(article) <> ''").select(on).distinct()
        found = windowed(found, article_intervals(spaced.join(small(wanted, terms=references), on, "left_semi"), on), on).withColumn("text", F.col("window"))
    return found.select("id", "pos", on, F.substring("text", 1, most).alias("passage")).filter("passage <> ''")


def article_references(examples: DataFrame, on: str = "content") -> DataFrame:
    """(id, pos, key, article): what examples (id, question, answer, contexts of structs content and article) refer to.

    The article is the one given, or else the first that the answer names, or the question.
    """
    each = examples.select("id", "question", "answer", F.posexplode("contexts").alias("pos", "c"))
    return each.select("id", "pos", F.col("c.content").alias(on), article_number(F.col("c.article"), F.col("answer"), F.col("question")).alias("article"))


def joined_contexts(passages: DataFrame, by: str = "\n\n") -> DataFrame:
    """(id, context): an example's passages (id, pos, passage) in order of pos, joined."""
    parts = passages.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "passage"))).alias("c"))
    return parts.select("id", F.array_join(F.transform("c", lambda s: s["passage"]), by).alias("context"))


def with_context(examples: DataFrame, found: DataFrame, fields: list[str]) -> DataFrame:
    """Adds context: the first non-blank of some fields, else the looked-up context (id, context), else nothing."""
    own = examples.join(found.withColumnRenamed("context", "_found"), "id", "left")
    options = [F.when(F.trim(f) != "", F.col(f)) for f in [*fields, "_found"]]
    return own.withColumn("context", F.coalesce(*options, F.lit(""))).drop("_found")


def prompt(question: Column | str, context: Column | str, most: int = CONTEXT_CHARS) -> Column:
    """A reader's input."""
    return F.format_string("câu hỏi: %s ngữ cảnh: %s", question, F.substring(context, 1, most))


def tagged(rows: DataFrame, **constants: str | int) -> DataFrame:
    """Rows with constant columns, such as model="..." or style=0."""
    return rows.withColumns({name: F.lit(value) for name, value in constants.items()})


def model_columns(rows: DataFrame, kind: str) -> DataFrame:
    """The columns that a kind of model reads, after id."""
    if kind not in MODEL_COLUMNS:
        raise ValueError(f"unknown kind of model {kind!r}; one of {sorted(MODEL_COLUMNS)}")
    return rows.select("id", *[c for c in MODEL_COLUMNS[kind] if c in rows.columns])


def chunk_sizes(text: str) -> list[int]:
    """Sizes written as numbers with commas."""
    return [int(x) for x in re.findall(r"[^,\s]+", text)]


def pairs_of_turns(turns: DataFrame) -> DataFrame:
    """(id, prediction, reference): a user's turn and the assistant's next one; turns: conv_id, turn, role, text."""
    said = turns.filter("role = 'user'").select("conv_id", F.col("turn").alias("t"), F.col("text").alias("prediction"))
    reply = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("t"), F.col("text").alias("reference"))
    return said.join(reply, ["conv_id", "t"]).select((F.col("conv_id") * 1000 + F.col("t")).alias("id"), "prediction", "reference")


def _placed(text: Column | str, parts: Column | str, start: Column, end: Column) -> Column:
    """Struct (before, begun): how many of the parts end at or before `start`, and how many begin before `end`.

    Parts follow each other in the text: each is looked for behind the one before it, and one that is missing stands there.
    """

    def find(texts: pd.Series, lists: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        out = []
        for t, own, a, z in zip(texts, lists, starts, ends, strict=True):
            at, before, begun = 0, 0, 0
            for part in () if t is None or own is None else own:
                found = t.find(part, at)
                found = at if found < 0 else found
                at = found + len(part)
                before += at <= a
                begun += found < z
            out.append((None if pd.isna(a) else before, None if pd.isna(z) else begun))
        return pd.DataFrame(out, columns=["before", "begun"], dtype="Int32")

    return F.pandas_udf(find, "struct<before:int,begun:int>")(text, parts, start.cast("double"), end.cast("double"))


def sentence_labels(df: DataFrame) -> DataFrame:
    """Adds sentences and evidence_labels: which sentences of `context` the characters [answer_start, answer_end) touch.

    Those are neighbours, so counting is enough: the sentences that end before the span and those that begin before its end. In
    a single-spaced text they are counted in what is left and right of these places; only other texts are searched.
    """
    start, end = F.col("answer_start").cast("int"), F.col("answer_end").cast("int")
    df = df.withColumn("sentences", F.when(F.col("context").isNotNull(), sentences("context"))).withColumn("_plain", F.col("context").eqNullSafe(single_spaced("context")))
    other = lambda c: F.when(~F.col("_plain"), F.col(c))
    df = df.withColumn("_s", _placed(other("context"), other("sentences"), start, end))
    context = F.col("context")
    rest = F.size(sentences(context.substr(F.greatest(start, F.lit(0)) + 1, F.length(context))))
    before = F.when(start.isNotNull(), F.when(F.col("_plain"), F.size("sentences") - rest).otherwise(F.col("_s.before")))
    begun = F.when(end.isNotNull(), F.when(F.col("_plain"), F.size(sentences(context.substr(F.lit(1), end)))).otherwise(F.col("_s.begun")))
    # a generator of one row keeps the optimizer from counting anew for every label
    df = df.select("*", F.inline(F.array(F.struct(before.alias("_before"), begun.alias("_begun")))))
    labels = F.transform("sentences", lambda s, i: ((i < F.col("_begun")) & (i >= F.col("_before"))).cast("int"))
    return df.withColumn("evidence_labels", labels).drop("_plain", "_s", "_before", "_begun")


def token_flags(df: DataFrame, most: int) -> DataFrame:
    """Adds tokens (the first `most` of context), start_flags and end_flags: 1 at the first and the last token that [answer_start, answer_end) touches.

    Without a valid span all flags are 0. Arrays are padded with 0 to `most`. Both places follow from the numbers of tokens left
    of the span's bounds, where a word that goes on over the first one counts as touched.
    """
    start, end, low = F.col("answer_start").cast("int"), F.col("answer_end").cast("int"), F.lower("context")
    valid = F.coalesce((start >= 0) & (start < end) & (end <= F.length("context")), F.lit(False))
    left = lambda at: F.size(words_and_marks(low.substr(F.lit(1), at)))
    goes_on = (start > 0) & F.rlike(low.substr(start, F.lit(2)), F.lit(rf"^{WORD_CHARACTER}{{2}}"))
    df = df.withColumn("tokens", F.when(F.col("context").isNotNull(), F.slice(words_and_marks("context"), 1, most)))
    df = df.withColumn("_a", F.when(valid, left(start) - goes_on.cast("int") + 1)).withColumn("_z", F.when(valid, F.least(left(end), F.lit(most))))
    zeros = lambda n: F.array_repeat(F.lit(0), F.greatest(n, F.lit(0)).cast("int"))
    flag = lambda at: F.when(F.col("_a") <= F.col("_z"), F.concat(zeros(at - 1), F.array(F.lit(1)), zeros(most - at))).otherwise(zeros(F.lit(most)))
    return df.withColumn("start_flags", flag(F.col("_a"))).withColumn("end_flags", flag(F.col("_z"))).drop("_a", "_z")


def window_features(df: DataFrame, width: int | Column, stride: int) -> DataFrame:
    """The first window of token ids that holds the whole answer: adds window, start, tokens, start_position, end_position.

    df: id, ids (the context's token ids), starts and ends (their characters), answer_start, answer_end. Windows step by
    width - stride; examples whose answer no window holds leave. Positions count from the window's beginning.
    """
    width = F.lit(width) if isinstance(width, int) else width
    step = F.greatest(F.lit(1), width - stride)
    own = df.filter("size(ids) > 0 and answer_start < answer_end").withColumn("_w", width).withColumn("_step", step)
    first = F.size(F.filter("starts", lambda x: x <= F.col("answer_start"))) - 1  # the token in which the answer begins
    last = F.size("ends") - F.size(F.filter("ends", lambda x: x >= F.col("answer_end")))  # and the one in which it ends
    own = own.withColumn("_a", first).withColumn("_b", last).filter("_w > 0 and _a >= 0 and _b < size(ids) and _a <= _b")
    # the earliest window that ends behind the answer's last token, if it begins at or before its first
    number = F.greatest(F.ceil((F.col("_b") + 1 - F.col("_w")) / F.col("_step")).cast("int"), F.lit(0))
    own = own.withColumn("window", number).withColumn("start", (F.col("window") * F.col("_step")).cast("int")).filter("start <= _a")
    own = own.withColumn("tokens", F.slice("ids", F.col("start") + 1, F.col("_w"))).withColumn("start_position", F.col("_a") - F.col("start")).withColumn("end_position", F.col("_b") - F.col("start"))
    return own.drop("_a", "_b", "_w", "_step")


OFFSETS = "struct<ids:array<int>,starts:array<int>,ends:array<int>>"


def encoded(text: Column | str, path: str) -> Column:
    """Token ids of a text by a file of the tokenizers library, without special tokens, each with its first character and the one behind its last.

    path: a file that each executor has at that place. A null text has no tokens.
    """

    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        for texts in parts:
            got = [tokenizer.encode(t or "", add_special_tokens=False) for t in texts]
            yield pd.DataFrame({"ids": [e.ids for e in got], "starts": [[a for a, _ in e.offsets] for e in got], "ends": [[b for _, b in e.offsets] for e in got]})

    return F.pandas_udf(encode, OFFSETS)(text)


def reader_features(df: DataFrame, path: str, max_length: int, stride: int, pad_id: int = 0) -> DataFrame:
    """Inputs of an extractive reader from raw text: (id, window, input_ids, attention_mask, start_positions, end_positions).

    df: id, question, context, answer_start, answer_end (characters of the context). A question's ids come first, whole; the rest of
    max_length is the first window of the context that holds the answer, and padding. Positions count in input_ids.
    """
    both = df.select("id", "answer_start", "answer_end", encoded("question", path).alias("q"), encoded("context", path).alias("c"))
    own = both.select("id", "answer_start", "answer_end", F.col("q.ids").alias("question"), F.inline(F.array("c")))
    own = window_features(own, F.lit(max_length) - F.size("question"), stride)
    ids = F.concat("question", "tokens")
    ones, zeros = (lambda n: F.array_repeat(F.lit(1), n)), (lambda n, x=0: F.array_repeat(F.lit(x), n))
    left = F.lit(max_length) - F.size(ids)
    return own.select(
        "id",
        "window",
        F.concat(ids, zeros(left, pad_id)).alias("input_ids"),
        F.concat(ones(F.size(ids)), zeros(left)).alias("attention_mask"),
        (F.col("start_position") + F.size("question")).alias("start_positions"),
        (F.col("end_position") + F.size("question")).alias("end_positions"),
    )


def seq2seq_rows(examples: DataFrame, most: int = CONTEXT_CHARS) -> DataFrame:
    """(id, question, context, answer) of a generator's training rows, single-spaced; rows that lack one of them leave."""
    df = examples.select("id", single_spaced("question").alias("question"), F.substring(single_spaced("context"), 1, most).alias("context"), single_spaced("answer").alias("answer"))
    return df.filter("question <> '' and context <> '' and answer <> ''")


#: A label that no loss counts (fixed value).
IGNORED = -100


def seq2seq_features(rows: DataFrame, path: str, max_input: int, max_target: int, pad_id: int = 0) -> DataFrame:
    """(id, input_ids, attention_mask, labels) of seq2seq_rows(): the prompt's and the answer's first tokens, padded; padding is no label."""
    own = rows.select("id", encoded(prompt("question", "context"), path).alias("x"), encoded("answer", path).alias("y"))
    ids, target = F.slice("x.ids", 1, max_input), F.slice("y.ids", 1, max_target)
    fill = lambda value, size, to: F.array_repeat(F.lit(value), F.lit(to) - size)
    labels = F.transform(F.concat(target, fill(pad_id, F.size(target), max_target)), lambda i: F.when(i == pad_id, F.lit(IGNORED)).otherwise(i))
    mask = F.concat(F.array_repeat(F.lit(1), F.size(ids)), fill(0, F.size(ids), max_input))
    return own.select("id", F.concat(ids, fill(pad_id, F.size(ids), max_input)).alias("input_ids"), mask.alias("attention_mask"), labels.alias("labels"))


def zipped(left: DataFrame, left_order: list[Column], right: DataFrame, right_order: list[Column], name: str = "zip") -> DataFrame:
    """Rows of two tables side by side by their places in an order, up to the shorter one's end; adds place, from 0.

    Both are numbered by sorted ranges and joined on the number, so no task orders all rows. Columns must differ.
    """
    return numbered(left, left_order, f"{name}-left", "place").join(numbered(right, right_order, f"{name}-right", "place"), "place")
