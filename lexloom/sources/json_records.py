"""Members of one large JSON object or list, read by many tasks.

The file is read as pieces between commas, which Spark's reader deals out by byte ranges. Whether a comma parts two members
depends on all that stands before it: on being in a string, and on the depth of brackets. A first pass sums up each
byte range for either beginning, in a string or not: what its quotes and brackets do to string and depth, and how many
of its commas stand at which depth. These small sums are put one after another, so that each range knows how it
begins, and a second pass cuts the ranges into members. Members that cross ranges come in parts, which are put together.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from lexloom.operators.store import stored

#: A backslash and what it stands before, a quote, a bracket.
_MARK = re.compile(r'\\.|["{}\[\]]', re.S)
_DEPTH = {"{": 1, "[": 1, "}": -1, "]": -1}
_KEY = re.compile(r'\s*("(?:[^"\\]|\\.)*")\s*:', re.S)

Batches = Iterator[pa.RecordBatch]
SUMS = "block long, flips boolean, depth array<int>, commas array<map<int,long>>, head string"
PART = pa.schema([("pos", pa.int64()), ("block", pa.int64()), ("text", pa.string()), ("whole", pa.bool_())])
MEMBER = pa.schema([("pos", pa.int64()), ("key", pa.string()), ("value", pa.string())])
MEMBER_DDL = "pos long, key string, value string"


def _sum(batches: Batches) -> Batches:
    """A row for each byte range: its two outcomes, for a beginning outside and inside a string."""
    now, inside, depth, commas, head = None, False, [0, 0], [Counter(), Counter()], ""

    def row() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.map_(pa.int32(), pa.int64())), pa.string()]
        values = [now, inside, depth, [list(c.items()) for c in commas], head]
        return pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["block", "flips", "depth", "commas", "head"])

    for b in batches:
        for block, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if block != now:
                if now is not None:
                    yield row()
                now, inside, depth, commas, head = block, False, [0, 0], [Counter(), Counter()], ""
            head = head or piece.lstrip("\ufeff \t\r\n")[:1]
            for mark in _MARK.findall(piece):
                if mark == '"':
                    inside = not inside
                elif mark in _DEPTH:
                    depth[inside] += _DEPTH[mark]  # the beginning for which this bracket is outside a string
            commas[inside][depth[inside]] += 1
    if now is not None:
        yield row()


def _cut(begins: dict[int, tuple[bool, int, int]]) -> Callable[[Batches], Batches]:
    """Byte ranges that begin as given (in a string, depth, members before) to members and parts of them."""

    def run(batches: Batches) -> Batches:
        for b in batches_of_blocks(batches):
            block, pieces = b
            inside, depth, pos = begins[block]
            held, first, rows = [], True, []
            for piece in pieces:
                held.append(piece)
                for mark in _MARK.findall(piece):
                    if mark == '"':
                        inside = not inside
                    elif not inside and mark in _DEPTH:
                        depth += _DEPTH[mark]
                if not inside and depth <= 1:
                    # the range's first member may have begun before it
                    rows.append((pos, block, ",".join(held), not first))
                    held, first, pos = [], False, pos + 1
                    if len(rows) == 1000:
                        yield _batch(rows, PART)
                        rows = []
            if held:
                rows.append((pos, block, ",".join(held) + ",", False))
            if rows:
                yield _batch(rows, PART)

    return run


def batches_of_blocks(batches: Batches) -> Iterator[tuple[int, Iterator[str]]]:
    """Each byte range of a task with its pieces, which are read as they are used."""
    rows = ((block, piece) for b in batches for block, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
    ahead = next(rows, None)

    def pieces(block: int) -> Iterator[str]:
        nonlocal ahead
        while ahead is not None and ahead[0] == block:
            piece, ahead = ahead[1], next(rows, None)
            yield piece

    while ahead is not None:
        yield ahead[0], pieces(ahead[0])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _members(kind: str) -> Callable[[Batches], Batches]:
    """Texts of members to keys and values, without the outer brackets."""
    opening, closing = ("{", "}") if kind == "OBJECT" else ("[", "]")

    def run(batches: Batches) -> Batches:
        for b in batches:
            rows = []
            for pos, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = text.strip("\ufeff \t\r\n")
                text = text[1:] if pos == 0 and text[:1] == opening else text
                # the last member has a closing bracket more than opening ones
                level, inside, end = 0, False, len(text)
                for m in _MARK.finditer(text):
                    mark = m.group()
                    if mark == '"':
                        inside = not inside
                    elif not inside and mark in _DEPTH:
                        level += _DEPTH[mark]
                        if level < 0:
                            if mark != closing or text[m.end() :].strip():
                                raise ValueError("the file does not end with its own bracket")
                            end = m.start()
                            break
                text = text[:end].strip()
                if not text and pos == 0:
                    continue
                if kind == "OBJECT":
                    key = _KEY.match(text)
                    if not key:
                        raise ValueError(f"member {pos} has no key")
                    rows.append((pos, json.loads(key[1]), text[key.end() :].strip()))
                else:
                    rows.append((pos, None, text))
            if rows:
                yield _batch(rows, MEMBER)

    return run


def json_members(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """The kind of a JSON file, OBJECT or ARRAY, and its members (pos, key, value): place from 0, key (null in a list), and text of the value.

    Of equal keys the last value counts, at the place of the first. The sums of the byte ranges, one row for each, come to the
    driver. A file of another kind raises ValueError; so does one whose brackets do not match.
    """
    pieces = spark.read.option("lineSep", ",").text(path).select(F.col("_metadata.file_block_start").alias("block"), "value")
    sums = sorted(pieces.mapInArrow(_sum, SUMS).collect(), key=lambda r: r.block)
    head = next((r.head for r in sums if r.head), "")
    kind = {"{": "OBJECT", "[": "ARRAY"}.get(head, "")
    if not kind:
        raise ValueError(f"{path}: neither an object nor a list of records")
    inside, depth, pos, begins = False, 0, 0, {}
    for r in sums:
        begins[r.block] = inside, depth, pos
        pos += r.commas[inside].get(1 - depth, 0)
        inside, depth = inside != r.flips, depth + r.depth[inside]
    if inside or depth:
        raise ValueError(f"{path}: its strings and brackets do not end")
    parts = stored(pieces.mapInArrow(_cut(begins), "pos long, block long, text string, whole boolean"), "json-parts")
    crossing = parts.filter("not whole").groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("p"))
    crossing = crossing.select("pos", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))
    rows = parts.filter("whole").select("pos", "text").unionByName(crossing).mapInArrow(_members(kind), MEMBER_DDL)
    if kind == "OBJECT":
        again = rows.groupBy("key").agg(F.min("pos").alias("_first"), F.max("pos").alias("_last")).filter("_first < _last")
        rows = rows.join(again, "key", "left").filter("_last is null or pos = _last").select(F.coalesce("_first", "pos").alias("pos"), "key", "value")
    return kind, rows
