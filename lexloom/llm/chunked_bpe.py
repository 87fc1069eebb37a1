"""Byte-level BPE of texts that are pre-tokenised in overlapping chunks; decoding joins the bytes of the ids.

    cut      a text is cut every CHUNK characters, and each chunk starts OVERLAP characters before its cut and ends as far behind the
             next: a row each, so that the chunks of a long text are worked on by many tasks
    match    each chunk is pre-tokenised on its own. The pattern looks ahead, never back: two passes that share one boundary
             share all that follow, up to what the end of the chunk may have changed
    stitch   a chunk hands over to the next at the first boundary that both have in their common stretch; neighbours are
             joined by their numbers, and only the boundaries in that stretch are shuffled
    encode   each chunk's pieces between its two hand-overs are encoded, equal pieces once
    digest   a text's ids are hashed in order, and so are the bytes that they stand for. SHA-256 has no parallel form, so a text passes one task, as a
             stream of chunks

Where two chunks share no boundary (one run of letters or white space is longer than the overlap), they are handed on as text,
joined, and encoded together: that run is a single piece or few, which nothing can split. Texts of one chunk take the same
pattern and pieces where they are read, without a shuffle.

Defined results: a null text is empty, without ids; rows of one id, and null ids, are encoded each on its own; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import regex
from pyspark.sql import DataFrame

from .common import give_back, held, materialize

#: Characters of a chunk between its cuts, and beyond either of them.
CHUNK, OVERLAP = 1 << 14, 256
#: Characters before the end of a chunk whose matches the missing text could change: a contraction looks at three.
AHEAD = 4
#: Bytes of a piece from which on it is not kept, and bytes of pieces that are kept with their ids.
LONG, HELD_BYTES = 512, 1 << 24


def default_path() -> str:
    """The public byte-level BPE ranks of 50,256 tokens."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Codec(dict):
    """Pieces to their ids as little-endian 32-bit numbers; pieces met before are looked up, up to HELD_BYTES of them."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.single = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})._core_bpe.encode_single_piece
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.pattern, self.size = regex.compile(pattern), 0

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        out = np.array(self.single(raw), "<u4").tobytes()
        self.size += len(raw) + len(out) + 150
        if self.size > HELD_BYTES:
            self.clear()
            self.size = len(raw) + len(out) + 150
        if len(raw) < LONG:
            self[piece] = out
        return out

    def encode(self, text: str, begin: int = 0, end: int | None = None) -> bytes:
        """Ids of the pieces from one boundary to another. The text beyond decides where the last of them ends."""
        pieces = self.pattern.findall(text, begin)
        beyond = 0 if end is None else len(text) - end
        while beyond > 0:
            beyond -= len(pieces.pop())
        return b"".join(map(self.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def trusted(text: str, ends: list[int], last: bool) -> list[int]:
    """Of the boundaries of a chunk those that no text after it can change; all of its text's last chunk."""
    if last:
        return ends
    solid = len(text.rstrip())  # white space up to the end may go on
    return [e for e in ends if e <= len(text) - AHEAD and e < solid]


def _codec(path: str, pattern: str) -> Codec:
    return held(f"codec {path}", lambda: Codec(path, pattern))


#: A chunk: its text's row, its number, whether it is the last, its start and text; then its boundaries near both cuts, as places in the text.
PARTS = pa.schema([("_row", pa.int64()), ("k", pa.int64()), ("last", pa.bool_()), ("start", pa.int64()), ("text", pa.string())])
PARTS_DDL = "_row long, k long, last boolean, start long, text string"
MATCHED = pa.schema([*PARTS, ("head", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64()))])
MATCHED_DDL = f"{PARTS_DDL}, head array<long>, tail array<long>"
#: ids of a chunk, and, where one of its text's hand-overs is missing, its text and whether it goes on in its neighbours.
IDS = pa.schema([("_row", pa.int64()), ("k", pa.int64()), ("last", pa.bool_()), ("ids", pa.binary()), ("text", pa.string()), ("joins_left", pa.bool_()), ("joins_right", pa.bool_())])
IDS_DDL = "_row long, k long, last boolean, ids binary, text string, joins_left boolean, joins_right boolean"
RESULT = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
RESULT_DDL = "n_tokens long, ids_sha256 string, decoded_sha256 string"

Batches = Iterator[pa.RecordBatch]


def _cut(chunk: int, overlap: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for b in batches:
            for row, value in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = value.as_py()
                for k in range(n := -(-len(text) // chunk)):
                    start = max(0, k * chunk - overlap)
                    yield pa.record_batch([[row], [k], [k == n - 1], [start], [text[start : (k + 1) * chunk + overlap]]], schema=PARTS)

    return run


def _match(path: str, pattern: str, chunk: int, overlap: int) -> Callable[[Batches], Batches]:
    """Pre-tokenises chunks."""

    def run(batches: Batches) -> Batches:
        codec = _codec(path, pattern)
        for b in batches:
            head, tail = [], []
            for r in b.select(["k", "last", "start", "text"]).to_pylist():
                ends = [m.end() for m in codec.pattern.finditer(r["text"])]
                at = [r["start"] + e for e in trusted(r["text"], ends, r["last"])]
                cut, following = r["k"] * chunk, (r["k"] + 1) * chunk
                head.append([r["start"], *(e for e in at if e <= cut + overlap)] if r["k"] else [])
                tail.append([] if r["last"] else [e for e in at if e >= following - overlap])
            yield pa.record_batch([*b.columns, pa.array(head, MATCHED.field("head").type), pa.array(tail, MATCHED.field("tail").type)], schema=MATCHED)

    return run


def _encode(path: str, pattern: str, chunk: int) -> Callable[[Batches], Batches]:
    """Ids of chunks between their hand-overs; without one, a chunk ends at its cut and its neighbour begins there."""

    def run(batches: Batches) -> Batches:
        codec = _codec(path, pattern)
        for b in batches:
            for r in b.to_pylist():
                left, right = r["k"] > 0 and r["begin"] is None, not r["last"] and r["finish"] is None
                a = r["k"] * chunk if left else r["begin"] or 0
                a, z = a - r["start"], None if r["last"] else ((r["k"] + 1) * chunk if right else r["finish"]) - r["start"]
                ids = None if left or right else codec.encode(r["text"], a, z)
                yield pa.record_batch([[r["_row"]], [r["k"]], [r["last"]], [ids], [r["text"][a:z] if r["torn"] else None], [left], [right]], schema=IDS)

    return run


class Hashes:
    """Hashes of ids and of their bytes, fed in order."""

    def __init__(self, codec: Codec):
        self.codec, self.n, self.ids, self.decoded = codec, 0, hashlib.sha256(), hashlib.sha256()

    def add(self, ids: bytes) -> None:
        self.n += len(ids) // 4
        self.ids.update(ids)
        self.decoded.update(self.codec.decode(ids))

    def row(self) -> tuple[int, str, str]:
        return self.n, self.ids.hexdigest(), self.decoded.hexdigest()


def _result(rows: list[tuple], key: str, kind: pa.DataType) -> pa.RecordBatch:
    schema = pa.schema([(key, kind), *RESULT])
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _digest(path: str, pattern: str) -> Callable[[Batches], Batches]:
    """Chunks of texts in order to a row a text."""

    def run(batches: Batches) -> Batches:
        codec = _codec(path, pattern)
        now, waiting = Hashes(codec), []  # waiting: text from a boundary on whose pieces are not known
        for b in batches:
            for r in b.to_pylist():
                joined = r["joins_left"]
                if waiting and not joined:
                    # a hand-over behind a missing one: it holds if the pieces from the last one on end there
                    before = "".join(waiting)
                    both = before + r["text"]
                    ends = trusted(both, [m.end() for m in codec.pattern.finditer(both)], r["last"] and not r["joins_right"])
                    at = bisect_left(ends, len(before))
                    joined = not (at < len(ends) and ends[at] == len(before))
                    if not joined:
                        now.add(codec.encode(both, 0, len(before)))
                        waiting = []
                if joined or r["joins_right"]:
                    waiting.append(r["text"])
                else:
                    now.add(r["ids"])
                if r["last"]:
                    if waiting:
                        now.add(codec.encode("".join(waiting)))
                    yield _result([(r["_row"], *now.row())], "_row", pa.int64())
                    now, waiting = Hashes(codec), []

    return run


def _short(path: str, pattern: str, key: str) -> Callable[[Batches], Batches]:
    """Texts of one chunk."""

    def run(batches: Batches) -> Batches:
        codec = _codec(path, pattern)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                one = Hashes(codec)
                one.add(codec.encode(text.as_py() or ""))
                rows.append((doc, *one.row()))
            if rows:
                yield _result(rows, key, b.schema.field(0).type)
        give_back()

    return run


def encode_decode(docs: DataFrame, path: str | None = None, pattern: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id") -> DataFrame:
    """A row (id_col, n_tokens, ids_sha256, decoded_sha256) for each text: the count and the hash of its ids, and the hash of what they decode to.

    path, pattern: a file of ranks, which each executor has at that place, and the pattern of its pieces. chunk, overlap: see the module.
    """
    if chunk < 2 * overlap:
        raise ValueError("chunk must be two overlaps at least")
    path, pattern = path or default_path(), pattern or default_pattern()
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col), F.col("text"))
    is_long = F.coalesce(F.char_length("text") > chunk, F.lit(False))
    short = docs.filter(~is_long).mapInArrow(_short(path, pattern, id_col), f"`{id_col}` {kind}, {RESULT_DDL}")
    # the ids of long texts, with a number for each row; the chunks carry the number alone
    long = materialize(docs.filter(is_long).withColumn("_row", F.monotonically_increasing_id()), "long-texts")
    parts = long.select("_row", "text").mapInArrow(_cut(chunk, overlap), PARTS_DDL).repartition("_row", "k")
    parts = materialize(parts.mapInArrow(_match(path, pattern, chunk, overlap), MATCHED_DDL), "chunks")
    heads = parts.filter("k > 0").select("_row", "k", "head")
    tails = parts.filter("not last").select("_row", (F.col("k") + 1).alias("k"), "tail")
    cuts = heads.join(tails, ["_row", "k"]).select("_row", "k", F.array_min(F.array_intersect("head", "tail")).alias("at"))
    sides = cuts.select("_row", "k", F.col("at").alias("begin"), F.lit(None).cast("long").alias("finish"), F.col("at").isNull().alias("torn"))
    sides = sides.unionByName(cuts.select("_row", (F.col("k") - 1).alias("k"), F.lit(None).cast("long").alias("begin"), F.col("at").alias("finish"), F.col("at").isNull().alias("torn")))
    sides = sides.groupBy("_row", "k").agg(F.max("begin").alias("begin"), F.max("finish").alias("finish"))
    torn = cuts.filter("at is null").select("_row", F.lit(True).alias("torn")).distinct()
    sides = sides.join(torn, "_row", "left").select("_row", "k", "begin", "finish", F.coalesce("torn", F.lit(False)).alias("torn"))
    chunks = parts.drop("head", "tail").join(sides, ["_row", "k"], "left")
    ids = chunks.mapInArrow(_encode(path, pattern, chunk), IDS_DDL)
    done = ids.repartition("_row").sortWithinPartitions("_row", "k").mapInArrow(_digest(path, pattern), f"_row long, {RESULT_DDL}")
    return short.unionByName(long.select("_row", id_col).join(done, "_row").drop("_row"))
