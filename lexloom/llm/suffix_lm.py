"""Language-model scores from a probabilistic suffix tree over bytes, and an add-one word model as the base.

A text (A-Z lower-cased) is read as its words [^\\x20\\x09-\\x0D]+ joined by single spaces, and one end symbol. The
tree predicts each byte, and the end, from the longest retained context of up to `depth` bytes before it.

Learning: texts are kept in chunks; each chunk counts its (context, next byte) cells of the full depth in numpy and
deals them to buckets by a hash of the last `LOW` bytes of the context, as compressed arrays. A bucket holds all cells
of its contexts: their sums over the chunks, and every longer context's parents. The short contexts (up to `LOW` bytes)
are summed and learned as DataFrames; then each bucket walks down from them, one level of contexts at a time. A context
that was seen `least` times (a fixed number, whatever the corpus) is retained if its next-symbol distribution diverges
from that of its longest retained shorter context: twice the log-likelihood ratio exceeds `divergence` for each free
symbol. Distributions are smoothed by interpolation with the shorter context's, down to a uniform one, so that every
text has a positive probability. The tree grows with the corpus and is never gathered in one place: a bucket answers
the chunks that asked for its cells, row by row, and a chunk looks its texts up in the answers. `build_tree` is the same
tree in one process, for small tables.

Word counts grow with the corpus: they are summed by a shuffle. The `frequent` commonest words (a bound)
are broadcast; the other words of a document are joined to their counts.

Defined results: a null or empty text is the end alone; without training rows the base is that of N = V = 0 and the
tree is uniform; rows with a null id count as training rows; repeated rows count and are scored each; further
columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window

from .common import crc32_of_id, kept, materialize, words_py
from .wordhash import chunks, mix

#: Symbols: bytes, and the end of a text. Codes of contexts have 9 bits a symbol; PAD stands before a text.
END, PAD, SYMBOLS, BITS = 256, 257, 257, 9
#: Contexts of up to so many bytes are learned as DataFrames, longer ones in buckets by their last LOW bytes.
LOW = 4


def raw_texts(texts: pa.Array) -> list[bytes]:
    """UTF-8 bytes of texts; a null is empty."""
    return [t or b"" for t in texts.cast(pa.large_binary()).to_pylist()]


def symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """Symbols of all texts (each with its end), how many each has, and their words."""
    words = [words_py(t) for t in texts]
    raw = [b" ".join(w) for w in words]
    counts = np.array([len(r) + 1 for r in raw], np.int64)
    out = np.frombuffer(b"\0".join([*raw, b""]), np.uint8).astype(np.int16)
    out[np.cumsum(counts) - 1] = END
    return out, counts, words


def context_codes(sym: np.ndarray, counts: np.ndarray, depth: int) -> np.ndarray:
    """Code of each symbol with the `depth` symbols before it, the latest lowest; PAD before a text."""
    real = np.ones(len(sym) + depth * len(counts), bool)
    starts = np.cumsum(counts) - counts + depth * np.arange(len(counts))
    for k in range(depth):
        real[starts + k] = False
    padded = np.full(len(real), PAD, np.int64)
    padded[real] = sym
    code = padded[depth:].copy()
    for k in range(1, depth + 1):
        code |= padded[depth - k : len(padded) - k] << (BITS * k)
    return code[real[depth:]]


def run_lengths(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and their counts; sorts in place."""
    code.sort()
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    return code[first], np.diff(np.append(first, len(code)))


@dataclass
class Tree:
    """An automaton: step[state, column[symbol]] is the next state, logp[state, column[symbol]] the symbol's log10 probability."""

    step: np.ndarray
    logp: np.ndarray
    column: np.ndarray
    depth: int
    contexts: int

    def walk(self, sym: np.ndarray, stretch: int = 256) -> np.ndarray:
        """log10 probability of each symbol. Stretches that overlap by the depth are walked together."""
        n, d = len(sym), self.depth
        rows = -(-n // stretch)
        grid = np.full(rows * stretch + d, self.column[END], np.int16)
        grid[d : d + n] = self.column[sym]  # before the first text stand ends: an end leads to the root
        out = np.zeros((stretch, rows), np.float32)
        at, width = np.zeros(rows, np.int64), self.step.shape[1]
        step, logp = self.step.ravel(), self.logp.ravel()
        for k in range(stretch + d):
            cell = at * width + grid[k : k + (rows - 1) * stretch + 1 : stretch]
            if k >= d:
                out[k - d] = logp[cell]
            at = step[cell].astype(np.int64)
        return out.T.ravel()[:n]

    def score(self, sym: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 probability of each text."""
        return np.add.reduceat(self.walk(sym).astype(np.float64), np.cumsum(counts) - counts)


def build_tree(k: np.ndarray, code: np.ndarray, n: np.ndarray, depth: int, divergence: float = 4.0) -> Tree:
    """The tree from cells sorted by (k, code): n symbols `code & 511` after the k symbols above it in code."""
    seen = np.unique(code[k == 0] & 511)
    column = np.full(SYMBOLS + 1, len(seen), np.int16)  # symbols that no training text has share a column: they are equally likely
    column[seen] = np.arange(len(seen))
    if END not in seen:
        column[END], seen = len(seen), np.append(seen, END)
        column[np.setdiff1d(np.arange(SYMBOLS), seen)] = len(seen)
    width = len(seen) + 1
    ctx = code >> BITS
    first = np.flatnonzero(np.append(True, (ctx[1:] != ctx[:-1]) | (k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    ends, cols = np.append(first, len(k))[1:], column[code & 511]
    retained: dict[tuple[int, int], np.ndarray] = {(0, 0): np.full(width, 1.0 / SYMBOLS)}
    for a, b in zip(first.tolist(), ends.tolist(), strict=True):
        size, own = int(k[a]), int(ctx[a])
        parent = next(p for j in range(max(size - 1, 0), -1, -1) if (p := retained.get((j, own & ((1 << (BITS * j)) - 1)))) is not None)
        times = n[a:b].astype(float)
        total, kinds, at = times.sum(), b - a, cols[a:b]
        if size and 2 * (times * np.log(times / total / parent[at])).sum() <= divergence * kinds:
            continue
        out = parent * (kinds / (total + kinds))  # Witten-Bell
        out[at] += times / (total + kinds)
        retained[size, own] = out

    def text(size: int, own: int) -> tuple[int, ...]:
        return tuple(own >> (BITS * (size - 1 - i)) & 511 for i in range(size))

    # states: retained contexts and their beginnings, written from the oldest symbol
    strings = {text(*key): key for key in retained}
    states = {s: i for i, s in enumerate(sorted({s[:i] for s in strings if PAD not in s and END not in s for i in range(len(s) + 1)}, key=lambda s: (len(s), s)))}
    step, logp = np.zeros((len(states), width), np.int32), np.zeros((len(states), width), np.float32)
    children: dict[int, list[tuple[int, int]]] = {}
    for s, i in states.items():
        if s:
            children.setdefault(states[s[:-1]], []).append((s[-1], i))
    for s, i in states.items():  # shorter ones first
        if s:
            step[i] = step[next(states[s[j:]] for j in range(1, len(s) + 1) if s[j:] in states)]
        for symbol, child in children.get(i, []):
            step[i, column[symbol]] = child
        step[i, column[END]] = 0
        logp[i] = np.log10(retained[next(strings[s[j:]] for j in range(len(s) + 1) if s[j:] in strings)])
    return Tree(step, logp, column, depth, len(retained))


def pack_rows(batch: pa.RecordBatch) -> bytes:
    """A batch as a compressed stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack_rows(blob: pa.Buffer) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob).read_next_batch()


def in_chunks(rows: DataFrame, block: int = 1 << 24) -> DataFrame:
    """(chunk, trains, texts): some rows (row, doc_id, trains, text) as a compressed stream, how many train, and their chunk.

    A chunk has about `block` bytes of texts; chunks that are not scored are negative. What is stored and shuffled from
    here on are streams of some MB of texts, not rows.
    """

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = 0, TaskContext.get().partitionId() << 32
        for big in batches:
            for batch in chunks(big, 4, 1 << 20):
                size = pc.fill_null(pc.binary_length(batch.column(4)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
                chunk, at, scored = part + at // block, at + int(size.sum()), batch.column(3)
                for own, number in ((batch.filter(scored), chunk), (batch.filter(pc.invert(scored)), ~chunk)):
                    if own.num_rows:
                        trains = pc.sum(own.column(2).cast(pa.int64())).as_py()
                        yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([trains]), pa.array([pack_rows(own.select(["row", "doc_id", "trains", "text"]))], pa.binary())], ["chunk", "trains", "texts"])

    return rows.mapInArrow(tag, "chunk long, trains long, texts binary")


def pack_numbers(x: np.ndarray) -> bytes:
    """Compressed numbers: the bytes of each place together."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def unpack_numbers(blob: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(kind).ravel()


class Sums:
    """Counts by code, merged whenever many have come in: memory follows the distinct codes."""

    def __init__(self, most: int = 1 << 22):
        self.parts, self.held, self.most = [], 0, most

    def add(self, code: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((code, n))
        self.held += len(code)
        if self.held > self.most:
            code, n = self.total()
            self.parts, self.held, self.most = [(code, n)], len(code), max(self.most, 2 * len(code))

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct codes, rising, and their counts."""
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        code, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(code, kind="stable")
        code = code[order]
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else order
        return code[first], np.add.reduceat(n[order], first) if len(code) else n


def bucket_of(context: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of the last LOW bytes of a context."""
    return (mix((context & ((1 << (BITS * LOW)) - 1)).astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def chunk_cells(rows: DataFrame, depth: int, buckets: int) -> DataFrame:
    """(bucket, chunk, codes, n): the cells of the full depth in a chunk, rising, and how often they stand in its training rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, at = Sums(), None

        def counted() -> Iterator[pa.RecordBatch]:
            code, n = sums.total()
            of = bucket_of(code >> BITS, buckets)
            order = np.argsort(of, kind="stable")
            ends = np.cumsum(np.bincount(of, minlength=buckets))
            full = np.flatnonzero(np.diff(ends, prepend=0))
            code, n, starts = code[order], n[order], np.append(0, ends)
            cuts = [(int(b), slice(int(starts[b]), int(ends[b]))) for b in full]
            cols = [pa.array([b for b, _ in cuts], pa.int32()), pa.array(np.full(len(cuts), at)), pa.array([pack_numbers(code[x]) for _, x in cuts], pa.binary()), pa.array([pack_numbers(n[x]) for _, x in cuts], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["bucket", "chunk", "codes", "n"])

        for big in batches:
            for c, blob in zip(big.column(0).to_pylist(), big.column(1), strict=True):
                if c != at:
                    if at is not None:
                        yield from counted()
                    sums, at = Sums(), c
                batch = unpack_rows(blob.as_buffer())
                trains = batch.column(2).to_numpy(zero_copy_only=False)
                sym, counts, _ = symbols(raw_texts(batch.column(3)))
                codes = context_codes(sym, counts, depth)
                for flag in (0, 1):
                    mine = trains == flag
                    if mine.any():
                        code, n = run_lengths(codes.copy() if mine.all() else codes[np.repeat(mine, counts)])
                        sums.add(code, n * flag)
        if at is not None:
            yield from counted()

    return rows.select("chunk", "texts").mapInArrow(count, "bucket int, chunk long, codes binary, n binary")


def bucket_sums(cells: DataFrame) -> DataFrame:
    """(bucket, codes, n): the cells of all chunks, summed as they come in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, at = Sums(), None

        def row() -> pa.RecordBatch:
            code, n = sums.total()
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([pack_numbers(code)], pa.binary()), pa.array([pack_numbers(n)], pa.binary())], ["bucket", "codes", "n"])

        for batch in batches:
            for b, codes, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if b != at:
                    if at is not None:
                        yield row()
                    sums, at = Sums(), b
                sums.add(unpack_numbers(codes.as_buffer(), np.int64), unpack_numbers(n.as_buffer(), np.int64))
        if at is not None:
            yield row()

    return cells.select("bucket", "codes", "n").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "bucket int, codes binary, n binary")


def low_cells(sums: DataFrame) -> DataFrame:
    """(code, n): the cells of contexts of LOW bytes. A bucket has all of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, n in zip(batch.column(0), batch.column(1), strict=True):
                code, total = shorter(unpack_numbers(codes.as_buffer(), np.int64), unpack_numbers(n.as_buffer(), np.int64), LOW)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total)], ["code", "n"])

    return sums.select("codes", "n").mapInArrow(run, "code long, n long")


def shorter(code: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells of contexts of k bytes."""
    sums = Sums()
    sums.add(code & ((1 << (BITS * (k + 1))) - 1), n)
    return sums.total()


def walk_down(code: np.ndarray, n: np.ndarray, low: np.ndarray, p: np.ndarray, depth: int, least: int, divergence: float) -> np.ndarray:
    """Probabilities of the cells of the full depth. low, p: cells of contexts of LOW bytes, rising, and their probabilities."""
    for k in range(LOW + 1, depth + 1):
        own, times = (code, n) if k == depth else shorter(code, n, k)
        q = p[np.searchsorted(low, own & ((1 << (BITS * k)) - 1))]
        if not len(own):
            return q
        context = own >> BITS
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
        size = np.diff(np.append(first, len(own)))
        seen = times > 0
        total, kinds = np.add.reduceat(times, first).astype(float), np.add.reduceat(seen.astype(np.int64), first).astype(float)
        s = np.add.reduceat(np.where(seen, times * np.log(np.maximum(times, 1) / q), 0.0), first)
        ratio = 2 * (s - total * np.log(np.maximum(total, 1)))
        stays = (total >= least) & (ratio > divergence * kinds) & (context[first] >> (BITS * (k - 1)) != PAD)
        total, kinds = np.repeat(total, size), np.repeat(kinds, size)
        mixed = (q * kinds + times) / np.maximum(total + kinds, 1)  # Witten-Bell
        low, p = own, np.where(np.repeat(stays, size), mixed, q)
    return p


def answers(sums: DataFrame, base: DataFrame, asked: DataFrame, depth: int, buckets: int, least: int = 2, divergence: float = 4.0) -> DataFrame:
    """(chunk, codes, logp): log10 probabilities of the cells that the chunks ask for.

    A bucket's rows come in order: its short contexts (base: code, p), its cells, and then the chunks' questions, of
    which one at a time is in memory.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(batch.column(0).to_numpy() >> BITS, buckets)), *batch.columns], ["bucket", "code", "p"])

    none = F.lit(None)
    low = base.mapInArrow(place, "bucket int, code long, p double").select("bucket", F.lit(0).alias("kind"), none.cast("long").alias("chunk"), "code", "p", none.cast("binary").alias("x"), none.cast("binary").alias("y"))
    own = sums.select("bucket", F.lit(1), none, none, none, "codes", "n")
    questions = asked.filter("chunk >= 0").select("bucket", F.lit(2), "chunk", none, none, "codes", none)
    rows = low.union(own).union(questions).repartition("bucket").sortWithinPartitions("bucket", "kind", "code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: list[np.ndarray] = []
        p: list[np.ndarray] = []
        code, logp, at = np.zeros(0, np.int64), np.zeros(0, np.float32), None
        for batch in batches:
            bucket, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (kind[1:] != kind[:-1]))) if len(bucket) else []
            for a, b in zip(cuts, np.append(cuts, len(bucket))[1:], strict=True):
                if bucket[a] != at:
                    low, p, at = [], [], bucket[a]
                if kind[a] == 0:
                    low.append(batch.column(3)[a:b].to_numpy())
                    p.append(batch.column(4)[a:b].to_numpy())
                    continue
                for i in range(a, b):
                    x = unpack_numbers(batch.column(5)[i].as_buffer(), np.int64)
                    if kind[a] == 1:
                        n = unpack_numbers(batch.column(6)[i].as_buffer(), np.int64)
                        code, logp = x, np.log10(walk_down(x, n, np.concatenate(low), np.concatenate(p), depth, least, divergence)).astype(np.float32)
                    else:
                        blob = pack_numbers(logp[np.searchsorted(code, x)])
                        yield pa.RecordBatch.from_arrays([batch.column(2)[i : i + 1], batch.column(5)[i : i + 1], pa.array([blob], pa.binary())], ["chunk", "codes", "logp"])

    return rows.mapInArrow(run, "chunk long, codes binary, logp binary")


class Lookup:
    """Values by code, in hash tables: codes whose place another one took go to the next, smaller table."""

    def __init__(self, code: np.ndarray, value: np.ndarray):
        self.code, self.value, self.tables = code, value, []
        left = np.arange(len(code))
        while len(left):
            bits = max(4, int(4 * len(left) - 1).bit_length())
            odd, table = np.uint64(0x9E3779B97F4A7C15 + 2 * len(self.tables)), np.zeros(1 << bits, np.int32)
            place = self._place(code[left], odd, bits)
            table[place] = left
            self.tables.append((odd, bits, table))
            left = left[table[place] != left]

    @staticmethod
    def _place(code: np.ndarray, odd: np.uint64, bits: int) -> np.ndarray:
        x = code.view(np.uint64)
        return ((x ^ (x >> np.uint64(31))) * odd) >> np.uint64(64 - bits)

    def get(self, code: np.ndarray) -> np.ndarray:
        """Values of codes, all of which are known."""
        out, left = np.empty(len(code), np.float64), None
        for odd, bits, table in self.tables:
            own = code if left is None else code[left]
            at = table[self._place(own, odd, bits)]
            hit = self.code[at] == own
            if left is None:
                out[:] = self.value[at]
                left = np.flatnonzero(~hit)
            else:
                out[left[hit]] = self.value[at[hit]]
                left = left[~hit]
            if not len(left):
                return out
        if left is None or len(left):
            raise KeyError("a code without an answer")
        return out


def learn(full: DataFrame, depth: int, least: int = 2, divergence: float = 4.0) -> DataFrame:
    """(code, p): the probability of each cell's symbol after its longest retained context of at most `depth` bytes.

    full: (code, n), distinct cells of contexts of `depth` bytes and how often they stand in training rows (0: in others alone).
    """
    levels = [full]
    for k in range(depth - 1, -1, -1):
        shorter = levels[-1].groupBy(F.col("code").bitwiseAND(F.lit((1 << (BITS * (k + 1))) - 1)).alias("code")).agg(F.sum("n").alias("n"))
        levels.append(materialize(shorter, f"cells-{k}"))
    tree = None
    for k, cells in enumerate(reversed(levels)):
        if tree is None:
            cells = cells.withColumn("q", F.lit(1.0 / SYMBOLS))
        else:
            parents = tree.select(F.col("code").alias("up"), F.col("p").alias("q"))
            cells = cells.withColumn("up", F.col("code").bitwiseAND(F.lit((1 << (BITS * k)) - 1))).join(parents, "up").drop("up")
        of = Window.partitionBy(F.shiftright("code", BITS))  # a context has at most 257 symbols
        cells = cells.select(
            "code", "n", "q",
            F.sum("n").over(of).alias("total"),
            F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).over(of).alias("kinds"),
            F.sum(F.when(F.col("n") > 0, F.col("n") * F.ln(F.col("n") / F.col("q"))).otherwise(0.0)).over(of).alias("s"),
        )
        ratio = 2 * (F.col("s") - F.col("total") * F.ln("total"))
        stays = (F.col("total") >= least) & (ratio > divergence * F.col("kinds")) & (F.shiftright("code", BITS * k) != PAD) if k else F.col("total") > 0
        mixed = (F.col("q") * F.col("kinds") + F.col("n")) / (F.col("total") + F.col("kinds"))  # Witten-Bell
        tree = cells.select("code", F.when(stays, mixed).otherwise(F.col("q")).alias("p"))
        if k < depth:
            tree = materialize(tree, f"tree-{k}")
    return tree


def held_out(id_col: str = "doc_id"):
    """Rows that learning leaves out."""
    return crc32_of_id(F.col(id_col)) % 7 == 2


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, c): words of all training rows of in_chunks(); counted per task before they are shuffled."""

    def found(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "c"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for big in batches:
            for blob in big.column(0):
                batch = unpack_rows(blob.as_buffer())
                for t in raw_texts(batch.column(3).filter(batch.column(2))):
                    held.update(words_py(t))
                    if len(held) > 1_000_000:
                        yield found(held)
                        held = Counter()
        yield found(held)

    return rows.filter("trains > 0").select("texts").mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def flagged(docs: DataFrame, id_col: str, text_col: str, trains: Column, scored: bool) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), trains.alias("trains"), F.lit(scored).alias("scored"), F.col(text_col).alias("text"))


def score(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of docs."""
    return score_flagged(flagged(docs, id_col, text_col, F.lit(False), True).union(flagged(train, id_col, text_col, F.lit(True), False)), **options)


def score_flagged(rows: DataFrame, frequent: int = 100_000, depth: int = 6, block: int = 1 << 25, buckets: int = 512, **options) -> DataFrame:
    """Scores of the rows that are `scored`, learned from those that are `trains`."""
    if not LOW < depth <= 6:
        raise ValueError(f"depth must lie between {LOW + 1} and 6: a code has 63 bits")
    spark = rows.sparkSession
    rows = materialize(in_chunks(rows.select(F.monotonically_increasing_id().alias("row"), "*"), block), "chunks", compression="none")
    # the chunks are written, so that their cells, held compressed, are the same however often they are computed
    asked = kept(chunk_cells(rows, depth, buckets))
    sums = kept(bucket_sums(asked))
    base = materialize(learn(low_cells(sums), LOW, **options), "short-contexts")
    found = answers(sums, base, asked, depth, buckets, **options)
    counts = materialize(word_counts(rows), "word-counts")
    n_docs = rows.agg(F.coalesce(F.sum("trains"), F.lit(0))).first()[0]
    words, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = words + n_docs, kinds + (1 if n_docs else 0)
    # the commonest words, at most `frequent`: from the count on that no more words reach
    by = dict(counts.filter("c > 1").groupBy(F.least("c", F.lit(100_000)).alias("c")).agg(F.count(F.lit(1)).alias("k")).collect())  # at most 100,000 rows
    least, room = 100_001, frequent
    for c in sorted(by, reverse=True):
        if by[c] > room:
            break
        room, least = room - by[c], c
    top = counts.filter(F.col("c") >= least).toArrow()
    known = dict(zip(top.column("word").cast(pa.binary()).to_pylist(), top.column("c").to_pylist(), strict=True))
    shared = spark.sparkContext.broadcast(known)
    log_all, end_count = float(np.log10(n + v + 1)), n_docs

    def scored(batch: pa.RecordBatch, look: Lookup) -> pa.RecordBatch:
        common = shared.value
        sym, sizes, doc_words = symbols(raw_texts(batch.column(3)))
        scores = np.add.reduceat(look.get(context_codes(sym, sizes, depth)), np.cumsum(sizes) - sizes)
        per = np.array([len(w) for w in doc_words], np.int64)
        flat = [w for own in doc_words for w in own]
        c = np.array([common.get(w, 0) for w in flat], np.float64)
        doc = np.repeat(np.arange(len(per)), per)
        sums = np.bincount(doc, np.log10(c + 1), minlength=len(per)) + np.log10(end_count + 1)
        seen = np.bincount(doc, c > 0, minlength=len(per)).astype(np.int64) + (end_count > 0)
        rare = np.flatnonzero(c == 0)
        cuts = pa.array(np.append(0, np.cumsum(np.bincount(doc[rare], minlength=len(per)))).astype(np.int32))
        names = pa.ListArray.from_arrays(cuts, pa.array([flat[i] for i in rare.tolist()], pa.binary()).cast(pa.string()))
        cols = [batch.column(0), batch.column(1), pa.array(per + 1), pa.array(seen), pa.array(sums), pa.array(scores), names]
        return pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "n_tokens", "n_known", "s", "score", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, look = None, [], None
        for big in batches:
            for c, x, y in zip(big.column(0).to_pylist(), big.column(1), big.column(2), strict=True):
                if c != at:
                    at, parts, look = c, [], None
                if y.is_valid:  # the answers of a chunk come before its texts
                    parts.append((unpack_numbers(x.as_buffer(), np.int64), unpack_numbers(y.as_buffer(), np.float32)))
                    continue
                if look is None:
                    code, logp = (np.concatenate(z) for z in zip(*parts, strict=True))
                    code, first = np.unique(code, return_index=True)  # a chunk read by two tasks asks twice
                    look, parts = Lookup(code, logp[first]), []
                yield scored(unpack_rows(x.as_buffer()), look)

    texts = rows.filter("chunk >= 0").select("chunk", F.col("texts").alias("x"), F.lit(None).cast("binary").alias("y"), F.lit(1).alias("kind"))
    both = texts.union(found.select("chunk", "codes", "logp", F.lit(0))).repartition("chunk").sortWithinPartitions("chunk", "kind").drop("kind")
    schema = "row long, doc_id long, n_tokens long, n_known long, s double, score double, words array<string>"
    rows = materialize(both.mapInArrow(run, schema), "scores", compression="zstd")
    # the other words of a document meet their counts; a word without one adds log10(1) = 0
    rare = rows.select("row", F.explode("words").alias("word"))
    found = rare.join(counts.filter(F.col("c") < least), "word").groupBy("row").agg(F.count(F.lit(1)).alias("known"), F.sum(F.log10(F.col("c") + 1)).alias("s2"))
    out = rows.select("row", "doc_id", "n_tokens", "n_known", "s", "score").join(found, "row", "left")
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("s") + F.coalesce("s2", F.lit(0.0)) - F.col("n_tokens") * F.lit(log_all)).alias("base_score"),
        "score",
    )


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Scores of all documents, learned from those that are not held out."""
    out = score_flagged(flagged(docs, id_col, text_col, ~held_out(id_col), True), **options)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
