"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

Words are runs of letters and digits (bytes from 128 on count as letters), A-Z lower-cased. A window of as many words
as an item has gets a 64-bit fingerprint: each word votes on every bit with the length of the word. Fingerprints of
the items of one size are indexed by b blocks of bits: of two fingerprints at most `radius` bits apart, some block
differs in at most radius // b bits, so looking up every block of a window and its variants that far away finds every
item within the radius. The more items, the fewer and wider the blocks (4 blocks of 16 bits and variants of 3 bits from
some thousand items on: 4 % of the items are compared). Those found are verified exactly: the weighted similarity (sum
of the lesser over sum of the greater weighted counts) of their runs of five words, weighted by length in bytes, must
reach `least`.

A window that holds no run of five words of any item cannot be similar, so fingerprints are made for the windows
around such runs alone; this loses nothing. An item of fewer than five words is one run, which a window must equal.
Items are handled in blocks of a bounded number and size, one at a time, each broadcast.

Defined results: a null or empty text, and an item without words, text or id, match nothing; a text shorter than an
item is one window; of several windows that match an item, the most similar (then the first) is returned; repeated
rows are matched each; equal items match each; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import held, materialize
from .wordhash import LETTERS, chunks, lower, mix, utf8, word_bounds, word_hashes

K = 5
#: Items, and bytes of them, whose index is broadcast at once.
ITEMS, ITEM_BYTES = 10_000, 8_000_000
MATCH = "doc_id long, item_id long, start_word int, n_words int, hamming int, similarity double"


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and length of each word, and how many words each text has."""
    buf, offsets = utf8(texts)
    buf = lower(buf)
    starts, ends, counts = word_bounds(buf, offsets, LETTERS)
    return word_hashes(buf, starts, ends), ends - starts, counts


def runs(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of all runs of k words; runs across texts are the caller's to leave out."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mix(out) + words[i : i + n]
    return mix(out)


def fingerprints(words: np.ndarray, lengths: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """64-bit fingerprints of the windows [start, start + n)."""
    votes = (np.unpackbits(mix(words).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1) * lengths[:, None].astype(np.int32)
    total = np.concatenate([np.zeros((1, 64), np.int64), np.cumsum(votes, axis=0, dtype=np.int64)])
    bits = total[np.minimum(starts + n, len(words))] - total[starts] > 0
    return np.packbits(bits, axis=1).view(np.uint64).ravel()


def variants(width: int, most: int) -> np.ndarray:
    """All numbers of `width` bits with at most `most` ones."""
    return np.array([sum(1 << i for i in on) for k in range(most + 1) for on in combinations(range(width), k)], np.uint64)


class HammingIndex:
    """Finds all stored fingerprints within a radius, by blocks of bits and their near variants."""

    def __init__(self, values: np.ndarray, radius: int, blocks: int | None = None):
        self.values, self.radius = values, radius
        # blocks some log2(number of values) bits wide, at most 16: then a variant meets about one value by chance
        blocks = blocks or -(-64 // min(16, max(4, int(np.log2(max(len(values), 1))))))
        cuts = np.linspace(0, 64, blocks + 1).astype(int)
        self.tables = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            key = (values >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)
            order = np.argsort(key, kind="stable")
            self.tables.append((a, b - a, variants(b - a, radius // blocks), order, np.searchsorted(key[order], np.arange((1 << (b - a)) + 1).astype(np.uint64))))

    def search(self, queries: np.ndarray, at_once: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, value, distance) of all pairs within the radius. Lookups and pairs are made in slices of about `at_once`."""
        found = [np.zeros(0, np.int64)]
        for shift, width, near, order, first in self.tables:
            rows = max(1, at_once // len(near))
            for a in range(0, len(queries), rows):
                own = queries[a : a + rows]
                key = ((((own >> np.uint64(shift)) & np.uint64((1 << width) - 1))[:, None] ^ near).astype(np.int64)).ravel()
                n = first[key + 1] - first[key]
                ends = np.cumsum(n)
                i = 0
                while i < len(n):
                    before = int(ends[i - 1]) if i else 0
                    j = max(i + 1, int(np.searchsorted(ends, before + at_once, "right")))
                    m = n[i:j]
                    at = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[key[i:j]], m)
                    q, v = np.repeat(np.arange(i, j) // len(near) + a, m), order[at]
                    ok = np.bitwise_count(queries[q] ^ self.values[v]) <= self.radius
                    found.append(q[ok] * len(self.values) + v[ok])
                    i = j
        pairs = np.unique(np.concatenate(found))
        q, v = pairs // max(1, len(self.values)), pairs % max(1, len(self.values))
        return q, v, np.bitwise_count(queries[q] ^ self.values[v]).astype(np.int64)


def weighted_runs(words: np.ndarray, lengths: np.ndarray) -> dict[int, int]:
    """Weighted counts of the runs of K words."""
    out: dict[int, int] = {}
    total = np.concatenate([[0], np.cumsum(lengths)])
    for r, w in zip(runs(words).tolist(), (total[K:] - total[:-K]).tolist() if len(words) >= K else [], strict=True):
        out[r] = out.get(r, 0) + w
    return out


def similarity(a: dict[int, int], b: dict[int, int]) -> float:
    """Weighted Jaccard similarity."""
    common = sum(min(w, b[r]) for r, w in a.items() if r in b)
    both = sum(a.values()) + sum(b.values()) - common
    return common / both if both else 0.0


class Items:
    """The index of a block of items."""

    def __init__(self, ids: list[int], texts: pa.Array, radius: int):
        words, lengths, counts = words_of(texts)
        ends = np.cumsum(counts)
        self.ids, self.words, self.lengths = [], [], []
        self.short: dict[int, dict[int, list[int]]] = {}  # size -> run -> items of fewer than K words
        for i, (e, n) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
            if 0 < n < K and ids[i] is not None:
                self.short.setdefault(n, {}).setdefault(int(runs(words[e - n : e], n)[0]), []).append(ids[i])
            elif n >= K and ids[i] is not None:
                self.ids.append(ids[i])
                self.words.append(words[e - n : e])
                self.lengths.append(lengths[e - n : e])
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        own = [runs(w) for w in self.words]
        pairs = np.unique(np.stack([np.concatenate(own), np.repeat(self.sizes, [len(r) for r in own]).astype(np.uint64)], axis=1), axis=0) if own else np.zeros((0, 2), np.uint64)
        self.runs, first = np.unique(pairs[:, 0], return_index=True)
        self.run_sizes = np.split(pairs[:, 1].astype(np.int64), first[1:]) if len(first) else []  # sizes of the items that hold a run
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.runs >> np.uint64(44)).astype(np.int64)] = True
        self.by_size = {}
        for n in np.unique(self.sizes).tolist():
            which = np.flatnonzero(self.sizes == n)
            values = np.array([fingerprints(self.words[i], self.lengths[i], np.zeros(1, np.int64), n)[0] for i in which], np.uint64)
            self.by_size[n] = (which, HammingIndex(values, radius))
        self.weighted = [weighted_runs(w, x) for w, x in zip(self.words, self.lengths, strict=True)]

    def anchors(self, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions (over all texts) of runs that items hold, and their numbers."""
        if not len(self.runs):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        r = runs(words)
        at = np.flatnonzero(self.maybe[(r >> np.uint64(44)).astype(np.int64)])
        ends = np.cumsum(counts)
        at = at[at + K <= ends[np.searchsorted(ends, at, "right")]] if len(at) else at
        number = np.minimum(np.searchsorted(self.runs, r[at]), len(self.runs) - 1)
        hit = self.runs[number] == r[at]
        return at[hit], number[hit]

    def match(self, words: np.ndarray, lengths: np.ndarray, at: np.ndarray, number: np.ndarray, least: float) -> list[tuple[int, int, int, int, float]]:
        """(item_id, start, n, hamming, similarity) of one text; at, number: its anchors."""
        best: dict[int, tuple[float, int, int, int]] = {}
        sizes: dict[int, list[int]] = {}
        for a, i in zip(at.tolist(), number.tolist(), strict=True):
            for n in self.run_sizes[i].tolist():
                sizes.setdefault(n, []).append(a)
        for n, places in sizes.items():
            last = max(0, len(words) - n)
            mark = np.zeros(len(words) + 1, np.int32)
            p = np.array(places)
            np.add.at(mark, np.clip(p - (n - K), 0, last), 1)
            np.add.at(mark, np.minimum(p, last) + 1, -1)
            starts = np.flatnonzero(np.cumsum(mark)[: last + 1] > 0)
            which, index = self.by_size[n]
            low = int(starts[0])
            high = min(len(words), int(starts[-1]) + n)
            queries, values, distance = index.search(fingerprints(words[low:high], lengths[low:high], starts - low, n))
            for q, v, d in zip(queries.tolist(), values.tolist(), distance.tolist(), strict=True):
                s, item = int(starts[q]), int(which[v])
                sim = similarity(weighted_runs(words[s : s + n], lengths[s : s + n]), self.weighted[item])
                if sim >= least and (item not in best or (-sim, s) < (-best[item][0], best[item][1])):
                    best[item] = (sim, s, min(n, len(words)), d)
        return [(self.ids[i], s, n, d, sim) for i, (sim, s, n, d) in sorted(best.items())]


def short_matches(items: Items, words: np.ndarray, counts: np.ndarray) -> list[tuple[int, tuple[int, int, int, int, float]]]:
    """(row, match) of items of fewer than K words: the first place of each in each text."""
    ends, out = np.cumsum(counts), []
    for n, by_run in items.short.items():
        wanted = np.array(sorted(by_run), np.uint64)
        r = runs(words, n)
        at = np.flatnonzero(np.isin(r, wanted))
        rows = np.searchsorted(ends, at, "right")
        inside = at + n <= ends[rows] if len(at) else np.zeros(0, bool)
        seen: set[tuple[int, int]] = set()
        for row, a in zip(rows[inside].tolist(), at[inside].tolist(), strict=True):
            run = int(r[a])
            if (row, run) not in seen:
                seen.add((row, run))
                out += [(row, (item, int(a - ends[row] + counts[row]), n, 0, 1.0)) for item in by_run[run]]
    return out


def find(items: Items, batch: pa.RecordBatch, text: int, least: float) -> list[tuple[int, tuple[int, int, int, int, float]]]:
    """(row of the batch, match) for all matches of a batch."""
    words, lengths, counts = words_of(batch.column(text))
    at, number = items.anchors(words, counts)
    out, ends = short_matches(items, words, counts), np.cumsum(counts)
    rows = np.searchsorted(ends, at, "right")
    for row in np.unique(rows).tolist():
        own, a, b = rows == row, int(ends[row] - counts[row]), int(ends[row])
        out += [(row, m) for m in items.match(words[a:b], lengths[a:b], at[own] - a, number[own], least)]
    return out


def item_blocks(benchmark: DataFrame, radius: int, id_col: str, text_col: str) -> tuple[int, Iterator[Items]]:
    """How many blocks of items there are, and their indexes, made one at a time."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).filter("t is not null")
    number, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    n = max(1, -(-number // ITEMS), -(-size // ITEM_BYTES))

    def each() -> Iterator[Items]:
        for b in range(n):
            got = rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).orderBy("i", "t").toArrow()
            if got.num_rows:
                yield Items(got.column("i").to_pylist(), got.column("t").combine_chunks(), radius)

    return n, each()


def contamination(docs: DataFrame, benchmark: DataFrame, radius: int = 15, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, start_word, n_words, hamming, similarity of every document and item that match."""
    spark, rows = docs.sparkSession, docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n, blocks = item_blocks(benchmark, radius, item_id, item_text)
    out = None
    for items in blocks:
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held(None)
            for big in batches:
                for batch in chunks(big, 1, 1 << 20):
                    if got := find(shared.value, batch, 1, least):
                        row, match = zip(*got, strict=True)
                        item, start, size, distance, sim = zip(*match, strict=True)
                        cols = [batch.column(0).take(pa.array(row)), pa.array(item, pa.int64()), pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(distance, pa.int32()), pa.array(sim, pa.float64())]
                        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "start_word", "n_words", "hamming", "similarity"])

        own = rows.mapInArrow(run, MATCH)
        if n > 1:  # a block's matches are written and its index is given up before the next one's
            own = materialize(own, "matches")
            shared.unpersist()
        out = own if out is None else out.unionByName(own)
    return out if out is not None else spark.createDataFrame([], MATCH)


def clean(docs: DataFrame, benchmark: DataFrame, radius: int = 15, least: float = 0.8, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that match no item. No shuffle."""
    n, blocks = item_blocks(benchmark, radius, item_id, item_text)
    for items in blocks:
        shared, at = docs.sparkSession.sparkContext.broadcast(items), docs.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, at=at) -> Iterator[pa.RecordBatch]:
            held(None)
            for big in batches:
                for batch in chunks(big, at, 1 << 20):
                    keep = np.ones(batch.num_rows, bool)
                    keep[[row for row, _ in find(shared.value, batch, at, least)]] = False
                    yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
        if n > 1:
            docs = materialize(docs, "clean")
            shared.unpersist()
    return docs
