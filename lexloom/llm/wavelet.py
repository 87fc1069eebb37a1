"""Token ids as one wavelet matrix per shard: compressed bit-planes with rank and select.

A shard holds the ids of consecutive documents (in order of doc_id) in one binary blob of the format below; ids can
be read, counted and looked up from it without the others. Shards are rows of a Parquet table that Spark's writer
commits, so they reach any store and survive lost executors; `WaveletMatrix.from_bytes` also reads a blob from a
plain file.

Format, little-endian: magic "LWM1"; uint32 header size; a JSON header {n, levels, zeros, docs, nulls, block, sizes},
nulls being how many documents, the first ones, have no doc_id; then, each zstd-compressed: the doc_ids (int64), the number of ids of each document (uint32), and for each level
its bit-plane in blocks of `block` bytes. Cumulated ones before each block are kept in the header's `ones`.

Defined results: a null text is an empty one, of the end id alone; documents of equal doc_id lie side by side,
ordered by their text's hash; those without doc_id stand before all others; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window

from .common import shared_dir
from .tokens import default_path, encoder

MAGIC = b"LWM1"
BLOCK = 1 << 15
SHARDS = "part int, seq int, first_doc long, n_docs long, n_tokens long, blob binary"


class WaveletMatrix:
    """Ids with access, rank, select, counts and occurrences. Planes are decompressed block by block, when needed."""

    def __init__(self, header: dict, doc_ids: np.ndarray, doc_counts: np.ndarray, planes: list[list[bytes]]):
        self.n, self.levels, self.zeros = header["n"], header["levels"], header["zeros"]
        self.block, self.ones = header["block"], [np.array(x, np.int64) for x in header["ones"]]
        self.doc_ids, self.doc_counts, self.planes = doc_ids, doc_counts, planes
        self.nulls = header["nulls"]
        self._open: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    # ---- building and storing

    @staticmethod
    def build(ids: np.ndarray, doc_ids: np.ndarray, doc_counts: np.ndarray, levels: int | None = None, nulls: int = 0) -> bytes:
        """The blob of a shard. nulls: how many of the first documents have no id."""
        n = len(ids)
        levels = levels or max(1, int(ids.max()).bit_length() if n else 1)
        kind = np.uint16 if levels <= 16 else np.uint32
        seq, press = ids.astype(kind), zstandard.ZstdCompressor(level=1).compress
        zeros, ones, parts = [], [], []
        for level in range(levels - 1, -1, -1):
            bit = (seq & kind(1 << level)) != 0
            low, high = np.flatnonzero(~bit), np.flatnonzero(bit)
            plane = np.packbits(bit, bitorder="little")
            cuts = range(0, len(plane), BLOCK)
            zeros.append(len(low))
            ones.append(np.searchsorted(high, np.arange(0, len(plane), BLOCK) * 8).tolist())
            parts.append([press(plane[a : a + BLOCK].tobytes()) for a in cuts])
            seq = np.concatenate([seq[low], seq[high]])
        docs = [press(doc_ids.astype("<i8").tobytes()), press(doc_counts.astype("<u4").tobytes())]
        header = {"n": n, "levels": levels, "zeros": zeros, "ones": ones, "block": BLOCK, "docs": [len(doc_ids), *map(len, docs)], "nulls": nulls, "sizes": [[len(x) for x in p] for p in parts]}
        head = json.dumps(header, separators=(",", ":")).encode()
        return b"".join([MAGIC, struct.pack("<I", len(head)), head, *docs, *(x for p in parts for x in p)])

    @classmethod
    def from_bytes(cls, blob: bytes) -> WaveletMatrix:
        if blob[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        size = struct.unpack_from("<I", blob, 4)[0]
        header, at = json.loads(blob[8 : 8 + size]), 8 + size
        view = memoryview(blob)

        def take(k: int) -> memoryview:
            nonlocal at
            at += k
            return view[at - k : at]

        _, a, b = header["docs"]
        unpress = zstandard.ZstdDecompressor().decompress
        doc_ids, counts = np.frombuffer(unpress(take(a)), "<i8"), np.frombuffer(unpress(take(b)), "<u4")
        return cls(header, doc_ids, counts, [[take(k) for k in sizes] for sizes in header["sizes"]])

    # ---- queries

    def _bits(self, level: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Bits of a block, and the ones before each bit of it."""
        if (level, block) not in self._open:
            bits = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(self.planes[level][block]), np.uint8), bitorder="little")
            self._open[level, block] = bits, np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
            if len(self._open) > 256:
                del self._open[next(iter(self._open))]
        return self._open[level, block]

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a level."""
        if i >= self.n:
            return self.n - self.zeros[level]
        block, within = divmod(i, self.block * 8)
        return int(self.ones[level][block] + self._bits(level, block)[1][within])

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(self.levels):
            block, within = divmod(i, self.block * 8)
            bit, before = int(self._bits(level, block)[0][within]), self._rank1(level, i)
            out = out << 1 | bit
            i = self.zeros[level] + before if bit else i - before
        return out

    def _range(self, token: int, a: int, b: int) -> tuple[int, int]:
        """Where occurrences in [a, b) end up after the last level."""
        for level in range(self.levels):
            x, y = self._rank1(level, a), self._rank1(level, b)
            a, b = (self.zeros[level] + x, self.zeros[level] + y) if token >> (self.levels - 1 - level) & 1 else (a - x, b - y)
        return a, b

    def rank(self, token: int, i: int) -> int:
        """Occurrences of a token before position i."""
        return self.count(token, 0, i)

    def count(self, token: int, a: int = 0, b: int | None = None) -> int:
        """Occurrences of a token in [a, b)."""
        if token >> self.levels:
            return 0
        a, b = self._range(token, a, self.n if b is None else b)
        return b - a

    def _find(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit of a kind in a level."""
        starts = self.ones[level] if bit else np.arange(len(self.ones[level])) * self.block * 8 - self.ones[level]
        block = int(np.searchsorted(starts, k, "right")) - 1
        before = self._bits(level, block)[1]
        cumulated = before[1:] if bit else np.arange(1, len(before)) - before[1:]
        return block * self.block * 8 + int(np.searchsorted(cumulated, k - int(starts[block]) + 1))

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of a token."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._range(token, 0, self.n)[0] + k
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            i = self._find(level, bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        """All positions of a token."""
        return [self.select(token, k) for k in range(self.count(token))]

    def to_array(self) -> np.ndarray:
        """All ids: the partitions are undone from the last level to the first."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        seq, unpress = np.zeros(self.n, kind), zstandard.ZstdDecompressor().decompress
        for level in range(self.levels - 1, -1, -1):
            plane = np.frombuffer(b"".join([unpress(x) for x in self.planes[level]]), np.uint8)
            bit = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            out, z = np.empty(self.n, kind), self.zeros[level]
            out[np.flatnonzero(~bit)] = seq[:z]
            out[np.flatnonzero(bit)] = seq[z:] | kind(1 << (self.levels - 1 - level))
            seq = out
        return seq.astype(np.uint32)


def build_shards(docs: DataFrame, end_id: int = 2, path: str | None = None, shard_tokens: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Shards in order of (part, seq). A shard ends with the batch (256 documents at most) that brings it to shard_tokens ids.

    Texts are dealt by ranges of doc_id (equal ids by the text's hash), sorted within each part, encoded and stored.
    """
    path = path or default_path()
    spark = docs.sparkSession
    parts = parts or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seq, part = encoder(path), 0, 0
        ids, docs_, counts, held, nulls = [], [], [], 0, 0

        def shard() -> pa.RecordBatch:
            nonlocal seq, ids, docs_, counts, held, nulls
            d, c = np.concatenate(docs_), np.concatenate(counts)
            blob = WaveletMatrix.build(np.concatenate(ids), d, c, nulls=nulls)
            row = [[part], [seq], [None if nulls else int(d[0])], [len(d)], [int(c.sum())], [blob]]
            seq, ids, docs_, counts, held, nulls = seq + 1, [], [], [], 0, 0
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "seq", "first_doc", "n_docs", "n_tokens", "blob"])

        for big in batches:
            for at in range(0, big.num_rows, 256):
                batch = big.slice(at, 256)
                part = batch.column(2)[0].as_py()
                own, n = enc.encode(batch.column(1))
                own = np.insert(own, np.cumsum(n), end_id)
                ids.append(own)
                docs_.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False))
                nulls += batch.column(0).null_count  # they come first
                counts.append(n + 1)
                held += len(own)
                if held >= shard_tokens:
                    yield shard()
        if held:
            yield shard()

    return rows.select("doc_id", "text", "part").mapInArrow(run, SHARDS)


def write_shards(docs: DataFrame, to: str, **options) -> str:
    """Writes the shards of documents to a new folder."""
    build_shards(docs, **options).write.option("compression", "none").option("parquet.page.size", 1 << 16).parquet(to)
    return to


def read_shards(spark: SparkSession, at: str, max_broadcast_shards: int = 1_000_000) -> DataFrame:
    """Shards with `base`: ids in all shards before. One small row for each shard meets in the running sum."""
    shards = spark.read.parquet(at)
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select("part", "seq", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    small = bases.count() <= max_broadcast_shards  # 20 bytes a shard
    return shards.join(F.broadcast(bases) if small else bases, ["part", "seq"])


def digest(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the shards of read_shards()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                w = WaveletMatrix.from_bytes(blob.as_py())
                ids, n = w.to_array().astype("<u4"), w.doc_counts.astype(np.int64)
                ends = np.cumsum(n)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (b - k) : 4 * b]) for b, k in zip(ends.tolist(), n.tolist(), strict=True)]
                named = pa.array(w.doc_ids, mask=np.arange(len(n)) < w.nulls)
                yield pa.RecordBatch.from_arrays([named, pa.array(base + ends - n), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("base", "blob").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, name: str = "wavelet", **options) -> DataFrame:
    """Writes documents as shards into the shared folder and reads them back."""
    import uuid

    spark = docs.sparkSession
    at = f"{shared_dir(spark)}/lexloom/{name}-{uuid.uuid4().hex}"
    return digest(read_shards(spark, write_shards(docs, at, **options)))
