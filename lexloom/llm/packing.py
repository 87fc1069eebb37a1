"""Best-fit packing of documents into sequences under several capacities.

A bin has three residual capacities: tokens, documents (pieces) and attention cost (sum of squared piece lengths).
Pieces are placed in order of falling length into the open bin that fits under every capacity and scores best:
rule "norm" takes the smallest weighted norm of what would be left, rule "dot" the largest weighted dot product of
the piece with what is left. If none fits, a bin is opened.

Pieces are dealt by a hash of the row and its place into blocks of about `block_pieces`, each packed on its own, so
that no task holds more than a block, also where rows are equal; a block wastes about one bin. Pieces that fill a
sequence alone need no search. With the default capacities tokens alone can bind, since the squares of lengths that
sum to at most 1,024 sum to at most 1,024 squared; the others bind where they are set lower (`max_docs`,
`max_attention`).

Defined results: a null text is an empty one, of the end id alone; repeated rows are packed as rows of their own;
an empty table gives an empty table; further columns are not read. A document of more than `capacity` ids is cut
into pieces of `capacity`, the first of which is shorter unless the length is a multiple.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import materialize
from .tokens import default_path, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document."""
    head = (length - 1) % capacity + 1
    return [(0, head)] + [(a, capacity) for a in range(head, length, capacity)]


def encode_pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece; with_ids adds the ids themselves."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.array([end_id], np.uint32)
        for big in batches:
            for at in range(0, big.num_rows, 2000):
                batch = big.slice(at, 2000)
                ids, counts = enc.encode(batch.column(1))
                rows, before = [], 0
                for i, n in enumerate(counts.tolist()):
                    own = np.concatenate([ids[before : before + n], end]).astype("<u4")
                    before += n
                    for k, (a, m) in enumerate(cut(n + 1, capacity)):
                        rows.append((i, k, a, m, zlib.crc32(own[a : a + m]), own[a : a + m] if with_ids else None))
                if not rows:
                    continue
                which, piece, start, length, crc, own = zip(*rows, strict=True)
                cols = [batch.column(0).take(pa.array(which)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array(own, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = PIECES + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacity: int, max_docs: int, max_attention: int, weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; lengths must fall."""
    n = len(lengths)
    caps = np.array([capacity, max_docs, max_attention], float)
    scale = np.sqrt(np.array(weights)) / caps
    left, bins, used = np.empty((3, 64)), np.empty(64, np.int64), 0  # scaled residuals and numbers of the open bins
    out, offset, opened = np.empty(n, np.int64), np.empty(n, np.int64), 0
    shortest = lengths[-1] * scale[0] if n else 0
    full = caps * scale
    for i, length in enumerate(lengths.tolist()):
        item = np.array([length, 1, length * length], float) * scale
        if item[0] > full[0] or item[2] > full[2] + 1e-12:
            raise ValueError(f"a piece of {length} exceeds the capacities")
        open_ = left[:, :used]
        after = open_ - item[:, None]
        fits = (after >= -1e-12).all(axis=0)
        if fits.any():
            score = (after * after).sum(axis=0) if rule == "norm" else -(open_ * item[:, None]).sum(axis=0)
            j = int(np.where(fits, score, np.inf).argmin())
        else:
            if used == left.shape[1]:
                keep = (left[:, :used] >= np.array([shortest, scale[1], 0])[:, None] - 1e-12).all(axis=0)  # bins that nothing fits any more are closed
                kept = int(keep.sum())
                wider = np.empty((3, max(64, 2 * kept)))
                wider[:, :kept], bins[:kept] = left[:, :used][:, keep], bins[:used][keep]
                left, bins, used = wider, np.resize(bins, wider.shape[1]), kept
            j = used
            left[:, j], bins[j] = full, opened
            used, opened = used + 1, opened + 1
        out[i] = bins[j]
        offset[i] = round((full[0] - left[0, j]) / scale[0])
        left[:, j] -= item
    return out, offset


def pack(pieces: DataFrame, capacity: int = 1024, max_docs: int = 1024, max_attention: int | None = None, weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "norm", block_pieces: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to pieces (a table on disk: it is read twice). Other columns of pieces are dropped."""
    max_attention = max_attention or capacity * capacity
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    pieces = pieces.select(*cols)
    alone = pieces.filter(F.col("length") >= capacity).select(*cols, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.filter(F.col("length") < capacity)
    blocks = max(1, math.ceil(rest.count() / block_pieces))
    # the row's place in the stored table parts equal rows, too
    rest = rest.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(blocks)))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        where, offset = best_fit(table.column("length").to_numpy(), capacity, max_docs, max_attention, weights, rule)
        block = key[0].as_py()
        return table.select(cols).append_column("sequence_id", pa.array(where + (block << 24), pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return alone.unionByName(rest.groupBy("block").applyInArrow(run, PLACED))


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Encodes, cuts and packs documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Texts are encoded once."""
    return pack(materialize(encode_pieces(docs, capacity, end_id, path, id_col, text_col), "pieces", "doc_id"), capacity, **options)
