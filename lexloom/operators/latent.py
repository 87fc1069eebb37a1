"""Latent semantic vectors: truncated SVD of the TF-IDF rows by subspace iteration, and search among them.

The rows stay on the executors. A pass multiplies them by a thin block of `components` + 16 columns and by their own
transpose; a task holds the block and one sum of its shape (max_features x columns, 4 bytes each: 109 MB at the
defaults), and the summed block comes to the driver to be made orthogonal. No square matrix of the features is formed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .index import Index, query_terms
from .store import stored


@dataclass
class Latent:
    """basis: terms x components; terms: term, i, idf (at most max_features rows); vectors: doc_id, p (stored, of unit length)."""

    basis: np.ndarray
    terms: DataFrame
    vectors: DataFrame

    @classmethod
    def fit(cls, index: Index, components: int = 256, max_features: int = 100_000, passes: int = 3, seed: int = 13) -> Latent:
        spark = index.postings.sparkSession
        words = index.vocabulary(max_features).orderBy("term").toArrow()
        size = words.num_rows
        terms = spark.createDataFrame(pa.table({"term": words.column("term"), "i": pa.array(np.arange(size, dtype=np.int32)), "idf": words.column("idf")}))
        rows = stored(document_rows(index, terms), "latent-rows")
        rng = np.random.default_rng(seed)
        block = rng.standard_normal((size, min(components + 16, size)), dtype=np.float32)
        product = block
        for _ in range(passes if size else 0):
            block = np.linalg.qr(product)[0]
            product = gram_product(rows, block)
        values, turn = np.linalg.eigh(block.T.astype(float) @ product) if size else (np.zeros(0), np.zeros((0, 0)))
        keep = np.argsort(-values, kind="stable")[: min(components, max(1, min(index.n, size) - 1))]
        basis = (block @ turn[:, keep]).astype(np.float32)
        return cls(basis, terms, stored(project(rows, basis, "doc_id"), "latent-vectors"))

    def queries(self, queries: DataFrame) -> DataFrame:
        """(query_id, p); a query without known terms has no row."""
        return project(sparse_rows(query_terms(queries), self.terms, "query_id", "qtf"), self.basis, "query_id")


def sparse_rows(counts: DataFrame, terms: DataFrame, key: str, tf: str) -> DataFrame:
    """(key, i, w): features and weights of each row; as many as the vocabulary has at most."""
    each = counts.join(F.broadcast(terms), "term").select(key, F.struct("i", ((1 + F.log(tf)) * F.col("idf")).cast("float").alias("w")).alias("x"))
    listed = each.groupBy(key).agg(F.sort_array(F.collect_list("x")).alias("x"))
    return listed.select(key, F.col("x.i").alias("i"), F.col("x.w").alias("w"))


def document_rows(index: Index, terms: DataFrame) -> DataFrame:
    """sparse_rows() of an index's documents, which are put together within its ranges: no shuffle, and a range at a time in memory."""
    own = index.blocks.select("range", "term", "ids", "tfs").join(F.broadcast(terms), "term").select("range", "i", "idf", "ids", "tfs")
    kind = index.blocks.schema["ids"].dataType.elementType.simpleString()
    return own.groupBy("range").applyInArrow(_turned, f"doc_id {kind}, i array<int>, w array<float>")


def _turned(table: pa.Table) -> pa.Table:
    """A range's blocks (range, i, idf, ids, tfs) as rows (doc_id, i, w)."""
    lists, tfs, idf, feature = (table.column(c).combine_chunks() for c in ("ids", "tfs", "idf", "i"))
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    weight = (1 + np.log(tfs.flatten().to_numpy(zero_copy_only=False))) * np.repeat(idf.to_numpy(zero_copy_only=False), sizes)
    features = np.repeat(feature.to_numpy(zero_copy_only=False), sizes)
    ids, place = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    order = np.lexsort((features, place))
    bounds = pa.array(np.append(0, np.cumsum(np.bincount(place, minlength=len(ids)))).astype(np.int32))
    both = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (features[order], weight[order].astype(np.float32))]
    return pa.table([pa.array(ids, lists.type.value_type), *both], names=["doc_id", "i", "w"])


def _features(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Place, features and weights of unit length of each row."""
    for k in range(batch.num_rows):
        i, w = batch.column(1)[k].values.to_numpy(), batch.column(2)[k].values.to_numpy()
        yield k, i, w / max(float(np.linalg.norm(w)), 1e-12)


def gram_product(rows: DataFrame, block: np.ndarray) -> np.ndarray:
    """Transpose of the rows times the rows times a block."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        out, used = np.zeros_like(own), np.zeros(len(own), bool)
        for batch in batches:
            for _, i, w in _features(batch):
                out[i] += np.outer(w, w @ own[i])
                used[i] = True
        at = np.flatnonzero(used)
        for a in range(0, len(at), 4096):
            part = at[a : a + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array([x.tobytes() for x in out[part]], pa.binary())], ["i", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(v.as_buffer(), np.float32)
                if i == at:
                    total = total + own
                    continue
                if at is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["i", "v"])
                at, total = i, own
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["i", "v"])

    parts = rows.select(F.lit(0), "i", "w").mapInArrow(run, "i int, v binary")
    got = parts.repartition("i").sortWithinPartitions("i").mapInArrow(add, "i int, v binary").toArrow()
    out = np.zeros_like(block)
    for i, v in zip(got.column("i").to_pylist(), got.column("v"), strict=True):
        out[i] = np.frombuffer(v.as_buffer(), np.float32)
    shared.unpersist()
    return out


def project(rows: DataFrame, basis: np.ndarray, key: str) -> DataFrame:
    """(key, p): rows in the latent space, of unit length (or zero)."""
    shared = rows.sparkSession.sparkContext.broadcast(basis)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, shared.value.shape[1]), np.float32)
            for k, i, w in _features(batch):
                out[k] = w @ shared.value[i]
            out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [key, "p"])

    return rows.select(F.col(key).cast("long").alias(key), "i", "w").mapInArrow(run, f"{key} long, p array<float>")


def latent_scores(latent: Latent, queries: DataFrame, n: int, at_once: int = 4096) -> DataFrame:
    """(query_id, doc_id, score): cosines of each query with its best n documents and some more, for top_k() to choose from.

    A stated query set against all documents, in blocks of `at_once` queries. A batch gives n rows a query, and ties.
    """
    spark, own = latent.vectors.sparkSession, stored(latent.queries(queries), "latent-queries")
    blocks = max(1, -(-own.count() // at_once))
    out = spark.createDataFrame([], "query_id long, doc_id long, score double")
    for b in range(blocks):
        got = own.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).orderBy("query_id").toArrow()
        if not got.num_rows:
            continue
        ids, table = got.column("query_id").to_numpy(), np.stack([x.values.to_numpy() for x in got.column("p")])

        def run(batches: Iterator[pa.RecordBatch], ids=ids, table=table) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                docs = batch.column(0).to_numpy()
                for a in range(0, len(docs), 2048):
                    part = batch.column(1).slice(a, 2048)
                    scores = part.flatten().to_numpy().reshape(len(part), -1) @ table.T
                    least = -np.partition(-scores, min(n, len(part)) - 1, axis=0)[min(n, len(part)) - 1]
                    i, j = np.nonzero(scores >= least - 1e-6)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[j]), pa.array(docs[a + i]), pa.array(scores[i, j].astype(float))], ["query_id", "doc_id", "score"])

        out = out.unionByName(latent.vectors.mapInArrow(run, out.schema))
    return out
