"""Language identification by a byte convolutional network, trained in numpy.

Bytes (A-Z lower-cased) get learned vectors; filters of several widths slide over fixed-length windows, each is
max-pooled over its window, and a softmax follows. A text is cut into windows side by side (the last one padded with
zero bytes), so every byte of the whole text is read; the mean of the windows' log probabilities decides.

Training uses a bounded, hash-chosen sample of labelled texts (`per_class` for each language, `windows_per_text`
windows of each, drawn by a hash of the text; only they reach the driver); everything else reads all data.

Defined results: a text that is null or has no letter (Unicode category L) is "und" with score 0; without labelled
rows every text is "und" and accept() keeps every row; ties go to the language first in order; repeated rows get equal
results; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import regex
from pyspark.sql import DataFrame

from .common import crc32_of_id, hashed_sample, held
from .wordhash import chunks, lower, utf8

WINDOW, DIM, WIDTHS, FILTERS = 128, 6, (2, 3, 4), 8
UNKNOWN = "und"


class ByteCnn:
    """Weights: emb [256, DIM], conv [max width * DIM, filters], bias, out [filters, classes], out_bias."""

    def __init__(self, labels: list[str], window: int = WINDOW, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.labels, self.window, self.width = labels, window, max(WIDTHS)
        f = len(WIDTHS) * FILTERS
        self.emb = rng.normal(0, 0.5, (256, DIM)).astype(np.float32)
        self.mask = np.zeros((self.width, DIM, f), np.float32)  # a filter of width w sees the first w bytes
        for i, w in enumerate(WIDTHS):
            self.mask[:w, :, i * FILTERS : (i + 1) * FILTERS] = 1
        self.mask = self.mask.reshape(self.width * DIM, f)
        self.conv = (rng.normal(0, 0.3, self.mask.shape) * self.mask).astype(np.float32)
        self.bias, self.out_bias = np.zeros(f, np.float32), np.zeros(len(labels), np.float32)
        self.out = rng.normal(0, 0.3, (f, len(labels))).astype(np.float32)

    def _columns(self, x: np.ndarray) -> np.ndarray:
        e = self.emb[x]
        n = x.shape[1] - self.width + 1
        return np.concatenate([e[:, k : k + n] for k in range(self.width)], axis=2)

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cols = self._columns(x)
        z = cols @ self.conv
        return cols, z, z.max(axis=1)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of windows, uint8 [n, window]."""
        h = np.maximum(self._pooled(x)[2] + self.bias, 0)
        z = h @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 6) -> ByteCnn:
        """Adam on the cross-entropy of windows."""
        rng, names = np.random.default_rng(seed), ("emb", "conv", "bias", "out", "out_bias")
        first = {k: np.zeros_like(getattr(self, k)) for k in names}
        second = {k: np.zeros_like(getattr(self, k)) for k in names}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), batch):
                xb, yb = x[order[a : a + batch]], y[order[a : a + batch]]
                cols, z, top = self._pooled(xb)
                where = z.argmax(axis=1)
                pre = top + self.bias
                h = np.maximum(pre, 0)
                s = h @ self.out + self.out_bias
                p = np.exp(s - s.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(yb)), yb] -= 1
                p /= len(yb)
                dh = (p @ self.out.T) * (pre > 0)
                picked = cols[np.arange(len(xb))[:, None], where]  # [n, filters, width * DIM]
                grads = {"out": h.T @ p, "out_bias": p.sum(axis=0), "bias": dh.sum(axis=0), "conv": np.einsum("nf,nfd->df", dh, picked) * self.mask}
                dcols = dh[:, :, None] * (self.conv * self.mask).T[None]  # [n, filters, width * DIM]
                demb = np.zeros_like(self.emb)
                for k in range(self.width):
                    np.add.at(demb, xb[np.arange(len(xb))[:, None], where + k].ravel(), dcols[:, :, k * DIM : (k + 1) * DIM].reshape(-1, DIM))
                grads["emb"] = demb
                step += 1
                lr = rate * (1 - 0.9 * epoch / epochs)
                for k in names:
                    first[k] = 0.9 * first[k] + 0.1 * grads[k]
                    second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                    setattr(self, k, (getattr(self, k) - lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32))
        self.conv *= self.mask
        return self


def windows(buf: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of all texts and how many each has; they lie side by side, the last one of a text is padded with zeros."""
    sizes = np.diff(offsets)
    counts = -(-sizes // size)
    out = np.zeros(int(counts.sum()) * size, np.uint8)
    at = np.repeat((np.cumsum(counts) - counts) * size - offsets[:-1], sizes)
    out[np.arange(len(buf)) + at] = buf
    return out.reshape(-1, size), counts


def train(docs: DataFrame, per_class: int = 600, windows_per_text: int = 3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> ByteCnn | None:
    """The network learned from labelled rows of docs; None if there are none."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label")).filter("label is not null and text rlike '\\\\p{L}'")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in chunks(big, 0, 1 << 20):
                x, counts = windows(lower(utf8(batch.column(0))[0]), utf8(batch.column(0))[1], WINDOW)
                rows, first, names = [], 0, []
                for n, text, label in zip(counts.tolist(), batch.column(0), batch.column(1).to_pylist(), strict=True):
                    own = np.random.default_rng(zlib.crc32(text.as_buffer())).permutation(n)[:windows_per_text]
                    rows += [x[first + i].tobytes() for i in own.tolist()]
                    names += [label] * len(own)
                    first += n
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(names, pa.string())], ["window", "label"])

    sample = hashed_sample(rows, "id", per_class, "label", text_col="text").select("text", F.col("label").cast("string"))
    got = sample.mapInArrow(cut, "window binary, label string").orderBy("label", "window").toArrow()
    labels = got.column("label").to_pylist()
    names = sorted(set(labels))
    if not names:
        return None
    index = {k: i for i, k in enumerate(names)}
    x = np.frombuffer(b"".join(got.column("window").to_pylist()), np.uint8).reshape(-1, WINDOW)
    return ByteCnn(names).fit(x, np.array([index[k] for k in labels]))


_LETTER = regex.compile(r"\p{L}")


def classify(texts: pa.Array, model: ByteCnn) -> tuple[list[str], np.ndarray]:
    """Language and score of each text: the softmax of the mean log probabilities of its windows."""
    buf, offsets = utf8(texts)
    x, counts = windows(lower(buf), offsets, model.window)
    sums = np.zeros((len(texts), len(model.labels)))
    parts = [model.log_probabilities(x[a : a + 1024]) for a in range(0, len(x), 1024)]
    full = np.flatnonzero(counts)
    if len(full):
        sums[full] = np.add.reduceat(np.concatenate(parts).astype(float), (np.cumsum(counts) - counts)[full])
    sums /= np.maximum(counts, 1)[:, None]
    best = sums.argmax(axis=1).tolist()
    letters = np.array([t is not None and _LETTER.search(t) is not None for t in texts.to_pylist()], bool)
    score = np.where(letters, 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1), 0.0)
    return [model.labels[i] if ok else UNKNOWN for i, ok in zip(best, letters.tolist(), strict=True)], score


def predict(docs: DataFrame, model: ByteCnn | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(None)
        for big in batches:
            for batch in chunks(big, 1, 1 << 20):
                names, score = classify(batch.column(1), model)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def accept(docs: DataFrame, model: ByteCnn | None, languages: list[str] | None = None, least: float = 0.4, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, in one of the languages (any learned one by default) with a score of at least `least`; all rows without a model."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(None)
        for big in batches:
            for batch in chunks(big, at, 1 << 20):
                names, score = classify(batch.column(at), model)
                yield batch.filter(pa.array([s >= least and n != UNKNOWN and (languages is None or n in languages) for n, s in zip(names, score.tolist(), strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema) if model is not None else docs


def held_out(id_col: str = "doc_id"):
    """Rows that training leaves out."""
    return crc32_of_id(F.col(id_col)) % 3 == 1


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from the labelled documents that are not held out."""
    model = train(docs.filter(~held_out(id_col)), id_col=id_col, text_col=text_col, label_col=label_col, **options)
    out = predict(docs, model, id_col, text_col)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
