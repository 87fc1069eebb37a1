"""Toxicity as an ordered severity: cumulative-link (proportional odds) regression on sparse word features.

P[grade <= k] = sigmoid(threshold_k - w.x): one weight vector serves all thresholds. x holds log(1 + count) of
words (runs of letters and digits, A-Z lower-cased) and word beginnings, known by 64-bit hashes. An L1 penalty leaves weights to the
few words that carry evidence; weights are not negative, so that harmless words cannot outweigh harm in a long text.
The expected severity is the sum of k * P[grade = k].

Labels say only toxic or not, so grades are derived: 0 for not toxic; 1 to 3 for the terciles, among the toxic
training documents, of how many words they hold that are over-represented in toxic documents. A document counts as
toxic from the P[grade > 0] up that best parts the training documents (share of toxic found less `cost` times the
share of others found).

Training uses a bounded, hash-chosen sample: `per_class` labelled documents of either label. Their features are
counted on the executors; those alone that stand out in toxic texts reach the driver.

Defined results: a null or empty text gets the severity of a text without evidence, and is not toxic; rows of labels
without label or document are ignored; without labels of both kinds nothing is toxic and the severity is 0; repeated
rows get equal results; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from .common import hashed_sample, held, materialize
from .wordhash import LETTERS, chunks, lower, mix, utf8, word_bounds, word_hashes

GRADES = 3
#: Words that mark grades: in so many toxic texts at least, and so many times more often there than in others.
MARKED, LIFT = 4, 6.0
#: Features of the model: in so many texts at least, and more often in toxic ones by so many standard deviations.
LEAST, DEVIATION = 5, 5.0


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


#: Lengths in bytes of the word beginnings that are features of their own.
PREFIXES = (4, 5, 6)


def features_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Features of all texts (hashes of words, and of beginnings of longer words), the text of each, and the number of texts."""
    buf, offsets = utf8(texts)
    buf = lower(buf)
    starts, ends, counts = word_bounds(buf, offsets, LETTERS)
    doc, lengths = np.repeat(np.arange(len(counts)), counts), ends - starts
    hashes, docs = [word_hashes(buf, starts, ends)], [doc]
    for k in PREFIXES:
        longer = lengths > k
        head = np.full(int(longer.sum()), k, np.uint64)
        for i in range(k):
            head = (head << np.uint64(8)) | buf[starts[longer] + i]
        hashes.append(mix(head))
        docs.append(doc[longer])
    return np.concatenate(hashes), np.concatenate(docs), len(counts)


@dataclass
class Ordinal:
    """features: sorted hashes; weights: one for each; thresholds: rising, one for each grade but the last; cut: see above."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.5

    def scores(self, hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """w.x of each text."""
        if not len(self.features) or not len(hashes):
            return np.zeros(n)
        at = np.minimum(np.searchsorted(self.features, hashes), len(self.features) - 1)
        hit = self.features[at] == hashes
        cells, times = np.unique(doc[hit] * len(self.features) + at[hit], return_counts=True)
        return np.bincount(cells // len(self.features), np.log1p(times) * self.weights[cells % len(self.features)], minlength=n)

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P[grade > k] for each threshold k."""
        return _sigmoid(scores[:, None] - self.thresholds[None])


def cells_of(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct features, cells (feature * n + text) and the count of each cell."""
    words, index = np.unique(hashes, return_inverse=True)
    cells, times = np.unique(index * n + doc, return_counts=True)
    return words, cells, times.astype(np.int32)


def grades_of(words: np.ndarray, cells: np.ndarray, times: np.ndarray, n: int, toxic: np.ndarray, least: int = MARKED, lift: float = LIFT) -> np.ndarray:
    """Grades 0 to GRADES of training documents."""
    word = cells // n
    seen = np.bincount(word, toxic[cells % n], minlength=len(words))
    df = np.bincount(word, minlength=len(words))
    n1 = max(1, int(toxic.sum()))
    marked = (seen >= least) & ((seen + 0.5) / n1 > lift * (df - seen + 0.5) / max(1, n - n1))
    keep = marked[word]
    found = np.bincount(cells[keep] % n, times[keep], minlength=n)
    cuts = np.quantile(found[toxic == 1], [g / GRADES for g in range(1, GRADES)])
    return np.where(toxic == 1, 1 + np.searchsorted(cuts, found, "left"), 0)


def fit(words: np.ndarray, cells: np.ndarray, times: np.ndarray, n: int, grades: np.ndarray, least: int = LEAST, deviation: float = DEVIATION, rounds: int = 2000, rate: float = 1.0, penalty: float = 0.0002, cost: float = 10.0) -> Ordinal:
    """Proximal AdaGrad on the mean negative log-likelihood with an L1 penalty."""
    df = np.bincount(cells // n, minlength=len(words))
    # only features more frequent in toxic texts than chance allows
    toxic, rate_ = grades > 0, float((grades > 0).mean())
    seen = np.bincount(cells // n, toxic[cells % n], minlength=len(words))
    z = (seen - df * rate_) / np.sqrt(np.maximum(df * rate_ * (1 - rate_) * (1 - df / n), 1e-9))
    keep = ((df >= least) & (z >= deviation))[cells // n]
    cells, x = cells[keep], np.log1p(times[keep])
    features, col = np.unique(cells // n, return_inverse=True)
    row = cells % n
    w, g2 = np.zeros(len(features)), np.full(len(features), 1e-4)
    share = np.array([(grades <= k).mean() for k in range(GRADES)])
    t = np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))
    gaps = 0.1 * np.arange(GRADES)  # thresholds stay apart
    t = np.maximum.accumulate(t - gaps) + gaps
    t2 = np.full(GRADES, 0.01)
    for _ in range(rounds):
        z = np.bincount(row, x * w[col], minlength=n)
        upper = np.where(grades < GRADES, _sigmoid(t[np.minimum(grades, GRADES - 1)] - z), 1.0)
        below = np.where(grades > 0, _sigmoid(t[np.maximum(grades - 1, 0)] - z), 0.0)
        p = np.maximum(upper - below, 1e-12)
        du, db = upper * (1 - upper) / p, below * (1 - below) / p
        gw = np.bincount(col, x * (du - db)[row], minlength=len(features)) / n
        gt = np.array([(db[grades == k + 1].sum() - du[grades == k].sum()) / n for k in range(GRADES)])
        g2 += gw * gw
        t2 += gt * gt
        step = rate / np.sqrt(g2)
        w = w - step * gw
        w = np.maximum(w - step * penalty, 0)
        t = np.maximum.accumulate(t - rate * gt / np.sqrt(t2) - gaps) + gaps
    used = w != 0
    model = Ordinal(words[features[used]], w[used], t)
    p = model.above(np.bincount(row, x * w[col], minlength=n))[:, 0]
    order = np.argsort(-p, kind="stable")
    last = np.append(p[order][1:] != p[order][:-1], True)  # a cut lies between different values
    gain = np.where(last, np.cumsum(toxic[order]) / max(1, toxic.sum()) - cost * np.cumsum(~toxic[order]) / max(1, (~toxic).sum()), -np.inf)
    best = int(gain.argmax())
    below_ = p[order][best + 1] if best + 1 < n else p[order][best]
    model.cut = float((p[order][best] + below_) / 2)
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Ordinal | None:
    """The model learned from labelled documents; None without labels of both kinds."""
    y = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    y = F.broadcast(hashed_sample(y, "id", per_class, "y"))  # bounded by the sample's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in chunks(big, 2, 1 << 20):
                words, cells, times = cells_of(*features_of(batch.column(2)))
                doc = cells % batch.num_rows
                order = np.argsort(doc, kind="stable")
                cuts = pa.array(np.append(0, np.cumsum(np.bincount(doc, minlength=batch.num_rows))).astype(np.int32))
                hashes = pa.ListArray.from_arrays(cuts, pa.array(words[cells // batch.num_rows][order].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), hashes, pa.ListArray.from_arrays(cuts, pa.array(times[order]))], ["row", "y", "hash", "times"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null").join(y, "id")
    # of an id that stands in several rows one text, so that the sample is bounded in rows
    one = F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("text"), "text"))
    rows = rows.withColumn("_one", one).filter("_one = 1").select(F.monotonically_increasing_id().alias("row"), "y", "text")
    sample = materialize(rows.mapInArrow(run, "row long, y int, hash array<long>, times array<int>"), "toxicity-sample", "row")
    heads = sample.select("row", "y").orderBy("row").toArrow()
    n, toxic = heads.num_rows, heads.column("y").to_numpy()
    n1 = int(toxic.sum())
    if n1 in (0, n):
        return None
    # what grades_of() and fit() can use comes to the driver: features that stand out in toxic texts, however long the texts are
    each = sample.select("row", "y", F.explode(F.arrays_zip("hash", "times")).alias("c")).select("row", "y", "c.hash", "c.times")
    df, seen, rate = F.col("df"), F.col("seen"), n1 / n
    chance = F.sqrt(F.greatest(df * rate * (1 - rate) * (1 - df / n), F.lit(1e-9)))
    marked = (seen >= MARKED) & ((seen + 0.5) / n1 > LIFT * (df - seen + 0.5) / (n - n1))
    kept = each.groupBy("hash").agg(F.count(F.lit(1)).alias("df"), F.sum("y").alias("seen")).filter(((df >= LEAST) & ((seen - df * rate) / chance >= DEVIATION * 0.999)) | marked)
    got = each.join(kept.select("hash"), "hash").select("row", "hash", "times").toArrow()
    words, index = np.unique(got.column("hash").to_numpy().view(np.uint64), return_inverse=True)
    cells = index * n + np.searchsorted(heads.column("row").to_numpy(), got.column("row").to_numpy())
    order = np.argsort(cells)
    found = (words, cells[order], got.column("times").to_numpy()[order], n)
    return fit(*found, grades_of(*found, toxic))


def grade(docs: DataFrame, model: Ordinal | None, threshold: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, severity (expected grade), grade (the likeliest), p_toxic (P[grade > 0]), toxic (p_toxic >= threshold, by default the model's cut)."""
    threshold = threshold if threshold is not None or model is None else model.cut

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(None)
        for big in batches:
            for batch in chunks(big, 1, 1 << 20):
                above = model.above(model.scores(*features_of(batch.column(1))))
                full = np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1)
                best = (full[:, :-1] - full[:, 1:]).argmax(axis=1)
                cols = [batch.column(0), pa.array(above.sum(axis=1)), pa.array(best.astype(np.int32)), pa.array(above[:, 0]), pa.array(above[:, 0] >= threshold)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "severity", "grade", "p_toxic", "toxic"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("severity"), F.lit(0).alias("grade"), F.lit(0.0).alias("p_toxic"), F.lit(False).alias("toxic"))
    return rows.mapInArrow(run, "doc_id long, severity double, grade int, p_toxic double, toxic boolean")


def accept(docs: DataFrame, model: Ordinal | None, threshold: float | None = None, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that are not toxic; all rows if nothing was learned."""
    if model is None:
        return docs
    at, threshold = docs.columns.index(text_col), model.cut if threshold is None else threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(None)
        for big in batches:
            for batch in chunks(big, at, 1 << 20):
                yield batch.filter(pa.array(model.above(model.scores(*features_of(batch.column(at))))[:, 0] < threshold))

    return docs.mapInArrow(run, docs.schema)


def severity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Trains on labelled documents and grades all documents."""
    return grade(docs, train(docs, labels, id_col=id_col, text_col=text_col, **options), id_col=id_col, text_col=text_col)
