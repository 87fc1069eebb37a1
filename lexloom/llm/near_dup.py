"""Near-duplicate documents by MinHash with tensored banding, confirmed on full shingle sets.

Two collections of `m` half keys each, of `t` minhashes, give m * m tables: the key of table (i, j) combines half
key i of the first and half key j of the second. A pair so meets in some table if and only if it agrees in a half
key of each collection; 2 * m * t minhashes do the work of m * m * 2 * t. With m = 12 and t = 3, a pair of
similarity 0.8 is met with probability (1 - (1 - 0.8**3)**12)**2 = 0.9996, one of 0.2 with 0.008.

Steps: equal shingle sets fall into classes first (any number of copies costs one row each); class representatives
get table keys, made from half keys that another class shares; within a table bucket each member is compared with
the smallest one; verified links give components. Members of buckets in which several components are left are then
compared across components, in cells of bounded size, but for pairs that sizes rule out (shingles that a document
alone has cannot be shared); so no link that a bucket holds is lost, whatever the bucket's size.

Defined results: a null, empty or wordless text has an empty set and is linked with nothing; a text of fewer than
k words is one shingle; rows of equal id count as one node, which has the links of all their texts; a row with a null
id is linked with nothing and has a null component; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import held, materialize
from .components import connected_components
from .wordhash import chunks, lower, mix, shingles, utf8, word_bounds, word_hashes

#: Ids up to this number are broadcast (8 MB), more are joined by shuffles.
BROADCAST_IDS = 1_000_000


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, words lower-cased (A-Z)."""
    buf, offsets = utf8(texts)
    buf = lower(buf)
    starts, ends, counts = word_bounds(buf, offsets)
    hashes, at, out = word_hashes(buf, starts, ends), 0, []
    for n in counts.tolist():
        s = shingles(hashes[at : at + n], k)
        s.sort()
        out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s)
        at += n
    return out


def _half_keys(sets: list[np.ndarray], m: int, t: int) -> np.ndarray:
    """2 * m half keys of each (non-empty) set."""
    data = np.concatenate(sets)
    first = np.cumsum([0] + [len(s) for s in sets[:-1]])
    rng = np.random.default_rng(20240611)
    odd = rng.integers(0, 1 << 63, 2 * m * t, np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, 2 * m * t, np.uint64)
    keys = np.zeros((2 * m, len(sets)), np.uint64)
    high = np.uint64(32)
    work = np.empty_like(data)
    for i in range(2 * m):
        for j in range(t):
            np.multiply(data, odd[i * t + j], out=work)
            np.add(work, add[i * t + j], out=work)
            np.right_shift(work, high, out=work)
            keys[i] = mix(keys[i]) + np.minimum.reduceat(work, first)
    return mix(keys).T


SIGNED = "doc_id long, n int, d1 long, d2 long, half array<long>"


def signatures(docs: DataFrame, k: int, m: int, t: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Set size, a 128-bit digest of the set and its half keys, for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(None)
        for big in batches:
            for batch in chunks(big, 1, 1 << 20):
                sets = shingle_sets(batch.column(1), k)
                full = [i for i, s in enumerate(sets) if len(s)]
                half = np.zeros((len(sets), 2 * m), np.int64)
                digest = np.zeros((2, len(sets)), np.int64)
                if full:
                    own = [sets[i] for i in full]
                    half[full] = _half_keys(own, m, t).view(np.int64)
                    data, first = np.concatenate(own), np.cumsum([0] + [len(s) for s in own[:-1]])
                    for j in range(2):
                        data = mix(data + np.uint64(j + 1))
                        digest[j, full] = np.add.reduceat(data, first).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * (2 * m)), pa.array(half.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array(digest[0]), pa.array(digest[1]), lists], ["doc_id", "n", "d1", "d2", "half"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SIGNED)


def table_keys(reps: DataFrame, m: int) -> DataFrame:
    """(key, rep, n) of the tensored tables; half keys that no other row shares can meet nobody and are left out."""
    half = reps.select("rep", "n", F.posexplode("half").alias("pos", "h"))
    shared = half.groupBy("pos", "h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("pos", "h")
    left = half.join(shared, ["pos", "h"]).groupBy("rep", "n").agg(F.collect_list(F.struct("pos", "h")).alias("k"))  # 2 m at most
    a, b = F.filter("k", lambda x: x["pos"] < m), F.filter("k", lambda x: x["pos"] >= m)
    pairs = left.select("rep", "n", F.explode(a).alias("x"), b.alias("b")).select("rep", "n", "x", F.explode("b").alias("y"))
    return pairs.select(F.xxhash64("x.pos", "x.h", "y.pos", "y.h").alias("key"), "rep", "n")


def verify(pairs: DataFrame, docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(x, y, inter, union_) of pairs (x, y) of ids, from the full texts."""
    ids = pairs.select(F.explode(F.array("x", "y")).alias("doc_id")).distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(ids, "doc_id", "left_semi")
    both = pairs.join(texts.select(F.col("doc_id").alias("x"), F.col("text").alias("tx")), "x").join(texts.select(F.col("doc_id").alias("y"), F.col("text").alias("ty")), "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(None)
        other, of = None, None  # pairs of one y lie together
        for batch in batches:
            for part in chunks(batch, 2, 1 << 20):
                sets, out = shingle_sets(part.column(2), k), []
                for s, y, text in zip(sets, part.column(1).to_pylist(), part.column(3), strict=True):
                    if of is None or of != (y, text):
                        other, of = shingle_sets(pa.array([text.as_py()], pa.large_string()), k)[0], (y, text)
                    inter = len(np.intersect1d(s, other, assume_unique=True))
                    out.append((inter, len(s) + len(other) - inter))
                inter, union = zip(*out, strict=True) if out else ((), ())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(inter, pa.int64()), pa.array(union, pa.int64())], ["x", "y", "inter", "union_"])

    return both.select("x", "y", "tx", "ty").mapInArrow(run, "x long, y long, inter long, union_ long")


def full_sets(ids: DataFrame, docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rep, set) of the documents of ids (rep); set: the sorted shingle hashes as bytes."""
    small = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text")).join(small, "rep", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(None)
        for big in batches:
            for batch in chunks(big, 1, 1 << 20):
                sets = [x.tobytes() for x in shingle_sets(batch.column(1), k)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["rep", "set"])

    return texts.mapInArrow(run, "rep long, set binary")


def lone_shingles(sets: DataFrame) -> DataFrame:
    """(rep, lone): how many shingles of a set no other one has; no row for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(None)
        for batch in batches:
            for rep, own in zip(batch.column(0), batch.column(1), strict=True):
                each = np.frombuffer(own.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(each), rep.as_py())), pa.array(each)], ["rep", "s"])

    each = sets.mapInArrow(run, "rep long, s long").groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("rep").alias("rep"))
    return each.filter("c = 1").groupBy("rep").agg(F.count(F.lit(1)).alias("lone"))


def links_across(rest: DataFrame, sets: DataFrame, m: int, percent: int, outer: int = 64_000, inner: int = 256_000, outer_rows: int = 256, inner_rows: int = 1024) -> DataFrame:
    """Links (a, b) between documents of different components that share table buckets.

    rest: rep, n, s (shingles that others have too), component, half. In each bucket of the first collection, the
    members outside its most frequent component are compared with all others, in cells of two hashed blocks; a cell
    holds some `outer` + `inner` shingles and some `outer_rows` + `inner_rows` rows, however large the bucket. What
    leaves a cell are links alone.
    """
    rows = rest.select("rep", "n", "s", "component", "half", F.posexplode(F.slice("half", 1, m)).alias("pos", "h"))
    by = rows.groupBy("pos", "h", "component").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("n").cast("long")).alias("size")).groupBy("pos", "h")
    by = by.agg(F.max(F.struct("c", "component", "size")).alias("m"), F.sum("size").alias("all"), F.sum("c").alias("rows"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    by = by.select("pos", "h", F.col("m.component").alias("main"), F.col("m.size").alias("n_main"), "all", F.col("m.c").alias("c_main"), "rows")
    rows = rows.join(materialize(by, "buckets"), ["pos", "h"])  # a plain join, which adaptive execution splits at hot buckets
    ob = F.greatest(F.ceil((F.col("all") - F.col("n_main")) / outer), F.ceil((F.col("rows") - F.col("c_main")) / outer_rows)).cast("int")
    mb = F.greatest(F.ceil(F.col("n_main") / inner), F.ceil(F.col("c_main") / inner_rows)).cast("int")
    rows = rows.withColumn("out", F.col("component") != F.col("main")).withColumn("ob", ob).withColumn("mb", mb)
    own = F.when(F.col("out"), F.pmod(F.xxhash64("rep"), "ob")).otherwise(F.pmod(F.xxhash64("rep"), "mb")).cast("int")
    rows = rows.withColumn("own", own)

    def cell(kind: str, a, b):
        return F.struct(F.lit(kind).alias("kind"), a.cast("int").alias("a"), b.cast("int").alias("b"))

    up = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    with_out = F.transform(up("ob"), lambda j: cell("oo", F.least(F.col("own"), j), F.greatest(F.col("own"), j)))
    with_main = F.transform(up("mb"), lambda j: cell("om", F.col("own"), j))
    of_main = F.transform(up("ob"), lambda j: cell("om", j, F.col("own")))
    cells = rows.withColumn("cell", F.explode(F.when(F.col("out"), F.concat(with_out, with_main)).otherwise(of_main)))
    cells = cells.select("pos", "h", "cell.*", "out", "rep", "n", "s", "component", "half").join(sets, "rep")

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        pos, kind = key[0].as_py(), key[2].as_py()
        rep, n, s, part, out = (table.column(c).to_numpy() for c in ("rep", "n", "s", "component", "out"))
        half = table.column("half").combine_chunks().flatten().to_numpy().reshape(-1, 2 * m)
        data = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("set")]
        root, links = {c: c for c in part.tolist()}, []

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        for i in np.flatnonzero(out).tolist():
            most = np.minimum(s[i], s)
            ok = (part != part[i]) & (most * 100 >= percent * (n[i] + n - most))
            ok &= (rep > rep[i]) if kind == "oo" else ~out
            near = np.flatnonzero(ok)
            if not len(near):
                continue
            same = half[near] == half[i]
            near = near[(same[:, :m].argmax(axis=1) == pos) & same[:, m:].any(axis=1)]  # each pair in one bucket
            for j in near.tolist():
                a, b = find(int(part[i])), find(int(part[j]))
                if a == b:
                    continue
                inter = len(np.intersect1d(data[i], data[j], assume_unique=True))
                if inter * 100 >= percent * (int(n[i]) + int(n[j]) - inter):
                    root[a] = b
                    links.append((int(rep[i]), int(rep[j])))
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cells.groupBy("pos", "h", "kind", "a", "b").applyInArrow(run, "a long, b long")


def ids_repeat(docs: DataFrame, id_col: str) -> bool:
    """Whether some id stands in several rows."""
    return not docs.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1").isEmpty()


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, str]:
    """Where an id alone is no key: rows of docs with a number of their id and text (rows without id leave), (number, doc_id), and the number's name."""
    taken = {c.lower() for c in docs.columns}
    key, digest, null = ("_" * (1 + max(map(len, taken))) + name for name in ("key", "digest", "null"))  # no column has such a name
    rows = docs.filter(F.col(id_col).isNotNull()).withColumn(digest, F.sha2(F.coalesce(text_col, F.lit("")), 256)).withColumn(null, F.col(text_col).isNull())
    order = [id_col, digest, null]  # numbers follow it, so that the least of a group does not depend on the rows' places
    keys = materialize(rows.select(*order).distinct().repartitionByRange(*order).sortWithinPartitions(*order).withColumn(key, F.monotonically_increasing_id()), "keys")
    return rows.join(keys, order).drop(digest, null), keys.select(key, F.col(id_col).cast("long").alias("doc_id")), key


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, m: int = 12, t: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links of at least `percent` similarity), kept."""
    if not ids_repeat(docs, id_col):
        return linked(docs, k, percent, m, t, id_col, text_col)
    # texts of one id are linked by it: each is a document of its own, with an edge to the first one of the id
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows, names, key = keyed(docs, "doc_id", "text")
    rows, names = materialize(rows.withColumnRenamed(key, "_key"), "keyed"), names.withColumnRenamed(key, "_key")
    same = names.groupBy("doc_id").agg(F.min("_key").alias("b"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("doc_id", "b")
    same = names.join(same, "doc_id").filter("_key <> b").select(F.col("_key").alias("a"), "b")
    got = materialize(linked(rows.select("_key", "text").dropDuplicates(["_key"]), k, percent, m, t, "_key", "text", same).withColumnRenamed("doc_id", "_key"), "keyed-classes")
    least = got.join(names, "_key").groupBy("component_id").agg(F.min("doc_id").alias("least"))
    out = rows.select("doc_id", "_key").join(got.join(least, "component_id").select("_key", "n_shingles", F.col("least").alias("component_id")), "_key")
    out = out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    return out.unionByName(linked(docs.filter("doc_id is null"), k, percent, m, t))


def linked(docs: DataFrame, k: int, percent: int, m: int, t: int, id_col: str = "doc_id", text_col: str = "text", more: DataFrame | None = None) -> DataFrame:
    """near_duplicates() where no id repeats. more: further edges (a, b) between ids."""
    signed = materialize(signatures(docs, k, m, t, id_col, text_col), "signatures", "doc_id")
    reps = signed.filter("n > 0 and doc_id is not null").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.first("half").alias("half"))
    reps = materialize(reps, "classes")  # equal sets have equal half keys
    tables = materialize(table_keys(reps.select("rep", "n", "half"), m), "tables")
    least = tables.groupBy("key").agg(F.min("rep").alias("y"), F.min_by("n", "rep").alias("ny"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("key", "y", "ny")
    stars = tables.join(least, "key").filter("rep <> y")
    pairs = materialize(stars.filter(F.least("n", "ny") * 100 >= percent * F.greatest("n", "ny")).select(F.col("rep").alias("x"), "y").distinct(), "pairs")
    good = verify(pairs, docs, k, id_col, text_col).filter(F.col("inter") * 100 >= percent * F.col("union_")).select(F.col("x").alias("a"), F.col("y").alias("b"))
    if more is not None:
        # classes that an id joins
        of = signed.select("doc_id", "d1", "d2", "n").join(reps.select("d1", "d2", "n", "rep"), ["d1", "d2", "n"], "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"))
        more = more.join(of.select(F.col("doc_id").alias("a"), F.col("rep").alias("ra")), "a").join(of.select(F.col("doc_id").alias("b"), F.col("rep").alias("rb")), "b")
        good = good.union(more.select("ra", "rb"))
    parts = connected_components(good)
    # buckets in which several components are left
    named = tables.select("key", "rep", "n").join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    open_ = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    rest = materialize(named.join(open_, "key", "left_semi").select("rep", "n", "component").distinct(), "rest")
    if not rest.isEmpty():
        # a shingle that one document alone has cannot be in an intersection
        sets = materialize(full_sets(rest.select("rep"), docs, k, id_col, text_col), "sets", "rep")
        rest = rest.join(lone_shingles(sets), "rep", "left").withColumn("s", F.col("n") - F.coalesce("lone", F.lit(0)).cast("int")).drop("lone")
        rest = materialize(rest.filter(F.col("s") * 100 >= percent * F.col("n")).join(reps.select("rep", "n", "half"), ["rep", "n"]), "rest")
        found = materialize(links_across(rest, sets, m, percent), "links")
        if not found.isEmpty():
            parts = connected_components(found.union(parts.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    # an id that `more` alone knows (of an empty set) is a node, but of no class
    classes = reps.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left").select("d1", "d2", "n", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n", "d1", "d2").join(classes, ["d1", "d2", "n"], "left")
    if more is not None:
        out = out.join(parts.select(F.col("node").alias("doc_id"), F.col("component").alias("own")), "doc_id", "left").withColumn("component", F.coalesce("component", "own"))
    out = out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, m: int = 12, t: int = 3) -> DataFrame:
    """The rows of docs, with all their columns, that are kept: one of each group of near-duplicates.

    Rows of equal id and text are one document, of which one row stays; rows of equal id and different texts are
    documents of their own here. Rows without id stay.
    """
    if not ids_repeat(docs, id_col):
        return without_near_duplicates(docs, id_col, text_col, k, percent, m, t)
    rows, _, key = keyed(docs, id_col, text_col)
    kept = without_near_duplicates(materialize(rows.dropDuplicates([key]), "keyed"), key, text_col, k, percent, m, t).select(*docs.columns)
    return docs.filter(F.col(id_col).isNull()).unionByName(kept)


def without_near_duplicates(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, m: int, t: int) -> DataFrame:
    """Rows that are kept, where no id repeats."""
    gone = linked(docs, k, percent, m, t, id_col, text_col).filter("not kept").select(F.col("doc_id").alias(id_col))
    gone = materialize(gone, "dropped")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, id_col, "left_anti").select(*docs.columns)
