r"""Source divergence audit: which sources of a language use its words differently, and which words tell them apart.

Terms are the matches of [^\x00-\x40\x5B-\x60\x7B-\x7F]+ with A-Z lower-cased. A language keeps the terms in at least
`least_docs` of its documents (rows). A group (lang, source), and a language as a whole, gives a kept term with `count`
occurrences the share p = 1 + floor(10^9 (count + 2) / (N + 2 V)), N its occurrences of kept terms, V their number. Two shares
differ by f = floor((p - q)^2 / (p + q)). All of it is exact in integers.

    count    every partition counts its terms in a byte radix trie, whose leaves hold documents and counters by source; a full
             trie is streamed out, its leaves in the order of their bytes, and begun anew
    merge    leaves are dealt out by ranges of (lang, bytes), whose bounds a bounded sample of terms gives (they decide on the size of
             the ranges alone), so that equal ones meet sorted and side by side whatever their frequency; those in too
             few documents end here
    stream   a second walk over the merged leaves, in the order of their bytes, sums f for each pair of sources over blocks of terms and
             keeps the first candidates of each group by (value descending, bytes ascending); both are merged by an aggregate
             and a rank

No term's leaves are held together but those of one key, and a hot term or source is one leaf or counter of each trie.

Defined results: null text, lang and source are ''; a group without terms has pairs and no terms; a language without kept
terms has pairs of value 0; one with a single source has no pairs; repeated rows count as often as they stand; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import gc
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from .common import give_back, materialize
from .wordhash import chunks, utf8

#: Bytes of a term stay, A-Z in lower case, all others become spaces.
TABLE = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
#: Leaves of a trie before it is streamed out.
LEAVES = 300_000
#: Bytes of text that are counted at once.
CHUNK = 12 << 20
#: Groups whose names and totals are broadcast to the tasks of one walk, some MB.
GROUPS = 100_000
#: Sources on a side of the pairs that are summed at once, and cells of a block of terms.
TILE, CELLS = 1024, 1 << 20
SCALE_STEPS = 3  # 10^9 as 1000 * 1000 * 1000

class Node:
    """A run of bytes below its parent; a leaf if it has counts."""

    __slots__ = ("label", "children", "docs", "counts")

    def __init__(self, label: bytes, children: dict[int, Node] | None = None):
        self.label, self.children, self.docs, self.counts = label, children, 0, None


class Trie:
    """A radix trie over bytes. Leaves hold a number of documents and a counter by source; equal leaves add up."""

    def __init__(self) -> None:
        self.root, self.leaves = Node(b"", {}), 0

    def leaf(self, term: bytes) -> Node:
        """The leaf of a term, made if it is new."""
        node, at, n = self.root, 0, len(term)
        while at < n:
            children = node.children
            if children is None:
                children = node.children = {}
            child = children.get(term[at])
            if child is None:
                node = children[term[at]] = Node(term[at:])
                break
            label = child.label
            if term.startswith(label, at):
                node = child
                at += len(label)
                continue
            same, most = 1, min(len(label), n - at)
            while same < most and label[same] == term[at + same]:
                same += 1
            node = children[term[at]] = Node(label[:same], {label[same]: child})
            child.label = label[same:]
            at += same
        if node.counts is None:
            node.counts = {}
            self.leaves += 1
        return node

    def add(self, term: bytes, docs: int, sources: list[int], counts: list[int]) -> None:
        """Adds documents and occurrences by source of a term."""
        leaf = self.leaf(term)
        leaf.docs += docs
        own = leaf.counts
        if own:
            for source, n in zip(sources, counts, strict=True):
                own[source] = own.get(source, 0) + n
        else:
            own.update(zip(sources, counts, strict=True))

    def walk(self) -> Iterator[tuple[bytes, Node]]:
        """Leaves in the order of their bytes."""
        stack = [(self.root, b"")]
        while stack:
            node, term = stack.pop()
            term += node.label
            if node.docs:
                yield term, node
            if node.children:
                stack += [(node.children[b], term) for b in sorted(node.children, reverse=True)]


LEAF_DDL = "lang string, term string, docs long, sources array<string>, counts array<long>"
LEAVES_DDL = f"range int, {LEAF_DDL}"
LEAF_ARROW = pa.schema([("lang", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
Batches = Iterator[pa.RecordBatch]
#: The first (lang, term) of each range but the first.
Bounds = list[tuple[str, bytes]]


def _terms(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The text that each term stands in, and the terms, of an Arrow array of texts."""
    buf, offsets = utf8(texts)
    cleaned = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(buf.tobytes().translate(TABLE)))
    lists = pc.ascii_split_whitespace(cleaned)
    flat = lists.flatten()
    there = pc.greater(pc.binary_length(flat), 0)
    doc = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))
    return doc[there.to_numpy(zero_copy_only=False)], flat.filter(there).dictionary_encode()


def _add(batch: pa.RecordBatch, tries: dict[str, Trie], code: dict[str, int]) -> None:
    """Counts a batch of (text, lang, source) into the tries of its languages. code: numbers of sources."""
    doc, terms = _terms(batch.column(0))
    if not len(doc):
        return
    groups = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
    known = sorted(set(groups))  # of a language side by side
    place = {g: i for i, g in enumerate(known)}
    langs = sorted({lang for lang, _ in known})
    lang_of = np.array([langs.index(lang) for lang, _ in known])
    source_of = np.array([code.setdefault(source, len(code)) for _, source in known])
    group = np.array([place[g] for g in groups])
    words = terms.dictionary.cast(pa.large_binary()).to_pylist()
    order = sorted(range(len(words)), key=words.__getitem__)  # neighbours in the trie one after another
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    words = [words[i] for i in order]
    found = pc.value_counts(pa.array(rank[terms.indices.to_numpy(zero_copy_only=False)] * len(groups) + doc))
    once, times = found.field("values").to_numpy(), found.field("counts").to_numpy()
    cells = once // len(groups) * len(known) + group[once % len(groups)]
    order = np.argsort(cells, kind="stable")
    cells, times = cells[order], times[order]
    first = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
    cells, counts, docs = cells[first], np.add.reduceat(times, first).tolist(), np.diff(np.append(first, len(cells)))
    sources = source_of[cells % len(known)].tolist()
    key = cells // len(known) * len(langs) + lang_of[cells % len(known)]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    key, docs, cuts = key[first], np.add.reduceat(docs, first), np.append(first, len(cells)).tolist()
    into = [tries.setdefault(lang, Trie()) for lang in langs]
    for i, (k, n) in enumerate(zip(key.tolist(), docs.tolist(), strict=True)):
        word, lang = divmod(k, len(langs))
        into[lang].add(words[word], n, sources[cuts[i] : cuts[i + 1]], counts[cuts[i] : cuts[i + 1]])


def _lists(sizes: np.ndarray | list[int], values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), values)


def _stream_out(tries: dict[str, Trie], sources: list[str], bounds: Bounds, rows: int = 50_000) -> Batches:
    """The leaves of tries with their ranges."""
    names = pa.array(sources, pa.string())
    for lang in sorted(tries, key=str.encode):
        ends = [t for x, t in bounds if x == lang]
        before = bisect_left([x.encode() for x, _ in bounds], lang.encode())
        walk = tries[lang].walk()
        while part := list(islice(walk, rows)):
            terms = [t for t, _ in part]
            own = [leaf.counts for _, leaf in part]
            sizes = [len(c) for c in own]
            codes = np.fromiter((k for c in own for k in c), np.int32, sum(sizes))
            counts = np.fromiter((n for c in own for n in c.values()), np.int64, len(codes))
            ranges = np.zeros(len(part), np.int32) + before
            for e in ends:
                ranges[bisect_left(terms, e) :] += 1
            docs = np.fromiter((leaf.docs for _, leaf in part), np.int64, len(part))
            columns = [pa.array(ranges), pa.array([lang] * len(part)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(docs), _lists(sizes, names.take(pa.array(codes))), _lists(sizes, pa.array(counts))]
            yield pa.record_batch(columns, names=["range", *LEAF_ARROW.names])


def _count(leaves: int, bounds: Bounds) -> Callable[[Batches], Batches]:
    """Batches of (text, lang, source) to the leaves of a partition's tries, one trie a language."""

    def run(batches: Batches) -> Batches:
        tries: dict[str, Trie] = {}
        code: dict[str, int] = {}
        gc.disable()  # tries have no cycles, and looking for them takes as long as building
        try:
            for big in batches:
                for b in chunks(big, 0, CHUNK):
                    _add(b, tries, code)
                    if sum(t.leaves for t in tries.values()) > leaves:
                        yield from _stream_out(tries, list(code), bounds)
                        tries, code = {}, {}
            yield from _stream_out(tries, list(code), bounds)
        finally:
            gc.enable()
        tries.clear()
        give_back()

    return run


def _merge(least_docs: int) -> Callable[[Batches], Batches]:
    """Sorted leaves to merged ones: equal keys stand side by side. A batch's last key may go on in the next one and waits for it."""

    def merged(b: pa.Table) -> pa.RecordBatch | None:
        lang, term = (b.column(c).combine_chunks() for c in ("lang", "term"))
        n = len(term)
        new = np.ones(n, bool)
        new[1:] = ~(pc.equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False) & pc.equal(lang[1:], lang[:-1]).to_numpy(zero_copy_only=False))
        first = np.flatnonzero(new)
        docs = np.add.reduceat(b.column("docs").to_numpy(), first)
        keep = docs >= least_docs
        if not keep.any():
            return None
        run = np.cumsum(new) - 1
        rows = np.flatnonzero(keep[run])
        place = np.cumsum(keep) - 1  # of the runs that are kept
        part = b.select(["sources", "counts"]).take(pa.array(rows)).combine_chunks()
        lists = part.column("sources").combine_chunks()
        names = lists.flatten().dictionary_encode()
        owner = np.repeat(place[run[rows]], lists.value_lengths().to_numpy(zero_copy_only=False))
        cell = owner * len(names.dictionary) + names.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        counts = np.add.reduceat(part.column("counts").combine_chunks().flatten().to_numpy(zero_copy_only=False)[order], starts)
        cell = cell[starts]
        sizes = np.bincount(cell // len(names.dictionary), minlength=int(keep.sum()))
        at = pa.array(first[keep])
        columns = [lang.take(at), term.take(at), pa.array(docs[keep]), _lists(sizes, names.dictionary.take(pa.array(cell % len(names.dictionary)))), _lists(sizes, pa.array(counts))]
        return pa.RecordBatch.from_arrays(columns, schema=LEAF_ARROW)

    def folded(b: pa.Table) -> pa.Table:
        """Rows of one key as one row."""
        own: Counter = Counter()
        for sources, counts in zip(b.column("sources").to_pylist(), b.column("counts").to_pylist(), strict=True):
            for source, n in zip(sources, counts, strict=True):
                own[source] += n
        values = [b.column("lang")[0].as_py()], [b.column("term")[0].as_py()], [pc.sum(b.column("docs")).as_py()], [list(own)], [list(own.values())]
        return pa.table([pa.array(v, f.type) for v, f in zip(values, LEAF_ARROW, strict=True)], schema=LEAF_ARROW)

    def run(batches: Batches) -> Batches:
        waits: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            own = pa.Table.from_batches([b.cast(LEAF_ARROW)])
            own = own if waits is None else pa.concat_tables([waits, own])
            last = (own.column("lang")[-1].as_py(), own.column("term")[-1].as_py())
            i = own.num_rows - 1
            while i > 0 and (own.column("term")[i - 1].as_py(), own.column("lang")[i - 1].as_py()) == last[::-1]:
                i -= 1
            waits = folded(own.slice(i))
            if i and (out := merged(own.slice(0, i).combine_chunks())) is not None:
                yield out
        if waits is not None and (out := merged(waits)) is not None:
            yield out

    return run


def bounds_of(docs: DataFrame, ranges: int, documents: int = 2000, most: int = 50_000) -> Bounds:
    """Where ranges of (lang, term) begin, from the terms of a bounded sample of documents."""

    def some(batches: Batches) -> Batches:
        for b in batches:
            doc, terms = _terms(b.column(0))
            langs, words = b.column(1).to_pylist(), terms.dictionary.cast(pa.large_binary()).to_pylist()
            pairs = np.unique(terms.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(langs) + doc) if len(doc) else []
            found = {(langs[x % len(langs)], words[x // len(langs)]) for x in pairs if zlib.crc32(words[x // len(langs)]) % 16 == 0}
            yield pa.record_batch([pa.array([x for x, _ in found], pa.string()), pa.array([t for _, t in found], pa.binary())], names=["lang", "term"])

    n = docs.count()
    part = docs.select("text", "lang") if n <= documents else docs.select("text", "lang").sample(documents / n, 11)
    terms = sorted((r.lang.encode(), bytes(r.term)) for r in part.mapInArrow(some, "lang string, term binary").distinct().limit(most).collect())
    return sorted({(terms[len(terms) * i // ranges][0].decode(), terms[len(terms) * i // ranges][1]) for i in range(1, ranges)}, key=lambda x: (x[0].encode(), x[1])) if terms else []


def kept_terms(docs: DataFrame, least_docs: int = 10, leaves: int = LEAVES) -> DataFrame:
    """Merged leaves (lang, term, docs, sources, counts) of the terms in at least `least_docs` documents of a language. docs: text, lang, source, without nulls."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("text", "lang", "source").mapInArrow(_count(leaves, bounds_of(docs, 4 * n)), LEAVES_DDL)
    ranges = rows.repartition(n, "range").sortWithinPartitions("lang", "term").drop("range")
    return materialize(ranges.mapInArrow(_merge(least_docs), LEAF_DDL), "leaves")


def share(count: np.ndarray, total: np.ndarray | int, terms: int) -> np.ndarray:
    """p = 1 + floor(10^9 (count + 2) / (total + 2 terms)), by long division: no step leaves 64 bits."""
    of = np.asarray(total, np.int64) + 2 * terms
    rest, out = count.astype(np.int64) + 2, np.zeros(np.broadcast(count, of).shape, np.int64)
    for _ in range(SCALE_STEPS):
        rest = rest * 1000
        out = out * 1000 + rest // of
        rest = rest % of
    return out + 1


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


AUDIT_SCHEMA = "lang string, source string, part string, item string, value long"
AUDIT_ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])

#: A language: its sources, their totals, its kept terms.
Totals = tuple[list[str], list[int], int]


def _stream(langs: dict[str, Totals], top: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Merged leaves to sums of f over their terms for pairs of sources, and to each group's first candidates."""

    def rows(lang: str, sources: list[str], part: str, items: list[str], values: list[int]) -> pa.RecordBatch:
        return pa.record_batch([[lang] * len(sources), sources, [part] * len(sources), items, values], schema=AUDIT_ARROW)

    def pairs(lang: str, names: list[str], sums: np.ndarray, i: int, j: int) -> Iterator[pa.RecordBatch]:
        for x in range(sums.shape[0]):
            others = [y for y in range(sums.shape[1]) if j + y != i + x]
            if others:
                yield rows(lang, [names[i + x]] * len(others), "pair", [names[j + y] for y in others], sums[x, others].tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {lang: {s: i for i, s in enumerate(sources)} for lang, (sources, _, _) in langs.items()}
        sums: dict[str, np.ndarray] = {}
        best: dict[tuple[str, int], list[tuple[int, bytes]]] = {}

        def block(lang: str, terms: list[str], sources: list[list[str]], counts: list[list[int]]) -> Iterator[pa.RecordBatch]:
            names, totals, kept = langs[lang]
            n = len(names)
            table = np.zeros((len(terms), n), np.int64)
            at = [place[lang][s] for own in sources for s in own]
            table[np.repeat(np.arange(len(terms)), [len(x) for x in sources]), at] = [c for own in counts for c in own]
            p = share(table, np.array(totals), kept)
            q = share(table.sum(axis=1), sum(totals), kept)
            values = np.where((table > 0) & (p > q[:, None]), difference(p, q[:, None]), -1)
            for s in np.flatnonzero((values >= 0).any(axis=0)).tolist():
                first = np.argsort(-values[:, s], kind="stable")[:top]  # a batch may join runs of terms, hence the bytes as well
                edge = values[first[-1], s]
                first = np.flatnonzero((values[:, s] >= 0) & (values[:, s] >= edge))
                found = best.get((lang, s), []) + [(-int(values[i, s]), terms[i].encode()) for i in first.tolist()]
                best[lang, s] = sorted(found)[:top]
            for i in range(0, n, TILE):
                for j in range(0, n, TILE):
                    left, right = p[:, i : i + TILE], p[:, j : j + TILE]
                    total = sums.get(lang) if n <= TILE else None
                    if total is None:
                        total = np.zeros((left.shape[1], right.shape[1]), np.int64)
                    for x in range(left.shape[1]):
                        total[x] += difference(left[:, x : x + 1], right).sum(axis=0)
                    if n <= TILE:
                        sums[lang] = total
                    else:
                        yield from pairs(lang, names, total, i, j)

        for b in batches:
            lang, term, _, sources, counts = (c.to_pylist() for c in b.columns)
            i = 0
            while i < len(lang):
                if lang[i] not in langs:
                    i += 1
                    continue
                j = i
                most = i + max(1, CELLS // len(langs[lang[i]][0]))
                while j < len(lang) and lang[j] == lang[i] and j < most:
                    j += 1
                yield from block(lang[i], term[i:j], sources[i:j], counts[i:j])
                i = j
        for lang, total in sums.items():
            yield from pairs(lang, langs[lang][0], total, 0, 0)
        for (lang, s), found in best.items():
            yield rows(lang, [langs[lang][0][s]] * len(found), "term", [t.decode() for _, t in found], [-v for v, _ in found])

    return run


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10, leaves: int = LEAVES) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): every pair of sources of a language, and each group's `top` terms.

    part `pair`: item is another source of the language, value the sum of f over its kept terms. part `term`: item is a kept
    term that the group uses more than its language does, value f between the two. rank: from 1, values descending, items
    ascending by bytes. Names and totals of the groups are broadcast, languages being walked in slices of at most GROUPS
    groups; a language with more sources alone has over 10^10 pairs by definition and is refused.
    """
    spark = docs.sparkSession
    docs = docs.select("text", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    kept = kept_terms(docs, least_docs, leaves)
    cells = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c"))
    totals = cells.groupBy("lang", F.col("c.sources").alias("source")).agg(F.sum("c.counts").alias("total"))
    groups = materialize(docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").fillna(0, ["total"]), "groups")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    # the empty pairs stand for languages without kept terms; each language's number of sources is checked before any comes here
    per_lang = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).join(sizes, "lang", "left").fillna(0, ["terms"]).orderBy("lang")
    slices: list[dict[str, tuple[int, int]]] = [{}]
    for r in per_lang.toLocalIterator():
        if r.n > GROUPS:
            raise ValueError(f"language {r.lang!r} has {r.n} sources; their pairs are over {GROUPS**2} rows")
        if sum(n for n, _ in slices[-1].values()) + r.n > GROUPS:
            slices.append({})
        slices[-1][r.lang] = (r.n, r.terms)
    parts = []
    for own in slices:
        found: dict[str, Totals] = {lang: ([], [], terms) for lang, (_, terms) in own.items()}
        for r in groups.filter(F.col("lang").isin(list(own))).orderBy("lang", "source").toLocalIterator():
            found[r.lang][0].append(r.source)
            found[r.lang][1].append(r.total)
        parts.append(kept.mapInArrow(_stream(found, top), AUDIT_SCHEMA))
    rows = spark.createDataFrame([], AUDIT_SCHEMA)
    for part in parts:
        rows = rows.unionByName(part)
    none = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")).join(sizes, "lang", "left_anti"), "lang").filter("source <> item")
    rows = rows.unionByName(none.select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value")))
    rows = rows.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return rows.withColumn("rank", place).filter(F.expr(f"part = 'pair' or rank <= {int(top)}"))
