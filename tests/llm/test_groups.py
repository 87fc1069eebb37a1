"""Near-duplicates, packing, token files and the pipeline."""

import random
import zlib
from collections import Counter

import numpy as np
import pyspark.sql.functions as F
import pytest

import __spark_entry__
import corpus_pipeline
from lexloom.llm import near_dup, packing, wavelet
from lexloom.llm.components import connected_components
from lexloom.llm.tokens import Encoder, default_path, encoder

TRICKY = ["", None, "a  b", "a\n\nb", "x\t \ty", " lead", "trail ", "é à\nñ", "\n", "<|endoftext|> a", "don't stop\nit's", "a b c", "“q” a b", "\x1c a", " ", "x" * 700_000 + " y z"]


def plain_ids(text):
    return np.append(encoder(default_path()).whole([text or ""])[0], 2).astype("<u4")


def test_encoder_equals_the_library():
    enc = Encoder(default_path(), bits=19)
    enc.known = 1 << 18  # forgets at once
    r = random.Random(1)
    texts = TRICKY + [" ".join("".join(r.choice("abcdeéñ#!.") for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 200))) + r.choice(["", "\nx y", "  z"]) for _ in range(60)]
    ids, counts = enc.encode(texts)
    for t, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert (own == enc.whole([t or ""])[0]).all()
    assert enc.encode([])[1].size == 0


def components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(201, 200), (202, 200), (202, 202), (40, 39)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = components(edges, {x for e in edges for x in e})
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(120)]
    rows = []
    for i in range(220):  # copies of copies, with growing numbers of changes: many pairs lie about the threshold
        own = base[:]
        for _ in range(r.randint(0, 5)):
            own[r.randrange(len(own))] = word()
        rows.append((i, " ".join(own).upper() if i % 9 == 0 else "\n".join(own)))
    for i in range(300, 340):
        rows.append((i, " ".join(word() for _ in range(r.randint(1, 60)))))
    rows += [(400, ""), (401, None), (402, " \t "), (403, "one two"), (404, "ONE two"), (405, "one"), (406, rows[0][1]), (407, rows[0][1]), (407, rows[0][1]), (None, rows[0][1])]
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 4]) for j in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    ids = [i for i in sets if i is not None]
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(links, ids)
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, component int")
    got = near_dup.near_duplicates(df, k=4).collect()
    assert len(got) == len(rows)
    for x in got:
        assert x.n_shingles == len(sets[x.doc_id])
        assert x.component_id == (want[x.doc_id] if x.doc_id is not None else None)
        assert x.kept == (x.doc_id is None or x.component_id == x.doc_id)
    kept = near_dup.deduplicate(df, k=4)
    assert kept.columns == df.columns
    assert Counter(x.doc_id for x in kept.collect()) == Counter({i for i in ids if want[i] == i} | {None})
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    r = np.random.default_rng(4)
    lengths = np.sort(r.integers(1, 100, 3000))[::-1]
    where, offset = packing.best_fit(lengths, 100, 4, 6000, rule=rule) if lengths.max() ** 2 <= 6000 else packing.best_fit(lengths, 100, 4, 10_000, rule=rule)
    for b in np.unique(where):
        own = np.flatnonzero(where == b)
        assert lengths[own].sum() <= 100 and len(own) <= 4 and (lengths[own] ** 2).sum() <= 10_000
        order = own[np.argsort(offset[own])]
        assert (offset[order] == np.cumsum(lengths[order]) - lengths[order]).all()
    free = packing.best_fit(lengths, 100, 100, 10_000, rule=rule)[0]
    assert free.max() + 1 <= 1.03 * np.ceil(lengths.sum() / 100)


def test_packing_round_trip(spark):
    rows = [(i, t) for i, t in enumerate([*TRICKY, "word " * 5000, "w", "w"])] + [(None, "no id"), (3, "again"), (3, "again")]
    df = spark.createDataFrame([(*x, 5) for x in rows], "doc_id long, text string, length int")
    got = packing.pack_documents(df, capacity=64, block_pieces=50).collect()
    want = Counter()
    for i, t in rows:
        ids = plain_ids(t)
        for k, (a, n) in enumerate(packing.cut(len(ids), 64)):
            want[i, k, a, n, zlib.crc32(ids[a : a + n].tobytes())] += 1
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == want
    seqs = {}
    for x in got:
        seqs.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for own in seqs.values():
        own.sort()
        assert sum(n for _, n in own) <= 64 and all(a == sum(n for _, n in own[:i]) for i, (a, _) in enumerate(own))
    assert packing.cut(64, 64) == [(0, 64)] and packing.cut(65, 64) == [(0, 1), (1, 64)]
    ids = packing.encode_pieces(df.filter("doc_id = 8"), capacity=64, with_ids=True).first().ids
    assert ids == plain_ids("\n").tolist()
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_wavelet_queries():
    r = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 1), (5000, 3), (600_000, 50_257)):
        ids = (r.zipf(1.4, n) % top).astype(np.uint32)
        w = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids, np.array([7]), np.array([n])))
        assert (w.to_array() == ids).all() and w.doc_ids.tolist() == [7]
        for i in r.integers(0, n, 20).tolist() if n else []:
            t = int(ids[i])
            assert w.access(i) == t and w.rank(t, i) == int((ids[:i] == t).sum()) and w.select(t, w.rank(t, i)) == i
        if n:
            assert w.occurrences(int(ids[0])) == np.flatnonzero(ids == ids[0]).tolist() if n < 10_000 else True
            assert w.count(1 << 20) == 0 and w.count(int(ids[0]), n // 2) == int((ids[n // 2 :] == ids[0]).sum())
            with pytest.raises(IndexError):
                w.access(n)
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix.from_bytes(b"nothing at all")


def test_token_files_round_trip(spark):
    rows = [(i * 3, t) for i, t in enumerate([*TRICKY, "word " * 5000])] + [(6, "equal id"), (None, "no id"), (-1, "below none")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, part int").repartition(5)
    got = wavelet.round_trip(df, shard_tokens=3000).orderBy("start").collect()
    start = 0
    for x in got:
        assert x.start == start
        start += x.n_tokens
    assert [x.doc_id for x in got] == [None] + sorted(i for i, _ in rows if i is not None)
    want = Counter((i, len(plain_ids(t)), zlib.crc32(plain_ids(t).tobytes())) for i, t in rows)
    assert Counter((x.doc_id, x.n_tokens, x.ids_crc32) for x in got) == want
    assert wavelet.round_trip(df.limit(0)).count() == 0


def test_pipeline_stages_filter(spark):
    sf, docs, seen = "/root/testdata/sf0.001", None, []
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == columns
        before, after = {r.doc_id for r in docs.select("doc_id").collect()}, {r.doc_id for r in out.select("doc_id").collect()}
        assert after <= before
        seen.append((name, len(before) - len(after)))
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_dup", "benchmark", "packing"]
    assert sum(n for _, n in seen) > 0
    result = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in result.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_all_queries_are_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


def test_an_id_that_repeats_keeps_different_texts(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [(1, one), (1, two), (1, two), (2, one), (3, three), (3, None), (None, "x"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text or "") for r in near_dup.deduplicate(df, k=4).collect())
    assert got == sorted([(1, one), (1, two), (3, three), (3, ""), (0, "x"), (0, "x")])


def test_links_of_all_texts_of_an_id(spark):
    one, two = ([f"{c}{i}" for i in range(60)] for c in "ab")
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, " ".join([*one, "x"])), (3, " ".join([*two, "y"])), (4, None), (4, " ".join([*two, "z"])), (5, ""), (5, "only this"), (6, "only THIS"), (7, None), (None, " ".join(one)), (1, " ".join(one))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dup.near_duplicates(df, k=4).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in got) == Counter({(1, 1, True): 3, (2, 1, False): 1, (3, 1, False): 1, (4, 1, False): 2, (5, 5, True): 2, (6, 5, False): 1, (7, 7, True): 1, (None, None, True): 1})
    assert {(r.doc_id, r.n_shingles) for r in got} >= {(4, 0), (5, 0), (5, 1), (7, 0), (1, 57)}


def test_hot_buckets_lose_no_link(spark):
    r = random.Random(3)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(400):  # two families that share enough shingles to meet in buckets, and a few texts between them
        own = base[:]
        for j in r.sample(range(40), 2 if i % 2 else 6):
            own[j] = f"v{i % 7}"
        rows.append((i, " ".join(own)))
    sets = {i: {tuple(w[j : j + 4]) for w in [t.split()] for j in range(len(w) - 3)} for i, t in rows}
    links = [(a, b) for a in sets for b in range(a + 1, 400) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(links, list(sets))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()
    assert {x.doc_id: x.component_id for x in got} == want


def test_equal_pieces_are_dealt_to_many_blocks(spark):
    same = spark.range(100_000).selectExpr("1L doc_id", "0 piece", "0L start", "10L length", "7L ids_crc32").repartition(4)
    got = packing.pack(same, capacity=100, block_pieces=2000).selectExpr("sequence_id >> 24 block", "sequence_id", "length")
    sizes = [r.n for r in got.groupBy("block").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 50 and max(sizes) < 3000 and sum(sizes) == 100_000
    assert got.select("sequence_id").distinct().count() <= 10_000 + 50


def test_pipeline_edges(spark, tmp_path):
    key = next(iter(corpus_pipeline.BATCHES))
    before = spark.conf.get(key, None)
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("_key", F.lit("x")).withColumn("component", F.lit(1)).withColumn("length", F.lit(2))
    columns = docs.columns
    clean = docs.orderBy("doc_id").first()
    odd = [(901, None), (902, ""), (903, "12 !"), (None, clean.text), (None, None), (904, "une phrase " * 40_000), (904, "une phrase " * 40_000), (905, clean.text)]
    more = spark.createDataFrame([(i, t, "en", "odd", 1, "x", 1, 2) for i, t in odd], docs.schema)
    docs = docs.unionByName(more)
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = spark.createDataFrame(stage(spark, out, str(tmp_path)).collect(), docs.schema)
        assert out.columns == columns
    spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    kept = Counter(r.doc_id for r in out.select("doc_id").collect())
    assert not {901, 902, 903} & set(kept) and kept[904] == 1 and kept[None] <= 1
    result = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in result.select("doc_id").collect()} == set(kept) and spark.conf.get(key, None) == before
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
