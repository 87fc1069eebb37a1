"""Sharding, quality rules and shared helpers against brute force."""

import math
import re
import zlib
from fractions import Fraction

import pyspark.sql.functions as F
import pytest

from lexloom.llm import quality_rules as qr
from lexloom.llm import queries
from lexloom.llm.common import crc32_of_id, hashed_sample, words_py
from lexloom.llm.shard_tree import Leaf, default_tree, shard_documents

TEXTS = ["a b", None, "", "x", "a b", "ñ" * 5000, "tab\tand\nline", "é è"]


def docs_of(spark, texts, extra=True):
    rows = [(i, t, "en" if i % 2 else None, 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, shard int")
    return df if extra else df.drop("shard")


def test_shards_have_gapless_slots_and_sizes(spark):
    rows = shard_documents(docs_of(spark, TEXTS * 30), 16).collect()
    assert len(rows) == len(TEXTS) * 30
    by = {}
    for r in rows:
        text = (TEXTS * 30)[r.doc_id] or ""
        assert r.size == len(text.encode()) + 1 and r.text_crc32 == zlib.crc32(text.encode()) and r.law == "key"
        assert r.grown_shard in (r.shard, 16)
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_repeated_rows_and_null_ids_get_slots(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, None)], "doc_id long, text string")
    rows = shard_documents(df, 4).collect()
    assert len({(r.shard, r.slot) for r in rows}) == 4
    assert shard_documents(df.limit(0), 4).count() == 0


def test_weights_move_rows_only_into_the_raised_subtree(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    tree = default_tree(16)
    raised = [Leaf(x.shard, x.region, x.rack, 3.0 if x.shard == 5 else 1.0) for x in tree]
    moved = [(r.shard, r.grown_shard) for r in shard_documents(df, tree=tree, grown=raised).collect() if r.shard != r.grown_shard]
    assert moved and all(b // 8 == 0 for _, b in moved), "only into the region whose weight rose"
    assert all(b // 4 == 1 for a, b in moved if a // 8 == 0), "in it only into the rack whose weight rose"
    assert all(b == 5 for a, b in moved if a // 4 == 1), "in that only into the shard itself"
    counts = [0] * 16
    for r in shard_documents(df, tree=tree, grown=raised).collect():
        counts[r.grown_shard] += 1
    assert counts[5] > 2 * sum(counts) / 18 * 0.8


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    spans = {}
    for i in range(len(w) - 7):
        spans.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {i + k for v in spans.values() if len(v) > 1 for i in v for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_base_metrics_equal_brute_force(spark):
    words = " ".join(f"w{i}" for i in range(30))
    texts = [*TEXTS, words + " " + words, "a " * 40, "x\nx\n\n \nx\r\nx", words + " zz " + words[:40], "# $ | <b>", "same line\n" * 5, " ".join("ab"[i % 2] for i in range(41))]
    got = {r.doc_id: r for r in qr.base_metrics(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), t


def test_binomial_tail_is_exact(spark):
    cases = [(0, 10, 0.05), (3, 50, 0.05), (5, 5, 0.2), (40, 4000, 0.01)]
    for k, n, p in cases:
        exact = sum(math.comb(n, j) * Fraction(p) ** j * (1 - Fraction(p)) ** (n - j) for j in range(k + 1))
        got = spark.range(1).select(qr.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        assert got == pytest.approx(float(exact), rel=1e-9)


def test_rules_reject_junk_and_keep_good(spark):
    good = [" ".join(f"word{(i * 37 + j) % 977}" for j in range(40)) for i in range(1500)]
    bad = [" ".join(f"w{(i * 31 + j) % 977}###" for j in range(40)) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(good + bad)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 1500)) for i in range(1800)], "doc_id long, quality int")
    rows = qr.quality_filter(docs, labels, alpha=0.05).collect()
    assert all(r.kept == (r.doc_id < 1500) for r in rows)
    none = qr.quality_filter(docs.limit(50), labels.limit(0)).collect()
    assert all(r.kept for r in none), "without labels nothing is rejected beyond the base rule"
    assert qr.quality_filter(docs.limit(0), labels).count() == 0


def tail(k, n, p):
    return float(sum(math.comb(n, j) * Fraction(p) ** j * (1 - Fraction(p)) ** (n - j) for j in range(k + 1)))


def metrics_of(spark, rows):
    """rows: doc_id, stratum, symbols a word; nothing else is remarkable."""
    df = spark.createDataFrame(rows, "doc_id long, stratum string, s double")
    return df.selectExpr("doc_id", "stratum", "100L n_words", "500L word_chars", "cast(round(s * 100) as long) n_symbols", "5L n_upper", "9L n_lines", "0L n_dup_lines", "0L n_repeat_words")


def test_thresholds_equal_brute_force(spark):
    import random

    r = random.Random(2)
    rows, good = [], {}
    for i in range(2400):
        stratum = "abcd"[i % 4]  # good documents of d spread widely, those of c are few
        y = int(r.random() < (0.05 if stratum == "c" else 0.8))
        rows.append((i, stratum, round(r.betavariate(1, 40 if stratum != "d" else 2) if y else r.random(), 2)))
        good[i] = y
    labels = spark.createDataFrame([(*x, 0) for x in good.items()] + [(None, 1, 0), (5, None, 0), (99999, 1, 0)], "doc_id long, quality int, stratum int")
    got = {x.stratum: x for x in qr.thresholds(metrics_of(spark, rows), labels, alpha=0.05).collect()}
    want = {}
    for s in "abcd":
        own = [(max(int(round(v * 100)) / 100, 0.05), good[i]) for i, t, v in rows if t == s]
        n, bad = sum(y for _, y in own), sum(1 - y for _, y in own)
        best = (0.0, -1.0)
        for c in reversed(qr.GRID):
            k, b = sum(y for v, y in own if v > c), sum(1 - y for v, y in own if v > c)
            if tail(k, n, 0.05) > 0.05 / 4:
                break
            gain = b / bad - 5 * k / n
            best = max(best, (gain, c)) if gain > 0 else best
        if best[1] >= 0:
            want[s] = best[1]
    assert {k: v.cutoff for k, v in got.items()} == want and "a" in want and "c" not in want


def test_false_rejections_stay_below_alpha_on_fresh_rows():
    """The law of thresholds() in plain Python, many times: cutoffs learned from a sample, tried on the whole population."""
    import random

    r = random.Random(8)
    broken = 0
    for _ in range(400):
        scores = sorted(r.betavariate(1, 8) for _ in range(300))
        cut = None
        for c in reversed(qr.GRID):
            k = sum(x > c for x in scores)
            if k > 6 or tail(k, 300, 0.02) > 0.05:
                break
            cut = c
        broken += cut is not None and (1 - min(cut, 1.0)) ** 8 > 0.02  # P[score > cut]
    assert broken <= 400 * 0.05 + 3 * math.sqrt(400 * 0.05 * 0.95)


def test_rules_reject_in_every_stratum_of_the_tables(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = qr.quality_filter(docs, labels).filter("not base_failed").join(labels.groupBy("doc_id").agg(F.max("quality").alias("y")), "doc_id", "left")
    by = {r.stratum: r for r in rows.groupBy("stratum").agg(F.count_if(~F.col("kept")).alias("gone"), F.avg((~F.col("kept") & (F.col("y") == 1)).cast("int")).alias("x"), F.count_if(F.col("y") == 1).alias("n"), F.count_if(~F.col("kept") & (F.col("y") == 1)).alias("k")).collect()}
    assert set(by) == {"de", "en", "es", "fr"}
    assert all(r.gone > 0 and r.k <= 0.02 * r.n for r in by.values())


def test_quality_edges(spark):
    rows = [(1, None, None, 7), (1, "x" * 2_000_000 + " y" * 30, "en", 7), (2, " ".join(f"w{i}" for i in range(25)), "en", 7), (2, " ".join(f"w{i}" for i in range(25)), "en", 7), (None, "", "en", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, stratum int")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1)], "doc_id long, quality int")
    got = sorted((r.doc_id or 0, r.stratum, r.n_words, r.base_failed, r.kept) for r in qr.quality_filter(docs, labels).collect())
    assert got == [(0, "en", 0, True, False), (1, "en", 31, True, False), (1, "none", 0, True, False), (2, "en", 25, False, True), (2, "en", 25, False, True)]


def test_helpers(spark):
    assert words_py("A b\x0bÉ c".encode()) == ["a b".encode(), "É".encode(), b"c"]
    df = spark.createDataFrame([(12,), (None,)], "i long")
    assert [r[0] for r in df.select(crc32_of_id(F.col("i"))).collect()] == [zlib.crc32(b"12"), 0]
    many = spark.range(20000).withColumn("k", F.when(F.col("id") < 20, "rare").otherwise("hot"))
    n = {r[0]: r[1] for r in hashed_sample(many, "id", 500, "k").groupBy("k").count().collect()}
    assert n["rare"] == 20 and 350 < n["hot"] < 650


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = c.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(repr(tuple(r[k] for k in want.columns)) for r in got.collect()) == sorted(map(repr, want.fetchall()))
