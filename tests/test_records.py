"""Article windows, labels by position, features from raw text, ordered draws, matched vectors and clusters against plain walks."""

import json
import math
import random
import re
import time

import numpy as np
import pyspark.sql.functions as F
import pytest

from lexloom import cli
from lexloom.functions import metrics
from lexloom.operators import articles, draws, prepare, records, retrieve


def window_of(passage, article):
    """The rule, text by text: from the article's marker to the next numbered one behind white space."""
    if not article or not article.strip():
        return passage
    found = re.search(rf"(?i)(?:điều|dieu)\s+{re.escape(article.strip())}\b\.?", passage)
    if not found:
        return passage
    behind = re.search(r"(?i)\s(?:điều|dieu)\s+\d+[a-z]?\b\.?", passage[found.end() :])
    return passage[found.start() : found.end() + behind.start() if behind else len(passage)].strip()


def test_windows_equal_a_search(spark):
    r = random.Random(2)
    parts = ["Điều 1.", "dieu 2", "ĐIỀU 12a.", "điều  3 ", "Điều 1", "điều hành", "x", "một hai.", "Điều 5.Điều 6.", "Điều II", "\n", "(điều 2)", "Dieu 12A ba"]
    docs = [(i, " ".join(r.choice(parts) for _ in range(r.randint(0, 9)))) for i in range(150)] + [(900, None), (901, "Điều 7")]
    named = ["1", "2", "12a", "12A", "3", " 1 ", "", None, "9", "II", "5.Điều", "6.", "hành", "7"]
    refs = [(i * 100 + j, j, i, a) for i, _ in docs for j, a in enumerate(named)]
    got = records.context_lookup(spark.createDataFrame(refs, "id int, pos int, doc_id int, article string"), spark.createDataFrame(docs, "doc_id int, text string"))
    want = {}
    for id_, pos, doc, article in refs:
        passage = " ".join((dict(docs)[doc] or "").split())
        own = window_of(passage, article)[:12_000]
        if own:
            want[id_, pos] = own
    assert {(x.id, x.pos): x.passage for x in got.collect()} == want
    # references without articles get beginnings, as before
    plain = records.context_lookup(spark.createDataFrame(refs, "id int, pos int, doc_id int, article string").drop("article"), spark.createDataFrame(docs, "doc_id int, text string"), 5)
    assert {x.passage for x in plain.filter("doc_id = 901").collect()} == {"Điều "}


def test_a_document_is_cut_once_whatever_the_references(spark):
    text = " ".join(f"Điều {i}. nội dung {i}." for i in range(1, 3001))
    found = articles.article_intervals(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    assert len(found) == 3000
    assert all(text[x.start :][: x.length] == f"Điều {x.article}. nội dung {x.article}." for x in found if x.length)


def test_references_name_their_articles(spark):
    rows = spark.createDataFrame([(1, "hỏi điều 4", "theo Điều 3b", [("c1", "7"), ("c2", None)]), (2, "điều 4", None, [("c1", " ")])], "id int, question string, answer string, contexts array<struct<content:string,article:string>>")
    assert {(x.id, x.pos): (x.content, x.article) for x in records.article_references(rows).collect()} == {(1, 0): ("c1", "7"), (1, 1): ("c2", "3b"), (2, 0): ("c1", "4")}


def test_labels_take_linear_time(spark):
    text = " ".join(f"word{i}." for i in range(100_000))
    df = spark.createDataFrame([(text, 500_000, 500_100)], "context string, answer_start int, answer_end int")
    records.sentence_labels(df.limit(0)).collect()
    began = time.time()
    row = records.sentence_labels(df).select(F.size("sentences").alias("n"), F.aggregate("evidence_labels", F.lit(0), lambda s, x: s + x).alias("hits")).first()
    assert row.n == 100_000 and 8 < row.hits < 14
    flags = records.token_flags(df, 200_000).select(F.array_position("start_flags", 1).alias("a"), F.array_position("end_flags", 1).alias("z")).first()
    assert 0 < flags.a < flags.z < 200_000
    assert time.time() - began < 30


@pytest.fixture(scope="module")
def vocabulary():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path("byte_bpe_50k.json")


def test_reader_features_equal_the_librarys_windows(spark, vocabulary):
    from tokenizers import Tokenizer

    r = random.Random(3)
    words = ["điều", "luật", "a", "the", "khoản 2.", "日本", "x1", "\n", "  ", "naïve", "end."]
    rows = []
    for i in range(80):
        context = " ".join(r.choice(words) for _ in range(r.randint(0, 120)))
        a = r.randint(0, max(0, len(context) - 1))
        rows.append((i, " ".join(r.choice(words) for _ in range(r.randint(0, 3))), context, a, min(len(context), a + r.randint(0, 30))))
    rows += [(90, "q", None, 0, 1), (91, None, "abc def", 0, 3), (92, "q", "abc", None, None)]
    df = spark.createDataFrame(rows, "id int, question string, context string, answer_start int, answer_end int")
    got = {x.id: tuple(x)[1:] for x in records.reader_features(df, vocabulary, 48, 12).collect()}
    plain, cut = Tokenizer.from_file(vocabulary), Tokenizer.from_file(vocabulary)
    cut.enable_truncation(48, stride=12, strategy="only_second")
    want = {}
    for i, question, context, a, z in rows:
        if not context or a is None or a >= z:
            continue
        n = len(plain.encode(question or "", add_special_tokens=False).ids)
        first = cut.encode(question or "", context, add_special_tokens=False)
        for w, e in enumerate([first, *first.overflowing]):
            own = range(n, len(e.ids))
            if len(own) and e.offsets[own[0]][0] <= a and e.offsets[own[-1]][1] >= z:
                start, end = max(j for j in own if e.offsets[j][0] <= a), min(j for j in own if e.offsets[j][1] >= z)
                if start <= end:
                    pad = 48 - len(e.ids)
                    want[i] = (w, e.ids + [0] * pad, [1] * len(e.ids) + [0] * pad, start, end)
                    break
        assert n < 48
    assert got == want and len(want) > 40


def sequential(seed, sizes, n):
    r = random.Random(seed)
    return [(sizes.index(r.choice(sizes)), r.random()) for _ in range(n)]


@pytest.mark.parametrize("sizes", [[50, 100, 200, 500], [1], [1, 2, 3, 4, 5, 6, 7]])
def test_draws_are_those_of_one_generator(spark, monkeypatch, sizes):
    monkeypatch.setattr(draws, "OUTPUTS", 1000)  # many refills
    got = {(x.seed, x.row): (x.choice, x.draw) for x in draws.draws(spark, 2500, [23, 24], len(sizes), block=700).collect()}
    assert got == {(s, i): d for s in (23, 24) for i, d in enumerate(sequential(s, sizes, 2500))}
    assert draws.draws(spark, 0, [1], 4).count() == 0


def test_epochs_are_one_write_read_apart(spark, tmp_path):
    rows = [(i, f"question {i}", "" if i % 9 == 0 else f"answer {i} here", " ".join(f"w{(i * j) % 50} answer" for j in range(130))) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, question string, answer string, context string").repartition(3)
    made = prepare.curriculum_epochs(df, [50, 100], 60, 0.8, 0.3, 4, str(tmp_path / "e"))
    for epoch in (1, 4):
        own = made.filter(F.col("epoch") == epoch)
        drawn = sequential(23 + epoch, [50, 100], 40)
        share = max(0.0, 0.8 - (epoch - 1) * 0.3)
        got = {x.id: (x.chunk_size, x.query_mode) for x in own.collect()}
        assert got == {i: ([50, 100][c], "answer" if u < share else "question") for i, (c, u) in enumerate(drawn) if i % 9}
        assert "PartitionFilters: [isnotnull(epoch" in own._jdf.queryExecution().executedPlan().toString()
    one = prepare.curriculum_records(df, [50, 100], 60, 0.8, seed=24)
    assert {tuple(x) for x in one.collect()} == {tuple(x)[:7] for x in made.filter("epoch = 1").select(*one.columns).collect()}


def test_matched_vectors_equal_a_double_loop(spark):
    r = np.random.default_rng(1)
    rows = []
    for i in range(30):
        p, q = r.integers(0, 6), r.integers(0, 6)
        rows.append((i, r.normal(size=(p, 5)).tolist(), r.normal(size=(q, 5)).tolist(), r.random(p).tolist(), r.random(q).tolist()))
    rows += [(100, [[0.0] * 5], [[1.0] * 5], [1.0], [1.0]), (101, [[1.0] * 5], [[1.0] * 5], [0.0], [1.0]), (102, None, [[1.0] * 5], None, [1.0])]
    df = spark.createDataFrame(rows, "id int, p array<array<double>>, r array<array<double>>, u array<double>, v array<double>")
    got = {x.id: x.m for x in df.select("id", metrics.vector_match("p", "r", "u", "v").alias("m")).collect()}

    def cosine(x, y):
        n = math.sqrt(sum(a * a for a in x) * sum(b * b for b in y))
        return sum(a * b for a, b in zip(x, y, strict=True)) / n if n else 0.0

    for i, p, q, u, v in rows:
        if p is None:
            assert got[i].f1 is None
            continue
        one = sum(w * max(cosine(x, y) for y in q) for x, w in zip(p, u, strict=True)) / sum(u) if p and q and sum(u) else 0.0
        two = sum(w * max(cosine(x, y) for x in p) for y, w in zip(q, v, strict=True)) / sum(v) if p and q and sum(v) else 0.0
        assert (got[i].precision, got[i].recall) == pytest.approx((one, two))
        assert got[i].f1 == pytest.approx(2 * one * two / (one + two) if one + two else 0.0)


def test_clusters_are_repeatable_and_keep_empty_ones(spark):
    r = np.random.default_rng(5)
    themes = np.eye(4)
    rows = [(i, (themes[i % 4] + r.normal(0, 0.05, 4)).tolist()) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, v array<double>")
    one = {x.doc_id: x.cluster for x in retrieve.kmeans_assign(df, 12, rounds=6).collect()}
    two = {x.doc_id: x.cluster for x in retrieve.kmeans_assign(df.repartition(5), 12, rounds=6).collect()}
    assert one == two and len(one) == 80
    assert all(len({i % 4 for i in one if one[i] == c}) == 1 for c in set(one.values()))


def test_gold_outside_the_scope_counts(spark, tmp_path):
    folder = tmp_path / "contexts"
    folder.mkdir()
    for i, t in enumerate(["alpha beta gamma", "delta epsilon"]):
        (folder / f"context_{i}.json").write_text(json.dumps({"name": f"name {i}", "link": "l", "passage": t}))
    split = {"a": {"question": "alpha", "contexts": {"1": {"content": "context_0.json"}, "2": {"content": "context_9.json"}}}, "b": {"question": "delta", "contexts": [{"content": "context_7.json"}]}, "c": {"question": "no gold"}}
    (tmp_path / "s.json").write_text(json.dumps(split))
    out = cli.main(["retrieve", "--data-dir", str(tmp_path), "--context-dir", str(folder), "--splits", "s.json", "--corpus-scope", "contexts", "--retriever", "bm25", "--top-k", "1", "--k1", "1.2", "--b", "0.5", "--output-dir", str(tmp_path / "o")])
    assert out["splits"]["s.json"] == {"queries": 2, "precision": 0.5, "recall": 0.25, "f1": pytest.approx(2 / 6, abs=1e-5), "hit_at_1": 0.5, "mrr": 0.5}
    rows = {r.id: r for r in spark.read.json(str(tmp_path / "o/s_bm25_top1")).collect()}
    assert set(rows) == {"a", "b"} and rows["a"].gold_contexts == ["context_0.json", "context_9.json"] and rows["a"].retrieved_contexts[0].content == "context_0.json"
    assert rows["a"].recall == 0.5 and rows["b"].precision == 0


def test_token_rows_of_generators(spark, vocabulary):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary)
    rows = [(1, " q  one ", "a b\n c " * 30, " the  answer!"), (2, "q", "c", "word " * 40), (3, "", "c", "a"), (4, "q", None, "a"), (5, "q", "c", " ")]
    df = records.seq2seq_rows(spark.createDataFrame(rows, "id int, question string, context string, answer string"))
    assert {x.id for x in df.collect()} == {1, 2}
    for x in records.seq2seq_features(df, vocabulary, 40, 12, pad_id=7).collect():
        _, question, context, answer = (" ".join(c.split()) if isinstance(c, str) else c for c in rows[x.id - 1])
        ids = plain.encode(f"câu hỏi: {question} ngữ cảnh: {context}", add_special_tokens=False).ids[:40]
        target = plain.encode(answer, add_special_tokens=False).ids[:12]
        assert x.input_ids == ids + [7] * (40 - len(ids)) and x.attention_mask == [1] * len(ids) + [0] * (40 - len(ids))
        assert x.labels == target + [-100] * (12 - len(target))


def test_tables_are_zipped_by_place(spark):
    left = spark.createDataFrame([(i, f"l{i}") for i in (5, 1, 3, 9)], "a int, x string").repartition(3)
    right = spark.createDataFrame([(i, f"r{i}") for i in (2, 8, 4)], "b int, y string")
    got = [(r.place, r.x, r.y) for r in records.zipped(left, [F.asc("a")], right, [F.desc("b")]).orderBy("place").collect()]
    assert got == [(0, "l1", "r8"), (1, "l3", "r4"), (2, "l5", "r2")]


def test_warming_writes_every_kind(spark, tmp_path, vocabulary):
    folder = tmp_path / "contexts"
    folder.mkdir()
    (folder / "context_0.json").write_text(json.dumps({"name": "n", "link": "", "passage": "Mở đầu. Điều 1. alpha beta gamma words. Điều 2. delta epsilon words here."}))
    split = [{"question": "Điều 2 nói gì?", "answer": "delta epsilon words", "contexts": [{"content": "context_0.json"}]}]
    (tmp_path / "s.json").write_text(json.dumps(split))
    made = cli.main(["prepare", "--data-dir", str(tmp_path), "--context-dir", str(folder), "--splits", "s.json", "--cache-dir", str(tmp_path / "k"), "--tokenizer", vocabulary, "--epochs", "2"])
    assert made == {"s.json:curriculum": 1, "s.json:seq2seq": 1, "s.json:extractive": 1, "s.json:seq2seq_tokens": 1, "s.json:epochs": 2}
    reader = spark.read.parquet(str(tmp_path / "k/extractive/*")).first()
    assert reader.passage_tokens[0][:2] == ["điều", "2"], "readers get the article's window"
    assert spark.read.parquet(str(tmp_path / "k/seq2seq/*")).first().context.startswith("Mở đầu.")
