"""Operators against plain Python models and on edge cases."""

import json
import random

import pyspark.sql.functions as F
import pytest

from lexloom.functions import metrics, text
from lexloom import cli
from lexloom.operators import cache, decode, evaluate, index, latent, prepare, rank, records, retrieve
from lexloom.sources import json_io
from lexloom.streaming.postings import index_stream

EDGES = ["", None, "   ", "a b\x1cc", "điều", "ñ x", "½ ² Ⅳ", "“quoted” text", "zero​width", "one", "x x x x", "A.  B!\tC? d"]


def test_tokens_equal_python(spark):
    import re

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(EDGES)], "i int, t string")
    got = rows.select("i", text.words("t").alias("w"), text.words_and_marks("t").alias("m"), text.single_spaced("t").alias("s")).collect()
    for r in got:
        t = EDGES[r.i] or ""
        assert r.w == re.findall(r"\w+", t.lower())
        assert r.m == re.findall(r"\w+|[^\w\s]", t.lower())
        assert r.s == re.sub(r"\s+", " ", t).strip()


def test_lcs_against_table(spark):
    r = random.Random(1)
    data = [(i, [r.choice("abcd") for _ in range(r.randint(0, 70))], [r.choice("abcd") for _ in range(r.randint(0, 70))]) for i in range(40)]

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
            row = new
        return row[-1]

    df = spark.createDataFrame(data, "i int, a array<string>, b array<string>")
    assert {x.i: x.n for x in df.select("i", metrics.lcs_length("a", "b").alias("n")).collect()} == {i: slow(a, b) for i, a, b in data}


def test_metric_bounds(spark):
    df = spark.createDataFrame([(1, "a b c", "a b c"), (2, "", "a"), (3, "x", "y"), (4, "a a a", "a")], "id int, prediction string, reference string")
    got = {r.id: r for r in metrics.with_meteor(metrics.with_rouge_l(df)).collect()}
    assert got[1].rouge_l == 1 and got[1].meteor == pytest.approx(1 - 0.5 / 27)
    assert got[2].rouge_l == got[2].meteor == got[3].rouge_l == got[3].meteor == 0
    assert 0 < got[4].meteor < 1


def test_identical_documents_tie_by_id(spark):
    docs = spark.createDataFrame([(3, "t", "alpha beta"), (1, "t", "alpha beta"), (2, "t", "gamma"), (4, "", "")], "doc_id long, name string, text string")
    q = spark.createDataFrame([(7, "alpha"), (8, "nothing known"), (9, None)], "query_id long, text string")
    got = [(r.query_id, r["rank"], r.doc_id) for r in retrieve.bm25(docs, q, 3).orderBy("query_id", "rank").collect()]
    assert got == [(7, 1, 1), (7, 2, 3)]


def test_fusion_treats_missing_as_zero(spark):
    a = spark.createDataFrame([(1, 1, 2.0), (1, 2, 4.0)], "query_id long, doc_id long, score double")
    b = spark.createDataFrame([(1, 3, 5.0)], "query_id long, doc_id long, score double")
    got = {r.doc_id: r.score for r in rank.fuse([(a, 0.5), (b, 0.5)]).collect()}
    assert got == {1: 0.25, 2: 0.5, 3: 0.5}


def test_top_k_is_a_prefix(spark):
    s = spark.createDataFrame([(1, i, float(i % 7)) for i in range(50)], "query_id long, doc_id long, score double")
    five = [r.doc_id for r in rank.ranked(s, 5).orderBy("rank").collect()]
    assert five == [r.doc_id for r in rank.ranked(s, 9).orderBy("rank").collect()][:5]


def test_evaluation_counts_queries_without_results(spark):
    res = spark.createDataFrame([(1, 1, 10), (1, 2, 11)], "query_id long, rank int, doc_id long")
    gold = spark.createDataFrame([(1, 11), (2, 5)], "query_id long, doc_id long")
    row = evaluate.means(evaluate.per_query(res, gold)).first()
    assert row.queries == 2 and row.mrr == 0.25 and row.precision == 0.25


def test_encode_cuts_after_eos(spark):
    vocab = spark.createDataFrame([("a", 4), ("b", 5)], "token string, idx int")
    rows = spark.createDataFrame([(1, ["a", "z", "b"]), (2, [])], "id int, tokens array<string>")
    got = {r.id: r.ids for r in prepare.encode(rows, vocab, 4, bos_eos=True).collect()}
    assert got == {1: [2, 4, 1, 5], 2: [2, 3, 0, 0]}


def test_vocabulary_without_bound_is_numbered_by_ranges(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(9)) for _ in range(12))) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, a string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.token: (r.idx, r.freq) for r in prepare.vocabulary(df, ["a"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    count, first = {}, {}
    for i, a in rows:
        for p, t in enumerate(a.split(" ")):
            count[t], first[t] = count.get(t, 0) + 1, min(first.get(t, (i, p)), (i, p))
    want = {t: (k, count[t]) for k, t in enumerate(sorted(count, key=lambda t: (-count[t], first[t])), len(prepare.SPECIALS))}
    assert got == want | {t: (k, 0) for k, t in enumerate(prepare.SPECIALS)}
    assert got == {r.token: (r.idx, r.freq) for r in prepare.vocabulary(df, ["a"], most=10_000).collect()}
    assert prepare.vocabulary(df.limit(0), ["a"]).count() == len(prepare.SPECIALS)


def test_queries_in_blocks_meet_all_vectors(spark):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "doc_id int, v array<float>")
    queries = vectors.filter("doc_id % 4 = 0").selectExpr("doc_id AS query_id", "v AS q")
    got = {n: sorted(map(tuple, retrieve.vector_scores(vectors, queries, n).collect())) for n in (3, 5000)}
    assert got[3] == got[5000] == sorted((q, d, q * d + 1.0) for q in range(0, 40, 4) for d in range(40) if d != q)
    assert retrieve.vector_scores(vectors, queries.limit(0), 3).count() == 0


def test_empty_input_is_one_empty_chunk(spark):
    df = spark.createDataFrame([([],), (["a"] * 5,)], "t array<string>")
    assert [[len(c) for c in r[0]] for r in df.select(prepare.chunks("t", 2)).collect()] == [[0], [2, 2, 1]]


def test_best_overlap_equals_exhaustive_search():
    r = random.Random(2)
    for _ in range(60):
        t, a = [r.choice("abcdefgh") * r.randint(1, 2) for _ in range(r.randint(1, 30))], [r.choice("abcdxyz") * r.randint(1, 2) for _ in range(r.randint(1, 12))]
        wanted, limit, best, at = {x for x in a if len(x) > 1} or set(a), min(len(t), max(8, min(len(a), 160))), 0.0, None
        for i in range(len(t)):
            for j in range(i, min(len(t), i + limit)):
                n = len(wanted & set(t[i : j + 1]))
                score = n / len(wanted) + n / (j - i + 1)
                if score > best + 1e-12:
                    best, at = score, (i, j)
        assert prepare._best_overlap_span(t, a) == at


def test_answer_span_runs_over_section_number(spark):
    df = spark.createDataFrame([("see the section 4.1.2. Next", "See the section 4")], "c string, a string")
    r = df.select(prepare.answer_span("c", "a").alias("s")).first().s
    assert "see the section 4.1.2. Next"[r.start : r.end] == "see the section 4.1.2."


def test_early_stopping_counts_epochs_without_gain(spark):
    df = spark.createDataFrame([("r", i, s) for i, s in enumerate([0.1, 0.2, 0.2, 0.1, 0.3], 1)], "run string, epoch int, score double")
    assert decode.early_stopping(df, 2).first().stop_epoch == 4


def test_split_forms(spark, tmp_path):
    record = {"question": "q", "answer": "a", "contexts": {"0": {"content": "context_1.json", "điều": 5}}, "answer_start": 1}
    (tmp_path / "o.json").write_text(json.dumps({"k1": record, "k2": {"id": "own", "contexts": [{"content": "c", "dieu": "7"}], "passage": ["x", "y"]}, "bad": 3}, ensure_ascii=False))
    (tmp_path / "l.json").write_text(json.dumps([{"id": "gone", "question": "q0"}, {"question": "q1"}]))
    (tmp_path / "s.json").write_text("3")
    got = {r.id: r for r in json_io.read_split(spark, str(tmp_path / "o.json")).collect()}
    assert set(got) == {"k1", "own"}
    assert [tuple(c) for c in got["k1"].contexts] == [("context_1.json", "5")] and got["k1"].answer_start == 1
    assert [tuple(c) for c in got["own"].contexts] == [("c", "7")] and got["own"].context == "x y"
    assert [r.id for r in json_io.read_split(spark, str(tmp_path / "l.json")).orderBy("pos").collect()] == ["0", "1"]
    assert json_io.read_split(spark, str(tmp_path / "l.json"), inject_ids=False, limit=1).first().id == "gone"
    with pytest.raises(ValueError):
        json_io.read_split(spark, str(tmp_path / "s.json"))


def test_corpus_scopes(spark, tmp_path):
    for n, name, link, passage in ((1, "A", "", "text a"), (10, "", "https://x/y/key.aspx", "text b"), (2, "C", "", " ")):
        (tmp_path / f"context_{n}.json").write_text(json.dumps({"name": name, "link": link, "passage": passage}))
    (tmp_path / "s" / "kind").mkdir(parents=True)
    (tmp_path / "s" / "kind" / "key.json").write_text("{}")
    rows = [(r.doc_id, r.content) for r in json_io.read_corpus(spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert rows == [(0, "context_1.json"), (1, "context_10.json")]
    keys = json_io.structured_keys(spark, str(tmp_path / "s"))
    assert [r.content for r in json_io.read_corpus(spark, str(tmp_path), structured=keys).collect()] == ["context_10.json"]
    refs = spark.createDataFrame([("context_1.json",), ("missing.json",)], "content string")
    assert json_io.read_corpus(spark, str(tmp_path), referenced=refs).count() == 1


def test_predictions_and_sinks(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"id": "1", "answer": "điều", "prediction": "x"}\n\n{"id": "2", "reference": "r"}\n')
    rows = json_io.read_predictions(spark, str(tmp_path / "p.jsonl"))
    assert {r.id: (r.reference, r.prediction) for r in rows.collect()} == {"1": ("điều", "x"), "2": ("r", "")}
    json_io.write_json_lines(rows, str(tmp_path / "out"))
    assert "điều" in "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))


def test_cache_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert cache.load_or_build(spark, str(tmp_path), {"b": 1, "a": 2}, build).count() == 3
    assert len(calls) == 1 and cache.cache_key({"a": 2, "b": 1}) == cache.cache_key({"b": 1, "a": 2})
    assert cache.fingerprints(spark.read.parquet(f"{tmp_path}/{cache.cache_key({'a': 2, 'b': 1})}"))[0]["file_size"] > 0


def test_stream_appends_postings(spark, tmp_path):
    spark.createDataFrame([(1, "n", "a a b")], "doc_id long, name string, text string").write.parquet(str(tmp_path / "in"))
    index_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    got = {(r.term, r.tf) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("n", 1), ("a", 2), ("b", 1)}


def test_batch_inference(spark):
    def make():
        return lambda frame: frame.assign(y=frame.x * 2)

    assert sorted(r.y for r in decode.batch_inference(spark.range(3).withColumnRenamed("id", "x"), make, "x long, y long", ["x"]).collect()) == [0, 2, 4]


def test_empty_corpus(spark):
    docs = spark.createDataFrame([], "doc_id long, name string, text string")
    q = spark.createDataFrame([(1, "a")], "query_id long, text string")
    assert retrieve.hybrid(docs, q).count() == 0 and index.corpus_stats(index.tokenized(docs)).first().n == 0


def test_retriever_by_name():
    assert retrieve.retriever("hybrid") is retrieve.hybrid
    with pytest.raises(ValueError):
        retrieve.retriever("none")




def themes(spark, n=120):
    r = random.Random(4)
    words = {t: [f"{t}{i}" for i in range(12)] for t in "abcd"}
    rows = [(i, "", " ".join(r.choice(words["abcd"[i % 4]]) for _ in range(30))) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None, None), (n + 1, "", rows[0][2])], "doc_id long, name string, text string")


def test_latent_vectors_span_the_leading_singular_space(spark):
    import numpy as np

    docs = themes(spark)
    own = retrieve.dense_index(docs)
    fitted = latent.Latent.fit(own, components=4, max_features=1000)
    rows = index.tfidf_vectors(own, 1000).collect()
    words = sorted({r.term for r in rows})
    a = np.zeros((122, len(words)))
    for r in rows:
        a[r.doc_id, words.index(r.term)] = r.weight
    exact = np.linalg.svd(a, full_matrices=False)[2][:4].T
    assert np.linalg.norm(exact @ exact.T - fitted.basis @ fitted.basis.T, 2) < 0.02
    got = {r.doc_id: np.array(r.p) for r in fitted.vectors.collect()}
    assert np.allclose([np.linalg.norm(v) for v in got.values()], 1, atol=1e-4) and np.allclose(got[0], got[121], atol=1e-5)


def test_latent_and_cluster_retrieval_find_the_theme(spark):
    docs = themes(spark)
    q = spark.createDataFrame([(1, "a0 a1"), (2, "c5"), (3, "unknown"), (4, None)], "query_id long, text string")
    fitted, own = latent.Latent.fit(retrieve.dense_index(docs), components=4), index.Index.build(docs)
    for got in (retrieve.lsa(docs, q, 5, latent=fitted), retrieve.latent_hybrid(docs, q, 5, index=own, latent=fitted), retrieve.cluster_retrieval(docs, q, 5, 8, 2, own, fitted)):
        rows = got.collect()
        assert {(r.query_id, r["rank"]) for r in rows} == {(i, k) for i in (1, 2) for k in range(1, 6)}
        assert all(r.doc_id % 4 == {1: 0, 2: 2}[r.query_id] or r.doc_id == 121 for r in rows)
    assert {r.doc_id for r in retrieve.lsa(docs, q, 3, latent=fitted).filter("query_id = 1").collect()} <= {i for i in range(0, 120, 4)} | {121}
    empty = retrieve.lsa(docs.limit(0), q, 3)
    assert empty.count() == 0


def test_gold_by_text(spark):
    docs = spark.createDataFrame([(1, "xone two three four five six sevenx tail"), (2, "one two three\nfour five six seven"), (3, "two words"), (4, None), (5, "a two wordsb c one two three four five six")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "one two three four five six seven"), (2, "two words"), (3, "one two three"), (4, ""), (5, None)], "query_id long, text string")
    got = {(r.query_id, r.doc_id) for r in evaluate.gold_by_text(docs, q).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert got == {(r.query_id, i) for r in q.collect() for i, t in texts.items() if r.text is not None and t is not None and r.text in t}


def test_sentences_keep_their_digits(spark):
    parts = ["0 first 0.", "1 second 1.", "22 third 2!", "3"]
    df = spark.createDataFrame([(1, "3", " ".join(parts))], "id int, question string, context string")
    assert df.select(text.sentences("context").alias("s")).first().s == parts
    row = prepare.evidence_sentence(df).first()
    assert (row.evidence, row.evidence_idx) == ("3", 3)


def test_labels_and_flags(spark):
    import re

    text = "One two. Three  is here! Two again? two."
    df = spark.createDataFrame([(1, text, 4, 14), (2, text, None, None), (3, text, 30, 99), (4, "", 0, 0)], "id int, context string, answer_start int, answer_end int")
    got = {r.id: r for r in records.sentence_labels(df).collect()}
    assert got[1].sentences == ["One two.", "Three is here!", "Two again?", "two."] and got[1].evidence_labels[:2] == [1, 1] and got[1].evidence_labels[3] == 0
    flags = {r.id: r for r in records.token_flags(df, 8).collect()}
    spans = [m.span() for m in re.finditer(r"\w+|[^\w\s]", text.lower())][:8]
    hits = [i for i, (a, b) in enumerate(spans) if b > 4 and a < 14]
    assert flags[1].start_flags.index(1) == hits[0] and flags[1].end_flags.index(1) == hits[-1] and len(flags[1].end_flags) == 8
    assert all(sum(flags[i].start_flags) == sum(flags[i].end_flags) == 0 for i in (2, 3, 4)) and flags[4].tokens == []
    assert records.chunk_sizes("50, 100,,200") == [50, 100, 200]
    assert records.model_columns(records.tagged(df.withColumn("question", F.lit("q")), model="m", style=0), "abstractive").columns == ["id", "context", "question"]
    with pytest.raises(ValueError):
        records.model_columns(df, "other")


def test_flags_and_labels_equal_a_walk_without_python(spark):
    import re

    def walk(context, parts, start, end):
        at, out = 0, []
        for part in parts:
            found = context.find(part, at)
            found = at if found < 0 else found
            at = found + len(part)
            out.append(found < end and at > start)
        return [int(x) for x in out]

    r = random.Random(11)
    rows = []
    for i in range(300):
        t = "".join(r.choice(["ab", "7", " ", " ", ". ", "! ", "-", "é", "😀", ".", *(["  ", "\n"] if i % 3 == 0 else [])]) for _ in range(r.randint(0, 30)))
        rows.append((i, t if i % 3 == 0 else " ".join(t.split()), r.randint(-2, 30), r.randint(-2, 40)))
    df = spark.createDataFrame(rows, "id int, context string, answer_start int, answer_end int")
    flags = records.token_flags(df, 9)
    assert "Python" not in flags._jdf.queryExecution().executedPlan().toString()
    labels = {x.id: x for x in records.sentence_labels(df).collect()}
    for x in flags.collect():
        assert labels[x.id].evidence_labels == walk(x.context, labels[x.id].sentences, x.answer_start, x.answer_end)
        assert x.tokens == re.findall(r"\w+|[^\w\s]", x.context.lower())[:9]
        hits = walk(x.context.lower(), x.tokens, x.answer_start, x.answer_end) if 0 <= x.answer_start < x.answer_end <= len(x.context) else []
        at = [i for i, h in enumerate(hits) if h]
        want = [[int(bool(at) and i == at[k]) for i in range(9)] for k in (0, -1)]
        assert [x.start_flags, x.end_flags] == want


def test_window_features_equal_a_walk(spark):
    r = random.Random(6)
    rows = []
    for i in range(60):
        n = r.randint(0, 40)
        cuts = [3 * k for k in range(n + 1)]
        a = r.randint(0, max(0, 3 * n - 2))
        rows.append((i, list(range(100, 100 + n)), cuts[:-1], [c - 1 for c in cuts[1:]], a, min(a + r.randint(1, 20), max(1, 3 * n - 1))))
    df = spark.createDataFrame(rows, "id int, ids array<int>, starts array<int>, ends array<int>, answer_start int, answer_end int")
    got = {x.id: (x.window, x.start, x.start_position, x.end_position) for x in records.window_features(df, 10, 4).collect()}
    want = {}
    for i, ids, starts, ends, a, b in rows:
        for k in range(max(1, -(-(len(ids) - 10) // 6) + 1)):
            own = range(6 * k, min(6 * k + 10, len(ids)))
            if len(own) and starts[own[0]] <= a and ends[own[-1]] >= b and a < b:
                first, last = max(j for j in own if starts[j] <= a), min(j for j in own if ends[j] >= b)
                if first <= last:
                    want[i] = (k, 6 * k, first - 6 * k, last - 6 * k)
                    break
    assert got == want and len(want) > 20


def test_command_line(spark, tmp_path):
    folder = tmp_path / "contexts"
    folder.mkdir()
    for i, t in enumerate(["alpha beta gamma delta words", "epsilon zeta eta theta words", "iota kappa lambda words"]):
        (folder / f"context_{i}.json").write_text(json.dumps({"name": f"name {i}", "link": "", "passage": t}))
    split = [{"question": "alpha beta", "answer": "gamma delta words", "contexts": [{"content": "context_0.json"}]}, {"question": "kappa", "answer": "iota kappa lambda", "contexts": [{"content": "context_2.json"}]}]
    (tmp_path / "s.json").write_text(json.dumps(split))
    base = ["--data-dir", str(tmp_path), "--context-dir", str(folder), "--splits", "s.json"]
    for name in ("bm25", "hybrid"):
        out = cli.main(["retrieve", *base, "--retriever", name, "--top-k", "2", "--corpus-scope", "contexts", "--output-dir", str(tmp_path / "out")])
        assert out["documents"] == 3 and out["splits"]["s.json"]["hit_at_1"] == 1.0
    rows = spark.read.json(str(tmp_path / "out/s_bm25_top2")).collect()
    assert {r.question for r in rows} == {"alpha beta", "kappa"} and rows[0].retrieved_contexts[0].rank == 1
    (tmp_path / "p.jsonl").write_text("".join(json.dumps({"id": str(i), "prediction": p, "reference": "a b c"}) + "\n" for i, p in enumerate(["a b c", "x"])))
    got = cli.main(["evaluate", "--predictions", str(tmp_path / "p.jsonl"), "--output", str(tmp_path / "m")])
    assert got["count"] == 2 and got["rouge_l"] == 0.5 and spark.read.json(str(tmp_path / "m/examples")).count() == 2
    made = cli.main(["prepare", *base, "--cache-dir", str(tmp_path / "cache")])
    assert made == {"s.json:curriculum": 2, "s.json:seq2seq": 2, "s.json:extractive": 2}
    import os
    import time

    time.sleep(1.1)
    split.append(dict(split[0], question="gamma"))
    (tmp_path / "s.json").write_text(json.dumps(split))
    assert cli.main(["prepare", *base, "--cache-dir", str(tmp_path / "cache")])["s.json:extractive"] == 3, "a changed file has another key"
    assert len([d for d in os.listdir(tmp_path / "cache/extractive") if d[0] != "."]) == 2
