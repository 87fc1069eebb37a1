"""Queries against their SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from lexloom.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "documents embeddings pages benchmark labels conversations events".split()



@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    rows = sorted(repr(plain(tuple(r[i] for i in at))) for r in want.fetchall())
    got = sorted(repr(plain(tuple(r[c] for c in cols))) for r in df.collect())
    assert got == rows
    assert got, "an empty match proves nothing"


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL) - {"lsa_top3", "latent_hybrid_top3"}))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_metrics_are_not_zero(spark):
    row = catalog.QUERIES["retrieval_metrics_mean"](spark, DATA).first()
    assert row.queries >= 1 and row.mrr > 0


def test_contexts_have_the_references_limit(spark):
    full = {(r.id, r.pos): r.passage for r in catalog.QUERIES["gold_context_lookup"](spark, DATA).collect()}
    assert 200 < max(map(len, full.values())) <= 12_000
    joined = {r.id: r.context for r in catalog.QUERIES["context_concat"](spark, DATA).collect()}
    assert joined == {i: "\n\n".join(full[k] for k in sorted(full) if k[0] == i) for i in {k[0] for k in full}}
    prompts = {r.item_id: r.prompt for r in catalog.QUERIES["prompt_format"](spark, DATA).collect()}
    assert all(prompts[r.query_id].endswith(" ngữ cảnh: " + r.text[:12_000]) for r in catalog.asked(spark, DATA).collect())


def test_records_have_the_references_limits(spark):
    text = " ".join(f"w{i}" for i in range(1200)) + " the answer stands here."
    row = spark.createDataFrame([(1, "what", "the answer stands here.", text, None, None)], "id long, question string, answer string, context string, answer_start int, answer_end int")
    got = catalog.prepare.extractive_records(row).first()
    assert got.start == 1200 and [len(p) for p in got.passage_tokens] == [256] * 4 + [181]
    chosen = {r.id: len(r.selected.split(" ")) for r in catalog.QUERIES["chunk_budget_select"](spark, DATA).collect()}
    assert 300 < max(chosen.values()) <= 1200


def test_evidence_scores_round_as_sql_does(spark, tmp_path):
    rows = [(1, "alpha\n" + " ".join(f"w{i}" for i in range(639))), (2, "beta\nsome beta"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0],) for r in rows], "doc_id long").write.parquet(str(tmp_path / "labels.parquet"))
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = {tuple(r) for r in c.sql(catalog.ORACLE_SQL["evidence_sentence"]).fetchall()}
    got = catalog.QUERIES["evidence_sentence"](spark, str(tmp_path)).select("id", "evidence", "evidence_idx", "evidence_score")
    assert {tuple(r) for r in got.collect()} == want and (1.001562 in {r[3] for r in want})
