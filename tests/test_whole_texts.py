"""Queries that read whole texts: what stands behind 12,000 characters counts."""

import math

import duckdb
import pytest

from lexloom.plans import catalog

LONG = "alpha beta\n" + "filler " * 2000 + "needle " * 2000
DOCS = [(1, LONG), (2, "needle"), (3, "needle one two three four five six"), *[(i, f"other{i} words{i % 3} stand here") for i in range(4, 14)]]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, "alpha"), (2, "needle")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def found(spark, folder, name):
    """Rows of a query, which equal those of its SQL where it has one."""
    df = catalog.QUERIES[name](spark, folder)
    got = sorted(tuple(r) for r in df.collect())
    if name in catalog.ORACLE_SQL:
        c = duckdb.connect()
        for t in ("documents", "benchmark"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
        want = c.sql(f"SELECT {', '.join(df.columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
        plain = lambda rows: sorted(tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in rows)
        assert plain(got) == plain(want)
    return got


def test_expansion_takes_terms_from_whole_texts(spark, folder):
    # the only document of "alpha" has "needle" at its end
    got = found(spark, folder, "iterative_expansion_top3")
    assert {r[2] for r in got if r[0] == 1} == {1, 2, 3}


def test_latent_vectors_hold_whole_texts(spark, folder):
    score = {r[2]: r[3] for r in found(spark, folder, "lsa_top3") if r[0] == 2}
    assert score[1] > 0.5 and score[2] > 0.9
    docs, queries = catalog.corpus(spark, folder), catalog.asked(spark, folder)
    alone = {r.doc_id: r.score for r in catalog.retrieve.lsa(docs, queries).filter("query_id = 2").collect()}
    assert alone[1] > 0.5


def test_rewritten_queries_meet_vectors_of_whole_texts(spark, folder):
    score = {r[2]: r[3] for r in found(spark, folder, "rewrite_hybrid_top3") if r[0] == 2}
    assert score[1] > 0.75  # BM25 alone gives 0.7
    docs, queries = catalog.corpus(spark, folder), catalog.asked(spark, folder)
    alone = {r.doc_id: r.score for r in catalog.retrieve.rewriting_hybrid(docs, queries).filter("query_id = 2").collect()}
    assert alone == score


def test_vectors_hold_the_words_of_whole_texts(spark, folder):
    weight = {r[1]: r[2] for r in found(spark, folder, "tfidf_vectors") if r[0] == 1}
    idf, n = lambda df: math.log((1 + len(DOCS)) / (1 + df)) + 1, 1 + math.log(2000)
    # names stand before texts, so that "alpha" and "beta" come twice
    parts = {"alpha": (1 + math.log(2)) * idf(1), "beta": (1 + math.log(2)) * idf(1), "filler": n * idf(1), "needle": n * idf(3)}
    norm = math.sqrt(sum(x * x for x in parts.values()))
    assert weight == pytest.approx({t: x / norm for t, x in parts.items()}, abs=1e-6)


def test_fusion_meets_vectors_of_whole_texts(spark, folder):
    score = {r[1]: r[2] for r in found(spark, folder, "weighted_fusion") if r[0] == 2}
    assert score[1] > 0.55  # BM25 alone gives 0.5
