"""Stored tables and their removal."""

import os

import pyspark.sql.functions as F

from lexloom.operators import store


def test_stored_tables_are_removed_together(spark):
    session = spark.newSession()
    kept = store.stored(session.range(10), "t")
    table = store.bucketed(session.range(40).select((F.col("id") % 4).cast("int").alias("range"), F.col("id").alias("term")), "b", 2, "range", "term")
    assert kept.count() == 10 and table.groupBy("range").count().count() == 4
    folder = store.scratch(session)
    assert len([f for f in os.listdir(folder) if "t-" in f or "lexloom_b" in f]) >= 2
    store.clear(session)
    assert not os.path.exists(folder)
    assert not [t for t in session.catalog.listTables() if t.name.startswith("lexloom_")]
    assert store.stored(session.range(3), "t").count() == 3, "storing begins anew"


def test_indexes_are_built_anew_after_removal(spark):
    from lexloom.plans import catalog

    data = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    before = catalog.indexed(spark, data)
    assert catalog.indexed(spark, data) is before
    catalog.release(spark)
    assert catalog.indexed(spark, data) is not before and catalog.bm25_top3(spark, data).count() > 0
