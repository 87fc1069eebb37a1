"""Tables written for reuse within a job: below spark.checkpoint.dir, which all executors share. clear() removes an application's tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections import Counter

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession, Window


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a local folder, but on a cluster an error."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = os.path.join(tempfile.gettempdir(), f"lexloom-{uuid.uuid4().hex}")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """The folder of this application's tables."""
    return f"{shared_folder(spark)}/lexloom/{spark.sparkContext.applicationId}"


#: How often each application has removed its tables.
_cleared: Counter[str] = Counter()


def cleared(spark: SparkSession) -> int:
    """Changes with each clear(): what is kept by key belongs to one such number."""
    return _cleared[spark.sparkContext.applicationId]


def clear(spark: SparkSession) -> None:
    """Removes the tables that this application has stored; DataFrames that read them, and indexes, can no longer be used."""
    _cleared[spark.sparkContext.applicationId] += 1
    for t in spark.catalog.listTables():
        if t.name.startswith("lexloom_"):
            spark.sql(f"DROP TABLE IF EXISTS {t.name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, computed once: written as Parquet to a fresh path and read again."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, buckets: int, by: str, order: str) -> DataFrame:
    """df, computed once: a table bucketed by a column and sorted by another, so that groups of the first need no shuffle."""
    spark, table = df.sparkSession, f"lexloom_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, by).sortBy(order).option("path", f"{scratch(spark)}/{table}").saveAsTable(table)
    return spark.table(table)


def numbered(df: DataFrame, order: list[Column], name: str, column: str) -> DataFrame:
    """df, computed once, with each row's place in an order, from 0.

    Rows are sorted by ranges and numbered within each; one task sees a count for each range, none all rows.
    """
    rows = stored(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), name)  # range, then row, in 33 bits
    rows = rows.withColumn("_range", F.shiftright("_at", 33))
    counts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = counts.select("_range", (F.sum("_rows").over(Window.orderBy("_range")) - F.col("_rows")).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(before), "_range").withColumn(column, place).drop("_at", "_range", "_before")
