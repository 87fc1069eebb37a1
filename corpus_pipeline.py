"""A training corpus from raw documents: five stages, each written as Parquet and read again as the next one's docs.

language    keeps documents in a learned language (byte convolutional network); rejects "und" and scores below 0.4
toxicity    keeps documents that the ordinal regression does not call toxic
near_dup    keeps one document, that of the smallest id, of each group of near-duplicates (five words, 0.8)
benchmark   keeps documents that hold no benchmark passage
packing     packs what is left into sequences of 1,024 tokens: a row per piece

Every stage reads all rows that its predecessor kept. Models are trained on bounded samples of labelled rows.

Defined results: a null, empty or letterless text is in no language and goes at the first stage, unless no document
has a language to learn from: then all stay; without labels of both kinds none is toxic; rows of equal id and text are one
document, of which one row stays, rows without id are never duplicates; an empty table gives an empty one; further columns
of any name pass through the filters untouched and are left out by the packing.

A stage called on its own bounds Arrow batches for its session, since its result is written later; run() restores that.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import decontaminate, lang_cnn, near_dup, packing, toxicity
from lexloom.llm.common import settings, shared_dir


#: Texts can be long, and both sides of a Python worker hold a batch.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def lean(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes."""
    for key, value in BATCHES.items():
        spark.conf.set(key, value)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean(spark)
    return lang_cnn.accept(docs, lang_cnn.train(docs))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean(spark)
    return toxicity.accept(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean(spark)
    return near_dup.deduplicate(docs, k=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean(spark)
    return packing.pack_documents(docs, capacity=1024, end_id=2)


STAGES = [("language", language), ("toxicity", toxic), ("near_dup", near_duplicate), ("benchmark", benchmark), ("packing", pack)]

#: The stages' models cannot be written as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents below sf_dir."""
    docs, at = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/lexloom/pipeline-{uuid.uuid4().hex}"
    with settings(spark, BATCHES):
        for name, stage in STAGES:
            stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
            docs = spark.read.parquet(f"{at}/{name}")
    return docs
