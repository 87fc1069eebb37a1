"""Postings kept up to date from a stream of documents."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lexloom.operators.index import term_frequencies, tokenized


def index_stream(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = "doc_id long, name string, text string") -> StreamingQuery:
    """Appends (doc_id, dl, term, tf, batch) of new Parquet files below source to target, and stops when all are read.

    Each micro-batch overwrites its own partition, so a batch that is run again leaves no doubles.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = term_frequencies(tokenized(batch)).withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
