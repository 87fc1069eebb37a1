"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import sys
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window

from lexloom.operators.store import shared_folder as shared_dir

#: White space that separates words: space, tab, \n, \v, \f, \r.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def give_back() -> None:
    """Returns freed memory to the system: workers live on, beside those of other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


#: Large tables of this worker process; those of one operator at a time.
_held: dict[str, object] = {}


def held(name: str | None, make: Callable[[], object] | None = None) -> object:
    """The table of a name, made at first use; all others are given up. None gives up all."""
    if others := [k for k in _held if k != name]:
        for k in others:
            del _held[k]
        give_back()
    if name is not None and name not in _held:
        _held[name] = make()
    return _held.get(name)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Sets session settings for a while."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def small_batches(spark: SparkSession, size: str = "8m"):
    """Bounds Arrow batches to and from Python workers by bytes while a table is written: rows of text can be large."""
    return settings(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": size})


def materialize(df: DataFrame, name: str, by: str | None = None, compression: str = "snappy") -> DataFrame:
    """Cuts lineage: writes df as Parquet below the shared folder and reads it again.

    The files survive the loss of executors. Each call writes to a fresh path. by: a column to deal rows out by, where a
    scan's many tasks would each write a small file; adaptive execution then makes files of the advisory size, also
    after other shuffles, and splits hot values.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexloom/{name}-{uuid.uuid4().hex}"
    with small_batches(spark), settings(spark, {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}):
        (df if by is None else df.hint("rebalance", by)).write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and held on the executors' disks; what a lost executor held is computed again.

    For results that follow from stored tables alone, however often they are computed. clearCache() gives them up.
    """
    df = df.persist(StorageLevel.DISK_ONLY)
    with small_batches(df.sparkSession), settings(df.sparkSession, {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}):
        df.count()
    return df


def crc32_of_id(id_col: Column) -> Column:
    """crc32 of an id written as text; 0 for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")), F.lit(0).cast("long"))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_py(text: bytes) -> list[bytes]:
    r"""Words [^\x20\x09-\x0D]+ of a UTF-8 text with A-Z lower-cased: bytes methods know ASCII alone."""
    return text.lower().split()


#: Values of a column, each with its count, that are broadcast (some MB); more are joined by a shuffle.
BROADCAST_VALUES = 100_000


def hashed_sample(df: DataFrame, id_col: str, rows: int, per: str | None = None, seed: int = 17, text_col: str | None = None) -> DataFrame:
    """At most `rows` rows (for each value of `per`), those with the smallest draws: a bounded, repeatable training sample.

    A draw is a hash of the id, and, where ids repeat (fewer different ones than half the rows), of the text as well; rows that
    agree in it are one, however often they stand. Tables with fewer different rows are kept whole. Light passes fix
    the draws: distinct ones are estimated, three times too many are kept and ranked, and the chosen ones meet the rows
    again; no text is shuffled but those of the sample, and none is read for the draws where ids differ.
    """

    def drawn(*columns: str) -> DataFrame:
        draw = F.xxhash64(F.lit(seed), *[F.col(c) for c in columns]).alias("_draw")
        return df.select("*", (F.lit(0) if per is None else F.col(per)).alias("_per"), draw)

    def sizes_of(own: DataFrame) -> tuple[DataFrame, list]:
        """Rows and different draws of each value, and, for a bounded number of values, the same as rows here."""
        sizes = own.groupBy("_per").agg(F.approx_count_distinct("_draw").alias("_n"), F.count(F.lit(1)).alias("_rows"))
        return sizes, sizes.limit(BROADCAST_VALUES + 1).collect()

    own = drawn(id_col)
    sizes, here = sizes_of(own)
    if text_col and 2 * sum(r._n for r in here) < sum(r._rows for r in here):
        own = drawn(id_col, text_col)
        sizes, here = sizes_of(own)
    groups, few = len(here), len(here) <= BROADCAST_VALUES
    sizes = df.sparkSession.createDataFrame(here, sizes.schema) if few else sizes
    edge = sizes.select(F.col("_per").alias("_p"), (F.lit(-(2.0**63)) + F.lit(2.0**64) * 3 * rows / F.greatest("_n", F.lit(1))).alias("_edge"))
    light = own.select("_per", "_draw").join(F.broadcast(edge) if few else edge, F.col("_per").eqNullSafe(F.col("_p"))).filter(F.col("_draw") < F.col("_edge")).select("_per", "_draw").distinct()
    place = F.row_number().over(Window.partitionBy("_per").orderBy("_draw"))
    chosen = light.withColumn("_r", place).filter(F.col("_r") <= rows).select(F.col("_per").alias("_p"), F.col("_draw").alias("_d"))
    chosen = F.broadcast(chosen) if few and groups * rows <= 10 * BROADCAST_VALUES else chosen
    return own.join(chosen, F.col("_per").eqNullSafe(F.col("_p")) & (F.col("_draw") == F.col("_d"))).dropDuplicates(["_per", "_draw"]).select(*df.columns)
