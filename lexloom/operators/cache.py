"""Results kept under a key made of their parameters and inputs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from typing import Any

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession


def cache_key(parameters: dict[str, Any]) -> str:
    """First 16 hex digits of the SHA-1 of the parameters as JSON with sorted keys."""
    return hashlib.sha1(json.dumps(parameters, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]


def key_column(payload: Column | str) -> Column:
    """cache_key of payloads that are JSON texts already."""
    return F.substring(F.sha1(payload), 1, 16)


def fingerprints(df: DataFrame) -> list[dict[str, Any]]:
    """Path, size and change time of the files that df reads; one row a file."""
    rows = df.select("_metadata.file_path", "_metadata.file_size", F.unix_micros("_metadata.file_modification_time").alias("changed")).distinct().orderBy("file_path")
    return [r.asDict() for r in rows.collect()]


def load_or_build(spark: SparkSession, folder: str, parameters: dict[str, Any], build: Callable[[], DataFrame], inputs: Iterable[DataFrame] = ()) -> DataFrame:
    """The table kept under the key of the parameters, and of the files behind inputs, below folder; built and written if missing. Spark commits whole tables."""
    files = [{k: str(v) for k, v in f.items()} for df in inputs for f in fingerprints(df)]
    path = f"{folder.rstrip('/')}/{cache_key(parameters | ({'files': files} if files else {}))}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(conf).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
