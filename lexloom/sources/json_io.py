"""Sources and sinks for question-answering data: split files, context files, predictions, metrics.

Splits are JSON objects keyed by id or JSON lists of records. contexts is a map or a list of structs, normalised to a
list. Order in the file is kept in `pos`, since a limit without an order means nothing here.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lexloom.functions.text import document_key
from lexloom.operators.store import numbered

from .json_records import json_members

#: Names of fields that may hold a record's context, in order (fixed values).
CONTEXT_FIELDS = ["context", "gold_context", "gold_context_text", "passage", "paragraph", "source_context", "source"]
CONTEXT = StructType([StructField("content", StringType()), StructField("article", StringType())])
EXAMPLE = StructType(
    [StructField("id", StringType()), StructField("question", StringType()), StructField("answer", StringType()), StructField("contexts", ArrayType(CONTEXT)), StructField("context", StringType()), StructField("answer_start", IntegerType()), StructField("answer_end", IntegerType()), StructField("pos", IntegerType())]
)


def read_split(spark: SparkSession, path: str, inject_ids: bool = True, limit: int | None = None) -> DataFrame:
    """Records of a split file. With inject_ids a record of an object keeps its id or takes its key, one of a list takes its place.

    The file is read by many tasks. Raises ValueError for JSON that is neither an object of records nor a list. Values that
    are no records leave.
    """
    kind, members = json_members(spark, path)
    each = members.withColumn("pos", F.col("pos").cast("int")).withColumn("value", F.parse_json("value"))
    given = F.try_variant_get("value", "$.id", "string")
    own_id = given if not inject_ids else F.col("pos").cast("string") if kind == "ARRAY" else F.coalesce(given, F.col("key"))
    each = each.filter(F.schema_of_variant("value").startswith("OBJECT"))
    each = each if limit is None else each.filter(F.col("pos") < limit)
    text = lambda name: F.try_variant_get("value", f"$.{name}", "string")
    listed = F.transform(
        F.coalesce(F.try_variant_get("value", "$.contexts", "array<variant>"), F.map_values(F.try_variant_get("value", "$.contexts", "map<string,variant>"))),
        lambda c: F.struct(F.try_variant_get(c, "$.content", "string").alias("content"), F.coalesce(F.try_variant_get(c, "$['điều']", "string"), F.try_variant_get(c, "$.dieu", "string")).alias("article")),
    )
    fields = [F.coalesce(F.array_join(F.try_variant_get("value", f"$.{n}", "array<string>"), " "), text(n)) for n in CONTEXT_FIELDS]
    context = F.coalesce(*[F.when(F.trim(f) != "", f) for f in fields])
    number = lambda name: F.try_variant_get("value", f"$.{name}", "int")
    return each.select(own_id.alias("id"), text("question").alias("question"), text("answer").alias("answer"), listed.alias("contexts"), context.alias("context"), number("answer_start").alias("answer_start"), number("answer_end").alias("answer_end"), "pos")


def context_references(examples: DataFrame) -> DataFrame:
    """(content): the files that examples refer to, each once."""
    return examples.select(F.explode("contexts").alias("c")).select(F.col("c.content").alias("content")).filter("content <> ''").distinct()


def read_corpus(spark: SparkSession, folder: str, referenced: DataFrame | None = None, structured: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(doc_id, content, name, link, text) of context_*.json files, numbered in order of their names; computed once.

    referenced: keep files listed in (content). structured: keep documents whose key is in (key). limit cuts the list of
    names before documents with a blank passage leave.
    """
    schema = "name string, link string, passage string"
    raw = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "context_*.json").json(folder)
    docs = raw.select(F.col("_metadata.file_name").alias("content"), "name", "link", "passage")
    if referenced is not None:
        docs = docs.join(referenced.select("content"), "content", "left_semi")
    if structured is not None:
        docs = docs.withColumn("key", document_key("name", "link")).join(structured.select("key"), "key", "left_semi").drop("key")
    if limit is not None:
        docs = docs.join(docs.select("content").orderBy("content").limit(limit), "content", "left_semi")
    docs = docs.filter(F.trim("passage") != "")
    docs = numbered(docs, [F.col("content")], "corpus", "doc_id")
    return docs.select("doc_id", "content", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("link", F.lit("")).alias("link"), F.col("passage").alias("text"))


def structured_keys(spark: SparkSession, folder: str) -> DataFrame:
    """(key): stems of the JSON files one level below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(f"{folder.rstrip('/')}/*/").select("path")
    return files.select(F.regexp_extract(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), r"([^/]*)\.json$", 1).alias("key")).distinct()


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(id, question, reference, prediction, model) of JSON lines; reference falls back to answer; blank lines leave."""
    schema = "id string, question string, reference string, answer string, prediction string, model string"
    rows = spark.read.schema(schema).json(path).filter("coalesce(id, question, reference, answer, prediction, model) is not null")
    return rows.select("id", "question", F.coalesce("reference", "answer", F.lit("")).alias("reference"), F.coalesce("prediction", F.lit("")).alias("prediction"), "model")


def write_json_lines(df: DataFrame, path: str) -> None:
    """JSON lines, in as many files as df has partitions; non-ASCII text stays as it is."""
    df.write.mode("overwrite").json(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A small table (one row a split or run) as one JSON-lines file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_metrics(spark: SparkSession, summary: dict[str, float], examples: DataFrame, path: str) -> None:
    """Metrics as JSON lines: the means below summary/, a row for each example below examples/."""
    write_summary(spark.createDataFrame([tuple(summary.values())], list(summary)), f"{path}/summary")
    write_json_lines(examples, f"{path}/examples")
