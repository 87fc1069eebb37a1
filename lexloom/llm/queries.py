"""Queries opN_<name> of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracle


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lstm_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(_table(spark, sf_dir, "pages"))


def op2_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shard_tree import shard_documents

    return shard_documents(_table(spark, sf_dir, "documents"), 16)


def op3_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lang_cnn import identify

    return identify(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_filter

    rows = quality_filter(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum", "rejected_by")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), capacity=1024, end_id=2)


def op6_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_lm import score_documents

    return score_documents(_table(spark, sf_dir, "documents"))


def op8_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import severity

    return severity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), k=4, percent=80)


def op10_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wavelet import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), end_id=2)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation import repair_damaged

    return repair_damaged(_table(spark, sf_dir, "conversations"))


def op12_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chunked_bpe import encode_decode

    return encode_decode(_table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(_table(spark, sf_dir, "documents"), least_docs=10, top=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lstm_html_extraction": op1_lstm_html_extraction,
    "op2_shard_tree": op2_shard_tree,
    "op3_byte_cnn_language": op3_byte_cnn_language,
    "op4_quality_rules": op4_quality_rules,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_simhash_decontamination": op6_simhash_decontamination,
    "op7_suffix_tree_lm": op7_suffix_tree_lm,
    "op8_ordinal_toxicity": op8_ordinal_toxicity,
    "op9_tensored_minhash": op9_tensored_minhash,
    "op10_wavelet_shards": op10_wavelet_shards,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_chunked_bpe": op12_chunked_bpe,
    "op13_source_divergence": op13_source_divergence,
}

#: The others hold models, hashes or a tokenizer, which SQL cannot express.
ORACLE_SQL: dict[str, str] = {"op4_quality_rules": oracle.OP4, "op9_tensored_minhash": oracle.OP9, "op11_conversation_repair": oracle.OP11, "op13_source_divergence": oracle.OP13}
