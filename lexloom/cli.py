"""Command line: retrieval over files, evaluation of predictions, warming of record caches.

    python -m lexloom.cli retrieve --data-dir D --context-dir C --retriever hybrid --output-dir O
    python -m lexloom.cli evaluate --predictions P.jsonl --output O
    python -m lexloom.cli prepare --data-dir D --context-dir C --cache-dir K
"""

from __future__ import annotations

import argparse
import json
from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from lexloom.functions import metrics
from lexloom.operators import cache, evaluate, prepare, records, retrieve, store
from lexloom.operators.index import Index
from lexloom.operators.latent import Latent
from lexloom.sources import json_io

#: Names of split files and default options, which are an interface (fixed values).
SPLITS = ["train_data.json", "dev_data.json", "test_data.json"]
K1, B, DENSE_COMPONENTS, DENSE_MAX_FEATURES, DENSE_MAX_DOC_CHARS, HYBRID_WEIGHT, HYBRID_CANDIDATES = 1.5, 0.75, 256, 100_000, 12_000, 0.5, 100

#: Characters of a whole passage: as many as a string can have.
WHOLE = 2**31 - 1


def corpus_of(spark: SparkSession, a: argparse.Namespace, splits: dict[str, DataFrame]) -> DataFrame:
    """The documents of a scope: all context files, those that splits refer to, or those with a structured file."""
    referenced = reduce(DataFrame.union, [json_io.context_references(s) for s in splits.values()]).distinct() if a.corpus_scope == "referenced" else None
    structured = json_io.structured_keys(spark, a.structured_dir or f"{a.data_dir}/structured_data") if a.corpus_scope == "structured" else None
    return json_io.read_corpus(spark, a.context_dir, referenced, structured, a.corpus_limit)


def contents(ranked: DataFrame, docs: DataFrame) -> DataFrame:
    """Ranked results with the names of their files as documents."""
    return ranked.join(docs.select("doc_id", "content"), "doc_id").select("query_id", "rank", F.col("content").alias("doc_id"))


def built_for(a: argparse.Namespace, docs: DataFrame) -> dict:
    """What a retriever needs of the corpus, built once for all splits."""
    out = {}
    if a.retriever in ("bm25", "hybrid", "latent_hybrid", "rewriting_hybrid", "title_fusion", "iterative_expansion", "graph_propagation", "cluster_retrieval"):
        out["index"] = Index.build(docs)
    vectors = retrieve.dense_index(docs, a.dense_max_doc_chars) if a.retriever not in ("bm25", "compact_hybrid", "iterative_expansion", "graph_propagation") else None
    if a.retriever in ("dense", "hybrid", "rewriting_hybrid", "title_fusion"):
        out["vectors"] = vectors
    if a.retriever in ("lsa", "latent_hybrid", "cluster_retrieval"):
        out["latent"] = Latent.fit(vectors, a.dense_components, a.dense_max_features)
    return out


def ranked_by(a: argparse.Namespace, docs: DataFrame, queries: DataFrame, built: dict) -> DataFrame:
    """Results of the chosen retriever under the options that it knows."""
    own = {"bm25": {"k1": a.k1, "b": a.b}, "dense": {"max_features": a.dense_max_features}, "hybrid": {"max_features": a.dense_max_features}}.get(a.retriever, {})
    if a.retriever in ("hybrid", "latent_hybrid"):
        own |= {"weight": a.hybrid_bm25_weight, "candidates": a.hybrid_candidates, "k1": a.k1, "b": a.b}
    if a.retriever == "cluster_retrieval":
        own |= {"most": a.clusters, "clusters": a.top_clusters}
    if a.retriever == "iterative_expansion":
        own |= {"iterations": a.iterations, "n_terms": a.expansion_terms}
    return retrieve.retriever(a.retriever)(docs, queries, a.top_k, **built, **own)


def retrieve_files(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Ranks the corpus for the questions of each split; writes results and a summary, and returns that."""
    splits = {name: json_io.read_split(spark, f"{a.data_dir}/{name}", limit=a.limit) for name in a.splits}
    docs = corpus_of(spark, a, splits)
    built = built_for(a, docs)
    summary = {"retriever": a.retriever, "corpus_scope": a.corpus_scope, "documents": docs.count(), "top_k": a.top_k, "splits": {}}
    for name, rows in splits.items():
        queries = rows.select(F.col("pos").cast("long").alias("query_id"), F.coalesce("question", F.lit("")).alias("text"))
        # all files that a question refers to count, whether the scope holds them or not
        gold = rows.select(F.col("pos").cast("long").alias("query_id"), F.explode("contexts.content").alias("doc_id")).filter("doc_id <> ''")
        ranked = ranked_by(a, docs, queries, built)
        if not a.no_predictions:
            named = rows.select(F.col("pos").cast("long").alias("query_id"), "id", "question")
            out = evaluate.nested(ranked, docs.select("doc_id", "content", "name", "link")).join(named, "query_id", "right")
            wanted = gold.groupBy("query_id").agg(F.sort_array(F.collect_set("doc_id")).alias("gold_contexts"))
            scores = evaluate.per_query(contents(ranked, docs), gold).select("query_id", "precision", "recall", "f1", "first_hit_rank")
            out = out.join(wanted, "query_id").join(scores, "query_id").drop("query_id")  # questions without references are not written
            json_io.write_json_lines(out, f"{a.output_dir}/{name.removesuffix('.json')}_{a.retriever}_top{a.top_k}")
        summary["splits"][name] = evaluate.means(evaluate.per_query(contents(ranked, docs), gold)).first().asDict()
    json_io.write_summary(spark.createDataFrame([(json.dumps(summary, ensure_ascii=False),)], "summary string"), f"{a.output_dir}/{a.retriever}_{a.corpus_scope}_top{a.top_k}_summary")
    return summary


def evaluate_file(spark: SparkSession, a: argparse.Namespace) -> dict:
    """ROUGE-L and METEOR of predictions: means, and a row for each example below --output."""
    rows = json_io.read_predictions(spark, a.predictions).withColumnRenamed("id", "name").withColumn("id", F.monotonically_increasing_id())
    scored = metrics.with_meteor(metrics.with_rouge_l(rows))
    summary = {"count": scored.count()} | metrics.metric_means(scored, ["rouge_l", "meteor"]).first().asDict()
    if a.output:
        json_io.write_metrics(spark, summary, scored.select(F.col("name").alias("id"), "rouge_l", "meteor"), a.output)
    return summary


def prepare_files(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Builds the curriculum and extractive records of each split, or finds them in the cache, under keys of parameters and files."""
    docs = json_io.read_corpus(spark, a.context_dir)
    out = {}
    for name in a.splits:
        rows = json_io.read_split(spark, f"{a.data_dir}/{name}", limit=a.limit)
        own = rows.drop("id").withColumn("id", F.col("pos").cast("long"))
        refs = records.article_references(own)
        # readers get the window of the article that a record is about, the curriculum whole passages
        found = records.joined_contexts(records.context_lookup(refs, docs, on="content"))
        examples = records.with_context(own, found, ["context"])
        passages = records.joined_contexts(records.context_lookup(refs.drop("article"), docs, WHOLE, on="content"))
        curriculum = records.with_context(own, passages, ["context"])
        sizes = records.chunk_sizes(a.chunk_sizes)
        inputs = [spark.read.text(f"{a.data_dir}/{name}"), spark.read.format("binaryFile").load(a.context_dir)]
        common = {"split": name, "limit": a.limit, "chars": records.CONTEXT_CHARS}
        kinds = {
            "curriculum": (common | {"sizes": sizes, "budget": a.budget, "easy": a.easy_ratio, "version": 2}, lambda e=curriculum, s=sizes: prepare.curriculum_records(e, s, a.budget, a.easy_ratio)),
            "seq2seq": (common | {"version": 1}, lambda e=curriculum: records.seq2seq_rows(e)),
            "extractive": (common | {"version": 2}, lambda e=examples: prepare.extractive_records(e)),
        }
        for kind, (parameters, build) in kinds.items():
            out[f"{name}:{kind}"] = cache.load_or_build(spark, f"{a.cache_dir}/{kind}", parameters, build, inputs).count()
        if a.tokenizer:
            lengths = {"max_input_length": a.max_input_length, "max_target_length": a.max_target_length, "pad_token_id": a.pad_token_id}
            build = lambda e=curriculum: records.seq2seq_features(records.seq2seq_rows(e), a.tokenizer, *lengths.values())
            out[f"{name}:seq2seq_tokens"] = cache.load_or_build(spark, f"{a.cache_dir}/seq2seq_tokens", common | lengths | {"tokenizer": a.tokenizer}, build, inputs).count()
        if a.epochs:
            made = prepare.curriculum_epochs(curriculum, sizes, a.budget, a.easy_ratio, a.easy_ratio_decay, a.epochs, f"{a.cache_dir}/epochs/{name.removesuffix('.json')}")
            out[f"{name}:epochs"] = made.count()
    return out


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lexloom")
    by = top.add_subparsers(dest="command", required=True)
    one, two, three = by.add_parser("retrieve"), by.add_parser("evaluate"), by.add_parser("prepare")
    for p in (one, three):
        p.add_argument("--data-dir", required=True)
        p.add_argument("--context-dir", required=True)
        p.add_argument("--splits", nargs="+", default=SPLITS)
        p.add_argument("--limit", type=int)
    one.add_argument("--structured-dir")
    one.add_argument("--corpus-scope", choices=["contexts", "structured", "referenced"], default="structured")
    one.add_argument("--corpus-limit", type=int)
    one.add_argument("--k1", type=float, default=K1)
    one.add_argument("--b", type=float, default=B)
    one.add_argument("--dense-components", type=int, default=DENSE_COMPONENTS)
    one.add_argument("--dense-max-features", type=int, default=DENSE_MAX_FEATURES)
    one.add_argument("--dense-max-doc-chars", type=int, default=DENSE_MAX_DOC_CHARS)
    one.add_argument("--hybrid-bm25-weight", type=float, default=HYBRID_WEIGHT)
    one.add_argument("--hybrid-candidates", type=int, default=HYBRID_CANDIDATES)
    one.add_argument("--iterations", type=int, default=2)
    one.add_argument("--expansion-terms", type=int, default=8)
    one.add_argument("--clusters", type=int, default=64)
    one.add_argument("--top-clusters", type=int, default=4)
    one.add_argument("--retriever", choices=sorted(retrieve.RETRIEVERS), default="latent_hybrid")
    one.add_argument("--top-k", type=int, default=3)
    one.add_argument("--output-dir", required=True)
    one.add_argument("--no-predictions", action="store_true")
    two.add_argument("--predictions", required=True)
    two.add_argument("--output")
    three.add_argument("--cache-dir", required=True)
    three.add_argument("--chunk-sizes", default="50,100,200,500")
    three.add_argument("--budget", type=int, default=1200)
    three.add_argument("--easy-ratio", type=float, default=0.5)
    three.add_argument("--tokenizer", help="a file of the tokenizers library, at the same place on each executor: write token caches as well")
    three.add_argument("--max-input-length", type=int, default=1024)
    three.add_argument("--max-target-length", type=int, default=256)
    three.add_argument("--pad-token-id", type=int, default=0)
    three.add_argument("--easy-ratio-decay", type=float, default=0.25)
    three.add_argument("--epochs", type=int, default=0, help="write the records of so many training epochs as well")
    return top


def main(arguments: list[str] | None = None) -> dict:
    a = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("lexloom").getOrCreate()
    try:
        result = {"retrieve": retrieve_files, "evaluate": evaluate_file, "prepare": prepare_files}[a.command](spark, a)
    finally:
        store.clear(spark)
    print(json.dumps(result, ensure_ascii=False, indent=2))
    return result


if __name__ == "__main__":
    main()
