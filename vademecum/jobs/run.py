"""The whole jobs, for spark-submit: python -m vademecum.jobs.run JOB OPTIONS."""

from __future__ import annotations

import argparse
import importlib
import sys
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vademecum import vocabulary as V
from vademecum.functions import vectors
from vademecum.operators import class_ranks, dosing, evaluation, ingest, names, reports, retrieval
from vademecum.sources import tables
from vademecum.sources.vector_table import VectorTable


def named(spec: str | None, default: Callable) -> Callable:
    """The function that an option names as module:function, or the default."""
    if not spec:
        return default
    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name)


def embed(rows: DataFrame) -> DataFrame:
    """Adds vector by the deterministic stand-in; --embedder names another function of such rows, say of a model's
    iterator pandas UDF."""
    return rows.withColumn("vector", vectors.hash_vector(F.col("text")).cast("array<float>"))


def job_ingest(spark: SparkSession, a: argparse.Namespace) -> None:
    """Pages to chunks; artifacts are written before the coverage gate may fail."""
    run = ingest.Ingestion(tables.read_pages(spark, a.pages), a.toc_first, a.toc_last, keep=lambda df: tables.rewritten(df, "ingest"))
    tables.write_artifacts(ingest.monographs(run.sections), run.chunks, run.report, a.out)
    gate = ingest.coverage_gate(spark.read.schema(run.report.schema).json(f"{a.out}/report"), a.max_missing).first()
    if not gate["passed"]:
        raise SystemExit(f"coverage: {gate['missing']} of {gate['toc_entries']} entries are missing")


def job_embed(spark: SparkSession, a: argparse.Namespace) -> None:
    from vademecum.operators.loading import keyed

    tables.cached_embeddings(keyed(tables.read_chunks(spark, a.chunks, a.form)), a.model, a.out, named(a.embedder, embed))


def job_load(spark: SparkSession, a: argparse.Namespace) -> None:
    table = VectorTable(spark, tables.table_path(a.out, a.model))
    table.load(tables.read_chunks(spark, a.chunks, a.form), named(a.embedder, embed), not a.no_prune).show()


def job_tidy(spark: SparkSession, a: argparse.Namespace) -> None:
    """Merges a vector table's segments and removes what none of its --keep newest versions names."""
    table = VectorTable(spark, tables.table_path(a.table, a.model))
    table.compact(everything=a.everything)
    print(f"removed {len(table.vacuum(a.keep))} segments")


def _corpus(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return VectorTable(spark, tables.table_path(a.table, a.model)).read()


def query_vectors(rows: DataFrame, asked: Column, a: argparse.Namespace) -> DataFrame:
    """Adds query_vector: the questions, with their prefix, by the embedder of the corpus."""
    if not a.embedder:
        return rows.withColumn("query_vector", vectors.hash_vector(asked))
    embedded = named(a.embedder, embed)(rows.withColumn("text", asked))
    return embedded.withColumnRenamed("vector", "query_vector").drop("text")


def job_retrieve(spark: SparkSession, a: argparse.Namespace) -> None:
    corpus = _corpus(spark, a)
    requests = spark.read.json(a.requests, schema="request_id bigint, query string, drug string, section string, species string, top_k int")
    asked = F.concat(F.lit(a.query_prefix), F.col("query"))
    requests = query_vectors(requests, asked, a)
    rescore = named(a.scorer, retrieval.shared_words) if a.rerank or a.scorer else None
    hits, empty, rejects = retrieval.retrieve(requests, corpus, names.canonical(corpus), rescore)
    for name, rows in (("hits", retrieval.citation(hits)), ("empty", empty), ("rejects", rejects)):
        rows.write.mode("overwrite").parquet(f"{a.out}/{name}")


def job_contraindications(spark: SparkSession, a: argparse.Namespace) -> None:
    corpus = _corpus(spark, a)
    known = names.canonical(corpus)
    requests = reports.resolved_requests(spark.read.json(a.requests, schema="request_id bigint, drug string, other_drugs array<string>"), known)
    others = names.resolve(requests.select("request_id", F.explode("other_drugs").alias("other")), known, "other")
    reports.contraindications(requests, corpus, others).write.mode("overwrite").parquet(a.out)


def indication_reports(requests: DataFrame, corpus: DataFrame) -> DataFrame:
    """The reports of requests (request_id, drug, species) by free-form names."""
    resolved = reports.resolved_requests(requests, names.canonical(corpus))
    return reports.indication_report(resolved, reports.indications(resolved.select("request_id", "canonical", "species"), corpus))


def job_indications(spark: SparkSession, a: argparse.Namespace) -> None:
    asked = spark.read.json(a.requests, schema="request_id bigint, drug string, species string")
    indication_reports(asked, _corpus(spark, a)).write.mode("overwrite").parquet(a.out)


def benchmark(models: dict[str, tuple[DataFrame, DataFrame]], relevant: DataFrame | None = None, own: str | None = None) -> DataFrame:
    """The scorecard of models, each with its queries (query_id, query_vector) and corpus (logical_key, vector), over the
    relevant pairs (query_id, logical_key). Without pairs, a row is relevant whose class is the one that a query wants
    (columns class and wanted); no pair is made then. Queries without relevant keys score 0."""
    rows = []
    for name, (asked, corpus) in models.items():
        counts = class_ranks.class_sizes(asked, corpus, own) if relevant is None else relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
        cases = asked.select("query_id", F.lit(name).alias("model")).join(counts, "query_id", "left").fillna(0, "n_relevant")
        ranks = class_ranks.leading_ranks(asked, corpus, max(evaluation.KS), own=own) if relevant is None else retrieval.block_ranks(asked, corpus, relevant, own=own)
        ranks = ranks.withColumn("model", F.lit(name))
        rows.append(evaluation.query_metrics(cases, ranks, ["model", "query_id"]))
    means = evaluation.mean_metrics(reduce(DataFrame.unionByName, rows), ["model"])
    return evaluation.scorecard(evaluation.long_form(means, ["model"]))


def job_benchmark(spark: SparkSession, a: argparse.Namespace) -> None:
    """Scores the vector tables of the models (--model, comma-separated) over a frozen query set."""
    cases = tables.read_eval_set(spark, a.requests)
    relevant = cases.select("query_id", F.explode("relevant_logical_keys").alias("logical_key"))
    asked = query_vectors(cases.select("query_id", "query"), F.concat(F.lit(a.query_prefix), F.col("query")), a).select("query_id", "query_vector")
    models = {m: (asked, VectorTable(spark, tables.table_path(a.table, m)).read()) for m in a.model.split(",")}
    print(tables.write_scorecard(benchmark(models, relevant), a.out))


def job_dose(spark: SparkSession, a: argparse.Namespace) -> None:
    """Extracted regimens (JSON per request) are parsed, grounded in their passage, chosen and dosed."""
    schema = "request_id bigint, drug string, indication string, all_regimens boolean, weight decimal(10,6), unit string, passage string, regimens_json string"
    requests = spark.read.json(a.requests, schema=schema)
    verdict, doses = dosing.dose_requests(requests)
    for name, rows in (("verdicts", verdict), ("doses", doses)):
        rows.write.mode("overwrite").parquet(f"{a.out}/{name}")


def job_build_eval_set(spark: SparkSession, a: argparse.Namespace) -> None:
    corpus = _corpus(spark, a)
    cases = evaluation.build_eval_set(corpus, V.FLOW_SECTIONS, a.per_flow, a.seed, a.other_fraction, "logical_key")
    cases.write.mode("overwrite").json(a.out)


JOBS = {name.removeprefix("job_"): f for name, f in globals().copy().items() if name.startswith("job_")}


def main(arguments: list[str]) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("job", choices=sorted(JOBS))
    for name in ("pages", "chunks", "table", "requests", "out"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--form", default="parquet")
    parser.add_argument("--model", default="hash")
    parser.add_argument("--toc-first", type=int, default=0)
    parser.add_argument("--toc-last", type=int, default=0)
    parser.add_argument("--max-missing", type=int, default=0)
    parser.add_argument("--query-prefix", default="")
    parser.add_argument("--embedder", help="module:function that adds vector to rows with text")
    parser.add_argument("--scorer", help="module:function of (query, text) columns; orders the best candidates anew")
    parser.add_argument("--rerank", action="store_true")
    parser.add_argument("--no-prune", action="store_true")
    parser.add_argument("--everything", action="store_true")
    parser.add_argument("--keep", type=int, default=2)
    parser.add_argument("--per-flow", type=int, default=25)
    parser.add_argument("--seed", type=int, default=0)
    parser.add_argument("--other-fraction", type=float, default=0.2)
    a = parser.parse_args(arguments)
    JOBS[a.job](SparkSession.builder.appName(f"vademecum-{a.job}").getOrCreate(), a)


if __name__ == "__main__":
    main(sys.argv[1:])
