"""A corpus pipeline of four stages: quality rules, toxicity, near-duplicates, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given; ``run`` writes each stage's rows as Parquet to
the shared folder and rereads them. The first three return the columns of ``documents``; the last returns the packed
token pieces. Rows without a doc_id keep the defined results of the operators: a null id is never labelled. Extra
columns stay as they are, whatever their names: the stages' own columns have names that no column begins with.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vademecum.llm import bin_packing, near_duplicates, quality, toxicity
from vademecum.llm.queries import tokenizer_path
from vademecum.llm.shared import free_prefix, text_batches, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject."""
    prefix = free_prefix(docs.columns)
    return quality.judge(docs, _labels(spark, sf_dir), docs.columns, prefix).where(f"`{prefix}kept`").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents predicted toxic."""
    field = toxicity.fit(docs, _labels(spark, sf_dir))
    prefix = free_prefix(docs.columns)
    return toxicity.score(docs, field, docs.columns, prefix).where(f"`{prefix}predicted` = 0").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates; rows without doc_id stay."""
    text_batches(spark)
    dropped = near_duplicates.groups(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the remaining documents into sequences."""
    text_batches(spark)
    return bin_packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_each_group),
    ("bin_packing", pack),
]

#: Models, MinHash and token ids are beyond SQL; tests hold the pipeline against its operators and a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
