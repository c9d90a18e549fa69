"""Reading and writing the tables of the handbook jobs.

Tables are Parquet or JSON folders with declared schemas; a malformed record fails the read. Vector tables are in
``vector_table``.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vademecum import schemas
from vademecum import vocabulary as V
from vademecum.operators import loading


def table_path(prefix: str, model: str) -> str:
    """The folder of a model's vector table."""
    return f"{prefix}__{re.sub('^_+|_+$', '', re.sub('[^a-z0-9]+', '_', model.lower()))}"


def read_pages(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    return spark.read.schema(schemas.PAGES).format(form).load(path)


def _read(spark: SparkSession, path: str, schema: str, form: str) -> DataFrame:
    """``form``: json (a record per line), json_array (one array per file) or any format of Spark."""
    reader = spark.read.schema(schema)
    if form.startswith("json"):
        return reader.option("mode", "FAILFAST").option("multiLine", form == "json_array").json(path)
    return reader.format(form).load(path)


def checked_sections(rows: DataFrame, column: str) -> DataFrame:
    """Fails on the first row whose section type isn't one of the vocabulary."""
    known = F.col(column).isin(V.SECTION_TYPES)
    return rows.withColumn(column, F.when(known, F.col(column)).otherwise(F.raise_error(F.concat(F.lit("unknown section type "), F.coalesce(column, F.lit("null"))))))


def read_chunks(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    return checked_sections(_read(spark, path, schemas.CHUNKS, form), "section_type")


def read_eval_set(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    return checked_sections(_read(spark, path, schemas.EVAL_CASES, form), "section")


def promote_eval_set(spark: SparkSession, draft: str, final: str) -> int:
    """Validates a reviewed draft, freezes it and returns its number of cases."""
    read_eval_set(spark, draft).write.mode("overwrite").json(final)
    return spark.read.schema(schemas.EVAL_CASES).json(final).count()


def write_artifacts(monographs: DataFrame, chunks: DataFrame, report: DataFrame, folder: str) -> None:
    """Writes monographs, chunks (a folder per section type) and the report."""
    monographs.write.mode("overwrite").parquet(f"{folder}/monographs")
    chunks.write.mode("overwrite").partitionBy("section_type").parquet(f"{folder}/chunks")
    report.write.mode("overwrite").json(f"{folder}/report")


def _names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in system.listStatus(target)) if system.exists(target) else []


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def cached_embeddings(chunks: DataFrame, model: str, folder: str, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The chunks (with content_hash and text) with their vectors. The cache is addressed by content: vectors are saved by
    content_hash for each model, and ``embed`` sees only chunks whose hash isn't saved yet, each once. A corpus that the
    model has met exactly as it is, known by its fingerprint, isn't compared with the cache at all.

    Every run that embeds adds one folder; only folders that were written whole are read. Vectors that two runs have made
    side by side are taken once.
    """
    spark = chunks.sparkSession
    base = table_path(f"{folder}/model", model)
    mark = f"{base}/corpora/{loading.fingerprint(chunks).first()['fingerprint']}"

    def saved() -> DataFrame:
        whole = [f"{base}/vectors/{n}" for n in _names(spark, f"{base}/vectors") if _exists(spark, f"{base}/vectors/{n}/_SUCCESS")]
        rows = spark.read.schema("content_hash string, vector array<float>").parquet(*whole) if whole else spark.createDataFrame([], "content_hash string, vector array<float>")
        return rows.groupBy("content_hash").agg(F.first("vector").alias("vector"))

    if not _exists(spark, mark):
        new = chunks.where("content_hash IS NOT NULL").join(saved().select("content_hash"), "content_hash", "left_anti").dropDuplicates(["content_hash"])
        new = rewritten(new.select(*chunks.columns), "unembedded")
        if not new.isEmpty():
            embed(new).select("content_hash", F.col("vector").cast("array<float>").alias("vector")).write.parquet(f"{base}/vectors/{uuid.uuid4().hex}")
        spark.createDataFrame([], "mark string").write.mode("overwrite").parquet(mark)
    return chunks.join(saved(), "content_hash", "left").select(*chunks.columns, "vector")


def write_scorecard(scorecard: DataFrame, folder: str) -> str:
    """Writes the scorecard as JSON and returns it as a markdown table; it has one row per model."""
    scorecard.write.mode("overwrite").json(f"{folder}/scorecard")
    rows = scorecard.orderBy("model").collect()
    names = scorecard.columns
    lines = ["| " + " | ".join(names) + " |", "|" + " --- |" * len(names)]
    shown = lambda v: f"{v:.3f}" if isinstance(v, float) else str(v)
    return "\n".join([*lines, *("| " + " | ".join(shown(r[n]) for n in names) + " |" for r in rows)])


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``; a local temporary one if a local session has none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="vademecum-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def rewritten(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: writes to the shared folder and reads back."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
