"""The derived handbook as DataFrames for the registered queries.

The tables that many queries start from are written to the shared folder once per session and input, and read from
there; that also keeps the plans of the queries short.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vademecum.operators import ingest
from vademecum.plans.registry import table
from vademecum.plans.sql import HANDBOOK
from vademecum.sources.tables import rewritten

_made: dict[tuple[str, str, str], Any] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], Any]) -> Any:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _made:
        _made[key] = make()
    return _made[key]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewritten(spark.sql(HANDBOOK, part=table(spark, sf_dir, "part"), lineitem=table(spark, sf_dir, "lineitem")), "handbook")


def _pages(lines: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("line_idx", "txt")))
    joined = F.array_join(F.transform(ordered, lambda x: x["txt"]), "\n")
    return lines.groupBy("book_id", "page_idx").agg(joined.alias("raw_text"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "lines", lambda: _lines(spark, sf_dir))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(lines(spark, sf_dir))


def ingest_anew(spark: SparkSession, sf_dir: str) -> ingest.Ingestion:
    """A run that shares nothing with others of the session."""
    return ingest.Ingestion(_pages(_lines(spark, sf_dir)), 0, 0, keep=lambda df: rewritten(df, "ingest"))


def ingestion(spark: SparkSession, sf_dir: str) -> ingest.Ingestion:
    made = lambda: ingest.Ingestion(pages(spark, sf_dir), 0, 0, keep=lambda df: rewritten(df, "ingest"))
    return _once(spark, sf_dir, "ingestion", made)


def whole_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks without splitting any text, so that SQL can number the same groups."""
    made = lambda: rewritten(ingest.chunks(ingestion(spark, sf_dir).groups, max_chars=1 << 30), "chunks")
    return _once(spark, sf_dir, "chunks", made)
