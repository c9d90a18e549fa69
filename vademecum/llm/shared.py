"""Shared-folder tables, group streaming over sorted Arrow batches and distributed ranking helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only for a local session that names none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="vademecum-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet to the shared folder and reads it back."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Sends at most ``rows`` rows at a time to Python workers: tables of texts need smaller Arrow batches than the
    default of 10,000 rows, which both the executor and its workers would hold."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def column_of(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that at most ``rows`` rows are turned into Python objects at once. After the last one, memory
    that this worker has freed goes back to the system, since the worker lives on for other tasks."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    give_back()


def give_back() -> None:
    """Returns freed memory of Arrow and, with glibc, of Python and numpy to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def key_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Groups of equal ``keys`` from a partition that is sorted by them: (key, rows as tuples in column order).

    Callers bound the group size beforehand, since a group is held in memory.
    """
    current, rows = None, []
    for batch in batches:
        columns = [column.to_pylist() for column in batch.columns]
        at = [batch.schema.get_field_index(k) for k in keys]
        for row in zip(*columns, strict=True):
            key = tuple(row[i] for i in at)
            if key != current:
                if rows:
                    yield current, rows
                current, rows = key, []
            rows.append(row)
    if rows:
        yield current, rows
    give_back()


def ranked_by_unit(df: DataFrame, group: list[str], unit: str, order: list, rank: str) -> DataFrame:
    """Adds ``rank``, the 0-based place of each row in its ``group`` under (unit, order), without one task per group.

    ``unit`` is a small integer column that splits a group into ordered parts; the rows of a (group, unit) share
    one task, and the counts of the units before it are added. Groups and units are counted with map-side sums.
    """
    from pyspark.sql import Window

    p = free_prefix([*df.columns, rank])
    n, start, inside = p + "n", p + "start", p + "in"
    counts = df.groupBy(*group, unit).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(*group).orderBy(unit).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn(start, F.coalesce(F.sum(n).over(before), F.lit(0))).drop(n)
    names = [*group, unit]
    right = starts.select(*[F.col(c).alias(f"{p}k{i}") for i, c in enumerate(names)], start)
    on = [F.col(c).eqNullSafe(F.col(f"{p}k{i}")) for i, c in enumerate(names)]
    within = Window.partitionBy(*names).orderBy(*order)
    placed = df.withColumn(inside, F.row_number().over(within) - 1)
    return placed.join(right, on, "left").withColumn(rank, F.col(start) + F.col(inside)).drop(inside, start, *right.columns)


def per_batch(function: Callable[[pa.RecordBatch], pa.RecordBatch], rows: int = 512) -> Callable:
    """A ``mapInArrow`` function that applies ``function`` to small slices."""

    def run(batches):
        for batch in slices(batches, rows):
            yield function(batch)

    return run


def label_of_ids(labels: DataFrame, column: str) -> DataFrame:
    """doc_id and label of every labelled id. Null ids and labels are left out; of several labels the lowest holds."""
    return labels.where(f"doc_id IS NOT NULL AND {column} IS NOT NULL").groupBy("doc_id").agg(F.min(column).alias("label"))


def sampled_labels(labels: DataFrame, column: str, most: int, where: str = "true") -> tuple[np.ndarray, np.ndarray]:
    """Sorted ids and their labels from about ``most`` labelled rows at most, chosen by a hash of the id.

    Null ids and labels are left out; of several labels for an id the lowest holds.
    """
    usable = labels.where(f"doc_id IS NOT NULL AND {column} IS NOT NULL AND ({where})")
    share = min(1.0, most / max(1, usable.count()))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = chosen.groupBy("doc_id").agg(F.min(column).alias("label")).toPandas().sort_values("doc_id")
    return rows["doc_id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64)


def looked_up(ids: list[int | None], known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of each id, -1 for an id that isn't known."""
    wanted = np.array([-1 if i is None else i for i in ids], np.int64)
    present = np.array([i is not None for i in ids], bool)
    at = np.searchsorted(known, wanted)
    hit = present & (at < len(known))
    hit[hit] = known[at[hit]] == wanted[hit]
    out = np.full(len(ids), -1, np.int64)
    out[hit] = values[at[hit]]
    return out


def labelled_texts(docs: DataFrame, ids: np.ndarray, values: np.ndarray) -> DataFrame:
    """text and label of the documents with these ids, written once to the shared folder: rows that go on to another
    Python function would else take a second worker for each task, and an executor keeps its workers and their memory."""
    shared = docs.sparkSession.sparkContext.broadcast((ids, values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = looked_up(column_of(batch, "doc_id"), *shared.value)
            rows = np.flatnonzero(label >= 0)
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(rows)), pa.array(label[rows])], ["text", "label"])

    return written(docs.select("doc_id", "text").mapInArrow(run, "text string, label long"), "labelled")


def fields(df: DataFrame, names: list[str]) -> str:
    """The schema of some columns as DDL."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema)


def free_prefix(columns: list[str]) -> str:
    """A start of names that no column has."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix
