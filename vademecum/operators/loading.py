"""Keeping a vector table in step with chunks: insert, skip and prune by point id and content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vademecum.functions import identity


def keyed(chunks: DataFrame) -> DataFrame:
    """Adds logical_key, content_hash and point_id."""
    key = identity.logical_key(F.col("drug_name"), F.col("section_type"), F.col("species"), F.col("ordinal"))
    rows = chunks.withColumn("logical_key", key).withColumn("content_hash", identity.content_hash(F.col("logical_key"), F.col("text")))
    return rows.withColumn("point_id", identity.point_id(F.col("logical_key")))


def existing_hashes(table: DataFrame) -> DataFrame:
    """point_id and content_hash of the stored rows that have a hash; vectors are not read."""
    return table.select("point_id", "content_hash").where("content_hash IS NOT NULL")


def duplicate_points(desired: DataFrame) -> DataFrame:
    return desired.groupBy("point_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def actions(desired: DataFrame, existing: DataFrame, prune: bool = True) -> DataFrame:
    """point_id and action: upsert (new or changed), skip (same hash), and if asked to prune: prune (stored only). Without
    pruning rows that are only stored aren't answered."""
    new = desired.select("point_id", F.col("content_hash").alias("_new"), F.lit(True).alias("_wanted"))
    old = existing_hashes(existing).select("point_id", F.col("content_hash").alias("_old"), F.lit(True).alias("_stored"))
    both = new.join(old, "point_id", "full" if prune else "left")
    action = F.when(F.col("_wanted").isNull(), "prune").when(F.col("_new").eqNullSafe(F.col("_old")), "skip").otherwise("upsert")
    return both.select("point_id", action.alias("action"))


def load_report(action_rows: DataFrame) -> DataFrame:
    count = lambda a: F.count_if(F.col("action") == a).alias({"upsert": "upserted", "skip": "skipped", "prune": "pruned"}[a])
    return action_rows.agg(count("upsert"), count("skip"), count("prune"))


def merged(existing: DataFrame, embedded: DataFrame, action_rows: DataFrame) -> DataFrame:
    """The new table: stored rows that are neither pruned nor replaced, and the embedded ones."""
    gone = action_rows.where("action IN ('upsert', 'prune')").select("point_id")
    return existing.join(gone, "point_id", "left_anti").unionByName(embedded.select(*existing.columns))


def check(desired: DataFrame, existing: DataFrame, prune: bool) -> None:
    """Raises on repeated points, and on an empty input that would prune a table that has rows."""
    if not duplicate_points(desired).isEmpty():
        raise ValueError("several chunks have one logical key")
    if prune and desired.isEmpty() and not existing.isEmpty():
        raise ValueError("an empty input would prune the whole table")


def fingerprint(chunks: DataFrame) -> DataFrame:
    """One row: a 16-digit hash of all content hashes, whatever their order: of their number and of the sums of their four
    quarters, so that tasks send a few numbers on, whatever the number of chunks."""
    quarter = lambda i: F.sum(F.conv(F.substring("content_hash", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)"))
    sums = [F.coalesce(quarter(i), F.lit(0).cast("decimal(38,0)")).cast("string") for i in range(4)]
    counted = chunks.agg(F.concat_ws("|", F.count("content_hash").cast("string"), *sums).alias("all"))
    return counted.select(F.substring(F.sha2("all", 256), 1, 16).alias("fingerprint"))
