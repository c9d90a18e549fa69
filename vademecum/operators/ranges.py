"""Numbering the rows of groups of any size: by ranges of the order in place of a window over each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vademecum.sources.tables import rewritten


def free_prefix(columns: list[str]) -> str:
    """A start of names that no column has."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def numbered(rows: DataFrame, by: list[str], order: list[Column | str], name: str, first: int = 1) -> DataFrame:
    """Adds ``name``: the place of each row, from ``first`` on, among the rows with equal ``by`` (nulls are a value) under
    ``order``. Rows that are equal in both get any of their places.

    Spark samples splitters of (by, order) and sorts the rows by ranges, so that the rows of one group are cut over many
    tasks wherever it is large; they are written with their number in the range. Of every (group, range) only a count
    and the smallest number are summed, one row for each, and joined back. Callers pass narrow rows.
    """
    p = free_prefix(rows.columns)
    row, part, base, least, count = (p + x for x in ("row", "part", "base", "least", "count"))
    keys = [F.col(c) for c in by]
    ordered = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    kept = rewritten(ordered.withColumn(row, F.monotonically_increasing_id()), "ranges")
    kept = kept.withColumn(part, F.shiftright(row, 33).cast("int"))
    ranges = kept.groupBy(*by, part).agg(F.min(row).alias(least), F.count(F.lit(1)).alias(count))
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    ranges = ranges.select(*[F.col(c).alias(f"{p}k{i}") for i, c in enumerate(by)], F.col(part).alias(f"{p}kp"), least, F.coalesce(F.sum(count).over(before), F.lit(0)).alias(base))
    same = [F.col(c).eqNullSafe(F.col(f"{p}k{i}")) for i, c in enumerate(by)]
    joined = kept.join(ranges, [*same, F.col(part) == F.col(f"{p}kp")])
    return joined.select(*rows.columns, (F.col(row) - F.col(least) + F.col(base) + first).alias(name))
