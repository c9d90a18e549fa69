"""Shards in Hilbert-curve order.

Several metadata columns are quantised to ``bits`` bits each at their quantiles, a row's cell is its place on the
Hilbert curve through the grid, rows are sorted by cell, and equally long runs of the order become shards. Neighbours on
the curve are neighbours in all dimensions, so each shard covers a narrow range of every column, and a reader that
filters on any of them can skip shards by their ranges (see ``manifest``).

Everything is DataFrame expressions. The curve is a walk through small tables, made from its rule, one step per bit. Rows
of one cell are ordered by a hash of doc_id, and the hash's top bits split a cell into parts, so that a cell with a large
share of the rows is ranked by many tasks. Counts of the parts, not rows, are summed across tasks.

Null metadata is quantised below all values, and an all-null column takes no part. Rows equal in doc_id and text take
neighbouring places. Texts are never moved, so their length doesn't matter; an empty table has no shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vademecum.llm.shared import free_prefix, written

BITS = 4
PARTS = 256


def curve_tables(dims: int) -> tuple[list[int], list[int]]:
    """Of each (state, cell corner): the place along the curve, and the next state.

    A state is an entry corner and a direction; the curve inside a corner's subcube is turned by the corner's Gray code.
    """
    size, mask = 1 << dims, (1 << dims) - 1
    turn_left = lambda x, k: (x << k % dims | x >> (dims - k % dims)) & mask
    turn_right = lambda x, k: turn_left(x, dims - k % dims)
    gray = [i ^ i >> 1 for i in range(size)]
    entry = [0] + [gray[2 * ((i - 1) // 2)] for i in range(1, size)]
    trailing = lambda i: (~i & (i + 1)).bit_length() - 1
    direction = [0 if i == 0 else (trailing(i - 1) if i % 2 == 0 else trailing(i)) % dims for i in range(size)]
    places, following = [], []
    for e in range(size):
        for d in range(dims):
            for corner in range(size):
                place = gray.index(turn_right(corner ^ e, d + 1))
                places.append(place)
                following.append((e ^ turn_left(entry[place], d + 1)) * dims + (d + direction[place] + 1) % dims)
    return places, following


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """The place on the Hilbert curve of integer coordinates of ``bits`` bits each."""
    dims = len(cells)
    places, following = (F.array(*[F.lit(x) for x in t]) for t in curve_tables(dims))

    def step(state: Column, bit: Column) -> Column:
        corner = sum((F.call_function("shiftright", c, bit.cast("int")).bitwiseAND(F.lit(1)) * (1 << k) for k, c in enumerate(cells)), F.lit(0)).cast("int")
        at = state["s"] * (1 << dims) + corner + 1
        return F.struct((state["h"] * (1 << dims) + F.element_at(places, at)).cast("long").alias("h"), F.element_at(following, at).cast("int").alias("s"))

    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0)), F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("s")), step)["h"]


def string_cuts(df: DataFrame, name: str, cells: int) -> list[str]:
    """The values at which the next of ``cells`` equally heavy cells of a string column starts, by the whole values and
    the counts of all rows that aren't null.

    Distinct values are counted, dealt by ranges and written; sums of the ranges and running sums within each give every
    value's place. Only values that start a cell, fewer than ``cells``, reach the driver.
    """
    counts = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    dealt = written(counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()), "values")
    parts = dealt.groupBy("part").agg(F.sum("n").alias("m"))  # a row per partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"), F.sum("m").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(parts), "part")
    rank = F.col("base") + F.col("before")
    cell = F.floor((2 * rank + F.col("n")) * cells / (2 * F.col("total")))  # of the middle of a value's run
    chosen = placed.groupBy(cell.alias("cell")).agg(F.min("value").alias("value")).where("cell > 0")
    return sorted(r["value"] for r in chosen.collect())


def quantised(df: DataFrame, dims: list[str], bits: int = BITS) -> list[Column]:
    """Cells 0 to 2**bits - 1 of each column by its quantiles over all rows; fewer than 2**bits cuts per column reach the
    driver. Strings are compared whole, other columns as numbers; null is in cell 0."""
    kinds = dict(df.dtypes)
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    numbers = [c for c in dims if kinds[c] != "string"]
    aggregates = [F.percentile_approx(F.col(c).cast("double"), shares, 10_000).alias(f"q{i}") for i, c in enumerate(numbers)]
    found = df.agg(*aggregates).first() if aggregates else []
    cuts = {c: sorted(set(found[i] or [])) for i, c in enumerate(numbers)}
    cuts |= {c: string_cuts(df, c, 1 << bits) for c in dims if c not in cuts}
    out = []
    for c in dims:
        key = F.col(c) if kinds[c] == "string" else F.col(c).cast("double")
        out.append(F.coalesce(sum(((key >= F.lit(x)).cast("int") for x in cuts[c]), F.lit(0)), F.lit(0)).cast("int"))
    return out


def shards(df: DataFrame, dims: list[str], n_shards: int, key: str = "doc_id", ties: tuple[str, ...] = (), bits: int = BITS) -> DataFrame:
    """Adds hilbert (place on the curve), shard (0 to n_shards - 1) and slot (gapless from 0 in each shard); columns of
    these names are replaced, all others stay.

    Shards differ by one row at most. Only the columns of ``df`` are moved, once, by (cell, part). Rows with a null key
    are spread by their ``ties``.
    """
    new = ["hilbert", "shard", "slot"]
    kept = [c for c in df.columns if c not in new]
    p = free_prefix(df.columns)
    spread, part, count, cell, total, start, row = (p + x for x in ("spread", "part", "count", "cell", "total", "start", "row"))
    at = [cell, part]
    placed = df.withColumn(cell, hilbert_index(quantised(df, dims, bits), bits)).withColumn(spread, F.xxhash64(F.coalesce(F.col(key), F.xxhash64(*dims, *ties))))
    placed = placed.withColumn(part, F.pmod(F.shiftright(spread, 40), F.lit(PARTS)).cast("int"))
    counts = placed.groupBy(*at).agg(F.count(F.lit(1)).alias(count))
    cells = counts.groupBy(cell).agg(F.sum(count).alias(total))  # at most 2 ** (bits * dims) rows
    before = Window.orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(cell, F.coalesce(F.sum(total).over(before), F.lit(0)).alias(start), F.sum(total).over(Window.partitionBy()).alias(total))
    inside = Window.partitionBy(cell).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn(row, F.coalesce(F.sum(count).over(inside), F.lit(0))).join(cells, cell)
    starts = starts.select(*at, (F.col(start) + F.col(row)).alias(start), total)
    order = Window.partitionBy(*at).orderBy(spread, key, *ties)
    ranked = placed.withColumn(row, F.row_number().over(order) - 1).join(starts, at)
    ranked = ranked.withColumn(row, F.col(start) + F.col(row))
    shard = F.expr(f"CAST((`{row}` * {n_shards}) DIV `{total}` AS INT)")
    ranked = ranked.select(*kept, F.col(cell).alias("hilbert"), shard.alias("shard"), row, total)
    slot = F.expr(f"`{row}` - (CAST(shard AS BIGINT) * `{total}` + {n_shards - 1}) DIV {n_shards}")
    return ranked.select(*kept, "hilbert", "shard", slot.alias("slot"))


def manifest(sharded: DataFrame, dims: list[str]) -> DataFrame:
    """Rows and the smallest and largest value of each dimension per shard, for pruning."""
    ranges = [f(c).alias(f"{n}_{c}") for c in dims for n, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *ranges)
