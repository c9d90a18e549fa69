"""A mix of sources near target weights, by hash thresholds from histograms.

A document's key is a 60-bit hash of its id and text. A source's budget is met by the documents up to a key: words are
summed by source and by the first ten bits of the key, the bucket in which the running sum passes the budget is the only
one that is looked at again, by the next ten bits, and so on until it holds one key. Rows are never sorted; each level
reads the rows of the boundary buckets alone, a thousandth of those before it, and a running sum sees at most 1,024
buckets of a source. A source with a third of all rows is summed by many tasks before anything is exchanged.

Thresholds are nested: with a larger budget every document that was taken still is, and a budget beyond the source's size
takes all its documents once or more before it takes some of them once again. Of the two sums around a budget the nearer
one is taken (the smaller on a tie), so a source misses its target by half of one document at most.

Everything is DataFrame expressions. Broadcasts are left to Spark's size limit: tables by source are written before they
are joined, so their size is known, and a larger one is joined by the adaptive skew join.

Defined results: a null text has size 0; documents of size 0 are taken 0 times in words. A null source is a source of
its own, the last. Rows equal in id and text have one key and share their fate, so a budget that ends within such
copies is met as nearly as all or none of them can; rows without an id are told apart by their text. A table without
words has targets of 0; an empty one has no rows. Other columns are not read by ``sized``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vademecum.llm.shared import written

#: Bits of a key, and bits that a level of the search looks at.
KEY_BITS, LEVEL_BITS = 60, 10
MOST_TIMES = 3


def n_words(text: Column) -> Column:
    """The number of maximal runs of characters other than the six ASCII spaces."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def mix_key(doc_id: Column, text: Column) -> Column:
    """The 60-bit key: the same in every run and for every input order."""
    own = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(own.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, source: str = "source") -> DataFrame:
    """doc_id, source, size in words and key of every document; written, since several passes follow."""
    return written(docs.select("doc_id", F.col(source).alias("source"), n_words(F.col("text")).alias("size"), mix_key(F.col("doc_id"), F.col("text")).alias("key")), "sized")


def in_order(rows: DataFrame, column: str, rank: str) -> DataFrame:
    """Adds the 0-based rank of each row by a column, nulls last, ranges of the column in parallel. Written between."""
    order = F.col(column).asc_nulls_last()
    dealt = written(rows.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "ranges")
    parts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row per partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return dealt.withColumn("inside", inside).join(parts, "part").withColumn(rank, F.col("base") + F.col("inside")).drop("part", "base", "inside")


def targets(sources: DataFrame) -> DataFrame:
    """source, source_size and target of sources (source, source_size): weights 1, 2, 3, 1, ... in code point order share
    the sum of all sizes; a source stops at MOST_TIMES its size and the excess is shared anew by weight.

    A round raises the words per unit of weight until no target is above; only its sums reach the driver. Rounds end as
    soon as one stops no further source.
    """
    rows = written(in_order(sources, "source", "rank").select("source", "source_size", (F.col("rank") % 3 + 1).alias("weight")), "sources")
    cap = MOST_TIMES * F.col("source_size")
    total = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, stopped = 0.0, -1
    while True:
        is_full = F.col("weight") * F.lit(level) > cap
        open_ = F.sum(F.when(is_full, 0).otherwise(F.col("weight")))
        n, full, weight = rows.agg(F.count_if(is_full), F.coalesce(F.sum(F.when(is_full, cap).otherwise(0)), F.lit(0)), F.coalesce(open_, F.lit(0))).first()
        if n == stopped or not weight:
            break
        level, stopped = (total - full) / weight, n
    share = F.col("weight") * F.lit(level)
    return rows.select("source", "source_size", F.when(share > cap, cap.cast("double")).otherwise(share).alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """source and threshold: the keys of a source up to it hold words nearest to its budget (source, budget).

    ``rows`` has source, key and size. Sources whose budget is no more than 0 or beyond their words are left out.
    """
    boundary = budgets.where("budget > 0").select("source", "budget", F.lit(0).cast("long").alias("base"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    level = rows
    for shift in range(KEY_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        bucket = F.shiftright("key", shift).bitwiseAND(F.lit((1 << LEVEL_BITS) - 1)).cast("int").alias("bucket")
        sums = level.groupBy("source", bucket).agg(F.sum("size").alias("words"), F.min("key").alias("low"), F.max("key").alias("high"))
        before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sums = sums.withColumn("before", before)
        at = boundary.select("source", "budget", "base")
        met = sums.join(at, same(sums, at)).withColumn("start", F.col("base") + F.col("before"))
        met = met.where("start <= budget AND budget < start + words")
        boundary = written(met.select(at["source"], "budget", F.col("start").alias("base"), "words", "low", "high"), "boundary")
        if boundary.where("low < high").isEmpty():
            break
        near = boundary.select("source", "low", "high")
        inside = level.join(near, same(level, near) & level["key"].between(near["low"], near["high"]))
        level = written(inside.select(level["source"], level["key"], level["size"]), "level")
    nearer = F.col("base") + F.col("words") - F.col("budget") < F.col("budget") - F.col("base")
    return boundary.select("source", F.when(nearer, F.col("high")).otherwise(F.col("low") - 1).alias("threshold"))


def plan(rows: DataFrame) -> DataFrame:
    """source, source_size, target, times (how often every document is taken) and threshold (documents up to this key are
    taken once more; null: none) of sized rows. One row per source; written."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    wanted = targets(sources)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    wanted = wanted.withColumn("times", times).withColumn("budget", F.col("target") - F.col("times") * F.col("source_size"))
    wanted = written(wanted, "targets")
    found = thresholds(rows, wanted.select("source", "budget"))
    joined = wanted.join(found, wanted["source"].eqNullSafe(found["source"]), "left")
    return written(joined.select(wanted["source"], "source_size", "target", "times", "threshold"), "plan")


def mixed(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Adds source_size, target, copies (how often the mix takes the document) and taken (in words) to sized rows: one
    comparison with the plan of the row's source."""
    copies = F.col("times") + F.coalesce((F.col("key") <= F.col("threshold")).cast("long"), F.lit(0))
    joined = rows.join(planned, rows["source"].eqNullSafe(planned["source"]))
    return joined.select(*[rows[c] for c in rows.columns], "source_size", "target", copies.alias("copies"), (rows["size"] * copies).alias("taken"))
