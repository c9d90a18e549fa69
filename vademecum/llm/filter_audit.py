"""How filters interact: what each removes at every place of every order, by contractions of a contingency tensor.

The rows of a part that pass or fail each of n filters are counted once, in a tensor with an axis of two (0 passes,
1 fails) per filter and one more axis for what is counted: all rows, good ones, toxic ones. Whatever a step of an order
needs is a contraction of that tensor in which each axis is taken at pass, at fail or at both (``PASS``, ``FAIL``,
``ALL``), so orders cost nothing per row: texts are read once, and a part meets its orders as 2**n counts at most.

Copies are found by SHA-256 of the whole text: digests are counted with map-side sums, and only the smallest id of
texts that occur under several ids is joined back, as a written table, so that the adaptive skew join can split the
rows of one very frequent text.

Defined results: a null text is empty; an empty text fails the word count alone of the text rules (it has no words to
repeat), and all empty texts are copies of each other. A null part is the empty string. A row without an id is never a
copy, makes none of others a copy and has no label; rows with equal ids aren't copies of each other. If labels repeat
an id, a document counts as good or toxic if any of them says so. Very long texts are counted whole, within their task.
Columns beside those named are not read, whatever their names; a table without rows has no parts, so no result rows.
"""

from __future__ import annotations

import itertools
import string

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vademecum.llm.shared import written

PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
GAP = r"[\x20\x09-\x0D]+"
#: What a tensor counts along its first axis.
COUNTED = ["n", "n_good", "n_toxic"]


def text_failures(text: Column) -> tuple[Column, list[Column]]:
    """An array of the words, and given a column ``words`` of it which of the four text rules A to D fail."""
    words = F.array_remove(F.split(text, GAP), "")
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return words, [n < 50, 100 * distinct < 65 * n, 100 * capitals > 5 * F.length(text), text.rlike("[#$%&*|]")]


def failures(docs: DataFrame, part: str = "source") -> DataFrame:
    """doc_id, part, fails (bit i: the text rule i fails) and the text's digest of every document; written, since two
    passes follow."""
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    words, fails = text_failures(F.col("text"))
    bits = sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails)), F.lit(0))
    rows = rows.withColumn("words", words).select("doc_id", "part", bits.cast("int").alias("fails"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    return written(rows, "failures")


def patterns(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, fails (bits of the rules A to E) and the counts of COUNTED."""
    rows = failures(docs, part)
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    copied = written(groups.where("last > first").select("digest", "first"), "copied")
    is_one = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    marks = written(labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic")), "marks")
    copy = F.when(F.col("doc_id") > F.col("first"), F.lit(16)).otherwise(F.lit(0))
    rows = rows.join(marks, "doc_id", "left").join(copied, "digest", "left")
    sums = [F.count(F.lit(1)), *(F.sum(F.coalesce(c, F.lit(0))) for c in ("good", "toxic"))]
    return rows.select("part", (F.col("fails") + copy).alias("fails"), "good", "toxic").groupBy("part", "fails").agg(*[s.alias(c) for s, c in zip(sums, COUNTED, strict=True)])


def contracted(tensor: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The sums (counted, case) of a tensor (counted, 2, ..., 2) for cases (case, axis, 2), each a choice of PASS, FAIL or
    ALL per axis; exact in 64 bits."""
    axes = string.ascii_lowercase[: chosen.shape[1]]
    spec = f"Z{axes}," + ",".join(f"Y{a}" for a in axes) + "->ZY"
    return np.einsum(spec, tensor, *[chosen[:, i] for i in range(len(axes))])


class Orders:
    """Every step of every order of n filters, as choices along the axes of a tensor."""

    def __init__(self, n: int) -> None:
        self.n = n
        self.orders = list(itertools.permutations(range(n)))
        self.own = np.array([f for order in self.orders for f in order])
        kept, removed, failing, alone = [], [], [], []
        for order in self.orders:
            for k, f in enumerate(order):
                before = set(order[:k])
                kept.append([PASS if i in before or i == f else ALL for i in range(n)])
                removed.append([PASS if i in before else FAIL if i == f else ALL for i in range(n)])
                failing.append([FAIL if i == f else ALL for i in range(n)])
                alone.append([FAIL if i == f else PASS for i in range(n)])
        self.kept, self.removed, self.failing, self.alone = (np.array(x, np.int64) for x in (kept, removed, failing, alone))

    def report(self, tensor: np.ndarray) -> dict[str, np.ndarray]:
        """The counts of every step, in the order of ``orders`` and within each of its steps."""
        removed, failing = contracted(tensor, self.removed), contracted(tensor[:1], self.failing)[0]
        return {
            "kept": contracted(tensor[:1], self.kept)[0],
            "removed": removed[0],
            "redundant": failing - removed[0],
            "unique_fails": contracted(tensor[:1], self.alone)[0],
            "good_lost": removed[1],
            "toxic_lost": removed[2],
            "shapley": np.array([removed[0][self.own == f].sum() for f in range(self.n)])[self.own],
        }


def audit(counts: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """One row per part, filter_order and step with the counts of ``Orders.report``, from counts by pattern."""
    n = len(letters)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        orders = Orders(n)
        tensor = np.zeros((len(COUNTED), 1 << n), np.int64)
        tensor[:, rows["fails"].to_numpy()] = rows[COUNTED].to_numpy(np.int64).T
        # bit i of a pattern is axis i: the last axis of a reshaped array varies fastest, so axes are turned around
        tensor = tensor.reshape(len(COUNTED), *[2] * n).transpose(0, *range(n, 0, -1))
        names = ["".join(letters[f] for f in order) for order in orders.orders]
        where = {"part": key[0], "filter_order": np.repeat(names, n), "step": np.tile(np.arange(1, n + 1, dtype=np.int32), len(names))}
        return pd.DataFrame(where | orders.report(tensor))

    fields = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return counts.groupBy("part").applyInPandas(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in fields))
