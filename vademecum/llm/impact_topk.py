"""Exact top-k inner products with an impact-ordered, score-at-a-time index.

Vectors are quantised to floor(256 * x). The rows are hashed into blocks of bounded size, and each block is an index of
its own: per dimension, the postings (row, component) in the order of falling magnitude, so that for any query weight
the impacts (weight times component) of a dimension fall along its run. A posting segment is the part of a dimension's
run between two impact levels. For a query, the segments of all dimensions are processed level by level, highest impacts
first, each moving its rows' bounds from the best that is possible to what their impacts really are.

With s the ratio of the lengths of query and rows, q.v = (|q|^2 / s + s |v|^2) / 2 - |q - s v|^2 / (2 s). A row's bound
starts with the first term, which needs its length only, and every posting met takes its own part of the second one off;
postings not met can only take more. The rows that lead so far are scored exactly, and the k-th best of them is a proven
floor: rows whose bound is below it are out. Processing stops only when that proves all but a
few rows out, or at impact 0, when everything is processed; only the rows that are still possible are then scored from
their full vectors. The result is exact, ties go to the smaller id.

Blocks and queries meet in one exchange: every query is sent to every block, a task builds a block's index once and
answers the queries one after the other; each block gives at most k rows per query, and the k best over all blocks are
taken by a window per query. Vectors that are null or empty, or hold a null or non-finite component, take no part; nor
do rows without an id; vectors of different lengths are never compared. Scores are 64-bit integers. Rows that repeat an
id are candidates each, but never of a query with that id. Extra columns are left behind. An empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of an index block, about.
INDEX_ROWS = 8192
#: Impact levels as shares of the block's highest impact for the query; at the last one all postings are processed.
LEVELS = (0.2, 0.1, 0.06, 0.04, 0.028, 0.02, 0.01, 0.0)
#: No more postings are processed once at most so many rows for each of the k wanted are still possible, and as many
#: leading rows are scored for the floor.
FEW, LEADING = 32, 3


class ImpactIndex:
    """The postings of one block: ids (ascending), integer vectors, and per dimension the rows by magnitude."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        size = np.abs(self.vectors).T
        by_size = np.argsort(-size, axis=1, kind="stable")
        self.rows = by_size.astype(np.int32).ravel()
        self.values = np.take_along_axis(self.vectors.T, by_size, axis=1).astype(np.float64).ravel()
        self.falling = -np.take_along_axis(size, by_size, axis=1)
        self.norms = (self.vectors.astype(np.float64) ** 2).sum(axis=1)

    def top(self, query: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Ids and scores of the k best rows whose id isn't ``query_id``; postings processed and rows rescored."""
        q = query.astype(np.float64)
        if np.sqrt(float(q @ q) * max(float(self.norms.max()), 1.0)) >= 2.0**62:
            return self.checked(query, query_id, k)
        left, postings = self.possible(query, query_id, k)
        scores = self.vectors[left] @ query
        best = np.lexsort((self.ids[left], -scores))[:k]
        return self.ids[left][best], scores[best], postings, len(left)

    def checked(self, query: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """``top`` where the lengths of the vectors don't prove that scores fit 64 bits: all scores as whole numbers of any
        size. One of the best that doesn't fit is an error."""
        open_ = np.flatnonzero(self.ids != query_id)
        scores = (self.vectors[open_].astype(object) @ query.astype(object)).tolist()
        best = sorted(range(len(open_)), key=lambda i: (-scores[i], self.ids[open_[i]]))[:k]
        if any(not -(2**63) <= scores[i] < 2**63 for i in best):
            raise OverflowError("a score doesn't fit 64 bits")
        return self.ids[open_[best]], np.array([scores[i] for i in best], np.int64), 0, len(open_)

    def possible(self, query: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, int]:
        """The rows other than ``query_id`` that the bounds can't prove out of the k best, and the postings processed."""
        n, dims = len(self.ids), len(self.falling)
        open_ = self.ids != query_id
        if n <= LEADING * k:
            return np.flatnonzero(open_), 0
        weight, q = np.abs(query), query.astype(np.float64)
        used = np.flatnonzero((weight > 0) & (self.falling[:, 0] < 0)).tolist()
        highest = int((weight * -self.falling[:, 0]).max())
        asked = float(q @ q)
        scale = np.sqrt(asked / max(float(np.median(self.norms)), 1.0)) or 1.0
        most = (asked / scale + scale * self.norms) / 2  # of q.v, by |q - scale * v| >= 0
        slack = 1e-9 * (most + most.max())  # more than the rounding of the sums
        done = np.zeros(dims, np.int64)
        left = np.flatnonzero(open_)
        for share in LEVELS:
            level = int(highest * share)
            rows, taken = [], []
            for d in used:
                upto = int(np.searchsorted(self.falling[d], -(level // int(weight[d])), side="left"))  # impact > level
                segment = slice(d * n + int(done[d]), d * n + upto)
                rows.append(self.rows[segment])
                taken.append((q[d] - scale * self.values[segment]) ** 2)
                done[d] = upto
            if rows:
                most -= np.bincount(np.concatenate(rows), np.concatenate(taken), n) / (2 * scale)
            lead = np.argpartition(np.where(open_, -most, np.inf), LEADING * k)[: LEADING * k]
            exact = np.sort(self.vectors[lead[open_[lead]]] @ query)
            if len(exact) >= k:
                left = np.flatnonzero(open_ & (most + slack >= exact[-k]))
            if len(left) <= FEW * k:
                break
        return left, int(done.sum())


def quantised(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """id and v (floor(256 * x) as array<long>) of the rows that take part; an entry beyond 64 bits is an error."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = df.where(F.col(vec_id).isNotNull() & (F.size(embedding) > 0) & ~bad)
    scaled = lambda x: x.cast("double") * 256
    too_large = F.raise_error(F.lit("an entry doesn't fit 64 bits")).cast("long")
    whole = F.transform(embedding, lambda x: F.when(F.abs(scaled(x)) >= F.lit(2.0**63), too_large).otherwise(F.floor(scaled(x)).cast("long")))
    return usable.select(F.col(vec_id).cast("long").alias("id"), whole.alias("v"))


def top_k(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows of ``corpus`` for every row of ``queries`` (both: id, v), and
    postings and rescored: what answering the query took in the block of the row.

    Rows with the query's own id are no candidates. A query without any candidate has no rows. Repeated queries are
    answered once each, with shared ranks.
    """
    blocks = max(1, -(-corpus.count() // INDEX_ROWS))
    left = corpus.select(F.size("v").alias("dims"), F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "v")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    right = queries.select("id", "v").dropDuplicates(["id", "v"]).select(F.size("v").alias("dims"), every, F.lit(1).alias("kind"), "id", "v")
    met = left.unionByName(right).repartition("dims", "block").sortWithinPartitions("dims", "block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, waiting, index = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            cuts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                if start == end:
                    continue
                own, kind = tuple(keys[start, :2].tolist()), keys[start, 2]
                part = batch.slice(start, end - start)
                ids = part.column(3).to_numpy()
                vectors = part.column(4).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                if own != block:
                    block, waiting, index = own, [], None
                if kind == 0:
                    waiting.append((ids, vectors))
                    continue
                if waiting:
                    index = ImpactIndex(*(np.concatenate(c) for c in zip(*waiting, strict=True)))
                    waiting = []
                if index is None:
                    continue
                found = [index.top(q, int(i), k) for i, q in zip(ids, vectors, strict=True)]
                sizes = [len(f[0]) for f in found]
                columns = [np.repeat(ids, sizes), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])]
                columns += [np.repeat([f[i] for f in found], sizes).astype(np.int64) for i in (2, 3)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score", "postings", "rescored"])

    found = met.mapInArrow(run, "query_id long, vec_id long, score long, postings long, rescored long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score", "postings", "rescored")
