"""Exact filtered search by inner product over blocks of vectors, with blocks that are proven out left unread.

Hard filters (a section, membership of a species) are masks within a block, so the corpus is never copied for them.

A corpus of many blocks is indexed by clusters: rows go to the nearest of some centroids, and a cluster is known by its
centroid c and radius r. No row v of it scores more than q.c + |q| r for a query q (Cauchy and Schwarz on v - c). A query
visits its most promising clusters first; with the k-th score that it finds there, all clusters whose bound is below it
are left out, and only the rest are visited in a second round. What is left out can't hold a better row, whatever the
filters: a query whose filters leave it fewer than k rows in the first round visits every cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vademecum.sources.tables import rewritten, scratch

#: Rows of a block, about; queries that meet it at once; clusters at most, and sampled rows for each to find centroids.
BLOCK_ROWS, QUERY_ROWS, MOST_CLUSTERS, SAMPLED = 8192, 256, 1024, 8
#: Blocks from which on a corpus is indexed, and clusters that a query visits in the first round.
INDEXED_BLOCKS, FIRST = 8, 2


def matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


class _Held:
    """The rows of a block, and masks of the filters that were asked for."""

    def __init__(self) -> None:
        self.parts: list[pa.RecordBatch] = []
        self.masks: dict[tuple, np.ndarray] = {}
        self.vectors: np.ndarray | None = None

    def close(self) -> None:
        if self.vectors is None:
            column = lambda i: [x for p in self.parts for x in p.column(i).to_pylist()]
            self.vectors = np.concatenate([matrix(p.column(4)) for p in self.parts])
            self.keys, self.sections, self.species = np.array(column(3), object), np.array(column(5), object), column(6)
            self.place = np.argsort(np.argsort(self.keys, kind="stable"))
            self.parts = []

    def mask(self, section: str | None, species: tuple | None) -> np.ndarray:
        key = (section, species)
        if key not in self.masks:
            keep = np.ones(len(self.keys), bool) if section is None else self.sections == section
            if species is not None:
                keep = keep & np.array([s is not None and species[0] in s for s in self.species], bool)
            self.masks[key] = keep
        return self.masks[key]

    def best(self, rows: pa.RecordBatch, k: int, digits: int) -> pa.RecordBatch:
        """The k best rows of every query of a batch that meet its filters."""
        self.close()
        ids, score = rows.column(2).to_numpy(), np.round(matrix(rows.column(4)) @ self.vectors.T, digits)
        out: list[tuple] = []
        wants = zip(rows.column(5).to_pylist(), rows.column(6).to_pylist(), strict=True)
        for i, (section, species) in enumerate(wants):
            at = np.flatnonzero(self.mask(section, tuple(species) if species is not None else None))
            own = score[i, at]
            if len(at) > 4 * k:  # all that reach the k-th score, ties included
                least = -np.partition(-own, k - 1)[k - 1]
                at = at[own >= least]
                own = score[i, at]
            first = np.lexsort((self.place[at], -own))[:k]
            out.append((np.repeat(ids[i], len(first)), self.keys[at[first]], own[first]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], pa.string()), pa.array(columns[2])], ["query_id", "logical_key", "score"])


def _asked(queries: DataFrame) -> DataFrame:
    """query_id, query_vector, want_section and want_species (null: any), as types that blocks understand."""
    want = lambda c: (F.col(c) if c in queries.columns else F.lit(None)).cast("string")
    species = want("want_species")
    return queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("query_vector").cast("array<double>").alias("query_vector"), want("want_section").alias("want_section"), F.when(species.isNotNull(), F.array(species)).alias("want_species"))


def _rows(corpus: DataFrame) -> DataFrame:
    has = lambda c, kind: (F.col(c) if c in corpus.columns else F.lit(None)).cast(kind).alias(c)
    return corpus.select("logical_key", F.col("vector").cast("array<double>").alias("vector"), has("section_type", "string"), has("species", "array<string>"))


def _visited(rows: DataFrame, asked: DataFrame, k: int, digits: int) -> DataFrame:
    """query_id, logical_key and score of the k best rows per query and block, of rows and queries that have ``block``."""
    none = lambda kind: F.lit(None).cast(kind)
    left = rows.select("block", F.lit(0).alias("kind"), none("bigint").alias("id"), F.col("logical_key").alias("key"), "vector", F.col("section_type").alias("section"), "species")
    right = asked.select("block", F.lit(1).alias("kind"), F.col("query_id").alias("id"), none("string").alias("key"), F.col("query_vector").alias("vector"), F.col("want_section").alias("section"), F.col("want_species").alias("species"))
    met = left.unionByName(right).repartition("block").sortWithinPartitions("block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, _Held()
        for batch in batches:
            marks = np.stack([batch.column(i).to_numpy() for i in range(2)])
            cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if start == end:
                    continue
                (block, kind), part = marks[:, start].tolist(), batch.slice(start, end - start)
                if block != at:
                    at, held = block, _Held()
                if kind == 0:
                    held.parts.append(part)
                elif held.parts or held.vectors is not None:
                    for first in range(0, part.num_rows, QUERY_ROWS):
                        yield held.best(part.slice(first, QUERY_ROWS), k, digits)

    return met.mapInArrow(run, "query_id bigint, logical_key string, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "logical_key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class ClusterIndex:
    """Rows by nearest centroid, written by cluster. What the driver and every task know of the clusters is bounded by
    MOST_CLUSTERS: centroid, radius and number of rows."""

    def __init__(self, corpus: DataFrame, clusters: int | None = None) -> None:
        rows, self.spark = _rows(corpus), corpus.sparkSession
        n = rows.count()
        wanted = max(1, min(MOST_CLUSTERS, clusters or -(-n // BLOCK_ROWS)))
        share = min(1.0, SAMPLED * wanted / max(1, n))
        some = rows.where(F.pmod(F.xxhash64("logical_key"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))
        self.centroids = _centroids(np.array([r[0] for r in some.select("vector").sort(F.xxhash64("logical_key")).limit(2 * SAMPLED * wanted).collect()], float), wanted)
        shared = self.spark.sparkContext.broadcast(self.centroids)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = shared.value
            for batch in batches:
                v = matrix(batch.column(1))
                cell = np.argmax(v @ c.T - (c * c).sum(axis=1) / 2, axis=1)
                far = np.sqrt(((v - c[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far)], [*batch.schema.names, "cell", "far"])

        schema = "logical_key string, vector array<double>, section_type string, species array<string>, cell int, far double"
        self.path, self.schema = scratch(self.spark, "clusters"), schema
        rows.mapInArrow(assign, schema).repartition("cell", F.pmod(F.xxhash64("logical_key"), F.lit(max(1, -(-n // (BLOCK_ROWS * wanted)))))).write.partitionBy("cell").parquet(self.path)
        known = {r["cell"]: r for r in self._table().groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("r")).collect()}
        self.sizes = np.array([known[i]["n"] if i in known else 0 for i in range(len(self.centroids))], np.int64)
        self.radii = np.array([known[i]["r"] if i in known else 0.0 for i in range(len(self.centroids))])

    def _table(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def _blocks(self) -> np.ndarray:
        """Of every cluster its number of blocks."""
        return np.maximum(1, -(-self.sizes // BLOCK_ROWS))

    def _pairs(self, asked: DataFrame, digits: int) -> DataFrame:
        """Per query and cluster with rows: the bound of its scores, and the cluster's place by bound from 0."""
        shared = self.spark.sparkContext.broadcast((self.centroids, self.radii, np.flatnonzero(self.sizes)))
        slack = 10.0**-digits

        def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c, r, live = shared.value
            for batch in batches if len(live) else ():
                for first in range(0, batch.num_rows, QUERY_ROWS):
                    part = batch.slice(first, QUERY_ROWS)
                    q = matrix(part.column(1))
                    bound = q @ c[live].T + np.linalg.norm(q, axis=1)[:, None] * r[live]
                    bound += slack + 1e-9 * np.abs(bound).max(initial=0.0)
                    order = np.argsort(np.argsort(-bound, axis=1, kind="stable"), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), len(live))), pa.array(np.tile(live, len(q)).astype(np.int32)), pa.array(bound.ravel()), pa.array(order.ravel().astype(np.int32))], ["query_id", "cell", "bound", "place"])

        return asked.select("query_id", "query_vector").mapInArrow(bounds, "query_id bigint, cell int, bound double, place int")

    def _visit(self, pairs: DataFrame, asked: DataFrame, k: int, digits: int) -> DataFrame:
        """The best rows of the clusters of ``pairs`` (query_id, cell); only these clusters are read."""
        cells = sorted(r["cell"] for r in pairs.select("cell").distinct().collect())  # at most MOST_CLUSTERS
        counts = F.array(*[F.lit(int(b)) for b in self._blocks()])
        most = F.lit(int(self._blocks().max(initial=1)))
        own = F.get(counts, F.col("cell"))
        rows = self._table().where(F.col("cell").isin(cells)).withColumn("block", (F.col("cell") * most + F.pmod(F.xxhash64("logical_key"), own)).cast("int"))
        each = pairs.select("query_id", F.explode(F.transform(F.sequence(F.lit(0), own - 1), lambda s: (F.col("cell") * most + s).cast("int"))).alias("block"))
        return _visited(rows, each.join(asked, "query_id"), k, digits)

    def search(self, queries: DataFrame, k: int, digits: int = 6) -> tuple[DataFrame, DataFrame]:
        """The k best rows (query_id, logical_key, score, rank), and the (query_id, cell) pairs that were visited."""
        asked = _asked(queries)
        pairs = rewritten(self._pairs(asked, digits), "bounds")
        first = pairs.where(F.col("place") < FIRST)
        found = rewritten(self._visit(first, asked, k, digits), "first")
        floor = _top(found, k).groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("floor"))
        rest = pairs.where(F.col("place") >= FIRST).join(floor, "query_id", "left").where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor")))
        rest = rewritten(rest.select("query_id", "cell"), "rest")
        visited = first.select("query_id", "cell").unionByName(rest)
        if not rest.isEmpty():
            found = found.unionByName(self._visit(rest, asked, k, digits))
        return _top(found, k), visited


def _centroids(sample: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """``n`` centroids at most of sampled vectors by a few rounds of nearest means; any centroids give right results."""
    if not len(sample):
        return np.zeros((1, 1))
    c = np.unique(sample, axis=0)
    c = c[:: max(1, len(c) // n)][:n]
    for _ in range(rounds):
        cell = np.argmax(sample @ c.T - (c * c).sum(axis=1) / 2, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, cell, sample)
        size = np.bincount(cell, minlength=len(c))
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
    return c


def filtered_top_k(queries: DataFrame, corpus: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """query_id, logical_key, score and rank of the k best rows for queries (query_id, query_vector, and if they filter
    want_section, want_species) in a corpus (logical_key, vector, section_type, species). Best score first, then key.

    Few blocks are met by all queries at once; from INDEXED_BLOCKS on they are indexed first, which pays for itself.
    """
    blocks = max(1, -(-corpus.count() // BLOCK_ROWS))
    if blocks >= INDEXED_BLOCKS:
        return ClusterIndex(corpus).search(queries, k, digits)[0]
    rows = _rows(corpus).withColumn("block", F.pmod(F.xxhash64("logical_key"), F.lit(blocks)).cast("int"))
    asked = _asked(queries).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return _top(_visited(rows, asked, k, digits), k)
