"""Whitening of embeddings with distributed block matrices.

Vectors become whole numbers, distinct ones are the list that the covariance is fitted on, and the rows less their mean are
indexed into a ``BlockMatrix`` of Spark's MLlib. The transposed matrix times the matrix is the scatter, summed over the
middle dimension in as many parts as there are tasks, so that no task sees more than its blocks; it is as large as the
dimension squared and is decomposed locally. A second block product, of all rows with the scaled eigenvectors, projects
them. Rows stay in the JVM throughout: no Python worker touches them.

Rows get places in a written table (a number per partition and row, plus the counts of the partitions before it), and
copies of a vector share the fate of the row with the first place: nothing joins rows by their vectors, so a vector with a
third of all rows is grouped by map-side minima only.

Defined results: null vectors and those holding null or non-finite entries are left out, and so are vectors whose
length isn't the most frequent one (of equally frequent lengths the longest) and empty ones. Values outside 64 bits after
scaling, and sums outside them, raise an arithmetic error. A row without an id keeps its null id; repeated rows are
answered each. Components without variance (constant columns, a single vector) have no direction to scale: ``whitened`` is
null and ``explained`` is 0, and they take no part in ``identity_error``, which is 0 if none is left. With fewer than
four dimensions there are as many components. A table without usable rows has no result rows. Other columns are not read.

Limits: the driver holds matrices of the dimension squared and, while it plans a product, the number of each block, of
``BLOCK_ROWS`` rows or of as many more as keep the blocks below ``MOST_BLOCKS``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vademecum.llm.shared import written

BLOCK_ROWS, MOST_BLOCKS = 1024, 100_000
#: A component whose variance is below this share of the largest has none, up to rounding.
NO_VARIANCE = 1e-12


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * entry) of every entry, as 64-bit numbers; beyond them an error."""
    scaled = lambda c: F.lit(float(scale)) * c.cast("double")
    too_large = lambda c: F.abs(scaled(c)) >= F.lit(2.0**63)
    return F.transform(vector, lambda c: F.when(too_large(c), F.raise_error(F.lit("an entry doesn't fit 64 bits")).cast("long")).otherwise(F.floor(scaled(c))))


def usable(vector: Column) -> Column:
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite)


def placed(rows: DataFrame) -> DataFrame:
    """Written rows with ``place``, their 0-based number."""
    own = written(rows.withColumn("row", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("row", 33).cast("int")
    counts = own.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # a row per partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "parts")
    inside = F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
    return own.withColumn("part", part).join(counts, "part").withColumn("place", F.col("base") + inside).drop("part", "row", "base")


def block_matrix(rows: DataFrame, values: Column, n_rows: int, n_columns: int, block_rows: int, block_columns: int) -> BlockMatrix:
    """Rows (place, and an array of doubles) as a block matrix; places that no row has are rows of zeros."""
    indexed = rows.select(F.col("place").cast("long").alias("index"), array_to_vector(values).alias("vector"))
    indexed = MLUtils.convertVectorColumnsFromML(indexed, "vector")
    return IndexedRowMatrix(indexed, n_rows, n_columns).toBlockMatrix(block_rows, block_columns)


def product(left: BlockMatrix, right: BlockMatrix, parts: int = 1) -> BlockMatrix:
    """left * right, the middle dimension cut into ``parts`` so that a small result is summed from many tasks."""
    java = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, parts)
    return BlockMatrix(java, left.rowsPerBlock, right.colsPerBlock)


def rows_of(matrix: BlockMatrix) -> DataFrame:
    """place and values (an array) of a block matrix, without leaving the JVM."""
    found = callMLlibFunc("getIndexedRows", matrix.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return found.select(F.col("index").alias("place"), vector_to_array("vector").alias("values"))


@dataclass
class Whitening:
    """The fitted list's size, sums and covariance, its eigenvalues by falling size and eigenvectors as columns."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    def scaled(self, components: int) -> np.ndarray:
        """Eigenvectors over the roots of their eigenvalues; zeros for those without variance."""
        e = self.values[:components]
        live = e > NO_VARIANCE * max(self.values[0], 0.0)
        return np.where(live, self.vectors[:, :components] / np.sqrt(np.where(live, e, 1.0)), 0.0)

    def explained(self, components: int) -> list[float]:
        trace = float(np.trace(self.covariance))
        e = self.values[:components]
        return [float(x / trace) if x > NO_VARIANCE * max(self.values[0], 0.0) else 0.0 for x in e]


def whiten(table: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 4) -> DataFrame:
    """key, n, deviation, identity_error, and component, whitened and explained of every component and usable row."""
    spark = table.sparkSession
    raw = table.select(F.col(key).alias("id"), F.col(vector).alias("v")).where(usable(F.col("v")))
    common = raw.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("d", F.struct("n", "d"))).first()[0]
    schema = f"`{key}` {table.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if common is None:
        return spark.createDataFrame([], schema)
    d, m = common, min(components, common)
    rows = placed(raw.where(F.size("v") == d).select("id", whole_numbers(F.col("v")).alias("x")))
    total = rows.count()
    fitted = written(rows.groupBy("x").agg(F.min("place").alias("place")), "fitted")
    sums = fitted.agg(F.count(F.lit(1)), *[F.sum(F.get("x", F.lit(i))) for i in range(d)]).first()
    n, sums = sums[0], list(sums[1:])
    block_rows, block_columns = max(BLOCK_ROWS, -(-total // MOST_BLOCKS)), min(d, 1024)
    mean, exact_sums = F.array(*[F.lit(s / n) for s in sums]), F.array(*[F.lit(s).cast("long") for s in sums])
    centred = F.zip_with("x", mean, lambda x, u: x.cast("double") - u)
    blocks = block_matrix(fitted, centred, total, d, block_rows, block_columns).persist(StorageLevel.MEMORY_AND_DISK)
    parts = max(1, min(-(-total // block_rows), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    scatter = product(blocks.transpose(), blocks, parts).toLocalMatrix().toArray()
    blocks._java_matrix_wrapper._java_model.blocks().unpersist(False)
    covariance = (scatter + scatter.T) / (2 * n)
    values, vectors = np.linalg.eigh(covariance)
    fit = Whitening(n, sums, covariance, values[::-1], vectors[:, ::-1])
    scaled, explained = fit.scaled(m), fit.explained(m)
    small = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(scaled)], "place long, w array<double>")
    projected = product(block_matrix(rows, centred, total, d, block_rows, block_columns), block_matrix(small, F.col("w"), d, m, block_columns, m))
    projected = written(rows_of(projected), "projected")
    error = identity_error(projected.join(fitted.select("place"), "place"), [i for i in range(m) if explained[i] > 0])
    deviation = F.aggregate(F.zip_with("x", exact_sums, lambda x, s: F.lit(n).cast("long") * x - s), F.lit(0).cast("long"), lambda a, y: a + y * y)
    shares = F.array(*[F.lit(x) for x in explained])
    out = rows.select("id", "place", deviation.alias("deviation")).join(projected, "place").select("id", "deviation", F.posexplode("values").alias("c", "w"))
    share = F.get(shares, F.col("c"))
    return out.select(F.col("id").alias(key), (F.col("c") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.when(share > 0, F.col("w")).alias("whitened"), share.alias("explained"), F.lit(error).alias("identity_error"))


def identity_error(projected: DataFrame, live: list[int]) -> float:
    """The largest absolute entry of the covariance of the projected fitted rows less the identity."""
    if not live:
        return 0.0
    at = lambda i: F.get("values", F.lit(i))
    means = projected.agg(*[F.avg(at(i)) for i in live]).first()
    pairs = [(a, b) for a in range(len(live)) for b in range(a + 1)]
    found = projected.agg(*[F.avg((at(live[a]) - F.lit(means[a])) * (at(live[b]) - F.lit(means[b]))) for a, b in pairs]).first()
    return max(abs(value - (a == b)) for value, (a, b) in zip(found, pairs, strict=True))
