"""Vector expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(vector: Column, dim: int | None = None) -> Column:
    """The first ``dim`` components scaled to length one; a zero vector stays."""
    cut = F.slice(vector, 1, dim) if dim else vector
    # an array of one length, so that the components don't work it out anew each
    scaled = F.transform(F.array(F.sqrt(dot(cut, cut))), lambda length: F.transform(cut, lambda x: x.cast("double") / F.when(length == 0, 1.0).otherwise(length)))
    return F.get(scaled, F.lit(0))


def hash_vector(text: Column, dim: int = 32) -> Column:
    """A deterministic stand-in for an embedding model: the bytes of the text's SHA-256, scaled to length one."""
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    byte = lambda i: F.conv(F.substring(digest, 2 * (i % 32) + 1, F.lit(2)), 16, 10).cast("double")
    return normalized(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), byte))
