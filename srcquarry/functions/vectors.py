"""Vector distances as expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where a vector is null, of another length or zero."""
    d = dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (dot(a, a) > 0) & (dot(b, b) > 0), 1.0 - d)


def distance_to(a: Column, vector: Sequence[float]) -> Column:
    """Distance to a given vector: a literal, so that ranking needs no join."""
    return cosine_distance(a, F.array(*[F.lit(float(v)) for v in vector]))


def similarity(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - distance)
