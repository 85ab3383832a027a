"""Vectors as array<float> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(v: Column, dim: int) -> Column:
    """Exactly ``dim`` finite numbers, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(v: Column, query: list[float]) -> Column:
    """1 - cosine similarity to a constant vector, in double precision."""
    q = [float(x) for x in query]
    norm = sum(x * x for x in q) ** 0.5
    qc = F.array(*[F.lit(x / norm) for x in q])
    return 1 - dot(v, qc) / F.sqrt(dot(v, v))
