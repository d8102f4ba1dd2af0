"""Dense-vector expressions on ``array<float|double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double_array(col: Column) -> Column:
    return F.transform(col, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Sequential double-precision dot product (cosine for unit vectors)."""
    prods = F.zip_with(as_double_array(a), as_double_array(b), lambda x, y: x * y)
    return F.aggregate(prods, F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))


def literal_vector(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])
