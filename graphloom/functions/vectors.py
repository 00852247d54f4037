"""Expressions over vectors (arrays of numbers), computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, d: s + d * d))


def normalised(v: Column, least: float = 1e-9) -> Column:
    """``v`` over its length; as it is where the length is ``least`` or less."""
    norm = F.sqrt(squared_norm(v))
    return F.transform(v, lambda x: F.when(norm > least, x.cast("double") / norm).otherwise(x.cast("double")))
