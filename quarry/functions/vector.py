"""Vector similarity as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, added from left to right; the cosine of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of any two vectors; null if one is zero or of another length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def normalized(a: Column) -> Column:
    """``a`` at length one; the zero vector stays."""
    norm = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: (x / F.when(norm > 0, norm).otherwise(1.0)).cast("float"))
