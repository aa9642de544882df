"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(x: Column, y: Column) -> Column:
    products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def unit(v: Column) -> Column:
    """The vector at unit length; null for a null, empty or zero vector."""
    halves = F.array(F.struct(v.alias("v"), F.sqrt(_dot(v, v)).alias("n")))
    scaled = F.transform(halves, lambda s: F.when(s["n"] > 0, F.transform(s["v"], lambda x: x.cast("double") / s["n"])))
    return F.when(F.size(v) > 0, scaled[0])


def unit_dot(a: Column, b: Column) -> Column:
    """Cosine similarity of two vectors of unit length; 0 where one is null or the lengths differ."""
    return F.coalesce(F.when(F.size(a) == F.size(b), _dot(a, b)), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for unequal or zero length and for zero norms."""
    return unit_dot(unit(a), unit(b))
