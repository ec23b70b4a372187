"""Column expressions on vectors (arrays of float), in double arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def view(v: Column, start: int, length: int) -> Column:
    """A part of a vector, from 1."""
    return F.slice(v, start, length)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def _with(v: Column, value: Column, make) -> Column:
    """``make(v, value)``, where ``value`` is computed once and not for each element of ``v``: it
    goes through a list of one struct, whose fields a lambda reads."""
    once = F.array(F.struct(v.alias("v"), value.alias("x")))
    return F.get(F.transform(once, lambda s: make(s["v"], s["x"])), F.lit(0))


def normalized(v: Column) -> Column:
    """A vector of length one; null for a vector of length zero."""
    return _with(doubles(v), F.sqrt(dot(v, v)), lambda v, norm: F.when(norm > 0, F.transform(v, lambda x: x / norm)))


def softmax(v: Column, scale: float = 1.0) -> Column:
    """Shifted by the largest value, so large scales do not overflow."""
    powers = _with(doubles(v), F.array_max(doubles(v)), lambda v, most: F.transform(v, lambda x: F.exp((x - most) * F.lit(scale))))
    return _with(powers, total(powers), lambda v, s: F.transform(v, lambda x: x / s))
