"""Vector functions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalise(a: Column, n: Column) -> Column:
    """Unit vector of ``a``, whose :func:`norm` is the column ``n``; the zero vector stays as it is.

    The norm is asked for as a column made in a step before, so that it is
    computed once a vector and not once a component.
    """
    return F.transform(a, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n))


def sparse_dot(a: Column, b: Column) -> Column:
    """Inner product of two term-to-weight maps over their shared terms."""
    return F.aggregate(F.array_intersect(F.map_keys(a), F.map_keys(b)), F.lit(0.0), lambda s, k: s + F.element_at(a, k) * F.element_at(b, k))


def relu(c: Column) -> Column:
    """An activation without its negative part."""
    return F.greatest(F.lit(0.0), c)
