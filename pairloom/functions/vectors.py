"""Element-wise expressions on ARRAY columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalise(v: Column, eps: float = 1e-12) -> Column:
    """Scale to unit length; a zero vector stays zero."""
    norm = F.greatest(l2_norm(v), F.lit(eps))
    # Beside the elements, not inside the lambda, where each element would ask for it anew.
    return F.zip_with(as_double(v), F.array_repeat(norm, F.size(v)), lambda x, n: x / n)


def l2_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def residual(x: Column, origin: Column, alpha: float = 10.0) -> Column:
    """``x + alpha * origin``, element by element."""
    return F.zip_with(as_double(x), as_double(origin), lambda a, b: a + F.lit(float(alpha)) * b)


def rounded(v: Column, digits: int) -> Column:
    return F.transform(v, lambda x: F.round(x, digits))
