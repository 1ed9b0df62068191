"""Vector arithmetic and index sampling over array columns, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_FLOOR = 1e-8


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_norm(v: Column) -> Column:
    return F.sqrt(_total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def l2_normalize(v: Column, norm: Column | None = None, floor: float = NORM_FLOOR) -> Column:
    """Divide by the norm, which is clamped from below so that a zero vector stays zero."""
    length = F.greatest(l2_norm(v) if norm is None else norm, F.lit(floor))
    return F.transform(v, lambda x: x.cast("double") / length)


def vector_error(a: Column, b: Column, kind: str = "l1") -> Column:
    """Mean absolute (``l1``) or mean squared (``l2``) difference over the dimensions."""
    if kind not in ("l1", "l2"):
        raise ValueError("kind is 'l1' or 'l2'")
    diff = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    parts = F.transform(diff, F.abs if kind == "l1" else (lambda d: d * d))
    return _total(parts) / F.size(a)


def _positions(k: int) -> Column:
    return F.sequence(F.lit(0), F.lit(k - 1))


def uniform_trunc(n: Column, k: int) -> Column:
    """k indices spread over 0..n-1, truncated; all indices when n <= k."""
    n = n.cast("int")
    step = (lambda i: F.lit(0)) if k == 1 else (lambda i: F.floor(i * (n - 1) / F.lit(k - 1)).cast("int"))
    return (
        F.when(n <= 0, F.array().cast("array<int>"))
        .when(n <= k, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1))
        .otherwise(F.transform(_positions(k), step))
    )


def uniform_interior(start: Column, end: Column, k: int) -> Column:
    """k indices strictly inside the half-open span; the whole span when it is no longer than k."""
    start, end = start.cast("int"), end.cast("int")
    span = end - start
    step = span / F.lit(float(k + 1))
    return (
        F.when(span <= 0, F.array().cast("array<int>"))
        .when(span <= k, F.sequence(start, F.greatest(end - 1, start)))
        .otherwise(F.transform(_positions(k), lambda i: start + (step * (i + 1)).cast("int")))
    )


def uniform_round(n: Column, k: int, k1: str = "first") -> Column:
    """k indices rounded half to even, duplicates removed; k = 1 takes the first or the middle index."""
    n = n.cast("int")
    if k == 1:
        spread = F.array(F.lit(0) if k1 == "first" else F.floor(n / 2).cast("int"))
    else:
        spread = F.array_distinct(
            F.transform(_positions(k), lambda i: F.bround(i * (n - 1) / F.lit(k - 1)).cast("int"))
        )
    return (
        F.when(n <= 0, F.array().cast("array<int>"))
        .when(n <= k, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1))
        .otherwise(spread)
    )


def take_positions(values: Column, positions: Column) -> Column:
    """Elements of ``values`` at the zero-based ``positions``."""
    return F.transform(positions, lambda p: F.get(values, p))
