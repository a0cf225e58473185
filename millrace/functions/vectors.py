"""Vectors as ``array<double>`` columns, and other numeric columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    """A vector for arithmetic: single precision is widened before anything is computed."""
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def checked(a: Column, b: Column, value: Column) -> Column:
    """``value``, or an error where the vectors differ in width."""
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors of unequal width")).cast("double"))


def dot(a: Column, b: Column) -> Column:
    return checked(a, b, total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y)))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(doubles(v), lambda x: x * x)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(checked(a, b, total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity, 0 where either vector is zero; norms may come from where they are computed once."""
    na, nb = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def normalized(v: Column) -> Column:
    """The vector over its norm; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(doubles(v), lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))


def linspace(i: Column, start: float | Column, stop: float | Column, n: int) -> Column:
    """The ``i``-th of ``n`` evenly spaced numbers, both ends included; the last is exact."""
    if n < 1:
        raise ValueError("n must be positive")
    a, b = (x if isinstance(x, Column) else F.lit(float(x)) for x in (start, stop))
    if n == 1:
        return a
    return F.when(i == n - 1, b).otherwise(i.cast("double") * ((b - a) / F.lit(float(n - 1))) + a)


def parabola(x: Column) -> Column:
    """(x - 3)^2"""
    return (x - 3.0) * (x - 3.0)


def parabola_slope(x: Column) -> Column:
    return (x - 3.0) * 2.0


def bowl(x: Column, y: Column) -> Column:
    """x^2 + 5 y^2"""
    return x * x + y * y * 5.0


def bowl_slope(x: Column, y: Column) -> tuple[Column, Column]:
    return x * 2.0, y * 10.0
