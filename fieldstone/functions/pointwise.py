"""Algebra of small vectors and matrices held in array columns, all inside generated code.

A vector is array<double>, a matrix array<array<double>> by rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, a: s + a)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda p, q: p * q))


def inner(a: Column, b: Column) -> Column:
    """Full contraction of two matrices."""
    return total(F.zip_with(a, b, dot))


def norm2(a: Column) -> Column:
    return dot(a, a)


def matvec(a: Column, x: Column) -> Column:
    return F.transform(a, lambda row: dot(row, x))


def transpose(a: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(F.element_at(a, 1))), lambda j: F.transform(a, lambda row: F.element_at(row, j.cast("int"))))


nabla_grad = transpose


def trace(a: Column) -> Column:
    return total(F.transform(a, lambda row, i: F.element_at(row, (i + 1).cast("int"))))


div = trace


def _half_sum(a: Column, sign: float) -> Column:
    return F.zip_with(a, transpose(a), lambda r, c: F.zip_with(r, c, lambda p, q: (p + sign * q) / 2))


def sym(a: Column) -> Column:
    return _half_sum(a, 1.0)


def skew(a: Column) -> Column:
    return _half_sum(a, -1.0)


def identity(n: int) -> Column:
    return F.array(*[F.array(*[F.lit(1.0 if i == j else 0.0) for j in range(n)]) for i in range(n)])


def outer(a: Column, b: Column) -> Column:
    return F.transform(a, lambda p: F.transform(b, lambda q: p * q))


def cross(a: Column, b: Column) -> Column:
    at = lambda v, k: F.element_at(v, k % 3 + 1)
    return F.array(*[at(a, k + 1) * at(b, k + 2) - at(a, k + 2) * at(b, k + 1) for k in range(3)])


def jump(minus: Column, plus: Column) -> Column:
    return minus - plus


def avg(minus: Column, plus: Column) -> Column:
    return (minus + plus) / 2


def jump_grad(minus: Column, plus: Column) -> Column:
    return F.zip_with(minus, plus, lambda a, b: a - b)


def avg_grad(minus: Column, plus: Column) -> Column:
    return F.zip_with(minus, plus, lambda a, b: (a + b) / 2)
