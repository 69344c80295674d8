"""Scalar functions of columns; all stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16


def finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def near_zero(c: Column, eps: float = EPSILON) -> Column:
    return F.abs(c) < F.lit(eps)


def sign_bit(c: Column) -> Column:
    """True for negative numbers and for minus zero."""
    return (c < 0) | ((c == 0) & c.cast("double").cast("string").startswith("-"))


def signum(c: Column) -> Column:
    """1 or -1 by the sign bit, so plus zero gives 1; NaN stays."""
    return F.when(F.isnan(c), c).when(sign_bit(c), F.lit(-1.0)).when(c.isNotNull(), F.lit(1.0))


def abs_sub(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def clamp(c: Column, lo, hi) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.when(c.isNotNull(), F.greatest(lit(lo), F.least(lit(hi), c)))


def clamped_int(c: Column, lo: int = -(2**31), hi: int = 2**31 - 1) -> Column:
    """Cast that saturates at the ends; NaN becomes 0."""
    return F.when(F.isnan(c), F.lit(0).cast("long")).otherwise(F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c)).cast("long"))


def factorial(n: Column) -> Column:
    """As a double, by the product; null for negative n."""
    return F.when(n >= 0, F.aggregate(F.sequence(F.lit(0), n.cast("int")), F.lit(1.0), lambda acc, i: acc * F.greatest(i, F.lit(1)).cast("double")))


def binomial(n: Column, k: Column) -> Column:
    """n over k as a double; 0 outside 0..n."""
    steps = F.sequence(F.lit(0), F.greatest(k, F.lit(0)).cast("int"))
    value = F.aggregate(steps, F.lit(1.0), lambda acc, i: F.when(i == 0, acc).otherwise(acc * (n - k + i).cast("double") / F.greatest(i, F.lit(1)).cast("double")))
    return F.when((k < 0) | (k > n), F.lit(0.0)).when(k.isNotNull() & n.isNotNull(), F.round(value))
