"""Scalar functions of columns, and functions registered for SQL."""

from .numeric import abs_sub, binomial, clamp, clamped_int, factorial, finite, near_zero, sign_bit, signum
from .sql import register

__all__ = ["abs_sub", "binomial", "clamp", "clamped_int", "factorial", "finite", "near_zero", "register", "sign_bit", "signum"]
