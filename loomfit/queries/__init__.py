"""Registered queries over the given tables, each with DuckDB SQL where SQL can say it."""

from . import calculus, columns, fits, statistics
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "calculus", "columns", "fits", "statistics"]
