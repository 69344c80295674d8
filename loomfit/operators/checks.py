"""Quality checks of fits: rows (check, value, threshold, passed)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.calculus import check_derivative, monotonicity_violations
from ..plans.model import Curve
from . import stats
from .fit import Fit
from .predict import residuals_filtered

SCHEMA = "check string, value double, threshold double, passed boolean"


class Checks:
    """Collects checks; ``rows`` gives them as a DataFrame, ``require`` raises if one failed."""

    def __init__(self, f: Fit):
        self.f, self.out = f, []

    def _add(self, name: str, value: float, threshold: float, passed: bool) -> Checks:
        self.out.append((name, None if value is None or math.isnan(value) else float(value), float(threshold), bool(passed)))
        return self

    def _metrics(self):
        if not hasattr(self, "_m"):
            self._m = stats.residual_metrics(self.f.points(), F.col("_y"), self.f.curve.column(F.col("_x")), self.f.k).first()
        return self._m

    def r_squared(self, least: float = 0.9) -> Checks:
        v = self._metrics()["r_squared"]
        return self._add("r_squared", v, least, v is not None and v > least)

    def adjusted_r_squared(self, least: float = 0.9) -> Checks:
        v = self._metrics()["adjusted_r_squared"]
        return self._add("adjusted_r_squared", v, least, v is not None and v > least)

    def robust_r_squared(self, least: float = 0.9) -> Checks:
        v = stats.robust_metrics(self.f.points(), F.col("_y") - self.f.curve.column(F.col("_x")))["robust_r_squared"]
        return self._add("robust_r_squared", v, least, v > least)

    def matches(self, truth: Curve, least: float = 0.9) -> Checks:
        """R squared of the fit against a known curve at the training x."""
        x = F.col("_x")
        v = stats.residual_metrics(self.f.points(), truth.column(x), self.f.curve.column(x), self.f.k).first()["r_squared"]
        return self._add("matches", v, least, v is not None and v >= least)

    def residuals_normal(self, least: float = 0.1, strict: bool = False) -> Checks:
        if strict:
            v = self._metrics()["normality"]
        else:
            r = residuals_filtered(self.f).agg(stats.skewness(F.col("residual")).alias("s"), stats.kurtosis(F.col("residual")).alias("k"), F.count("*").alias("n"))
            v = r.select(stats.normality(F.col("s"), F.col("k"), F.col("n"))).first()[0]
        return self._add("residuals_normal", v, least, v >= least)

    def max_residual(self, most: float, share: float = 0.95) -> Checks:
        r = F.abs(F.col("_y") - self.f.curve.column(F.col("_x")))
        v = stats.quantile(self.f.points(), r, share)
        return self._add("max_residual", v, most, v <= most)

    def monotone(self) -> Checks:
        n = len(monotonicity_violations(self.f.curve))
        return self._add("monotone", n, 0, n == 0)

    def value_at(self, x: float, want: float, tolerance: float = 1e-9) -> Checks:
        v = float(self.f.curve(x))
        return self._add("value_at", v, want, abs(v - want) <= tolerance * max(1.0, abs(want)))

    def derivative(self, df: Curve) -> Checks:
        bad = check_derivative(self.f.curve, df, *self.f.curve.x_range)
        return self._add("derivative", 0.0 if bad is None else abs(bad.derivative - bad.finite_difference), 0.0, bad is None)

    def rows(self) -> DataFrame:
        return self.f.data.sparkSession.createDataFrame(self.out, SCHEMA)

    def require(self) -> None:
        bad = [c for c in self.out if not c[3]]
        if bad:
            raise AssertionError("; ".join(f"{c[0]} = {c[1]} against {c[2]}" for c in bad))


def all_close(df: DataFrame, a: Column, b: Column, tolerance: float = 1e-9) -> DataFrame:
    """One row: how far two columns are apart at most."""
    d = df.agg(F.max(F.abs(a - b)).alias("value"))
    return d.select(F.lit("all_close").alias("check"), "value", F.lit(tolerance).alias("threshold"), (F.coalesce("value", F.lit(0.0)) <= tolerance).alias("passed"))
