"""Row operators of a fit: fitted values, residuals, bands, outliers."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import OutOfRange
from ..plans.model import Curve
from .fit import Fit
from .points import as_double, finite
from .stats import EPS

#: Two-sided standard normal quantiles of common levels.
Z = {0.80: 1.281, 0.90: 1.644, 0.95: 1.959, 0.98: 2.326, 0.99: 2.575, 0.999: 3.290}
_T = {
    0.80: "3.078 1.886 1.638 1.533 1.476 1.440 1.415 1.397 1.383 1.372 1.363 1.356 1.350 1.345 1.341 1.337 1.333 1.330 1.328 1.325 1.323 1.321 1.319 1.318 1.316 1.315 1.314 1.313 1.311",
    0.90: "6.314 2.920 2.353 2.132 2.015 1.943 1.895 1.860 1.833 1.812 1.796 1.782 1.771 1.761 1.753 1.746 1.740 1.734 1.729 1.725 1.721 1.717 1.714 1.711 1.708 1.706 1.703 1.701 1.699",
    0.95: "12.706 4.303 3.182 2.776 2.571 2.447 2.365 2.306 2.262 2.228 2.201 2.179 2.160 2.145 2.131 2.120 2.110 2.101 2.093 2.086 2.080 2.074 2.069 2.064 2.060 2.056 2.052 2.048 2.045",
    0.98: "31.821 6.965 4.541 3.747 3.365 3.143 2.998 2.896 2.821 2.764 2.718 2.681 2.650 2.624 2.602 2.583 2.567 2.552 2.539 2.528 2.518 2.508 2.500 2.492 2.485 2.479 2.473 2.467 2.462",
    0.99: "63.657 9.925 5.841 4.604 4.032 3.707 3.499 3.355 3.250 3.169 3.106 3.055 3.012 2.977 2.947 2.921 2.898 2.878 2.861 2.845 2.831 2.819 2.807 2.797 2.787 2.779 2.771 2.763 2.756",
    0.999: "636.619 31.599 12.924 8.610 6.869 5.959 5.408 5.041 4.781 4.587 4.437 4.318 4.221 4.140 4.073 4.015 3.965 3.922 3.883 3.850 3.819 3.792 3.768 3.745 3.725 3.707 3.690 3.674 3.659",
}
STUDENT = {level: tuple(map(float, row.split())) for level, row in _T.items()}


def z_score(level: float) -> float:
    """Of a tabulated level; any other number is a score of one's own."""
    return Z.get(level, level)


def t_score(level: float, df: int) -> float:
    if df <= 0:
        return math.inf
    return z_score(level) if level not in STUDENT or df > len(STUDENT[level]) else STUDENT[level][df - 1]


def alpha(level: float) -> float:
    return 1 - level


@dataclass(frozen=True)
class Tolerance:
    """absolute: added to the band; measurement: a share of the value, added;
    variance: a share of the deviation of y, added in squares."""

    kind: str = "absolute"
    amount: float = 0.0


@dataclass(frozen=True)
class Uncertain:
    mean: float
    std_dev: float

    def band(self, level: float) -> tuple[float, float]:
        d = z_score(level) * self.std_dev
        return self.mean - d, self.mean + d

    def __str__(self) -> str:
        return f"{self.mean:g} ± {self.std_dev:g}"

    @classmethod
    def of(cls, values) -> Uncertain:
        v = np.asarray(values, float)
        return cls(float(v.mean()), float(v.std()))


def covariance(f: Fit) -> np.ndarray:
    """(X'X + eps I)^+ times the residual variance."""
    k = f.k
    g = f.gram + EPS * np.eye(k)
    scale = np.sqrt(np.diag(g))
    inv = np.linalg.pinv(g / scale / scale[:, None], rcond=EPS) / scale / scale[:, None]
    return inv * (f.rss / (f.n - k) if f.n > k else 0.0)


def standard_errors(f: Fit) -> np.ndarray:
    return np.sqrt(np.maximum(np.diag(covariance(f)), 0))


def prune(f: Fit, level: float = 0.95) -> Curve:
    """Without coefficients that don't differ from zero at the level."""
    return f.curve.pruned(standard_errors(f), t_score(level, f.n - f.k))


def prediction_variance(f: Fit, x: float) -> float:
    phi = f.curve.family.design(np.array([float(x)]), f.k, f.curve.domain)[0]
    return float(phi @ covariance(f) @ phi)


def variance_column(f: Fit, x: Column) -> Column:
    """Variance of the fitted value."""
    return form_column(f.curve, covariance(f), x)


def form_column(c: Curve, cov: np.ndarray, x: Column) -> Column:
    """phi' C phi of the curve's functions. It is a function of the doubled degree for
    polynomials, so it is one more curve; other families sum over the factor of C."""
    if c.family.kind == "polynomial":
        k2 = 2 * c.k - 1
        if c.x_max > c.x_min:
            at = c.x_min + (np.cos(np.pi * (np.arange(k2) + 0.5) / k2) + 1) / 2 * (c.x_max - c.x_min)
            phi = c.family.design(at, c.k, c.domain)
            t = 2 * (at - c.x_min) / (c.x_max - c.x_min) - 1
            series = np.linalg.solve(np.polynomial.chebyshev.chebvander(t, k2 - 1), np.einsum("ij,jk,ik->i", phi, cov, phi))
            return Curve("chebyshev", tuple(series), c.x_min, c.x_max).column(x)
    val, vec = np.linalg.eigh(cov)
    out = F.lit(0.0)
    for lam, v in zip(val, vec.T):
        if lam > 0:
            out = out + F.pow(Curve(c.basis, tuple(np.sqrt(lam) * v), c.x_min, c.x_max).column(x), 2)
    return out


def band(f: Fit, x: Column, level: float = 0.95, tolerance: Tolerance = Tolerance(), y_sd: float | None = None) -> Column:
    """struct(value, lower, upper, level) at x within the range, else null."""
    x = as_double(x)
    value, var = f.curve.column(x), F.greatest(variance_column(f, x), F.lit(0.0))
    extra = F.lit(0.0)
    if tolerance.kind == "variance":
        if y_sd is None:
            y_sd = f.points().agg(F.stddev_pop("_y")).first()[0] or 0.0
        var = var + F.lit((y_sd * tolerance.amount) ** 2)
    elif tolerance.kind == "measurement":
        extra = F.abs(value) * F.lit(tolerance.amount)
    else:
        extra = F.lit(tolerance.amount)
    half = F.lit(z_score(level)) * F.sqrt(var) + extra
    inside = x.between(*map(F.lit, f.curve.x_range))
    return F.when(inside, F.struct(value.alias("value"), (value - half).alias("lower"), (value + half).alias("upper"), F.lit(float(level)).alias("level")))


def with_band(df: DataFrame, f: Fit, x="x", level: float = 0.95, tolerance: Tolerance = Tolerance(), into: str = "band") -> DataFrame:
    return df.withColumn(into, band(f, as_double(x), level, tolerance))


def outliers(f: Fit, level: float = 0.95, tolerance: Tolerance = Tolerance()) -> DataFrame:
    """Training rows whose y lies outside the band at their x, with the band."""
    rows = f.data.where(finite(as_double(f.x)) & finite(as_double(f.y)))
    out = with_band(rows, f, f.x, level, tolerance)
    y = as_double(f.y)
    return out.where((y < F.col("band.lower")) | (y > F.col("band.upper")))


def with_fit(df: DataFrame, c: Curve, x, into: str = "y_fit", guard: str | None = None) -> DataFrame:
    """guard: None evaluates anywhere, "null" gives null outside the training range,
    "error" raises there."""
    xd = as_double(x)
    value = c.column(xd)
    if guard:
        inside = xd.between(F.lit(c.x_min), F.lit(c.x_max))
        other = F.lit(None).cast("double") if guard == "null" else F.raise_error(F.lit(f"x outside {c.x_min}..{c.x_max}")).cast("double")
        value = F.when(inside | xd.isNull(), value).otherwise(other)
    return df.withColumn(into, value)


def predict(c: Curve, x: float) -> float:
    if not c.x_min <= x <= c.x_max:
        raise OutOfRange(f"{x} lies outside {c.x_min}..{c.x_max}")
    return float(c(x))


def with_residual(df: DataFrame, c: Curve, x, y, into: str = "residual") -> DataFrame:
    return df.withColumn(into, as_double(y) - c.column(as_double(x)))


def residuals_filtered(f: Fit, into: str = "residual") -> DataFrame:
    """Training rows whose residual is more than rounding: eps sqrt(n) max(1, |y|, |fit|)."""
    rows = with_residual(with_fit(f.data, f.curve, f.x, "_fit"), f.curve, f.x, f.y, into)
    n, a, b = rows.agg(F.count("*"), F.max(F.abs(as_double(f.y))), F.max(F.abs(F.col("_fit")))).first()
    floor = EPS * math.sqrt(n) * max(1.0, a or 0.0, b or 0.0)
    return rows.where(F.abs(F.col(into)) >= floor).drop("_fit")


def stepped(spark: SparkSession, lo: float, hi: float, step: float = 1.0) -> DataFrame:
    """lo, lo + step, ... up to hi, each by one product."""
    n = math.floor((hi - lo) / step + 1e-9) + 1 if hi >= lo else 0
    return spark.range(max(n, 0)).select((F.lit(float(lo)) + F.col("id") * F.lit(float(step))).alias("x")).where(F.col("x") <= F.lit(float(hi)))


def curve_over(spark: SparkSession, c: Curve, lo: float, hi: float, step: float = 1.0, guard: str | None = None) -> DataFrame:
    return with_fit(stepped(spark, lo, hi, step), c, "x", "y", guard)


def y_range(f: Fit) -> tuple[float, float]:
    return tuple(f.points().agg(F.min("_y"), F.max("_y")).first())


def properties(f: Fit) -> DataFrame:
    """degree, data_points, coefficients, coefficient_errors, mse, r_squared: one row."""
    lo = f.points().agg((F.var_pop("_y") * F.count("*")).alias("sst")).first()[0]
    errors = [float(e) for e in standard_errors(f)] if f.n > f.k else None
    row = (f.degree, f.n, list(f.curve.coefs), errors, f.rss / f.n, 1 - f.rss / lo if lo else None)
    return f.data.sparkSession.createDataFrame([row], "degree int, data_points long, coefficients array<double>, coefficient_errors array<double>, mse double, r_squared double")
