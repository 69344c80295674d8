"""Which family of functions suits a series: fits several, ranks them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import FitError
from ..plans.bases import PolynomialBasis, basis
from ..plans.display import equation
from ..plans.model import Curve
from . import moments as mm
from . import stats
from .fit import Fit, fit_auto
from .points import points, spread_rows
from .scores import Score, score_of

FAMILIES = ("chebyshev", "fourier", "legendre", "hermite", "hermite_e", "laguerre", "logarithmic")
SCHEMA = "rank int, basis string, degree int, parameters int, score double, weight double, r_squared double, robust_r_squared double, normality double, rating double, stars double, equation string, model string"


def rank_bases(df: DataFrame, x, y, families: Sequence[str] = FAMILIES, bound: str | int = "relaxed", score: Score | str = "aic") -> DataFrame:
    """One row a family that could be fitted, best score first. weight: Akaike's;
    rating: fit quality over relative size; stars: rating from 0.3..1 to 0..5.

    Families of polynomials span the same functions, so they share one fit, its
    score and its measures; only coefficients differ."""
    method, got = score_of(score), []
    shared: tuple[Fit, tuple] | None = None
    pts = points(df, x, y)
    pts = spread_rows(pts, pts.count()).persist()  # read in many passes, and few rows of a file may be one task
    try:
        for name in families:
            polynomial = isinstance(basis(name), PolynomialBasis)
            try:
                if polynomial and shared:
                    f, measures = shared
                    lo, hi = f.curve.x_range
                    curve = Curve(name, tuple(mm.change_of_basis(basis(name), f.k, lo, hi) @ f.curve.coefs), lo, hi)
                    got.append((name, curve, *measures))
                    continue
                f = fit_auto(pts, "_x", "_y", bound, method, "chebyshev" if polynomial else name)
            except (FitError, ArithmeticError, ValueError):
                continue
            value = f.curve.column(F.col("_x"))
            m = stats.residual_metrics(pts, F.col("_y"), value, f.k).first()
            robust = stats.robust_metrics(pts, F.col("_y") - value)
            measures = (f.score, m["r_squared"], robust["robust_r_squared"], m["normality"])
            curve = f.curve
            if polynomial:
                shared = f, measures
                if name != "chebyshev":
                    lo, hi = f.curve.x_range
                    curve = Curve(name, tuple(mm.change_of_basis(basis(name), f.k, lo, hi) @ f.curve.coefs), lo, hi)
            got.append((name, curve, *measures))
    finally:
        pts.unpersist()
    if not got:
        return df.sparkSession.createDataFrame([], SCHEMA)
    got.sort(key=lambda r: (math.inf if math.isnan(r[2]) else r[2], r[0]))
    best, least = got[0][2], min(r[1].k for r in got)
    weights = [math.exp(-(r[2] - best) / 2) if r[2] - best < 1400 else 0.0 for r in got]
    rows = []
    for i, ((name, c, s, r2, rr2, p), w) in enumerate(zip(got, weights)):
        good = max(v for v in (r2, rr2, 0.0) if v is not None and not math.isnan(v))
        rating = (0.75 * min(1.0, good) + 0.25 * min(1.0, max(0.0, p))) / (c.k / least)
        stars = min(5.0, max(0.0, (rating - 0.3) / 0.7 * 5))
        rows.append((i + 1, name, c.degree, c.k, s, w / sum(weights), r2, rr2, p, rating, stars, equation(c), c.to_json()))
    return df.sparkSession.createDataFrame(rows, SCHEMA)
