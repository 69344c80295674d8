"""Functions for spark.sql: table functions over model JSON, scalar functions of a
model, and the fit as an aggregate."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..plans import calculus
from ..plans.display import equation
from ..plans.model import Curve


class CurveRoots:
    def eval(self, model: str):
        for r in calculus.roots(Curve.from_json(model)):
            yield r.kind, r.re, r.im


class CurveTurns:
    def eval(self, model: str):
        for t in calculus.critical_points(Curve.from_json(model)):
            yield t.kind, t.x, t.y


class CurveRange:
    def eval(self, model: str, lo: float, hi: float, step: float):
        c, i = Curve.from_json(model), 0
        while lo + i * step <= hi:
            x = lo + i * step
            yield x, float(c(x))
            i += 1


def register(spark: SparkSession) -> None:
    """curve_roots, curve_turns and curve_range are table functions; curve_value,
    curve_equation, curve_derivative and curve_integral work on a model's JSON.
    curve_fit(x, y, degree) is an aggregate for groups that fit into one task; use
    ``fit_groups`` for larger ones."""
    spark.udtf.register("curve_roots", F.udtf(CurveRoots, returnType="kind string, re double, im double"))
    spark.udtf.register("curve_turns", F.udtf(CurveTurns, returnType="kind string, x double, y double"))
    spark.udtf.register("curve_range", F.udtf(CurveRange, returnType="x double, y double"))

    def each(models: pd.Series, f) -> pd.Series:
        known = {m: f(Curve.from_json(m)) for m in models.dropna().unique()}
        return models.map(known)

    @F.pandas_udf("double")
    def curve_value(models: pd.Series, x: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=models.index)
        for m, at in models.dropna().groupby(models).groups.items():
            out[at] = np.asarray(Curve.from_json(m)(x[at].to_numpy(float)))
        return out

    @F.pandas_udf("string")
    def curve_equation(models: pd.Series) -> pd.Series:
        return each(models, equation)

    @F.pandas_udf("string")
    def curve_derivative(models: pd.Series) -> pd.Series:
        return each(models, lambda c: calculus.derivative(c).to_json())

    @F.pandas_udf("string")
    def curve_integral(models: pd.Series) -> pd.Series:
        return each(models, lambda c: calculus.integral(c).to_json())

    @F.pandas_udf("string")
    def curve_fit(x: pd.Series, y: pd.Series, degree: pd.Series) -> str:
        ok = np.isfinite(x) & np.isfinite(y)
        x, y, d = x[ok].to_numpy(float), y[ok].to_numpy(float), int(degree.iloc[0])
        if len(x) <= d or not x.max() > x.min():
            return None
        series = np.polynomial.Chebyshev.fit(x, y, d)
        return Curve("chebyshev", tuple(series.coef), float(x.min()), float(x.max())).to_json()

    for f in (curve_value, curve_equation, curve_derivative, curve_integral, curve_fit):
        spark.udf.register(f.__name__, f)
