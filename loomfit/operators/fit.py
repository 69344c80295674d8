"""Fits: fixed degree, automatic degree, cross-validated, weighted, many groups."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DegenerateDomain, NoModel, TooManyParameters
from ..plans.bases import BASES, Basis, basis
from ..plans.model import Curve
from . import moments as mm
from .points import fold_of, points, with_index, x_range

if TYPE_CHECKING:
    from .scores import Score

#: name: (most, rows for each parameter, smoothness)
BOUNDS = {"conservative": (8, 15, 2), "relaxed": (15, 8, 1), "aggressive": (None, 8, 0)}
FOLDS = {"variance": 5, "bias": 10, "balanced": 7}


def degree_cap(n: int, bound: str | int = "relaxed") -> int:
    """Largest degree that is tried for n rows."""
    if isinstance(bound, int):
        return max(0, min(bound, n - 1))
    most, ratio, s = BOUNDS[bound]
    if most is None:
        return max(0, min(n - 1, math.floor(n / ratio - 1)))
    return max(0, min(math.floor(n ** (1 / (2 * s + 1))), math.floor(n / ratio - 1), most, n - 1))


def fold_count(n: int, strategy: str | int = "balanced") -> int:
    if isinstance(strategy, int):
        return strategy
    return n if strategy == "leave_one_out" else FOLDS[strategy]


@dataclass
class Fit:
    """A curve with what its queries need. The training rows stay a DataFrame."""

    curve: Curve
    n: int
    data: DataFrame
    x: object
    y: object
    gram: np.ndarray  # of the family's own functions
    rss: float
    score: float | None = None  # of the rule that chose its degree

    @property
    def k(self) -> int:
        return self.curve.k

    @property
    def degree(self) -> int:
        return self.curve.degree

    def points(self) -> DataFrame:
        return points(self.data, self.x, self.y)


def _solve(gram: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    a = gram / scale / scale[:, None]
    eps = np.finfo(float).eps
    return np.linalg.lstsq(a, rhs / scale, rcond=eps * len(a))[0] / scale


class _Nested:
    """One pass over the rows gives the least squares of every degree up to the top."""

    def __init__(self, pts: DataFrame, fam: Basis, top: int, n: int, lo: float, hi: float):
        if not hi > lo and fam.home != (-math.inf, math.inf):
            raise DegenerateDomain(f"x spans only {lo}")
        self.fam, self.lo, self.hi, self.n = fam, lo, hi, n
        self.r = None
        k = fam.k(top)
        self.inner = mm.has_moments(fam) and hi > lo
        if self.inner:
            row = mm.moment_sums(pts, fam, top, lo, hi).first()
            self.gram, self.rhs = mm.normal_equations(fam, top, n, row["y0"], row["m"], row["q"])
            self.yy = row["yy"]
            if mm.condition(self.gram) < mm.WELL_CONDITIONED:
                return
            design = lambda x: mm.inner_design(fam, x, k, lo, hi)
        else:
            dom = fam.domain(lo, hi)
            design = lambda x: fam.design(x, k, dom)
        self.r = mm.triangles(pts, design, k)
        self.gram, self.rhs, self.yy = self.r[:, :-1].T @ self.r[:, :-1], self.r[:, :-1].T @ self.r[:, -1], float(self.r[:, -1] @ self.r[:, -1])

    def inner_coefs(self, k: int) -> np.ndarray:
        if self.r is None:
            return _solve(self.gram[:k, :k], self.rhs[:k])
        a = self.r[:, :k]
        size = np.maximum(np.linalg.norm(a, axis=0), 1e-300)
        return np.linalg.lstsq(a / size, self.r[:, -1], rcond=np.finfo(float).eps * max(a.shape))[0] / size

    def curve(self, degree: int) -> Curve:
        k = self.fam.k(degree)
        c = self.inner_coefs(k)
        if self.inner:
            c = mm.change_of_basis(self.fam, k, self.lo, self.hi) @ c
        if not np.isfinite(c).all():
            raise NoModel(f"degree {degree} has no finite solution")
        known = BASES.get(self.fam.name) is self.fam
        return Curve(self.fam.name if known else self.fam, tuple(c), self.lo, self.hi)

    def own_gram(self, k: int) -> np.ndarray:
        g = self.gram[:k, :k]
        if not self.inner:
            return g
        back = np.linalg.inv(mm.change_of_basis(self.fam, k, self.lo, self.hi))
        return back.T @ g @ back

    def rss(self, k: int) -> float:
        c = self.inner_coefs(k)
        return max(0.0, float(self.yy - 2 * c @ self.rhs[:k] + c @ self.gram[:k, :k] @ c))


def _made(nested: _Nested, degree: int, df: DataFrame, x, y) -> Fit:
    k = nested.fam.k(degree)
    return Fit(nested.curve(degree), nested.n, df, x, y, nested.own_gram(k), nested.rss(k))


def fit(df: DataFrame, x, y, degree: int, family: str | Basis = "chebyshev") -> Fit:
    """Least squares of one degree: two jobs, range and moments."""
    pts, fam = points(df, x, y), basis(family)
    n, lo, hi = x_range(pts)
    if degree >= n or fam.k(degree) > n:
        raise TooManyParameters(f"degree {degree} needs more than {n} rows")
    return _made(_Nested(pts, fam, degree, n, lo, hi), degree, df, x, y)


def fit_auto(df: DataFrame, x, y, bound: str | int = "relaxed", score: Score | str = "aic", family: str | Basis = "chebyshev") -> Fit:
    """The lowest degree whose score lies within the score's distance of the best."""
    from .scores import score_of

    method, pts, fam = score_of(score), points(df, x, y), basis(family)
    n, lo, hi = x_range(pts)
    top = degree_cap(n, bound)
    while top > 0 and fam.k(top) > n:
        top -= 1
    nested = _Nested(pts, fam, top, n, lo, hi)
    curves = {}
    for d in range(top + 1):
        try:
            curves[d] = nested.curve(d)
        except (NoModel, np.linalg.LinAlgError):
            continue
    scores = dict(zip(curves, method.scores(pts, list(curves.values()), n)))
    best = _choose(scores, method.distance)
    return replace(_made(nested, best, df, x, y), score=scores[best])


def _choose(scores: dict[int, float], distance: float) -> int:
    known = {d: s for d, s in scores.items() if s is not None and not math.isnan(s)}
    if not known:
        raise NoModel("no degree has a score")
    least = min(known.values())
    return next(d for d in sorted(known) if known[d] - least <= distance or known[d] == least)


def fit_kfold(df: DataFrame, x, y, strategy: str | int = "balanced", bound: str | int = "relaxed", score: Score | str = "rmse", family: str | Basis = "chebyshev", order=None) -> Fit:
    """The lowest degree within the score's distance of the best mean score over
    contiguous folds along the order (default: x, then y); then all rows are fitted.

    Fold moments come from one pass; training moments are all minus the fold's. With
    every row a fold, errors come from leverages instead, so nothing is kept a row.
    """
    from .scores import score_of

    method, fam = score_of(score), basis(family)
    pts = points(df, x, y, order=order)
    n, lo, hi = x_range(pts)
    folds = max(2, min(n, fold_count(n, strategy)))
    top = degree_cap(n - -(-n // folds), bound)
    if not mm.has_moments(fam):
        raise NoModel(f"{fam.name} can't be cross-validated by moments")
    if folds == n:
        return _leave_one_out(pts.select("_x", "_y"), fam, top, n, lo, hi, method, df, x, y)
    rows = with_index(pts, *(("_o",) if order is not None else ("_x", "_y")))
    rows = rows.withColumn("_f", fold_of(F.col("_i"), n, folds)).select("_f", "_x", "_y")
    sums = mm.moment_sums(rows, fam, top, lo, hi, ["_f"]).collect()  # one row a fold
    parts = {r["_f"]: mm.normal_equations(fam, top, r["n"], r["y0"], r["m"], r["q"]) for r in sums}
    g, b = sum(p[0] for p in parts.values()), sum(p[1] for p in parts.values())
    curves: dict[int, dict[int, Curve]] = {}
    for d in range(top + 1):
        k = fam.k(d)
        w = mm.change_of_basis(fam, k, lo, hi)
        curves[d] = {f: Curve(fam.name, tuple(w @ _solve((g - p[0])[:k, :k], (b - p[1])[:k])), lo, hi) for f, p in parts.items()}
    mean = {d: float(np.mean(s)) for d, s in method.fold_scores(rows, curves, {r["_f"]: r["n"] for r in sums}).items()}
    best = _choose(mean, method.distance)
    return _made(_Nested(pts.select("_x", "_y"), fam, best, n, lo, hi), best, df, x, y)


def _leave_one_out(pts: DataFrame, fam: Basis, top: int, n: int, lo: float, hi: float, method, df: DataFrame, x, y) -> Fit:
    """The error of a row left out is its residual over one less its leverage; of a
    single row, root mean square and mean absolute error are both its size, and
    robust scores see no spread."""
    from .predict import form_column
    from .stats import EPS

    nested = _Nested(pts, fam, top, n, lo, hi)
    curves = {d: nested.curve(d) for d in range(top + 1)}
    aggs = []
    for d, c in curves.items():
        k = fam.k(d)
        w = mm.change_of_basis(fam, k, lo, hi)
        hat = form_column(c, w @ np.linalg.pinv(nested.gram[:k, :k]) @ w.T, F.col("_x"))
        left = F.greatest(F.lit(1.0) - hat, F.lit(EPS))
        aggs.append(F.avg(F.abs(F.col("_y") - c.column(F.col("_x"))) / left).alias(f"e{d}"))
    *sizes, y_lo, y_hi = pts.agg(*aggs, F.min("_y"), F.max("_y")).first()
    base = getattr(method, "base", method)
    scores = {d: base.of_residuals(1, c.k, e, e, 0.0) for (d, c), e in zip(curves.items(), sizes)}
    if base is not method:
        scores = {d: s + method.penalty(curves[d], n, y_hi - y_lo) for d, s in scores.items()}
    return _made(nested, _choose(scores, method.distance), df, x, y)


def fit_weighted(f: Callable, lo: float, hi: float, degree: int, family: str | Basis = "chebyshev") -> Curve:
    """Fits a function sampled at Gauss nodes, weighted by the family's weight."""
    fam = basis(family)
    k = fam.k(degree)
    t, w = fam.gauss(k)
    root = np.sqrt(w)
    y = np.asarray(f(fam.domain(lo, hi).back(t)), float)
    c = np.linalg.lstsq(fam.vander(t, k) * root[:, None], y * root, rcond=None)[0]
    return Curve(family, tuple(c), lo, hi)


GROUP_SCHEMA = "n long, x_min double, x_max double, coefficients array<double>, power array<double>, scale double, shift double, mse double, r_squared double, error string"


def fit_groups(df: DataFrame, keys: Sequence[str], x, y, degree: int, family: str | Basis = "chebyshev") -> DataFrame:
    """A fit for each group in two aggregates; raw rows never gather in one task. A
    group that can't be fitted has an error and no coefficients."""
    fam = basis(family)
    if not mm.has_moments(fam) or fam.kind == "fourier":
        raise NoModel(f"{fam.name} can't be fitted by group")
    pts = points(df, x, y, keys)
    ranges = pts.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    rows = pts.join(ranges, same).select(*keys, "_x", "_y", "_lo", "_hi")
    sums = mm.moment_sums(rows, fam, degree, F.col("_lo"), F.col("_hi"), [*keys, "_lo", "_hi"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                r = dict(zip(pdf.columns, r))
                n, lo, hi = int(r["n"]), r["_lo"], r["_hi"]
                row = [n, lo, hi, None, None, None, None, None, None, None]
                if degree >= n:
                    row[-1] = "TooManyParameters"
                elif not hi > lo:
                    row[-1] = "DegenerateDomain"
                else:
                    g, b = mm.normal_equations(fam, degree, n, r["y0"], r["m"], r["q"])
                    if not np.isfinite(g).all() or mm.condition(g) > 1e8:
                        row[-1] = "SingularMatrix"
                    else:
                        c = _solve(g, b)
                        rss = max(0.0, float(r["yy"] - 2 * c @ b + c @ g @ c))
                        sst = float(r["yy"] - r["y0"] ** 2 / n)
                        curve = Curve(fam.name, tuple(mm.change_of_basis(fam, degree + 1, lo, hi) @ c), lo, hi)
                        power, scale, shift = (np.array(curve.coefs), 1.0, 0.0) if fam.kind == "log" else curve.horner()
                        row[3:9] = [list(curve.coefs), [float(v) for v in power], scale, shift, rss / n, 1 - rss / sst if sst > 0 else None]
                out.append([r[k] for k in keys] + row)
            yield pd.DataFrame(out, columns=[*keys, *[p.split()[0] for p in GROUP_SCHEMA.split(", ")]])

    return sums.mapInPandas(solve, f"{schema}, {GROUP_SCHEMA}")


def predict_groups(df: DataFrame, models: DataFrame, keys: Sequence[str], x, family: str | Basis = "chebyshev", into: str = "y_fit") -> DataFrame:
    """Joins the groups' models and evaluates each by Horner's rule in the JVM."""
    small = models.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "power", "scale", "shift", F.col("x_min").alias("_lo"))
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    xd = (F.col(x) if isinstance(x, str) else x).cast("double")
    t = F.log(xd - F.col("_lo") + 1.0) if basis(family).kind == "log" else xd * F.col("scale") + F.col("shift")
    value = F.aggregate(F.reverse("power"), F.lit(0.0), lambda acc, c: acc * F.col("_t") + c)
    both = df.join(small, cond, "left").withColumn("_t", t)
    return both.select(*df.columns, F.when(F.col("power").isNotNull(), value).alias(into))
