"""Scores of candidate models; lower is better. All candidates share each pass."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.bases import FourierBasis, PolynomialBasis
from ..plans.calculus import _second, derivative
from ..plans.model import Curve
from . import stats


class Residuals:
    """y less the value of each curve, by numpy for a batch of _x and _y: the steps of
    Curve.column in the same order, where curves share the functions they are sums of."""

    def __init__(self, curves: Sequence[Curve]):
        self.steps = []  # kind, family or curve, coefficients, scale, shift
        self.partial = [c.family.kind == "log" for c in curves]  # null where the logarithm has no value
        for c in curves:
            fam = c.family
            if isinstance(fam, FourierBasis):
                self.steps.append(("fourier", fam.level, c.coefs, c.domain.scale, c.domain.shift))
            elif fam.kind == "log":
                self.steps.append(("log", None, c.coefs, c.domain.scale, c.domain.shift))
            elif isinstance(fam, PolynomialBasis):
                power, scale, shift = c.horner()
                self.steps.append(("power", None, tuple(map(float, power)), scale, shift))
            else:
                self.steps.append(("own", c, (), 1.0, 0.0))

    def __call__(self, b: pa.RecordBatch) -> list[np.ndarray]:
        x, y = (b.column(c).to_numpy(zero_copy_only=False) for c in ("_x", "_y"))
        made, out = {}, []

        def once(key, f):
            if key not in made:
                made[key] = f()
            return made[key]

        for kind, own, coefs, scale, shift in self.steps:
            if kind == "own":
                out.append(y - own(x))
                continue
            at = once((scale, shift), lambda: x * scale + shift)  # noqa: B023
            if kind == "fourier":
                v = np.full(len(x), coefs[0])
                for p in range(1, own + 1):
                    v += coefs[p] * once(("power", p), lambda: x**p)  # noqa: B023
                for h in range(1, (len(coefs) - own - 1) // 2 + 1):
                    for c, wave in zip(coefs[own + 2 * h - 1 : own + 2 * h + 1], (np.sin, np.cos)):
                        v += c * once((wave, h, scale, shift), lambda: wave(at * h))  # noqa: B023
            else:
                t = once(("log", scale, shift), lambda: np.where(at > 0, np.log(np.where(at > 0, at, 1.0)), np.nan)) if kind == "log" else at  # noqa: B023
                v = np.where(np.isnan(t), t, coefs[-1])
                for c in coefs[-2::-1]:
                    v *= t
                    v += c
            out.append(y - v)
        return out


class Score:
    """Implement ``of_residuals`` (from n, k, mae, rmse, huber) or override ``scores``."""

    distance = 0.0
    needs_huber = False
    rows_in_memory = 2_000_000  # up to which medians of folds are taken by one aggregate

    def of_residuals(self, n: int, k: int, mae: float, rmse: float, huber: float) -> float:
        raise NotImplementedError

    def scores(self, rows: DataFrame, curves: Sequence[Curve], n: int) -> list[float]:
        rows, res, m = rows.select("_x", "_y").where("_x is not null and _y is not null"), Residuals(curves), len(curves)
        known = stats.sums(rows, lambda b: [~np.isnan(r) if s else np.ones(len(r)) for r, s in zip(res(b), res.partial)], m) if any(res.partial) else [n] * m
        mean = lambda f: [s / k if k else None for s, k in zip(stats.sums(rows, f, m), known)]
        given = lambda v: [np.nan_to_num(r, nan=0.0, posinf=math.inf, neginf=-math.inf) if s else r for r, s in zip(v, res.partial)]
        if not m or not n:
            return [self.of_residuals(n, c.k, math.nan, math.nan, math.nan) for c in curves]
        if self.needs_huber:
            picked, middle = stats.sampled(rows, n), ((n - 1) // 2, n // 2)
            med = stats.ranked(rows, lambda b: [abs(r) for r in res(b)], m, n, middle, picked)
            mad = stats.ranked(rows, lambda b: [abs(abs(r) - v) for r, v in zip(res(b), med)], m, n, middle, picked)
            huber = mean(lambda b: given([stats.huber_loss(r, stats.HUBER * v) for r, v in zip(res(b), mad)]))
            return [self.of_residuals(n, c.k, math.nan, math.nan, h) for c, h in zip(curves, huber)]
        mae, mse = mean(lambda b: given([abs(r) for r in res(b)])), mean(lambda b: given([r * r for r in res(b)]))
        return [self.of_residuals(n, c.k, a, None if s is None else math.sqrt(s), math.nan) for c, a, s in zip(curves, mae, mse)]

    def fold_scores(self, rows: DataFrame, curves: dict[int, dict[int, Curve]], sizes: dict[int, int]) -> dict[int, list[float]]:
        """rows(_f, _x, _y); curves by degree and fold. Scores by degree, one a fold."""
        powers = {d: {f: c.horner() if c.family.kind == "polynomial" else None for f, c in by.items()} for d, by in curves.items()}
        cols = []
        for d, by in curves.items():
            some = next(iter(by.values()))
            if powers[d][next(iter(by))] is None:
                value = None
                for f, c in by.items():
                    v = c.column(F.col("_x"))
                    value = F.when(F.col("_f") == f, v) if value is None else value.when(F.col("_f") == f, v)
            else:
                top = max(by) + 1
                rows_of = [list(map(float, powers[d][f][0])) if f in powers[d] else [0.0] * some.k for f in range(top)]
                table = F.array(*[F.array(*[F.lit(v) for v in p]) for p in rows_of])
                _, scale, shift = powers[d][next(iter(by))]
                z = F.col("_x") * scale + shift
                own = F.get(table, F.col("_f"))
                value = F.get(own, F.lit(some.k - 1))
                for j in range(some.k - 2, -1, -1):
                    value = value * z + F.get(own, F.lit(j))
            cols.append((F.col("_y") - value).alias(f"_r{d}"))
        res = rows.select("_f", *cols)
        r = {d: F.col(f"_r{d}") for d in curves}
        if self.needs_huber:
            large = sum(sizes.values()) > self.rows_in_memory

            def fold_medians(value) -> dict[int, dict[str, float]]:
                if not large:
                    return {x["_f"]: x.asDict() for x in res.groupBy("_f").agg(*[F.median(value(d)).alias(f"m{d}") for d in r]).collect()}
                return {f: {f"m{d}": v for d, v in zip(r, stats.medians(res.where(F.col("_f") == f), [value(d) for d in r], n))} for f, n in sizes.items()}

            res = res.persist() if large else res  # each fold is read several times; partitions that don't fit go to disk
            pick = lambda t, d: F.get(F.array(*[F.lit(float(t[f][f"m{d}"])) if f in t else F.lit(0.0) for f in range(max(t) + 1)]), F.col("_f"))
            med = fold_medians(lambda d: F.abs(r[d]))
            mad = fold_medians(lambda d: F.abs(F.abs(r[d]) - pick(med, d)))
            got = res.groupBy("_f").agg(*[F.avg(stats.huber(c, stats.HUBER * pick(mad, d))).alias(f"h{d}") for d, c in r.items()]).collect()
            if large:
                res.unpersist()
            return {d: [self.of_residuals(sizes[x["_f"]], curves[d][x["_f"]].k, math.nan, math.nan, x[f"h{d}"]) for x in got] for d in curves}
        got = res.groupBy("_f").agg(*[a for d, c in r.items() for a in (F.avg(F.abs(c)).alias(f"a{d}"), F.sqrt(F.avg(c * c)).alias(f"s{d}"))]).collect()
        return {d: [self.of_residuals(sizes[x["_f"]], curves[d][x["_f"]].k, x[f"a{d}"], x[f"s{d}"], math.nan) for x in got] for d in curves}


class Aic(Score):
    """With the small-sample term below four rows a parameter."""

    distance, needs_huber = 2.0, True

    def of_residuals(self, n, k, mae, rmse, huber):
        if n == 0 or huber is None:
            return math.nan
        out = n * math.log(max(huber, stats.EPS)) + 2 * k
        return out + 2 * k * (k + 1) / (n - k - 1) if n / k < 4 and n > k + 1 else out


class Bic(Score):
    distance, needs_huber = 2.0, True

    def of_residuals(self, n, k, mae, rmse, huber):
        return math.nan if n == 0 or huber is None else n * math.log(max(huber, stats.EPS)) + k * math.log(n)


class Rmse(Score):
    def of_residuals(self, n, k, mae, rmse, huber):
        return math.nan if rmse is None else rmse


class Mae(Score):
    def of_residuals(self, n, k, mae, rmse, huber):
        return math.nan if mae is None else mae


PENALTY = {"none": 0.0, "weakest": 1e-6, "weak": 1e-4, "strong": 1e-2, "strict": 1e6}


@dataclass
class Shape(Score):
    """A base score plus penalties for curvature and for slopes against a direction
    (inferred by a vote of signs, increasing or decreasing), sampled over the range."""

    base: Score = field(default_factory=Rmse)
    curvature: str | float = "none"
    monotonic: str | float = "none"
    direction: str = "infer"
    sampling: str | int | float = 200  # rows to use: a count, a share, or "all"

    @property
    def distance(self):
        return self.base.distance

    def samples(self, n: int) -> int:
        s = self.sampling
        want = n if s == "all" else round(s * n) if isinstance(s, float) else int(s)
        return max(1, min(want, n))

    def penalty(self, c: Curve, n: int, y_span: float) -> float:
        w = [PENALTY.get(v, v) if isinstance(v, str) else float(v) for v in (self.curvature, self.monotonic)]
        m = max(2, self.samples(n))
        x = np.linspace(c.x_min, c.x_max, m)
        h, xr, yr = (c.x_max - c.x_min) / (m - 1), c.x_max - c.x_min, y_span or 1.0
        out = 0.0
        if w[0]:
            out += w[0] * h * float(((_second(c)(x) * xr / yr) ** 2).sum())
        if w[1]:
            d = derivative(c)(x) * xr / yr
            up = self.direction == "increasing" or self.direction == "infer" and np.sign(d).sum() >= 0
            out += w[1] * h * float((np.minimum(d, 0) ** 2 if up else np.maximum(d, 0) ** 2).sum())
        return out

    def scores(self, rows, curves, n):
        lo, hi = rows.agg(F.min("_y"), F.max("_y")).first()
        return [s + self.penalty(c, n, hi - lo) for s, c in zip(self.base.scores(rows, curves, n), curves)]

    def fold_scores(self, rows, curves, sizes):
        lo, hi = rows.agg(F.min("_y"), F.max("_y")).first()
        base = self.base.fold_scores(rows, curves, sizes)
        return {d: [s + self.penalty(c, n, hi - lo) for s, (f, c), n in zip(v, curves[d].items(), sizes.values())] for d, v in base.items()}


_NAMES = {"aic": Aic, "bic": Bic, "rmse": Rmse, "mae": Mae}


def score_of(s: Score | str) -> Score:
    return _NAMES[s]() if isinstance(s, str) else s


def model_score(rows: DataFrame, curve: Curve, method: Score | str = "aic") -> float:
    """rows(_x, _y)."""
    return score_of(method).scores(rows, [curve], rows.count())[0]
