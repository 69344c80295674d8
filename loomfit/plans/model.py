"""A fitted curve: basis, range of x and coefficients, and its algebra.

A model is a small row. ``struct()`` and ``from_row`` carry it through
DataFrames; ``column()`` is its value as a Spark expression.
"""

from __future__ import annotations

import functools
import json
import math
from dataclasses import dataclass, replace

import numpy as np
from numpy.polynomial import chebyshev as C
from numpy.polynomial import polynomial as M
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Unsupported, WrongParameterCount
from .bases import Basis, FourierBasis, PolynomialBasis, basis
from .domain import DomainMap

MODEL_SCHEMA = T.StructType([
    T.StructField("basis", T.StringType()),
    T.StructField("degree", T.IntegerType()),
    T.StructField("x_min", T.DoubleType()),
    T.StructField("x_max", T.DoubleType()),
    T.StructField("coefficients", T.ArrayType(T.DoubleType())),
])
_TRIM = np.finfo(float).eps


@dataclass(frozen=True)
class Curve:
    basis: str | Basis
    coefs: tuple[float, ...]
    x_min: float = -1.0
    x_max: float = 1.0

    def __post_init__(self):
        object.__setattr__(self, "coefs", tuple(float(c) for c in self.coefs))
        self.family.degree(len(self.coefs))  # checks the count

    # --- what it is
    @property
    def family(self) -> Basis:
        return basis(self.basis)

    @property
    def degree(self) -> int:
        return self.family.degree(len(self.coefs))

    @property
    def k(self) -> int:
        return len(self.coefs)

    @functools.cached_property
    def domain(self) -> DomainMap:
        return self.family.domain(self.x_min, self.x_max)

    @property
    def x_range(self) -> tuple[float, float]:
        return self.x_min, self.x_max

    def row(self) -> tuple:
        return self.family.name, self.degree, self.x_min, self.x_max, list(self.coefs)

    @classmethod
    def from_row(cls, r) -> Curve:
        return cls(r["basis"], tuple(r["coefficients"]), r["x_min"], r["x_max"])

    def to_json(self) -> str:
        return json.dumps(dict(zip(MODEL_SCHEMA.fieldNames(), self.row())))

    @classmethod
    def from_json(cls, text: str) -> Curve:
        return cls.from_row(json.loads(text))

    def struct(self) -> Column:
        name, degree, lo, hi, coefs = self.row()
        return F.struct(F.lit(name).alias("basis"), F.lit(degree).alias("degree"), F.lit(lo).alias("x_min"), F.lit(hi).alias("x_max"), F.array(*[F.lit(c) for c in coefs]).alias("coefficients"))

    # --- evaluation
    def __call__(self, x):
        """numpy; x may be complex for families of polynomials and Fourier."""
        x = np.asarray(x)
        return (self.family.design(np.atleast_1d(x), self.k, self.domain) @ np.asarray(self.coefs)).reshape(x.shape)[()]

    def normalized(self, t):
        """Value at normalised places."""
        return self(self.domain.back(np.asarray(t)))

    def column(self, x: Column) -> Column:
        """One flat expression: Horner's rule in a variable on [-1, 1], or harmonics."""
        x = x.cast("double")
        fam = self.family
        if isinstance(fam, FourierBasis):
            theta = x * F.lit(self.domain.scale) + F.lit(self.domain.shift)
            out = F.lit(self.coefs[0])
            for p in range(1, fam.level + 1):
                out = out + F.lit(self.coefs[p]) * F.pow(x, F.lit(p))
            for n in range(1, self.degree + 1):
                a, b = self.coefs[fam.level + 2 * n - 1 : fam.level + 2 * n + 1]
                out = out + F.lit(a) * F.sin(theta * F.lit(float(n))) + F.lit(b) * F.cos(theta * F.lit(float(n)))
            return out
        if fam.kind == "log":
            inner = x * F.lit(self.domain.scale) + F.lit(self.domain.shift)
            t = F.when(inner > 0, F.log(F.when(inner > 0, inner).otherwise(1.0)))
            power, scale, shift = self.coefs, 1.0, 0.0
        elif isinstance(fam, PolynomialBasis):
            power, scale, shift = self.horner()
            t = x
        else:
            raise Unsupported(f"{fam.name} has no Spark expression")
        z = t * F.lit(scale) + F.lit(shift) if (scale, shift) != (1.0, 0.0) else t
        out = F.lit(float(power[-1]))
        for c in power[-2::-1]:
            out = out * z + F.lit(float(c))
        return out if len(power) > 1 else F.when(t.isNotNull(), out)

    def horner(self) -> tuple[np.ndarray, float, float]:
        """Power coefficients in scale * x + shift, which maps the range onto [-1, 1]."""
        if self.family.name == "monomial" and not (math.isfinite(self.x_min) and math.isfinite(self.x_max)):
            return np.array(self.coefs), 1.0, 0.0
        to_unit = DomainMap.between((self.x_min, self.x_max), (-1.0, 1.0)) if self.x_max > self.x_min else DomainMap(1.0, -self.x_min)
        t = C.chebpts1(self.k) if self.k > 1 else np.zeros(1)
        series = np.linalg.solve(C.chebvander(t, self.k - 1), self(to_unit.back(t)))
        return C.cheb2poly(series), to_unit.scale, to_unit.shift

    # --- algebra
    def scaled(self, by: float) -> Curve:
        return replace(self, coefs=tuple(c * by for c in self.coefs))

    def __mul__(self, other):
        if isinstance(other, Curve):
            self._monomials(other)
            return replace(self, coefs=tuple(M.polymul(self.coefs, other.coefs))).trimmed()
        return self.scaled(float(other))

    __rmul__ = __mul__

    def __truediv__(self, by: float) -> Curve:
        return self.scaled(1 / by)

    def __add__(self, other: Curve) -> Curve:
        self._monomials(other)
        return replace(self, coefs=tuple(M.polyadd(self.coefs, other.coefs))).trimmed()

    def __sub__(self, other: Curve) -> Curve:
        self._monomials(other)
        return replace(self, coefs=tuple(M.polysub(self.coefs, other.coefs))).trimmed()

    def _monomials(self, other: Curve) -> None:
        if self.family.name != "monomial" or other.family.name != "monomial":
            raise Unsupported("sums and products need monomial curves: use as_monomial")

    def abs(self) -> Curve:
        return replace(self, coefs=tuple(abs(c) for c in self.coefs))

    def trimmed(self) -> Curve:
        """Without leading coefficients that are zero to rounding."""
        c = list(self.coefs)
        while len(c) > 1 and abs(c[-1]) < _TRIM:
            c.pop()
        return replace(self, coefs=tuple(c)) if self.family.kind != "fourier" else self

    @property
    def leading(self) -> float:
        return self.coefs[-1]

    # --- change of family
    def _series(self) -> np.ndarray:
        if not isinstance(self.family, PolynomialBasis):
            raise Unsupported(f"{self.family.name} is no family of polynomials")
        return self.family.to_chebyshev(self.coefs)

    def as_monomial(self) -> Curve:
        """The same function in powers of raw x."""
        power = C.cheb2poly(self._series())
        out, step = np.zeros(1), np.array([self.domain.shift, self.domain.scale])
        for c in power[::-1]:
            out = M.polyadd(M.polymul(out, step), [c])
        out = np.append(out, np.zeros(self.k))[: self.k]
        return Curve("monomial", tuple(out), self.x_min, self.x_max)

    def as_first_kind(self) -> Curve:
        return Curve("chebyshev", tuple(self._series()), self.x_min, self.x_max) if self.family.home == (-1.0, 1.0) else self.project("chebyshev")

    def project(self, to: str | Basis, x_range: tuple[float, float] | None = None) -> Curve:
        """Least squares at 15 places for each coefficient, at the same degree."""
        lo, hi = x_range or self.x_range
        fam = basis(to)
        k = fam.k(self.degree)
        x = np.linspace(lo, hi, 15 * self.k + 1)
        a = fam.design(x, k, fam.domain(lo, hi))
        size = np.linalg.norm(a, axis=0)
        c = np.linalg.lstsq(a / size, self(x), rcond=None)[0] / size
        return Curve(to, tuple(c), lo, hi)

    def project_orthogonal(self, to: str | Basis, degree: int, x_range: tuple[float, float] | None = None) -> Curve:
        """Gauss quadrature of f times each function over its norm."""
        lo, hi = x_range or self.x_range
        fam = basis(to)
        k = fam.k(degree)
        t, w = fam.gauss(max(k, 2 * self.k) + 1)
        phi = fam.vander(t, k)
        y = self(fam.domain(lo, hi).back(t))
        return Curve(to, tuple((w * y) @ phi / ((w[:, None] * phi**2).sum(0))), lo, hi)

    # --- spectrum
    def energies(self) -> np.ndarray:
        return np.array([c * c * self.family.norm2(j) for j, c in enumerate(self.coefs)])

    def smoothness(self) -> float:
        e = self.energies()
        return float((np.arange(len(e)) ** 2 * e).sum() / e.sum()) if e.sum() > _TRIM else 0.0

    def spectral_filter(self) -> Curve:
        """Keeps coefficients up to the K that minimises the energy before K over K
        squared, and fades those below it by sinc."""
        e = self.energies()
        n = len(e)
        if n < 2:
            return self
        gain = [e[:k].sum() / k**2 for k in range(1, n)]
        cut = 1 + int(np.argmin(gain))
        c = np.array(self.coefs)
        k = np.arange(1, cut)
        c[1:cut] *= np.sinc(k / (cut + 1))
        c[cut + 1 :] = 0
        return replace(self, coefs=tuple(c))

    def pruned(self, errors: np.ndarray, t_critical: float) -> Curve:
        """Coefficients that differ from zero by less than the critical share of their
        standard errors become zero."""
        keep = [0.0 if abs(c) > _TRIM and (s <= 0 or abs(c) / s < t_critical) and s > 0 else c for c, s in zip(self.coefs, errors)]
        return replace(self, coefs=tuple(keep))


def fourier(x_range: tuple[float, float], constant: float, harmonics: list[tuple[float, float]], trend: tuple[float, ...] = ()) -> Curve:
    """constant + trend powers + sum of a sin + b cos."""
    names = ("fourier", "linear_fourier", "fourier_2", "fourier_3")
    return Curve(names[len(trend)], (constant, *trend, *(v for h in harmonics for v in h)), *x_range)


def parse(text: str) -> Curve:
    """A monomial curve from text such as ``2 x^2 + 3 x - 5``."""
    import re

    flat = re.sub(r"\s+", "", text).replace("-", "+-")
    coefs: dict[int, float] = {}
    for term in filter(None, flat.split("+")):
        m = re.fullmatch(r"(-?[\d.]*(?:e-?\d+)?)\*?(x(?:\^(\d+))?)?", term)
        if not m or not (m[1] or m[2]):
            raise WrongParameterCount(f"can't read {term!r}")
        p = 0 if not m[2] else int(m[3] or 1)
        coefs[p] = coefs.get(p, 0.0) + (float(m[1] + "1") if m[1] in ("", "-") else float(m[1]))
    n = max(coefs, default=0)
    return Curve("monomial", tuple(coefs.get(i, 0.0) for i in range(n + 1)), -math.inf, math.inf)
