"""The eleven families of basis functions.

A family says how x is normalised, how many coefficients a degree has and how
its functions are evaluated. All families of polynomials span the same functions,
so their calculus runs once, on Chebyshev series, and a change of family is a
square solve at Chebyshev nodes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from numpy.polynomial import chebyshev as C
from numpy.polynomial import hermite as H
from numpy.polynomial import hermite_e as HE
from numpy.polynomial import laguerre as L
from numpy.polynomial import legendre as P
from numpy.polynomial import polynomial as M

from ..errors import Unsupported, WrongParameterCount
from .domain import DomainMap

INF = math.inf


@dataclass(frozen=True)
class Basis:
    """A family; subclass it to add one of your own: home, k and vander are enough to fit."""

    name: str = "custom"
    home: tuple[float, float] = (-INF, INF)
    kind: str = "custom"  # polynomial, log, fourier, custom
    derivative_of: str | None = None
    integral_of: str | None = None
    symbol: str = ""

    def k(self, degree: int) -> int:
        return degree + 1

    def degree(self, k: int) -> int:
        if k < 1:
            raise WrongParameterCount(f"{self.name} has no form with {k} coefficients")
        return k - 1

    def domain(self, x_min: float, x_max: float) -> DomainMap:
        return DomainMap.between((x_min, x_max), self.home)

    def vander(self, t: np.ndarray, k: int) -> np.ndarray:
        raise NotImplementedError

    def design(self, x: np.ndarray, k: int, dom: DomainMap) -> np.ndarray:
        return self.vander(dom(np.asarray(x)), k)

    # orthogonal families only
    def gauss(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        raise Unsupported(f"{self.name} has no Gauss nodes")

    def norm2(self, j: int) -> float:
        raise Unsupported(f"{self.name} has no norms")


@dataclass(frozen=True)
class PolynomialBasis(Basis):
    kind: str = "polynomial"
    analytic_roots: bool = False
    _vander: object = field(default=None, compare=False, repr=False)
    _gauss: object = field(default=None, compare=False, repr=False)
    _norm2: object = field(default=None, compare=False, repr=False)

    def vander(self, t, k):
        return self._vander(np.asarray(t), k - 1)

    def gauss(self, n):
        return super().gauss(n) if self._gauss is None else self._gauss(n)

    def norm2(self, j):
        return super().norm2(j) if self._norm2 is None else self._norm2(j)

    def to_chebyshev(self, coefs) -> np.ndarray:
        """Chebyshev series, in the same normalised variable."""
        c = np.asarray(coefs)
        n = len(c)
        t = C.chebpts1(n) if n > 1 else np.zeros(1)
        return np.linalg.solve(C.chebvander(t, n - 1), self.vander(t, n) @ c)

    def from_chebyshev(self, series) -> np.ndarray:
        s = np.asarray(series)
        n = len(s)
        t = C.chebpts1(n) if n > 1 else np.zeros(1)
        return np.linalg.solve(self.vander(t, n), C.chebval(t, s))


def _recurrence(first: float, slope: float):
    """Vandermonde matrix of p0 = 1, p1 = slope t + first, p(n+1) = 2 t p(n) - p(n-1)."""

    def vander(t, degree):
        out = np.ones((degree + 1, *np.shape(t)), dtype=np.result_type(t, float))
        if degree > 0:
            out[1] = slope * t + first
        for j in range(2, degree + 1):
            out[j] = 2 * t * out[j - 1] - out[j - 2]
        return np.moveaxis(out, 0, -1)

    return vander


def _chebgauss(n):
    return C.chebgauss(n)


class LogBasis(Basis):
    def design(self, x, k, dom):
        with np.errstate(invalid="ignore", divide="ignore"):
            t = dom(np.asarray(x, float))
            return self.vander(np.where(t > 0, np.log(np.where(t > 0, t, 1.0)), np.nan), k)

    def vander(self, t, k):
        """Of logarithms: powers."""
        return M.polyvander(t, k - 1)


@dataclass(frozen=True)
class FourierBasis(Basis):
    """1, then `level` powers of raw x, then sin and cos of each harmonic of the angle."""

    kind: str = "fourier"
    level: int = 0

    def k(self, degree):
        return 1 + self.level + 2 * degree

    def degree(self, k):
        n = k - 1 - self.level
        if n < 0 or n % 2:
            raise WrongParameterCount(f"{self.name} has no form with {k} coefficients")
        return n // 2

    def design(self, x, k, dom):
        x = np.asarray(x)
        theta = dom(x)
        cols = [np.ones_like(x, dtype=np.result_type(x, float))] + [x**p for p in range(1, self.level + 1)]
        for n in range(1, self.degree(k) + 1):
            cols += [np.sin(n * theta), np.cos(n * theta)]
        return np.stack(cols, -1)

    def vander(self, t, k):
        if self.level:
            raise Unsupported("an augmented Fourier family needs raw x: use design")
        return self.design(t, k, DomainMap())

    def gauss(self, n):
        if self.level:
            return super().gauss(n)
        return np.arange(n) * (2 * np.pi / n), np.full(n, 2 * np.pi / n)

    def norm2(self, j):
        return super().norm2(j) if self.level else (2 * np.pi if j == 0 else np.pi)


_ALL = [
    PolynomialBasis("monomial", (-INF, INF), derivative_of="monomial", integral_of="monomial", symbol="x", analytic_roots=True, _vander=M.polyvander),
    PolynomialBasis("chebyshev", (-1.0, 1.0), derivative_of="chebyshev_u", symbol="T", analytic_roots=True, _vander=C.chebvander, _gauss=_chebgauss, _norm2=lambda j: np.pi if j == 0 else np.pi / 2),
    PolynomialBasis("chebyshev_u", (-1.0, 1.0), derivative_of="chebyshev_v", integral_of="chebyshev", symbol="U", analytic_roots=True, _vander=_recurrence(0.0, 2.0)),
    PolynomialBasis("chebyshev_v", (-1.0, 1.0), integral_of="chebyshev_u", symbol="V", _vander=_recurrence(-1.0, 2.0)),
    PolynomialBasis("legendre", (-1.0, 1.0), derivative_of="legendre", symbol="P", _vander=P.legvander, _gauss=P.leggauss, _norm2=lambda j: 2 / (2 * j + 1)),
    PolynomialBasis("hermite", (-INF, INF), derivative_of="hermite", symbol="H", _vander=H.hermvander, _gauss=H.hermgauss, _norm2=lambda j: math.sqrt(math.pi) * 2.0**j * math.factorial(j)),
    PolynomialBasis("hermite_e", (-INF, INF), derivative_of="hermite_e", symbol="He", _vander=HE.hermevander, _gauss=HE.hermegauss, _norm2=lambda j: math.sqrt(2 * math.pi) * math.factorial(j)),
    PolynomialBasis("laguerre", (0.0, INF), derivative_of="laguerre", symbol="L", _vander=L.lagvander, _gauss=L.laggauss, _norm2=lambda j: 1.0),
    FourierBasis("fourier", (0.0, 2 * math.pi), derivative_of="fourier", integral_of="linear_fourier"),
    FourierBasis("linear_fourier", (0.0, 2 * math.pi), derivative_of="fourier", integral_of="fourier_2", level=1),
    FourierBasis("fourier_2", (0.0, 2 * math.pi), derivative_of="linear_fourier", integral_of="fourier_3", level=2),
    FourierBasis("fourier_3", (0.0, 2 * math.pi), derivative_of="fourier_2", level=3),
    LogBasis("logarithmic", (1.0, INF), kind="log", symbol="ln"),
]
BASES: dict[str, Basis] = {b.name: b for b in _ALL}


def basis(b: str | Basis) -> Basis:
    return b if isinstance(b, Basis) else BASES[b]


def register(b: Basis) -> Basis:
    """Makes a family of one's own known by its name."""
    BASES[b.name] = b
    return b
