"""Affine maps between the range of x and the home range of a basis."""

from __future__ import annotations

import math
from dataclasses import dataclass

from ..errors import DegenerateDomain


@dataclass(frozen=True)
class DomainMap:
    """t = scale * x + shift."""

    scale: float = 1.0
    shift: float = 0.0

    @classmethod
    def between(cls, src: tuple[float, float], dst: tuple[float, float]) -> DomainMap:
        """Infinite ends of dst leave that end free: both free is the identity, one
        free only shifts."""
        (a, b), (lo, hi) = src, dst
        if math.isinf(lo) and math.isinf(hi):
            return cls()
        if math.isinf(lo):
            return cls(1.0, hi - b)
        if math.isinf(hi):
            return cls(1.0, lo - a)
        if not b > a:
            raise DegenerateDomain(f"x spans only {a}")
        scale = (hi - lo) / (b - a)
        return cls(scale, lo - scale * a)

    def __call__(self, x):
        return x * self.scale + self.shift

    def back(self, t):
        """Inverse; complex values keep a shift of the real part only."""
        return (t - self.shift) / self.scale
