"""Equations as text."""

from __future__ import annotations

import math

from .bases import FourierBasis
from .model import Curve

_UP = str.maketrans("0123456789+-", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻")
_DOWN = str.maketrans("0123456789+-", "₀₁₂₃₄₅₆₇₈₉₊₋")
GREEK = dict(zip("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split(), "αβγδεζηθικλμνξοπρστυφχψω"))


def superscript(n) -> str:
    return str(n).translate(_UP)


def subscript(n) -> str:
    return str(n).translate(_DOWN)


def number(v: float, digits: int = 2) -> str:
    """Fixed within [0.001, 1000), else scientific."""
    if v == 0 or 1e-3 <= abs(v) < 1e3:
        return f"{v:.{digits}f}"
    mantissa, _, power = f"{v:.{digits}e}".partition("e")
    return f"{mantissa}e{int(power)}"


def coefficient(c: float, degree: int, digits: int = 2) -> str | None:
    """None for zero, empty for one before a variable."""
    c, eps = abs(c), 2.3e-16
    if c <= eps:
        return None
    return "" if abs(c - 1) <= eps and degree else number(c, digits)


def variable(name: str, power: int, index: int | None = None) -> str:
    base = name + (subscript(index) if index is not None else "")
    return "" if power == 0 else base if power == 1 else base + superscript(power)


def _names(f: Curve) -> list[str]:
    fam, n = f.family, f.k
    if isinstance(fam, FourierBasis):
        out = [variable("x", p) for p in range(fam.level + 1)]
        for h in range(1, f.degree + 1):
            at = f"{h if h > 1 else ''}xₛ"
            out += [f"sin({at})", f"cos({at})"]
        return out
    if fam.name == "monomial":
        return [variable("x", p) for p in range(n)]
    if fam.kind == "log":
        return ["", *(f"ln(x')" + (superscript(p) if p > 1 else "") for p in range(1, n))]
    at = "x" if fam.home[0] == -math.inf else "xₛ"
    return ["", *(f"{fam.symbol or 'φ'}{subscript(j)}({at})" for j in range(1, n))]


def _end(v: float) -> str:
    if math.isinf(v):
        return "∞" if v > 0 else "-∞"
    turns = v / math.pi
    if v and abs(turns - round(turns)) < 1e-12 and abs(turns) < 10:
        return f"{'' if round(turns) == 1 else round(turns)}π"
    return f"{v:g}"


def scaling(f: Curve) -> str | None:
    """How x is normalised, if it is."""
    lo, hi = f.family.home
    if f.family.kind == "log":
        return f"x' = x - {f.x_min:g} + 1"
    if math.isinf(lo) and math.isinf(hi):
        return None
    return f"xₛ = T[ {_end(f.x_min)}..{_end(f.x_max)} -> {_end(lo)}..{_end(hi)} ]"


def equation(f: Curve, digits: int = 2) -> str:
    """``scaling, y(x) = term ± term``, highest term first."""
    out = ""
    for c, name in reversed(list(zip(f.coefs, _names(f)))):
        size = coefficient(c, 1 if name else 0, digits)
        if size is not None:
            sign = "-" if c < 0 else "+"
            out += (f" {sign} " if out else "-" if c < 0 else "") + (size + name)
    head = scaling(f)
    return (f"{head}, " if head else "") + f"y(x) = {out or '0'}"
