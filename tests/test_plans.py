import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomfit.errors import DegenerateDomain, Unsupported, WrongParameterCount
from loomfit.plans import calculus as ca
from loomfit.plans.bases import BASES, Basis, basis
from loomfit.plans.display import equation, number, scaling, variable
from loomfit.plans.domain import DomainMap
from loomfit.plans.model import Curve, fourier, parse

POLYNOMIALS = [n for n, b in BASES.items() if b.kind == "polynomial"]
ORTHOGONAL = ["chebyshev", "legendre", "hermite", "hermite_e", "laguerre", "fourier"]
coefs = st.lists(st.floats(-10, 10).map(lambda v: round(v, 3)), min_size=1, max_size=6)


@pytest.mark.parametrize("name", ORTHOGONAL)
def test_functions_are_orthogonal(name):
    g = ca.gauss_matrix(name, 5, 60)
    want = np.diag([basis(name).norm2(j) for j in range(5)])
    assert np.allclose(g / np.sqrt(np.outer(np.diag(want), np.diag(want))), np.eye(5), atol=1e-10)


@settings(max_examples=30, deadline=None)
@given(coefs, st.sampled_from(POLYNOMIALS))
def test_same_function_in_powers(c, name):
    f = Curve(name, tuple(c), 0.5, 4.0)
    x = np.linspace(0.5, 4.0, 11)
    assert np.allclose(f(x), f.as_monomial()(x), rtol=1e-6, atol=1e-5 * (1 + np.abs(f(x)).max()))


@settings(max_examples=30, deadline=None)
@given(coefs, st.sampled_from([n for n, b in BASES.items() if b.derivative_of]))
def test_derivative_is_the_slope(c, name):
    k = basis(name).k(2)
    f = Curve(name, tuple((c * 8)[:k]), 0.5, 4.0)
    assert ca.check_derivative(f, ca.derivative(f), 0.6, 3.9, rel=1e-3) is None


@pytest.mark.parametrize("name", [n for n, b in BASES.items() if b.integral_of and b.derivative_of])
def test_integral_undoes_derivative(name):
    k = basis(name).k(2)
    f = Curve(name, tuple(range(1, k + 1)), 0.0, 3.0)
    g = ca.derivative(ca.integral(f, 4.0))
    x = np.linspace(0.1, 2.9, 9)
    assert np.allclose(f(x), g(x))


def test_second_kind_derivative_of_high_degree():
    f = Curve("chebyshev_u", (0, 0, 0, 1), -1, 1)
    assert np.allclose(ca.derivative(f)(np.array([-0.5, 0.3])), 24 * np.array([-0.5, 0.3]) ** 2 - 4)


def test_area():
    assert ca.area(parse("3 x^2"), 0, 2) == pytest.approx(8)
    assert ca.area(Curve("legendre", (1, 2), 0, 4), 0, 4) == pytest.approx(4)


def test_roots_of_every_kind():
    assert [(r.kind, round(r.re, 6)) for r in ca.roots(Curve("monomial", (-4, 0, 1), -5, 5))] == [("real", -2), ("real", 2)]
    assert [r.kind for r in ca.roots(Curve("monomial", (5, 2, 1), -5, 5))] == ["complex_pair"]
    assert [round(r.re, 6) for r in ca.roots(Curve("chebyshev", (0, 1), 0, 10))] == [5]  # degree 1
    assert [round(r.re, 6) for r in ca.roots(Curve("legendre", (0, 0, 1), -1, 1))] == [-0.57735, 0.57735]
    assert ca.roots(fourier((0, 1), 3.0, [(1.0, 1.0)])) == []  # no real zero is made up
    assert [round(r.re, 4) for r in ca.roots(fourier((0, 2 * math.pi), 0.0, [(1.0, 0.0)]))] == [0, 3.1416, 6.2832]


def test_critical_points_and_monotonicity():
    f = Curve("monomial", (0, -3, 0, 1), -2, 2)
    assert [(t.kind, round(t.x, 6), round(t.y, 6)) for t in ca.critical_points(f)] == [("maximum", -1, 2), ("minimum", 1, -2)]
    assert np.allclose(ca.monotonicity_violations(f), [-1, 1])
    assert ca.monotonicity_violations(Curve("monomial", (0, 0, 0, 1), -2, 2)) == []
    assert [t.kind for t in ca.critical_points(Curve("monomial", (0, 0, 0, 1), -2, 2))] == ["inflection"]
    assert np.allclose([t.x for t in ca.critical_points(f, search=True)], [-1, 1])


def test_algebra_keeps_degrees_and_signs():
    a, b = parse("x^2 - 4"), parse("-2 x^2 + x")
    assert (a + b).coefs == (-4, 1, -1)
    assert (a - a).coefs == (0,)
    assert (a * b).coefs == (0, -4, 8, 1, -2)
    assert (a * 2).coefs == (-8, 0, 2) and (a / 2).coefs == (-2, 0, 0.5)
    with pytest.raises(Unsupported):
        _ = a + Curve("chebyshev", (1,), 0, 1)


def test_energies_and_spectral_filter():
    f = Curve("legendre", (4.0, 2.0, 1.0, 0.01, 0.01), 0, 1)
    e = f.energies()
    assert np.allclose(e, [c * c * 2 / (2 * j + 1) for j, c in enumerate(f.coefs)])
    cut = f.spectral_filter()
    assert cut.coefs[0] == 4 and cut.k == f.k
    assert Curve("legendre", (3.0,), 0, 1).smoothness() == 0


def test_pruning_works_for_negative_coefficients():
    f = Curve("monomial", (5.0, -0.1, -3.0), 0, 1)
    assert f.pruned(np.array([0.1, 1.0, 0.1]), 2.0).coefs == (5.0, 0.0, -3.0)


def test_projection():
    f = Curve("chebyshev", (1, 2, -0.5, 0.25), 0, 10)
    x = np.linspace(0, 10, 21)
    for name in ("legendre", "monomial", "laguerre"):
        assert np.allclose(f.project(name)(x), f(x))
    assert np.allclose(f.project_orthogonal("legendre", 3)(x), f(x))


def test_domains():
    assert DomainMap.between((0, 10), (-1, 1))(5) == 0
    assert DomainMap.between((3, 9), (0, math.inf))(3) == 0
    assert DomainMap.between((3, 9), (-math.inf, 1))(9) == 1
    with pytest.raises(DegenerateDomain):
        DomainMap.between((2, 2), (0, 1))


def test_counts_of_coefficients():
    assert basis("fourier").k(3) == 7 and basis("linear_fourier").k(3) == 8
    with pytest.raises(WrongParameterCount):
        Curve("fourier", (1, 2), 0, 1)


def test_text():
    assert number(0.5) == "0.50" and number(1e5) == "1.00e5"
    assert variable("x", 2, 1) == "x₁²"
    assert equation(parse("x^2 - 1")) == "y(x) = x² - 1.00"
    assert equation(Curve("monomial", (0,), 0, 1)) == "y(x) = 0"
    assert scaling(Curve("fourier", (1, 1, 1), 0, 100)) == "xₛ = T[ 0..100 -> 0..2π ]"
    assert equation(Curve("logarithmic", (1, 2, 3), 1, 5)).endswith("3.00ln(x')² + 2.00ln(x') + 1.00")


def test_json_round_trip():
    f = Curve("legendre", (1.5, -2.0), 0, 3)
    assert Curve.from_json(f.to_json()) == f


def test_a_basis_of_ones_own(spark):
    from loomfit.operators.fit import fit

    class Roots(Basis):
        def vander(self, t, k):
            return np.stack([np.sqrt(np.abs(t)) ** j for j in range(k)], -1)

    df = spark.range(1, 200).selectExpr("cast(id as double) as x", "3 + 2 * sqrt(id) as y")
    f = fit(df, "x", "y", 1, Roots("roots"))
    assert np.allclose(f.curve.coefs, [3, 2])
