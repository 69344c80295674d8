"""Calculus and algebra of fitted and given curves."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import register
from ..operators import fit as ft
from ..operators import predict as pr
from ..plans import calculus as ca
from ..plans.display import equation
from ..plans.model import Curve, fourier, parse
from .fits import PART
from .registry import fit_sql, powers, query, rounded, rows_sql, table

#: In t, the fit is c0 + c1 (t - w1_0) + c2 (t^2 - w2_0 - w2_1 (t - w1_0)).
_BEND = ",\np as (select *, c1 - c2 * w2_1 as b, c0 - c1 * w1_0 - c2 * (w2_0 - w2_1 * w1_0) as a from (select distinct lo, hi, c0, c1, c2 from f), w1, w2)\n"
_PARABOLA = fit_sql(PART, powers(2)) + _BEND
_SUPPLIER = fit_sql(rows_sql("supplier", "s_suppkey", "s_acctbal"), powers(2)) + _BEND


def _parabola(spark, d):
    return ft.fit(table(spark, d, "part"), "p_partkey", "p_retailprice", 2)


def _supplier(spark, d):
    return ft.fit(table(spark, d, "supplier"), "s_suppkey", "s_acctbal", 2).curve


@query(_PARABOLA + "select p_partkey, round((p.b + 2 * p.c2 * f.t) * 2 / (p.hi - p.lo), 8) as slope, round(2 * p.c2 * 4 / pow(p.hi - p.lo, 2), 12) as bend from f, p")
def derivatives_part(spark, d):
    f = _parabola(spark, d)
    slope = ca.derivative(f.curve)
    rows = f.data.select("p_partkey")
    x = F.col("p_partkey").cast("double")
    return rows.select("p_partkey", F.round(slope.column(x), 8).alias("slope"), F.round(ca._second(f.curve).column(x), 12).alias("bend"))


@query(_SUPPLIER + "select round((hi - lo) / 2 * (2 * a + 2 * c2 / 3), 3) as area from p")
def area_supplier(spark, d):
    c = _supplier(spark, d)
    return rounded(spark.createDataFrame([(ca.area(c, *c.x_range),)], "area double"), 3, "area")


@query(_SUPPLIER + ", v as (select lo + (1 - b / (2 * c2)) * (hi - lo) / 2 as x, a - b * b / (4 * c2) as y, c2, lo, hi from p) select case when c2 > 0 then 'minimum' else 'maximum' end as kind, round(x, 4) as x, round(y, 4) as y from v where x between lo and hi")
def critical_points_supplier(spark, d):
    found = ca.critical_points(_supplier(spark, d))
    return rounded(spark.createDataFrame([(t.kind, t.x, t.y) for t in found], "kind string, x double, y double"), 4, "x", "y")


@query(_SUPPLIER + ", v as (select lo + (1 - b / (2 * c2)) * (hi - lo) / 2 as x, lo, hi from p) select round(x, 4) as x from v where x > lo and x < hi")
def monotonicity_supplier(spark, d):
    return rounded(spark.createDataFrame([(x,) for x in ca.monotonicity_violations(_supplier(spark, d))], "x double"), 4, "x")


@query("select curve, kind, re::double as re, im::double as im from (values ('parabola', 'real', -2.5, 0.0), ('parabola', 'real', 1.0, 0.0), ('no real', 'complex_pair', -1.0, 2.0), ('cubic', 'real', -1.0, 0.0), ('cubic', 'real', 0.0, 0.0), ('cubic', 'real', 1.0, 0.0), ('wave', 'real', 0.5, 0.0), ('wave', 'real', 0.833333, 0.0)) t(curve, kind, re, im)")
def curve_roots(spark, d):
    curves = {
        "parabola": Curve("monomial", parse("2 x^2 + 3 x - 5").coefs, -10, 10),
        "no real": Curve("monomial", parse("x^2 + 2 x + 5").coefs, -10, 10),
        "cubic": Curve("chebyshev", (0.0, -0.25, 0.0, 0.25), -1, 1),
        "wave": fourier((0.0, 1.0), 0.5, [(math.sqrt(3) / 2, 0.5)]),
    }
    rows = [(name, r.kind, r.re, r.im) for name, c in curves.items() for r in ca.roots(c)]
    out = rounded(spark.createDataFrame(rows, "curve string, kind string, re double, im double"), 6, "re", "im")
    return out.withColumns({c: F.col(c) + F.lit(0.0) for c in ("re", "im")})


@query("select kind, x::double as x, y::double as y from (values ('maximum', -1.0, 2.0), ('minimum', 1.0, -2.0)) t(kind, x, y)")
def sql_table_functions(spark, d):
    """Turning points through the table function registered for SQL."""
    register(spark)
    model = Curve("monomial", (0.0, -3.0, 0.0, 1.0), -5, 5).to_json().replace("'", "\\'")
    return rounded(spark.sql(f"select kind, x, y from curve_turns('{model}')"), 6, "x", "y")


@query("select * from (values ('y(x) = 2.00x² + 3.00x - 5.00'), ('xₛ = T[ 0..10 -> -1..1 ], y(x) = -0.50T₂(xₛ) + 2.00T₁(xₛ) + 1.00')) t(equation)")
def equations(spark, d):
    rows = [(equation(parse("2 x^2 + 3 x - 5")),), (equation(Curve("chebyshev", (1.0, 2.0, -0.5), 0, 10)),)]
    return spark.createDataFrame(rows, "equation string")


@query("select i::int as i, round(e, 8) as energy, round(sum(i * i * e) over () / sum(e) over (), 8) as smoothness from (select i, power([1.0, 2.0, -0.5][i + 1], 2) * (case when i = 0 then pi() else pi() / 2 end) as e from range(0, 3) t(i))")
def energies_chebyshev(spark, d):
    c = Curve("chebyshev", (1.0, 2.0, -0.5), 0, 100)
    rows = [(i, float(e), c.smoothness()) for i, e in enumerate(c.energies())]
    return rounded(spark.createDataFrame(rows, "i int, energy double, smoothness double"), 8, "energy", "smoothness")


@query(fit_sql(PART, powers(3)) + "\nselect p_partkey, round(fit3, 4) as monomial, round(fit3, 4) as projected, round(fit3, 4) as orthogonal from f")
def changes_of_family_part(spark, d):
    """One cubic in powers of x, as Hermite functions, and by Gauss quadrature."""
    f = ft.fit(table(spark, d, "part"), "p_partkey", "p_retailprice", 3, "legendre")
    x = F.col("p_partkey").cast("double")
    out = f.data.select("p_partkey", f.curve.as_monomial().column(x).alias("monomial"), f.curve.project("laguerre").column(x).alias("projected"), f.curve.project_orthogonal("chebyshev", 3).column(x).alias("orthogonal"))
    return rounded(out, 4, "monomial", "projected", "orthogonal")


@query("select (i / 4.0)::double as x, round(pow(i / 4.0, 3) + pow(i / 4.0, 2) - 4 * (i / 4.0) - 4, 6) as product, round(pow(i / 4.0, 2) + i / 4.0 - 3, 6) as total, round(pow(i / 4.0, 2) - i / 4.0 - 5, 6) as apart from range(-8, 9) t(i)")
def algebra_of_curves(spark, d):
    a, b = parse("x^2 - 4"), parse("x + 1")
    x = F.col("x")
    return rounded(pr.stepped(spark, -2, 2, 0.25).select("x", (a * b).column(x).alias("product"), (a + b).column(x).alias("total"), (a - b).column(x).alias("apart")), 6, "product", "total", "apart")


@query()
def spectral_filter_part(spark, d):
    f = ft.fit(table(spark, d, "part"), "p_partkey", "p_retailprice", 9)
    return pr.with_fit(f.data.select("p_partkey"), f.curve.spectral_filter(), "p_partkey", "smooth")


@query("select (i / 10.0)::double as x, round(sin(i / 10.0), 6) as integral from range(0, 64) t(i) where i / 10.0 <= 2 * pi()")
def fourier_integral(spark, d):
    c = ca.integral(fourier((0.0, 2 * math.pi), 0.0, [(0.0, 1.0)]))
    rows = pr.stepped(spark, 0, 2 * math.pi, 0.1)
    return rounded(rounded(rows.select("x", (c.column(F.col("x")) - c.coefs[0]).alias("integral")), 6, "integral"), 1, "x")
