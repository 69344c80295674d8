import math
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from loomfit import functions as fn
from loomfit.operators import fit as ft
from loomfit.operators.plots import plot_fit
from loomfit.plans.model import Curve
from loomfit.sources import points_csv, points_json, points_memory, read_model, write_model, write_svg


def test_csv_with_and_without_heading(spark, tmp_path):
    (tmp_path / "a.csv").write_text("age, height\n1,2\n3, 4.5,note\n\n")
    (tmp_path / "b.csv").write_text("5,6\n7,8\n")
    assert sorted((r.x, r.y) for r in points_csv(spark, str(tmp_path)).collect()) == [(1, 2), (3, 4.5), (5, 6), (7, 8)]
    (tmp_path / "c.csv").write_text("1,2\nbroken,3\n")
    with pytest.raises(Exception, match="not a point"):
        points_csv(spark, str(tmp_path / "c.csv")).collect()


def test_json(spark, tmp_path):
    (tmp_path / "p.json").write_text("[[0, 1], [1, 3.5]]")
    assert [(r.ord, r.x, r.y) for r in points_json(spark, str(tmp_path / "p.json")).collect()] == [(0, 0, 1), (1, 1, 3.5)]


def test_models_and_drawings(spark, tmp_path):
    f = ft.fit(points_memory(spark, [(x, 1 + 2 * x + x * x) for x in range(10)]), "x", "y", 2)
    write_model(spark, f.curve, str(tmp_path / "m"))
    assert read_model(spark, str(tmp_path / "m")) == f.curve
    write_svg(plot_fit(f), str(tmp_path / "s"))
    assert "<svg" in spark.read.text(str(tmp_path / "s"), wholetext=True).first()[0]


def test_sql_functions(spark):
    fn.register(spark)
    m = Curve("monomial", (-4.0, 0.0, 1.0), -5, 5).to_json()
    spark.createDataFrame([(m, 3.0)], "m string, x double").createOrReplaceTempView("models")
    row = spark.sql("select curve_value(m, x) as v, curve_equation(m) as e, curve_derivative(m) as d, curve_integral(m) as i from models").first()
    assert row.v == 5 and row.e == "y(x) = x² - 4.00" and Curve.from_json(row.d).coefs == pytest.approx((0, 2)) and Curve.from_json(row.i)(3.0) == pytest.approx(-3)
    assert [r.re for r in spark.sql("select re from models, lateral curve_roots(m) order by re").collect()] == pytest.approx([-2, 2])
    assert spark.sql("select count(*) from models, lateral curve_range(m, 0D, 1D, 0.1D)").first()[0] == 11
    fit = spark.sql("select curve_fit(cast(id as double), 2.0D * id + 1, 1) as m from range(10)").first().m
    assert Curve.from_json(fit)(4.0) == pytest.approx(9)


def test_scalars(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (2.5,), (-3.0,), (float("nan"),), (None,)], "v double")
    got = [r[0] for r in df.select(fn.signum(F.col("v"))).collect()]
    assert got[:4] == [1, -1, 1, -1] and math.isnan(got[4]) and got[5] is None
    one = spark.range(1)
    assert one.select(fn.factorial(F.lit(5)), fn.binomial(F.lit(10), F.lit(3)), fn.binomial(F.lit(3), F.lit(5))).first() == (120, 120, 0)
    assert one.select(fn.clamped_int(F.lit(1e30)), fn.clamped_int(F.lit(float("nan"))), fn.clamp(F.lit(5.0), 0, 1)).first() == (2**31 - 1, 0, 1)


def test_command_line(tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("x,y\n" + "".join(f"{x},{1 + 2 * x}\n" for x in range(60)))
    out = subprocess.run([sys.executable, "-m", "loomfit", "rank", str(path), "--bound", "2"], capture_output=True, text=True, timeout=300)
    assert out.returncode == 0 and out.stdout.startswith("1. "), out.stderr[-500:]
