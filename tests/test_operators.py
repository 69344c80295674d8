import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomfit.errors import DegenerateDomain, NoData, OutOfRange, TooManyParameters
from loomfit.operators import fit as ft
from loomfit.operators import plots, stats
from loomfit.operators import predict as pr
from loomfit.operators import transforms as tr
from loomfit.operators.checks import Checks, all_close
from loomfit.operators.points import with_index
from loomfit.operators.ranking import rank_bases
from loomfit.operators.scores import Mae, Shape, score_of
from loomfit.plans.model import Curve, parse


def series(spark, xs, f):
    return spark.createDataFrame([(i, float(x), float(f(x))) for i, x in enumerate(xs)], "ord long, x double, y double")


@pytest.fixture(scope="module")
def wavy(spark):
    rng = np.random.default_rng(3)
    return series(spark, np.linspace(0, 10, 400), lambda x: 1 + 2 * x - 0.3 * x * x + rng.normal(0, 0.2))


@pytest.mark.parametrize("family", ["monomial", "chebyshev", "chebyshev_u", "chebyshev_v", "legendre", "hermite", "hermite_e", "laguerre", "logarithmic"])
def test_fit_recovers_coefficients(spark, family):
    c = Curve(family, (1.0, 2.0, -0.5), 0.0, 100.0)
    got = ft.fit(series(spark, range(101), c), "x", "y", 2, family).curve
    assert np.allclose(got.coefs, c.coefs, rtol=1e-7, atol=1e-7)


@pytest.mark.parametrize("family, coefs", [("fourier", (1, 0.6, 3, -0.5, 2)), ("linear_fourier", (1, 0.6, 3, -0.5, 2, 1)), ("fourier_2", (1, 0.6, 0.01, 3, -0.5)), ("fourier_3", (1, 0.6, 0.01, 1e-4, 3, -0.5))])
def test_fit_recovers_waves(spark, family, coefs):
    c = Curve(family, tuple(map(float, coefs)), 0.0, 100.0)
    got = ft.fit(series(spark, range(101), c), "x", "y", c.degree, family).curve
    assert np.allclose(got.coefs, c.coefs, rtol=1e-6, atol=1e-6)


def test_fit_equals_numpy_where_powers_are_ill_conditioned(spark):
    x = 1e6 + np.arange(300)
    df = series(spark, x, lambda v: math.sin(v / 30))
    f = ft.fit(df, "x", "y", 9)
    want = np.polynomial.Chebyshev.fit(x, np.sin(x / 30), 9)
    assert np.allclose(f.curve(x), want(x), atol=1e-9)
    rows = pr.with_fit(df, f.curve, "x").select("x", "y_fit").collect()
    assert np.allclose([r.y_fit for r in rows], [want(r.x) for r in rows], atol=1e-6)


def test_nulls_and_nans_take_no_part(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 3.0), (2.0, 5.0), (None, 9.0), (3.0, None), (4.0, float("nan")), (float("inf"), 1.0)], "x double, y double")
    f = ft.fit(df, "x", "y", 1)
    assert f.n == 3 and np.allclose(f.curve.as_monomial().coefs, (1, 2))


def test_errors(spark):
    empty = spark.createDataFrame([], "x double, y double")
    with pytest.raises(NoData):
        ft.fit(empty, "x", "y", 1)
    with pytest.raises(TooManyParameters):
        ft.fit(series(spark, range(3), float), "x", "y", 3)
    with pytest.raises(DegenerateDomain):
        ft.fit(series(spark, [2, 2, 2], float), "x", "y", 1)


@pytest.mark.parametrize("n, bound, want", [(4, "relaxed", 0), (100, "relaxed", 4), (168, "relaxed", 5), (1000, "relaxed", 9), (60000, "relaxed", 15), (1000, 12, 12), (5, 12, 4), (1000, "conservative", 3), (100, "aggressive", 11)])
def test_degree_bounds(n, bound, want):
    assert ft.degree_cap(n, bound) == want


def test_fold_counts():
    assert [ft.fold_count(50, s) for s in ("variance", "bias", "balanced", "leave_one_out", 4)] == [5, 10, 7, 50, 4]


@pytest.mark.parametrize("score", ["aic", "bic"])
def test_auto_degree(wavy, score):
    assert ft.fit_auto(wavy, "x", "y", "relaxed", score).degree == 2


def test_auto_takes_the_lowest_degree_within_the_distance(spark):
    assert ft.fit_auto(series(spark, range(40), lambda x: 7.0), "x", "y").degree == 0


def test_kfold_equals_refits_by_numpy(wavy):
    f = ft.fit_kfold(wavy, "x", "y", 5, 4, "rmse")
    rows = np.array(sorted((r.x, r.y) for r in wavy.collect()))
    fold = np.minimum(np.arange(len(rows)) // (len(rows) // 5), 4)
    mean = []
    for d in range(5):
        err = []
        for k in range(5):
            p = np.polynomial.Chebyshev.fit(*rows[fold != k].T, d)
            err.append(np.sqrt(np.mean((rows[fold == k, 1] - p(rows[fold == k, 0])) ** 2)))
        mean.append(np.mean(err))
    assert f.degree == int(np.argmin(mean))


def test_robust_scores_of_folds_do_not_depend_on_how_medians_are_taken(wavy, monkeypatch):
    from loomfit.operators.scores import Aic

    a = ft.fit_kfold(wavy, "x", "y", 5, 4, "aic")
    monkeypatch.setattr(Aic, "rows_in_memory", 10)
    b = ft.fit_kfold(wavy, "x", "y", 5, 4, "aic")
    assert a.degree == b.degree and a.curve == b.curve


@pytest.mark.parametrize("family", ["chebyshev", "logarithmic", "fourier"])
def test_leaving_one_out_equals_refits(spark, family):
    rng = np.random.default_rng(8)
    df = series(spark, np.linspace(1, 9, 40), lambda x: 2 + math.sin(x) + rng.normal(0, 0.1))
    f = ft.fit_kfold(df, "x", "y", "leave_one_out", 3, "mae", family)
    rows = np.array([(r.x, r.y) for r in df.collect()])
    fam = f.curve.family
    dom, mean = fam.domain(1, 9), []
    for d in range(ft.degree_cap(39, 3) + 1):
        a, err = fam.design(rows[:, 0], fam.k(d), dom), []
        for i in range(40):
            c = np.linalg.lstsq(np.delete(a, i, 0), np.delete(rows[:, 1], i), rcond=None)[0]
            err.append(abs(rows[i, 1] - a[i] @ c))
        mean.append(np.mean(err))
    assert f.degree == int(np.argmin(mean))
    assert ft.fit_kfold(df, "x", "y", "leave_one_out", 3, Shape(curvature=1e6), family).degree <= f.degree if family == "chebyshev" else True


def test_shape_constraint_prefers_a_rising_curve(spark):
    df = series(spark, np.linspace(0, 6, 200), lambda x: x + 1.5 * math.sin(2 * x))
    free = ft.fit_auto(df, "x", "y", 9, "rmse")
    held = ft.fit_auto(df, "x", "y", 9, Shape(monotonic="strict", direction="increasing"))
    assert held.degree < free.degree
    assert ft.fit_auto(df, "x", "y", 3, Mae()).degree >= 0


def test_weighted_fit():
    c = ft.fit_weighted(np.sin, 0, 3, 11, "legendre")
    x = np.linspace(0, 3, 50)
    assert np.allclose(c(x), np.sin(x), atol=1e-9)


def test_groups_equal_single_fits(spark):
    rows = [(g, float(x), float(a + b * x + 0.1 * x * x)) for g, a, b in (("a", 1, 2), (None, 3, -1)) for x in range(20)]
    rows += [("flat", 1.0, 1.0), ("flat", 1.0, 2.0), ("flat", 1.0, 3.0), ("few", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r.g: r for r in ft.fit_groups(df, ["g"], "x", "y", 2).collect()}
    assert got["flat"].error == "DegenerateDomain" and got["few"].error == "TooManyParameters" and got["few"].coefficients is None
    for g in ("a", None):
        own = ft.fit(df.where(F.col("g").eqNullSafe(F.lit(g))), "x", "y", 2)
        assert np.allclose(got[g].coefficients, own.curve.coefs)
    out = ft.predict_groups(df, ft.fit_groups(df, ["g"], "x", "y", 2), ["g"], "x").collect()
    assert all(r.y_fit is None if r.g in ("flat", "few") else abs(r.y_fit - r.y) < 1e-9 for r in out) and len(out) == len(rows)


def test_covariance_and_band(wavy):
    f = ft.fit(wavy, "x", "y", 2)
    x = np.array([r.x for r in wavy.collect()])
    a = f.curve.family.design(x, 3, f.curve.domain)
    want = np.linalg.inv(a.T @ a) * f.rss / (f.n - 3)
    assert np.allclose(pr.covariance(f), want, rtol=1e-6)
    assert pr.prediction_variance(f, 4.0) == pytest.approx(float((p := f.curve.family.design(np.array([4.0]), 3, f.curve.domain)[0]) @ want @ p))
    row = wavy.select(pr.band(f, F.lit(4.0)).alias("b")).first().b
    assert row.upper - row.value == pytest.approx(1.959 * math.sqrt(pr.prediction_variance(f, 4.0)))
    assert wavy.select(pr.band(f, F.lit(99.0)).alias("b")).first().b is None


def test_student_and_normal_scores():
    assert pr.t_score(0.95, 1) == 12.706 and pr.t_score(0.95, 29) == 2.045 and pr.t_score(0.95, 30) == pr.z_score(0.95) == 1.959
    assert pr.t_score(0.95, 0) == math.inf and pr.z_score(2.5) == 2.5 and pr.alpha(0.9) == pytest.approx(0.1)
    assert pr.Uncertain.of([1, 2, 3]).band(0.95)[0] == pytest.approx(2 - 1.959 * math.sqrt(2 / 3))


def test_texts_of_results():
    from loomfit.plans.calculus import Root, Turn

    assert str(pr.Uncertain(2, 0.5)) == "2 ± 0.5" and str(Turn("minimum", 1, -2)) == "minimum at (1, -2)"
    assert str(Root("real", 1.5, 0)) == "1.5" and str(Root("complex_pair", -1, 2)) == "-1 ± 2i"


def test_guarded_prediction(wavy):
    f = ft.fit(wavy, "x", "y", 2)
    with pytest.raises(OutOfRange):
        pr.predict(f.curve, 11)
    far = wavy.sparkSession.createDataFrame([(5.0,), (50.0,), (None,)], "x double")
    assert [r.y_fit is None for r in pr.with_fit(far, f.curve, "x", guard="null").collect()] == [False, True, True]
    with pytest.raises(Exception, match="outside"):
        pr.with_fit(far, f.curve, "x", guard="error").collect()


def test_stepped_range_is_by_products(spark):
    assert pr.stepped(spark, 0, 1, 0.1).count() == 11
    assert pr.stepped(spark, 2, 1).count() == 0


def test_metrics_on_edges(spark):
    def of(rows, k=1):
        return stats.residual_metrics(spark.createDataFrame(rows, "y double, f double"), F.col("y"), F.col("f"), k).first()

    y = [0.5, -1.25, 4.0, 7.5]
    assert of([(v, v) for v in y]).r_squared == 1
    assert of([(v, sum(y) / 4) for v in y]).r_squared == pytest.approx(0)
    far = [(v, -3.0) for v in y]
    assert of(far).r_squared == pytest.approx(1 - sum((v + 3) ** 2 for v in y) / sum((v - sum(y) / 4) ** 2 for v in y))
    assert of([(6.5, 6.5)] * 3).r_squared is None
    assert of([(6.5, 1.0)]).residual_variance == 0
    empty = of([])
    assert empty.n == 0 and empty.mae is None and empty.normality == 1


def test_exact_medians_by_narrowing(spark):
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=5000), 2)
    df = spark.createDataFrame([(float(a), float(a * a)) for a in v], "a double, b double")
    assert stats.medians(df, [F.col("a"), F.col("b")], 5000, gather=200) == pytest.approx([np.median(v), np.median(v * v)])


def test_index_over_many_buckets(spark):
    df = spark.range(1000).withColumn("k", F.expr("id div 3"))
    rows = with_index(df, "k", "id", rows_a_bucket=100).collect()
    assert sorted((r.id, r._i) for r in rows) == [(i, i) for i in range(1000)]


def test_smoothing_against_numpy(spark):
    v = np.random.default_rng(8).normal(size=40).round(3)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "x long, y double")
    avg = [r.y for r in tr.moving_average(df, 5, ["x"]).orderBy("x").collect()]
    assert np.allclose(avg, [v[max(0, i - 2) : i + 3].mean() for i in range(40)])
    g = np.exp(-0.5 * (np.arange(-6, 7) / 2.0) ** 2)
    longer = np.concatenate([np.full(6, v[0]), v, np.zeros(6)])
    smooth = [r.y for r in tr.gaussian_smooth(df, 2.0, ["x"]).orderBy("x").collect()]
    assert np.allclose(smooth, [longer[i : i + 13] @ g / g.sum() for i in range(40)])
    assert tr.moving_average(df, 0, ["x"]).count() == 40
    holed = df.withColumn("y", F.when(F.col("x") != 20, F.col("y")))
    got = [r.y for r in tr.gaussian_smooth(holed, 1.0, ["x"]).orderBy("x").collect()]
    assert [i for i, y in enumerate(got) if y is None] == list(range(17, 24))


@pytest.mark.parametrize("rho", [0.3, -0.8, 0.9, 0.9995, 1.0, -1.0, 1e-9])
def test_correlated_noise_is_the_recursion(spark, rho):
    df = spark.range(3000).selectExpr("id", "1.5D as y")
    got = [r.y for r in tr.correlated_noise(df, tr.Strength(2.0), rho, ["id"], 11).orderBy("id").collect()]
    e = [r.e for r in df.select("id", tr.normal_of(11, F.col("id")).alias("e")).orderBy("id").collect()]
    state, want = 0.0, []
    for i, x in enumerate(e):
        state = rho * state + x * (1 if i == 0 else math.sqrt(1 - rho * rho))
        want.append(1.5 + 2 * state)
    assert np.allclose(got, want, atol=1e-9)


def test_draws_at_the_edges_of_their_parameters(spark):
    df, k = spark.range(20000), F.col("id")
    draws = {
        "none": (tr.poisson_of(0.0, 1, k), 0, 0), "some": (tr.poisson_of(30.5, 1, k), 30.5, 30.5), "many": (tr.poisson_of(1e6, 1, k), 1e6, 1e6),
        "poles": (tr.beta_of(0.3, 0.5, 1, k), 0.375, 0.3 * 0.5 / (0.8**2 * 1.8)), "whole": (tr.beta_of(2.0, 5.0, 1, k), 2 / 7, 10 / (49 * 8)), "odd": (tr.beta_of(2.5, 1.5, 1, k), 0.625, 3.75 / (16 * 5)),
    }
    got = df.agg(*[f(c).alias(f"{n}_{f.__name__}") for n, (c, *_) in draws.items() for f in (F.avg, F.var_pop)]).first()
    for n, (_, mean, var) in draws.items():
        assert got[f"{n}_avg"] == pytest.approx(mean, abs=5 * math.sqrt(var / 20000) + 1e-12)
        assert got[f"{n}_var_pop"] == pytest.approx(var, rel=0.06, abs=1e-12)
    for bad in (lambda: tr.poisson_of(-1.0, 1, k), lambda: tr.beta_of(0.0, 1.0, 1, k), lambda: tr.correlated_noise(df, tr.Strength(1.0), 1.5, ["id"])):
        with pytest.raises(ValueError):
            bad()


def test_smoothing_in_blocks_equals_one_window(spark):
    df = spark.range(500).selectExpr("id as x", "sin(id / 7.0) as y")
    whole = tr._windowed(df, ["x"], (), 3, lambda w, _: F.avg("y").over(w.rowsBetween(-3, 3)))
    cut = tr._windowed(df, ["x"], (), 3, lambda w, _: F.avg("y").over(w.rowsBetween(-3, 3)), block=20)
    a, b = (sorted((r.x, r._v) for r in t.collect()) for t in (whole, cut))
    assert np.allclose(a, b) and len(b) == 500


def test_counting_cuts_below(spark):
    from loomfit.operators.points import below

    for n in (1, 2, 5, 9, 10, 37):
        cuts = [3 * i + 1 for i in range(n)]
        rows = spark.range(-2, 3 * n + 4).select("id", below(F.col("id"), cuts, "long").alias("b")).collect()
        assert all(r.b == sum(c < r.id for c in cuts) for r in rows)


def test_a_long_key_is_cut_into_blocks(spark):
    df = spark.range(900).selectExpr("id as x", "if(id % 3 = 0, 'hot', if(id % 5 = 0, null, 'b')) as k", "sin(id / 7.0) as y")
    whole = tr._windowed(df, ["x"], ["k"], 2, lambda w, _: F.avg("y").over(w.rowsBetween(-2, 2)))
    cut = tr._windowed(df, ["x"], ["k"], 2, lambda w, _: F.avg("y").over(w.rowsBetween(-2, 2)), block=25)
    plain = df.withColumn("_v", F.expr("avg(y) over (partition by k order by x rows between 2 preceding and 2 following)"))
    a, b, c = (sorted((r.x, round(r._v, 12)) for r in t.collect()) for t in (whole, cut, plain))
    assert a == b == c
    many = {(r.k, r.x): r._i for r in with_index(df, "x", rows_a_bucket=100, keys=["k"]).collect()}
    few = {(r.k, r.x): r._i for r in with_index(df, "x", keys=["k"]).collect()}
    assert many == few and len(many) == 900


def test_medians_of_columns_with_few_values(spark):
    df = spark.range(5000).selectExpr("cast(id % 2 as double) as a", "1.0D as b", "cast(id as double) as c")
    assert stats.medians(df, [F.col("a"), F.col("b"), F.col("c")], gather=300) == [0.5, 1.0, 2499.5]
    assert stats.medians(df.where("id < 0"), [F.col("a")]) == [0.0]


def test_quantiles_by_narrowing(spark):
    rng = np.random.default_rng(6)
    v = np.round(rng.normal(size=3001), 3)
    df = spark.createDataFrame([(float(a),) for a in v] + [(None,)], "v double")
    for p in (0.05, 0.5, 0.95, 1.0):
        want = np.sort(v)[max(0, math.ceil(p * len(v)) - 1)]
        assert stats.quantile(df, F.col("v"), p) == stats.quantile(df, F.col("v"), p, gather=100) == want
    assert stats.quantile(df.where("v > 1e9"), F.col("v"), 0.5) is None


def test_normalising(spark):
    v = np.array([-3.5, 0.25, 11.0, 4.75])
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "x long, y double")
    got = lambda t, c="y": [r[c] for r in t.orderBy("x").collect()]
    assert np.allclose(got(tr.standardize(df)), (v - v.mean()) / v.std())
    assert np.allclose(got(tr.center(df)), v - v.mean())
    assert np.allclose(got(tr.domain(df, -4, 6, "y")), -4 + 10 * (v + 3.5) / 14.5)
    assert got(tr.clip(df, 0, 5)) == [0, 0.25, 5, 4.75]


@pytest.mark.parametrize("kind, a", [("identity", 1.0), ("shift", -1.75), ("linear", 0.3), ("quadratic", 2.2), ("sqrt", 0.7), ("cubic", 1.9), ("cbrt", 3.1), ("exponential", 2.4), ("logarithmic", 7.0)])
def test_scale_and_inverse(spark, kind, a):
    s = tr.Scale(kind, a)
    values = [0.05, 1.0, 3.3, 17.2]
    df = spark.createDataFrame([(v,) for v in values], "y double")
    assert sorted(r.y for r in tr.scale(df, s, s.inverse()).collect()) == pytest.approx(values)


@pytest.mark.parametrize("noise, mean, sd", [
    (lambda d: tr.normal_noise(d, tr.Strength(1.0), ["id"], 42), 2.0, 1.0),
    (lambda d: tr.correlated_noise(d, tr.Strength(1.0), 0.5, ["id"], 42), 2.0, 1.0),
    (lambda d: tr.uniform_noise(d, 1.0, 1.0, ["id"], 42), 2.0, 0.577),
    (lambda d: tr.poisson_noise(d, 4.0, tr.Strength(1.0), ["id"], 42), 2.0, 2.0),
    (lambda d: tr.salt_and_pepper(d, 1.0, 0.0, 4.0, ["id"], 42), 2.0, 2.0),
    (lambda d: tr.impulse_noise(d, 1.0, 0.0, 4.0, 2.0, 2.0, ["id"], 42), 2.0, 0.894),
])
def test_noise_moments_and_repeatability(spark, noise, mean, sd):
    df = spark.range(20000).selectExpr("id", "2.0D as y")
    a = noise(df)
    got = a.agg(F.avg("y"), F.stddev_pop("y")).first()
    assert got[0] == pytest.approx(mean, abs=0.06) and got[1] == pytest.approx(sd, rel=0.05)
    b = noise(df.repartition(7))
    assert a.agg(F.sum(F.hash("id", F.round("y", 9)).cast("long"))).first() == b.agg(F.sum(F.hash("id", F.round("y", 9)).cast("long"))).first()


def test_ranking_prefers_the_true_family(spark):
    c = Curve("fourier", (0.5, 1.0, 2.0, 4.0, 8.0), 0, 100)
    df = series(spark, np.arange(0, 100.01, 0.5), c)
    rows = rank_bases(df, "x", "y", bound=4).collect()
    assert rows[0].basis == "fourier" and len(rows) == 7
    assert sum(r.weight for r in rows) == pytest.approx(1)
    same = {r.basis: Curve.from_json(r.model) for r in rows if r.basis in ("chebyshev", "legendre", "laguerre")}
    x = np.linspace(0, 100, 11)
    assert np.allclose(same["chebyshev"](x), same["legendre"](x)) and np.allclose(same["chebyshev"](x), same["laguerre"](x), atol=1e-5)


def jobs_of(spark, run):
    sc = spark.sparkContext
    group = f"jobs-{id(run)}"
    sc.setJobGroup(group, "")
    try:
        return run(), len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_ranks_take_few_passes(spark):
    """Bins around a rank narrow a column by more than a thousandth in one pass."""
    df = spark.range(0, 200_000, 1, 4).select((F.pow(F.col("id") * 7919 % 200_003, 2) - 5e9).alias("a"), F.when(F.col("id") % 3 > 0, 0.0).otherwise(F.col("id").cast("double")).alias("b"))
    v = np.arange(200_000)
    want = [np.median((v * 7919 % 200_003).astype(float) ** 2 - 5e9), np.median(np.where(v % 3 > 0, 0.0, v))]
    got, jobs = jobs_of(spark, lambda: stats.medians(df, [F.col("a"), F.col("b")], 200_000, gather=300))
    assert got == want and jobs <= 5


def test_ranks_without_a_useful_sample(spark):
    """Even steps over the doubles find ranks that the sampled values miss, at the ends too."""
    v = np.array([-math.inf] * 3 + [-1e300, -1.0, -0.0, 0.0, 5e-324, 1e-9, 2.0] * 100 + [math.inf] * 3 + [math.nan])
    df = spark.createDataFrame([(float(a),) for a in v], "a double")
    told, empty = np.sort(v), df.limit(0).toArrow()
    for r in (0, 250, 703):
        assert stats.ranked(df, stats.columns_of, 1, len(v), (r, r), empty, gather=5) == [told[r]]


@pytest.mark.parametrize("family", ["chebyshev", "logarithmic", "fourier", "fourier_2", "hermite"])
def test_scores_are_those_of_the_columns(spark, family):
    """Batches give the errors that a column expression gives."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(rng.uniform(3, 50, 999), rng.normal(size=999))], "_x double, _y double")
    curves = [Curve(family, tuple(rng.normal(size=k)), 3.0, 50.0) for k in ((5, 7) if family == "fourier_2" else (1, 3, 5))]
    for c, s, m in zip(curves, score_of("aic").scores(df, curves, 999), score_of("mae").scores(df, curves, 999)):
        r = [abs(x[0]) for x in df.select(F.col("_y") - c.column(F.col("_x"))).collect()]
        mad = np.median(np.abs(np.array(r) - np.median(r)))
        assert m == pytest.approx(np.mean(r), rel=1e-9)
        assert s == pytest.approx(999 * math.log(stats.huber_loss(np.array(r), stats.HUBER * mad).mean()) + 2 * c.k, rel=1e-9)


def test_ranking_deals_rows_over_all_cores(spark, tmp_path):
    """A file of one group of rows is one task of a scan, but not of each pass."""
    spark.range(0, 2000, 1, 1).selectExpr("id as x", "id * 0.5D + id % 7 as y").write.parquet(str(tmp_path / "t"))
    from loomfit.operators.points import points, spread_rows

    pts = points(spark.read.parquet(str(tmp_path / "t")), "x", "y")
    sizes = [r[0] for r in spread_rows(pts, 2000).groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert pts.rdd.getNumPartitions() == 1 and len(sizes) >= spark.sparkContext.defaultParallelism and max(sizes) < 600


def test_checks(wavy):
    f = ft.fit(wavy, "x", "y", 2)
    c = Checks(f).r_squared(0.9).residuals_normal(0.01).residuals_normal(0.01, strict=True).max_residual(1.0).matches(parse("-0.3 x^2 + 2 x + 1")).value_at(0.0, f.curve(0.0))
    assert all(r.passed for r in c.rows().collect())
    c.require()
    with pytest.raises(AssertionError):
        Checks(f).r_squared(0.9999).require()
    assert all_close(wavy, F.col("y"), F.col("y")).first().passed


def test_plot(wavy):
    f = ft.fit(wavy, "x", "y", 2)
    p = plots.plot_fit(f)
    assert {r.kind for r in p.select("kind").distinct().collect()} == {"fit", "data"}
    assert 90 <= p.where("kind = 'data'").count() <= 210
    assert plots.svg(p).endswith("</svg>")
    assert plots.plot_residuals(f).count() > 0


def test_plans_stay_in_the_jvm(wavy, spark, tmp_path):
    """A fit reads two columns and aggregates before its only exchange."""
    wide = wavy.withColumn("other", F.lit("text"))
    wide.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    from loomfit.operators import moments as mm
    from loomfit.operators.points import points
    from loomfit.plans.bases import basis

    plan = mm.moment_sums(points(df, "x", "y"), basis("chebyshev"), 5, 0.0, 10.0)._jdf.queryExecution().executedPlan().toString()
    assert "other" not in plan and "Python" not in plan and plan.count("Exchange") == 1
