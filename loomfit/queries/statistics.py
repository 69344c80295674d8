"""Aggregates: error measures, robust measures, moments, normality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fit as ft
from ..operators import stats
from ..operators.points import as_double
from .fits import PART
from .registry import fit_sql, powers, query, rounded, rows_sql, table

_METRICS = """select {keys}count(*) as n, round(avg(abs(r)), 4) as mae, round(avg(r * r), 2) as mse, round(sqrt(avg(r * r)), 4) as rmse, round(sum(r * r) / (count(*) - {k}), 2) as residual_variance,
  round(1 - sum(r * r) / (var_pop(y) * count(*)), 8) as r_squared,
  round((1 - sum(r * r) / (var_pop(y) * count(*))) - (sum(r * r) / (var_pop(y) * count(*))) * {k}.0 / (count(*) - {k}), 8) as adjusted_r_squared,
  round(max(abs(r)), 4) as max_residual
from ({rows}) {group}"""


def _measured(df):
    return rounded(rounded(rounded(df, 4, "mae", "rmse", "max_residual"), 2, "mse", "residual_variance"), 8, "r_squared", "adjusted_r_squared").drop("skewness", "kurtosis", "normality")


@query(fit_sql(rows_sql("lineitem", "l_quantity", "l_extendedprice"), powers(2)) + ",\nz as (select y, y - fit2 as r from f)\n" + _METRICS.format(keys="", k=3, rows="select * from z", group=""))
def metrics_lineitem(spark, d):
    f = ft.fit(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 2)
    return _measured(stats.residual_metrics(f.points(), F.col("_y"), f.curve.column(F.col("_x")), f.k))


@query("with a as (select event_type, value as y, avg(value) over (partition by event_type) as m from events), z as (select event_type, y, y - m as r from a)\n" + _METRICS.format(keys="event_type, ", k=1, rows="select * from z", group="group by event_type"))
def metrics_by_event_type(spark, d):
    e = table(spark, d, "events").select("event_type", "value")
    means = e.groupBy("event_type").agg(F.avg("value").alias("m"))
    return _measured(stats.residual_metrics(e.join(means, "event_type"), F.col("value"), F.col("m"), 1, ["event_type"]))


@query(fit_sql(PART, powers(1)) + """,
r as (select y - fit1 as r from f),
m as (select median(abs(r)) as med, median(r * r) as med2 from r),
a as (select median(abs(abs(r) - med)) as mad, median(pow(r * r - med2, 2)) as msd from r, m),
h as (select sum(case when abs(r) <= 1.345 * mad then r * r / 2 else 1.345 * mad * (abs(r) - 1.345 * mad / 2) end) as loss, count(*) as n, sum(r * r) as sse from r, a)
select round(med, 6) as median_abs, round(mad, 6) as mad, round(loss / n, 4) as huber, round(1 - loss / sse, 8) as robust_r_squared, round(msd, 2) as median_squared_deviation from h, m, a""")
def robust_metrics_part(spark, d):
    f = ft.fit(table(spark, d, "part"), "p_partkey", "p_retailprice", 1)
    m = stats.robust_metrics(f.points(), F.col("_y") - f.curve.column(F.col("_x")))
    df = spark.createDataFrame([tuple(m.values())], ", ".join(f"{k} double" for k in m))
    return rounded(rounded(rounded(rounded(df, 6, "median_abs", "mad"), 4, "huber"), 8, "robust_r_squared"), 2, "median_squared_deviation")


@query("""with c as (select event_type, value as v, avg(value) over (partition by event_type) as m from events),
s as (select event_type, count(*) as n, avg(pow(v - m, 2)) as m2, avg(pow(v - m, 3)) as m3, avg(pow(v - m, 4)) as m4, max(v) - min(v) as spread, median(v) as median, any_value(m) as mean from c group by 1),
k as (select *, m3 / pow(m2, 1.5) as sk, m4 / (m2 * m2) - 3 as ku from s)
select event_type, n, round(mean, 6) as mean, round(sqrt(m2), 6) as stddev, round(median, 6) as median, round(spread, 6) as spread, round(sk, 6) as skewness, round(ku, 5) as kurtosis, round(exp(-(sk * sk * n / 6.0 + ku * ku * n / 24.0) / 2), 8) as normality from k""")
def moments_by_event_type(spark, d):
    v = as_double("value")
    out = table(spark, d, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("stddev"), F.median(v).alias("median"), stats.spread(v).alias("spread"), stats.skewness(v).alias("skewness"), stats.kurtosis(v).alias("kurtosis"),
    )
    out = out.withColumn("normality", stats.normality(F.col("skewness"), F.col("kurtosis"), F.col("n")))
    return rounded(rounded(rounded(out, 6, "mean", "stddev", "median", "spread", "skewness"), 5, "kurtosis"), 8, "normality")


@query(fit_sql(rows_sql("supplier", "s_suppkey", "s_acctbal"), powers(2)) + """,
b as (select count(*) as n, ln(sum(pow(y - fit1, 2)) / count(*)) * count(*) + 2 * ln(count(*)) as b1, ln(sum(pow(y - fit2, 2)) / count(*)) * count(*) + 3 * ln(count(*)) as b2 from f)
select round(exp(least(700, (b2 - b1) / 2)), 6) as bayes_factor from b""")
def bayes_factor_supplier(spark, d):
    """Evidence for a line against a parabola, from squared errors."""
    import math

    s = table(spark, d, "supplier")
    fits = [ft.fit(s, "s_suppkey", "s_acctbal", k) for k in (1, 2)]
    bic = [f.n * math.log(f.rss / f.n) + f.k * math.log(f.n) for f in fits]
    return rounded(spark.createDataFrame([(stats.bayes_factor(*bic),)], "bayes_factor double"), 6, "bayes_factor")


@query("select count(*) as n, min(l_quantity) as x_min, max(l_quantity) as x_max, round(min(l_extendedprice), 4) as y_min, round(max(l_extendedprice), 4) as y_max from lineitem")
def ranges_lineitem(spark, d):
    return rounded(table(spark, d, "lineitem").agg(F.count("*").alias("n"), F.min("l_quantity").alias("x_min"), F.max("l_quantity").alias("x_max"), F.min("l_extendedprice").alias("y_min"), F.max("l_extendedprice").alias("y_max")), 4, "y_min", "y_max")


@query("""with r as (select l_extendedprice - (select regr_intercept(l_extendedprice, l_quantity) from lineitem) - (select regr_slope(l_extendedprice, l_quantity) from lineitem) * l_quantity as r from lineitem)
select round(quantile_disc(abs(r), 0.95), 3) as residual_95, round(median(abs(r)), 3) as residual_50 from r""")
def residual_quantiles_lineitem(spark, d):
    f = ft.fit(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 1)
    r = F.abs(F.col("_y") - f.curve.column(F.col("_x")))
    out = spark.createDataFrame([(stats.quantile(f.points(), r, 0.95), stats.medians(f.points(), [r])[0])], "residual_95 double, residual_50 double")
    return rounded(out, 3, "residual_95", "residual_50")
