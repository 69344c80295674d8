"""Plot data in long form, and a small SVG writer.

The engine gives series (series, kind, x, y, lower, upper, label); drawing takes
a bounded number of points, thinned by a stride over the row order.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.display import equation
from ..plans.model import Curve
from .fit import Fit
from .points import points, with_index
from .predict import Tolerance, band, curve_over

SCHEMA = "series int, kind string, x double, y double, lower double, upper double, label string"


@dataclass
class PlotOptions:
    title: str = "Plot"
    x_label: str = "x"
    y_label: str = "y"
    size: tuple[int, int] = (800, 600)
    x_range: tuple[float, float] | None = None
    y_range: tuple[float, float] | None = None
    tolerance: Tolerance = field(default_factory=Tolerance)
    level: float = 0.95
    legend: bool = True
    margin: int = 40
    ticks: tuple[int, int] = (8, 8)


def _series(df: DataFrame, number: int, kind: str, label: str, lower=None, upper=None) -> DataFrame:
    null = F.lit(None).cast("double")
    return df.select(F.lit(number).alias("series"), F.lit(kind).alias("kind"), "x", "y", (lower if lower is not None else null).alias("lower"), (upper if upper is not None else null).alias("upper"), F.lit(label).alias("label"))


def thinned(df: DataFrame, order: str = "x", keep: int = 100) -> DataFrame:
    n = df.count()
    return with_index(df, order).where(F.col("_i") % max(1, n // keep) == 0).drop("_i")


def fit_series(f: Fit, number: int, options: PlotOptions, steps: int = 200) -> DataFrame:
    """The fitted curve over its range, with its band."""
    c, spark = f.curve, f.data.sparkSession
    step = (c.x_max - c.x_min) / steps or 1.0
    rows = curve_over(spark, c, c.x_min, c.x_max, step).withColumn("_b", band(f, F.col("x"), options.level, options.tolerance))
    return _series(rows, number, "fit", equation(c), F.col("_b.lower"), F.col("_b.upper"))


def curve_series(spark: SparkSession, c: Curve, lo: float, hi: float, number: int, steps: int = 200) -> DataFrame:
    return _series(curve_over(spark, c, lo, hi, (hi - lo) / steps or 1.0), number, "canonical", equation(c))


def data_series(df: DataFrame, x, y, number: int, label: str = "data", keep: int = 100) -> DataFrame:
    rows = points(df, x, y).select(F.col("_x").alias("x"), F.col("_y").alias("y"))
    return _series(thinned(rows, "x", keep), number, "data", label)


def marker_series(spark: SparkSession, marks: list[tuple[float, float]], number: int, label: str = "marks") -> DataFrame:
    return _series(spark.createDataFrame(marks, "x double, y double"), number, "markers", label)


def plot(*series: DataFrame) -> DataFrame:
    out = series[0]
    for s in series[1:]:
        out = out.unionByName(s)
    return out


def plot_fit(f: Fit, options: PlotOptions | None = None) -> DataFrame:
    return plot(fit_series(f, 0, options or PlotOptions()), data_series(f.data, f.x, f.y, 1))


def plot_residuals(f: Fit) -> DataFrame:
    rows = f.points().select(F.col("_x").alias("x"), (F.col("_y") - f.curve.column(F.col("_x"))).alias("y"))
    return _series(thinned(rows), 0, "data", "residuals")


def svg(plot_df: DataFrame, options: PlotOptions | None = None) -> str:
    """Draws series that are small by construction."""
    o, rows = options or PlotOptions(), plot_df.orderBy("series", "x").collect()
    w, h = o.size
    xs, ys = [r["x"] for r in rows], [v for r in rows for v in (r["y"], r["lower"], r["upper"]) if v is not None]
    (x0, x1), pad = o.x_range or (min(xs), max(xs)), 0.1 * ((max(ys) - min(ys)) or 1.0)
    y0, y1 = o.y_range or (min(ys) - pad, max(ys) + pad)
    px = lambda v: o.margin + (v - x0) / ((x1 - x0) or 1) * (w - 2 * o.margin)
    py = lambda v: h - o.margin - (v - y0) / ((y1 - y0) or 1) * (h - 2 * o.margin)
    colours = ("#1f6f8b", "#c8553d", "#588157", "#6d597a", "#e09f3e")
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{w}" height="{h}"><text x="{w / 2}" y="20" text-anchor="middle">{escape(o.title)}</text>']
    for i in range(o.ticks[0] + 1):
        v = x0 + (x1 - x0) * i / o.ticks[0]
        out.append(f'<text x="{px(v):.1f}" y="{h - 8}" font-size="10" text-anchor="middle">{v:.4g}</text>')
    for i in range(o.ticks[1] + 1):
        v = y0 + (y1 - y0) * i / o.ticks[1]
        out.append(f'<text x="4" y="{py(v):.1f}" font-size="10">{v:.4g}</text>')
    for s in sorted({r["series"] for r in rows}):
        own, c = [r for r in rows if r["series"] == s], colours[s % len(colours)]
        if own[0]["kind"] in ("fit", "canonical"):
            if own[0]["lower"] is not None:
                edge = [(r["x"], r["upper"]) for r in own] + [(r["x"], r["lower"]) for r in reversed(own)]
                out.append(f'<polygon fill="{c}" fill-opacity="0.2" points="{" ".join(f"{px(a):.1f},{py(b):.1f}" for a, b in edge)}"/>')
            out.append(f'<polyline fill="none" stroke="{c}" points="{" ".join(f"{px(r["x"]):.1f},{py(r["y"]):.1f}" for r in own)}"/>')
        else:
            out += [f'<circle cx="{px(r["x"]):.1f}" cy="{py(r["y"]):.1f}" r="2" fill="{c}"/>' for r in own]
        if o.legend:
            out.append(f'<text x="{o.margin + 8}" y="{o.margin + 14 * (s + 1)}" font-size="11" fill="{c}">{escape(own[0]["label"])}</text>')
    return "\n".join([*out, "</svg>"])
