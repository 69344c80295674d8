"""Statistics over columns, each in as few aggregates as its definition allows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HUBER = 1.345
EPS = float(np.finfo(float).eps)
NAN = float("nan")


def huber(r: Column, delta) -> Column:
    a = F.abs(r)
    d = delta if isinstance(delta, Column) else F.lit(float(delta))
    return F.when(a <= d, 0.5 * r * r).otherwise(d * (a - 0.5 * d))


def huber_loss(r: np.ndarray, d: float) -> np.ndarray:
    a = np.abs(r)
    return np.where(a <= d, 0.5 * r * r, d * (a - 0.5 * d))


def medians(df: DataFrame, cols: list[Column], n: int | None = None, gather: int = 20_000) -> list[float]:
    """Exact medians of several columns at once; 0 without rows."""
    n = df.count() if n is None else n
    return by_rank(df, cols, n, ((n - 1) // 2, n // 2), gather) if n else [0.0] * len(cols)


def quantile(df: DataFrame, col: Column, share: float, gather: int = 20_000) -> float | None:
    """The value of nearest rank: the smallest that at least the share of rows don't exceed."""
    rows = df.select(col.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    n = rows.count()
    rank = max(0, math.ceil(share * n) - 1)
    return by_rank(rows, [F.col("_v")], n, (rank, rank), gather)[0] if n else None


#: From a batch of rows to an array for each column.
Values = Callable[[pa.RecordBatch], Sequence[np.ndarray]]


def columns_of(b: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in b.columns]


def _ordered(values: Values, b: pa.RecordBatch) -> list[np.ndarray]:
    """Nulls and NaN lie above all numbers; minus zero is zero."""
    return [np.where(np.isnan(v), np.inf, v) + 0.0 for v in values(b)]


def _key(v: float) -> int:
    """Integers in the order of doubles."""
    bits = int(np.float64(v).view(np.int64))
    return bits if bits >= 0 else -(2**63) - bits


def _cuts(sample: np.ndarray, lo: float, hi: float, shares: tuple[float, float]) -> np.ndarray:
    """Where to cut [lo, hi]: at the sampled values near both shares of what it holds,
    or, where few were sampled, in even steps over the doubles in it."""
    s = sample[np.searchsorted(sample, lo, "right") : np.searchsorted(sample, hi, "right")]
    if len(s) >= 64:
        reach = 2 * math.sqrt(len(s)) + 2  # four deviations of a rank in the sample
        s = s[max(0, int(shares[0] * len(s) - reach)) : int(shares[1] * len(s) + reach) + 1]
        if len(s):
            cuts = np.unique(np.concatenate([s, np.nextafter(s[1:][s[1:] == s[:-1]], np.inf)]))  # a frequent value gets a bin of its own
            return cuts[cuts <= hi]
    a, b = _key(lo), _key(hi)
    steps = np.array(sorted({a + (b - a) * j // 1024 for j in range(1, 1025)} - {a}), np.int64)
    return np.where(steps < 0, np.int64(-(2**63)) - steps, steps).view(np.float64)


def _counted(values: Values, cuts: list[tuple[int, float, float, np.ndarray]]):
    """How many values of a column lie in each bin of a bracket: rows (bracket's start + bin, count)."""
    starts = np.cumsum([0] + [len(c) + 1 for *_, c in cuts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(starts[-1], np.int64)
        for b in batches:
            got = _ordered(values, b)
            for at, (i, lo, hi, c) in zip(starts, cuts):
                v = got[i]
                v = v[(v >= lo) & (v <= hi)]
                mid = v[(v >= c[0]) & (v < c[-1])]
                n = np.bincount(np.searchsorted(c, mid, "right"), minlength=len(c) + 1)
                n[0] = np.count_nonzero(v < c[0])
                n[-1] = len(v) - n[0] - len(mid)
                total[at : at + len(n)] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "n"])

    return run, starts


def _inside(values: Values, brackets: list[tuple[int, float, float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = _ordered(values, b)
            got = [every[i][(every[i] >= lo) & (every[i] <= hi)] for i, lo, hi in brackets]
            at = np.repeat(np.arange(len(brackets), dtype=np.int32), [len(v) for v in got])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.concatenate(got))], ["i", "v"])

    return run


def sampled(df: DataFrame, n: int, gather: int = 20_000) -> pa.Table:
    """Some of n rows: they only propose where to cut, exact counts decide."""
    return (df.where(F.rand(17) < 10_000 / n) if n > gather else df.limit(0)).toArrow()


def by_rank(df: DataFrame, cols: list[Column], n: int, ranks: tuple[int, int], gather: int = 20_000) -> list[float]:
    """Means of the values at two ranks (from 0, of n rows without nulls)."""
    named = [c.cast("double").alias(f"c{i}") for i, c in enumerate(cols)]
    picked = df.where(F.rand(17) < 10_000 / n).select(*named) if n > gather else df.select(*named).limit(0)
    return ranked(df.select(*named), columns_of, len(cols), n, ranks, picked.toArrow(), gather)


def ranked(df: DataFrame, values: Values, m: int, n: int, ranks: tuple[int, int], picked: pa.Table, gather: int = 20_000) -> list[float]:
    """As by_rank, of m arrays made from each batch of rows.

    A sample proposes bins around each rank, an exact count says which of them holds
    it (by its bins, one pass up to some 200 million rows). Once it holds at most ``gather`` values,
    or one value, they are sorted by the driver. All columns share each pass, each
    value is made once a pass, and none sorts or shuffles rows.
    """
    parts = [_ordered(values, b) for b in picked.to_batches() if b.num_rows]
    sample = [np.sort(np.concatenate([p[i] for p in parts])) if parts else np.empty(0) for i in range(m)]
    held = {(i, r): (-math.inf, math.inf, 0, n) for i in range(m) for r in ranks}  # lo, hi, values below, values inside
    while wide := sorted({(i, lo, hi, under, k) for (i, _), (lo, hi, under, k) in held.items() if k > gather and lo < hi}):
        of = {w: [r for r in sorted(set(ranks)) if (w[0], *held[w[0], r]) == w] for w in wide}
        cuts = [(i, lo, hi, _cuts(sample[i], lo, hi, tuple((of[i, lo, hi, under, k][j] - under) / k for j in (0, -1)))) for i, lo, hi, under, k in wide]
        run, starts = _counted(values, cuts)
        got = df.mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(starts[-1], np.int64)
        counts[got.column("at").to_numpy()] = got.column("n").to_numpy()
        for w, start, (i, lo, hi, c) in zip(wide, starts, cuts):
            ends = w[3] + np.cumsum(counts[start : start + len(c) + 1])
            for r in of[w]:
                j = int(np.searchsorted(ends, r, "right"))
                bin_lo, bin_hi = lo if j == 0 else float(c[j - 1]), hi if j == len(c) else float(np.nextafter(c[j], -math.inf))
                held[i, r] = bin_lo, bin_hi, int(ends[j - 1]) if j else w[3], int(counts[start + j])
    few = sorted({(i, lo, hi) for (i, _), (lo, hi, *_) in held.items() if lo < hi})
    values_of = {}
    if few:
        got = df.mapInArrow(_inside(values, few), "i int, v double").toArrow()
        at, value = got.column("i").to_numpy(), got.column("v").to_numpy()
        values_of = {f: np.sort(value[at == j]) for j, f in enumerate(few)}
    at = lambda i, r: held[i, r][0] if held[i, r][0] == held[i, r][1] else values_of[i, *held[i, r][:2]][r - held[i, r][2]]
    return [float((at(i, ranks[0]) + at(i, ranks[1])) / 2) for i in range(m)]


def sums(df: DataFrame, values: Values, m: int) -> list[float]:
    """Of m arrays made from each batch of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(m)
        for b in batches:
            total += [float(np.sum(v)) for v in values(b)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(m, dtype=np.int32)), pa.array(total)], ["i", "v"])

    got = df.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = dict(zip(got.column("i").to_pylist(), got.column("v").to_pylist()))
    return [out.get(i, 0.0) for i in range(m)]


def spread(c: Column) -> Column:
    return F.max(c) - F.min(c)


def skewness(c: Column) -> Column:
    """Population skewness; 0 without spread."""
    return F.coalesce(F.skewness(c), F.lit(0.0))


def kurtosis(c: Column) -> Column:
    """Population excess kurtosis; 0 without spread."""
    return F.coalesce(F.kurtosis(c), F.lit(0.0))


def normality(skew: Column, kurt: Column, n: Column) -> Column:
    """Chance of moments at least as far from a normal's (1 without rows)."""
    k2 = skew * skew * n / 6.0 + kurt * kurt * n / 24.0
    return F.when(n > 0, F.exp(-k2 / 2.0)).otherwise(1.0)


def residual_metrics(df: DataFrame, y: Column, y_fit: Column, k: int = 1, keys=()) -> DataFrame:
    """One fused aggregate: n, mae, mse, rmse, residual_variance, r_squared,
    adjusted_r_squared, max_residual, skewness, kurtosis, normality."""
    r = F.col("_r")
    rows = df.select(*keys, y.cast("double").alias("_y"), (y - y_fit).cast("double").alias("_r")).where(F.col("_r").isNotNull())
    n = F.col("n")
    out = (rows.groupBy(*keys) if keys else rows.groupBy()).agg(
        F.count("*").alias("n"), F.avg(F.abs(r)).alias("mae"), F.avg(r * r).alias("mse"), F.sum(r * r).alias("_sse"), (F.var_pop("_y") * F.count("*")).alias("_sst"),
        F.max(F.abs(r)).alias("max_residual"), skewness(r).alias("skewness"), kurtosis(r).alias("kurtosis"),
    )
    r2 = F.when((F.col("_sst") == 0) & (F.col("_sse") == 0), F.lit(None)).otherwise(1.0 - F.try_divide(F.col("_sse"), F.col("_sst")))
    return out.select(
        *keys, "n", "mae", "mse", F.sqrt("mse").alias("rmse"),
        F.when(n == k, 0.0).otherwise(F.try_divide(F.col("_sse"), n - k)).alias("residual_variance"),
        r2.alias("r_squared"), (r2 - (1.0 - r2) * F.try_divide(F.lit(float(k)), n - k)).alias("adjusted_r_squared"),
        "max_residual", "skewness", "kurtosis", normality(F.col("skewness"), F.col("kurtosis"), n).alias("normality"),
    )


def robust_metrics(df: DataFrame, r: Column) -> dict[str, float]:
    """median_abs, mad, huber (mean loss), robust_r_squared (1 - Huber sum over squared sum)
    and median_squared_deviation of a residual column: three aggregates."""
    rows = df.select(r.cast("double").alias("_r")).where(F.col("_r").isNotNull())
    a, s = F.abs(F.col("_r")), F.col("_r") * F.col("_r")
    n = rows.count()
    if n == 0:
        return {"median_abs": 0.0, "mad": 0.0, "huber": NAN, "robust_r_squared": NAN, "median_squared_deviation": 0.0}
    med, med2 = medians(rows, [a, s], n)
    mad, msd = medians(rows, [F.abs(a - med), F.pow(s - med2, 2)], n)
    loss, sse = rows.agg(F.sum(huber(F.col("_r"), HUBER * mad)), F.sum(s)).first()
    return {"median_abs": med, "mad": mad, "huber": loss / n, "robust_r_squared": 1 - loss / sse if sse else NAN, "median_squared_deviation": msd}


def folded_rmse(df: DataFrame, r: Column, fold: Column) -> DataFrame:
    """Mean and deviation of the errors over all rows but each fold's (one row)."""
    per = df.select(fold.alias("_f"), r.cast("double").alias("_r")).groupBy("_f").agg(F.sum(F.col("_r") * F.col("_r")).alias("s"), F.count("*").alias("n"))
    every = per.agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    rest = per.crossJoin(every)  # one row on the right
    rmse = F.sqrt(F.try_divide(F.col("all_s") - F.col("s"), F.col("all_n") - F.col("n")))
    return rest.select(rmse.alias("_v")).agg(F.avg("_v").alias("rmse_mean"), F.stddev_pop("_v").alias("rmse_stddev"))


def bayes_factor(bic_a: float, bic_b: float) -> float:
    return math.exp(min(700.0, (bic_b - bic_a) / 2))
