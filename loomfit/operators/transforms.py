"""Transforms of one column: normalise, smooth, scale, add noise.

Each takes and gives a DataFrame, replaces the column (y unless told otherwise)
and works within the groups of ``keys`` if given. Whole-column statistics come
from one aggregate, never from a window over all rows. Noise is a function of
the seed and a row key, so results don't depend on partitions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .points import with_index


def _with_stats(df: DataFrame, keys: Sequence[str], **aggs: Column) -> tuple[DataFrame, dict[str, Column]]:
    """Statistics as literals, or joined by group."""
    if not keys:
        row = df.agg(*[c.alias(n) for n, c in aggs.items()]).first()
        return df, {n: F.lit(row[n]).cast("double") for n in aggs}
    got = df.groupBy(*keys).agg(*[c.cast("double").alias(f"_s_{n}") for n, c in aggs.items()])
    got = got.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[f"_s_{n}" for n in aggs])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(got, cond).drop(*[f"_k_{k}" for k in keys]), {n: F.col(f"_s_{n}") for n in aggs}


def _put(df: DataFrame, col: str, value: Column, used: dict[str, Column]) -> DataFrame:
    return df.withColumn(col, value).drop(*[f"_s_{n}" for n in used])


def domain(df: DataFrame, lo: float, hi: float, col: str = "x", keys: Sequence[str] = ()) -> DataFrame:
    df, s = _with_stats(df, keys, lo=F.min(col), hi=F.max(col))
    return _put(df, col, F.lit(float(lo)) + F.try_divide((F.col(col) - s["lo"]) * F.lit(float(hi - lo)), s["hi"] - s["lo"]), s)


def clip(df: DataFrame, lo: float, hi: float, col: str = "y") -> DataFrame:
    return df.withColumn(col, F.when(F.col(col).isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), F.col(col)))))


def center(df: DataFrame, col: str = "y", keys: Sequence[str] = ()) -> DataFrame:
    df, s = _with_stats(df, keys, mean=F.avg(col))
    return _put(df, col, F.col(col) - s["mean"], s)


def standardize(df: DataFrame, col: str = "y", keys: Sequence[str] = ()) -> DataFrame:
    """(y - mean) / population deviation; null without spread."""
    df, s = _with_stats(df, keys, mean=F.avg(col), sd=F.stddev_pop(col))
    return _put(df, col, F.try_divide(F.col(col) - s["mean"], s["sd"]), s)


def log_offset(df: DataFrame, epsilon: float = 0.01, col: str = "y", keys: Sequence[str] = ()) -> DataFrame:
    """ln(max + epsilon deviations - y)."""
    df, s = _with_stats(df, keys, hi=F.max(col), sd=F.stddev_pop(col))
    return _put(df, col, F.log(s["hi"] + s["sd"] * F.lit(epsilon) - F.col(col)), s)


def _windowed(df: DataFrame, order: Sequence[str], keys: Sequence[str], halo: int, make, block: int = 100_000) -> DataFrame:
    """make(window, whole) -> Column over rows in order. A long series, of all rows or
    of a key, is cut into blocks that borrow `halo` rows from their neighbours, so no
    task holds it all."""
    rows = with_index(df, *order, keys=keys)
    block = max(block, 2 * halo + 1)
    own = F.expr(f"_i div {block}")
    near = F.array_distinct(F.array(F.greatest(F.expr(f"(_i - {halo}) div {block}"), F.lit(0).cast("long")), own, F.expr(f"(_i + {halo}) div {block}")))
    rows = rows.withColumn("_own", own).withColumn("_b", F.explode(near))
    w = Window.partitionBy(*keys, "_b")
    return rows.withColumn("_v", make(w.orderBy("_i"), w)).where("_b = _own").drop("_own", "_b", "_i")


def moving_average(df: DataFrame, window: int, order: Sequence[str], col: str = "y", keys: Sequence[str] = ()) -> DataFrame:
    """Mean of the rows up to window // 2 before and after; shorter at the ends."""
    half = window // 2
    if window <= 0:
        return df
    out = _windowed(df, order, keys, half, lambda w, _: F.avg(col).over(w.rowsBetween(-half, half)))
    return out.withColumn(col, F.col("_v")).drop("_v")


def gaussian_smooth(df: DataFrame, sigma: float, order: Sequence[str], col: str = "y", keys: Sequence[str] = ()) -> DataFrame:
    """Kernel of radius 3 sigma. Before the first row stands its value; after the
    last one nothing (zero), without new weights. A null inside the series makes the
    values around it null."""
    r = math.ceil(3 * sigma)
    weights = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    weights /= weights.sum()

    def make(w, _):
        first = F.first(col).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        out = F.lit(0.0)
        for j, g in zip(range(-r, r + 1), weights.tolist()):
            there = F.lead(F.lit(True), j).over(w).isNotNull()  # a row, whatever its value
            v = F.col(col) if j == 0 else F.when(there, F.lead(col, j).over(w)).otherwise(first if j < 0 else F.lit(0.0))
            out = out + F.lit(g) * v
        return out

    return _windowed(df, order, keys, r, make).withColumn(col, F.col("_v")).drop("_v")


@dataclass(frozen=True)
class Scale:
    """shift y + a; linear a y; quadratic a y^2; sqrt a sqrt(y); cubic a y^3; cbrt a
    cbrt(y); exponential base^y; logarithmic log_base(max(y, smallest positive));
    identity y."""

    kind: str
    a: float = 1.0

    def column(self, y: Column) -> Column:
        a = F.lit(float(self.a))
        return {
            "identity": lambda: y, "shift": lambda: y + a, "linear": lambda: a * y, "quadratic": lambda: a * y * y, "sqrt": lambda: a * F.sqrt(y),
            "cubic": lambda: a * y * y * y, "cbrt": lambda: a * F.cbrt(y), "exponential": lambda: F.pow(a, y),
            "logarithmic": lambda: F.log(F.greatest(y, F.lit(float(np.finfo(float).tiny)))) / F.lit(math.log(self.a)),
        }[self.kind]()

    def inverse(self) -> Scale:
        a = self.a
        return {
            "identity": lambda: self, "shift": lambda: Scale("shift", -a), "linear": lambda: Scale("linear", 1 / a), "quadratic": lambda: Scale("sqrt", 1 / math.sqrt(a)), "sqrt": lambda: Scale("quadratic", 1 / a**2),
            "cubic": lambda: Scale("cbrt", 1 / float(np.cbrt(a))), "cbrt": lambda: Scale("cubic", 1 / a**3), "exponential": lambda: Scale("logarithmic", a), "logarithmic": lambda: Scale("exponential", a),
        }[self.kind]()


def scale(df: DataFrame, *steps: Scale, col: str = "y") -> DataFrame:
    value = F.col(col).cast("double")
    for s in steps:
        value = s.column(value)
    return df.withColumn(col, value)


def inverse(steps: Sequence[Scale]) -> list[Scale]:
    return [s.inverse() for s in reversed(steps)]


def polynomial_scale(df: DataFrame, coefs: Sequence[float], col: str = "y") -> DataFrame:
    out = F.lit(float(coefs[-1]))
    for c in coefs[-2::-1]:
        out = out * F.col(col) + F.lit(float(c))
    return df.withColumn(col, out)


# --- noise


def uniform_of(seed: int, *key: Column) -> Column:
    """In [0, 1), from the seed and the row's key: the first 52 bits of an MD5 of
    both as text, so any engine gives the same draws."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def normal_of(seed: int, *key: Column) -> Column:
    u, v = uniform_of(2 * seed, *key), uniform_of(2 * seed + 1, *key)
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u)) * F.cos(F.lit(2 * math.pi) * v)


@dataclass(frozen=True)
class Strength:
    """An amount, or a share of the column's population deviation."""

    amount: float
    relative: bool = False

    def literal(self, df: DataFrame, col: str) -> Column:
        v = self.amount * (df.agg(F.stddev_pop(col)).first()[0] or 0.0) if self.relative else self.amount
        return F.lit(v if math.isfinite(v) else 0.0)


def normal_noise(df: DataFrame, strength: Strength, key: Sequence[str], seed: int = 0, col: str = "y") -> DataFrame:
    return df.withColumn(col, F.col(col) + strength.literal(df, col) * normal_of(seed, *map(F.col, key)))


def _autoregressed(rows: DataFrame, rho: float, n: int) -> DataFrame:
    """Adds _v to rows(_i, _e): v = e + rho times v of the row before. A block is one
    scan of e scaled by powers of rho, short enough that no power leaves the range of
    doubles; block ends are a series of the same kind, with rho to the block's length."""
    size = 1 << 17 if abs(rho) == 1 else max(1, min(1 << 17, int(230 / -math.log(abs(rho)))))
    r, at = F.lit(float(rho)), F.expr(f"_i % {size}")
    scan = Window.partitionBy("_b").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("_b", F.expr(f"_i div {size}")).withColumn("_v", F.pow(r, at) * F.sum(F.col("_e") * F.pow(r, -at)).over(scan))
    if n <= size:
        return own.drop("_b")
    ends = own.groupBy(F.col("_b").alias("_i")).agg(F.max_by("_v", "_i").alias("_e"))
    onward = float(rho) ** size
    # what fades below a double's precision within a block is not carried past it
    ends = _autoregressed(ends, onward, -(-n // size)) if abs(onward) > 1e-18 else ends.withColumn("_v", F.col("_e"))
    before = ends.select((F.col("_i") + 1).alias("_b"), F.col("_v").alias("_c"))
    return own.join(before, "_b", "left").withColumn("_v", F.col("_v") + F.coalesce("_c", F.lit(0.0)) * F.pow(r, at + 1)).drop("_b", "_c")


def correlated_noise(df: DataFrame, strength: Strength, rho: float, order: Sequence[str], seed: int = 0, col: str = "y") -> DataFrame:
    """First-order autoregressive noise of unit variance along the order, for any rho
    from -1 to 1."""
    if not abs(rho) <= 1:
        raise ValueError("rho must lie between -1 and 1")
    if rho == 0:
        return normal_noise(df, strength, order, seed, col)
    amount = strength.literal(df, col)
    fresh = F.when(F.col("_i") == 0, 1.0).otherwise(math.sqrt(max(0.0, 1 - rho * rho)))
    rows = with_index(df, *order).withColumn("_e", normal_of(seed, *map(F.col, order)) * fresh)
    return _autoregressed(rows, rho, df.count()).withColumn(col, F.col(col) + amount * F.col("_v")).drop("_v", "_e", "_i")


def uniform_noise(df: DataFrame, lower: float, upper: float, key: Sequence[str], seed: int = 0, col: str = "y") -> DataFrame:
    """Between -lower and upper."""
    return df.withColumn(col, F.col(col) - F.lit(float(lower)) + F.lit(float(lower + upper)) * uniform_of(seed, *map(F.col, key)))


def poisson_of(rate: float, seed: int, *key: Column) -> Column:
    """A count: up to a rate of 1000 the exact quantile of one uniform draw, beyond it
    the normal quantile with its correction for skewness."""
    if rate < 0:
        raise ValueError("a rate can't be negative")
    if rate == 0:
        return F.lit(0.0)
    if rate > 1000:
        z = normal_of(seed, *key)
        return F.greatest(F.lit(0.0), F.round(F.lit(float(rate)) + F.lit(math.sqrt(rate)) * z + (z * z - 1) / 6))
    least, top = max(0, int(rate - 12 * math.sqrt(rate))), int(rate + 12 * math.sqrt(rate) + 20)
    cdf = np.cumsum(np.exp([k * math.log(rate) - rate - math.lgamma(k + 1) for k in range(least, top)]))
    u = uniform_of(seed, *key)
    return F.get(F.transform(F.array(u), lambda v: F.size(F.filter(F.array(*[F.lit(float(c)) for c in cdf]), lambda c: c <= v))), F.lit(0)).cast("double") + F.lit(float(least))


def poisson_noise(df: DataFrame, rate: float, strength: Strength, key: Sequence[str], seed: int = 0, col: str = "y") -> DataFrame:
    """(Poisson(rate) - rate), times the point's share if relative."""
    size = F.lit(strength.amount) * F.abs(F.col(col)) if strength.relative else F.lit(1.0)
    return df.withColumn(col, F.col(col) + (poisson_of(rate, seed, *map(F.col, key)) - F.lit(float(rate))) * size)


def salt_and_pepper(df: DataFrame, share: float, lo: float, hi: float, key: Sequence[str], seed: int = 0, col: str = "y") -> DataFrame:
    k = [F.col(c) for c in key]
    other = F.when(uniform_of(2 * seed + 1, *k) < 0.5, F.lit(float(hi))).otherwise(F.lit(float(lo)))
    return df.withColumn(col, F.when(uniform_of(2 * seed, *k) < share, other).otherwise(F.col(col)))


def beta_of(a: float, b: float, seed: int, *key: Column) -> Column:
    """Whole shapes (to a sum of 64): the a-th least of a + b - 1 uniform draws. Other
    shapes: the quantile of one draw, from 2049 points between which lines run; masses
    are summed over the logit, where the density has no poles."""
    if a <= 0 or b <= 0:
        raise ValueError("shapes must be positive")
    if a == int(a) and b == int(b) and a + b <= 64:
        return F.get(F.sort_array(F.array(*[uniform_of(seed * 64 + i, *key) for i in range(int(a + b) - 1)])), F.lit(int(a) - 1))
    reach = 40 / min(a, b, 1)
    logit = np.linspace(-reach, reach, 1 << 17)
    log_x, log_y = -np.logaddexp(0, -logit), -np.logaddexp(0, logit)
    mass = np.cumsum(np.exp(a * log_x + b * log_y - (a * log_x + b * log_y).max()))
    quantile = np.interp(np.linspace(0, 1, 2049), mass / mass[-1], np.exp(log_x))
    table = F.array(*[F.lit(float(q)) for q in quantile])
    u = uniform_of(seed, *key) * 2048.0
    at = F.floor(u).cast("int")
    return F.get(table, at) + (u - at) * (F.get(table, at + 1) - F.get(table, at))


def impulse_noise(df: DataFrame, share: float, lo: float, hi: float, a: float, b: float, key: Sequence[str], seed: int = 0, col: str = "y") -> DataFrame:
    """Some values become Beta(a, b) draws mapped to lo..hi."""
    k = [F.col(c) for c in key]
    draw = F.lit(float(lo)) + beta_of(a, b, 2 * seed + 1, *k) * F.lit(float(hi - lo))
    return df.withColumn(col, F.when(uniform_of(2 * seed, *k) < share, draw).otherwise(F.col(col)))
