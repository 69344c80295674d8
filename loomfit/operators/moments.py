"""Normal equations as a Spark aggregate, and QR where they are ill-conditioned.

Products of Chebyshev functions and of harmonics are sums of such functions, so
2d + 1 plain sums hold the whole Gram matrix of degree d: one codegen aggregate,
partial before the shuffle, one row out (or one a group).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from numpy.polynomial import chebyshev as C
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.bases import Basis, FourierBasis, PolynomialBasis
from ..plans.domain import DomainMap

#: Above this condition number of the design matrix, QR is used.
WELL_CONDITIONED = 1e4


def has_moments(fam: Basis) -> bool:
    return isinstance(fam, PolynomialBasis) or fam.kind == "log" or isinstance(fam, FourierBasis) and fam.level == 0


def inner_variable(fam: Basis, x: Column, x_min, x_max) -> Column:
    """The variable of the inner functions: on [-1, 1], or the angle. x_min and x_max
    are numbers or columns."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    lo, hi = lit(x_min), lit(x_max)
    if isinstance(fam, FourierBasis):
        return F.try_divide(x - lo, hi - lo) * F.lit(2 * np.pi)
    if fam.kind == "log":
        return F.try_divide(F.log(x - lo + 1.0), F.log(hi - lo + 1.0)) * 2.0 - 1.0
    return F.try_divide(x - lo, hi - lo) * 2.0 - 1.0


def inner_design(fam: Basis, x: np.ndarray, k: int, lo: float, hi: float) -> np.ndarray:
    if isinstance(fam, FourierBasis):
        return fam.design(x, k, DomainMap.between((lo, hi), fam.home))
    t = np.log(x - lo + 1) / np.log(hi - lo + 1) if fam.kind == "log" else (x - lo) / (hi - lo)
    return C.chebvander(2 * t - 1, k - 1)


def change_of_basis(fam: Basis, k: int, lo: float, hi: float) -> np.ndarray:
    """Matrix from inner coefficients to the family's."""
    if isinstance(fam, FourierBasis):
        return np.eye(k)
    t = C.chebpts1(k) if k > 1 else np.zeros(1)
    x = np.exp((t + 1) / 2 * np.log(hi - lo + 1)) - 1 + lo if fam.kind == "log" else lo + (t + 1) / 2 * (hi - lo)
    a = fam.design(x, k, fam.domain(lo, hi))
    size = np.abs(a).max(0)
    return np.linalg.solve(a / size, C.chebvander(t, k - 1)) / size[:, None]


def with_functions(df: DataFrame, fam: Basis, degree: int, t: Column) -> tuple[DataFrame, list[str], list[str]]:
    """Adds the inner functions; returns (df, cosine-like 0..2d, sine-like 1..2d names)."""
    df = df.withColumn("_t", t)
    if isinstance(fam, FourierBasis):
        cos = {f"_c{m}": F.cos(F.col("_t") * F.lit(float(m))) for m in range(1, 2 * degree + 1)}
        sin = {f"_s{m}": F.sin(F.col("_t") * F.lit(float(m))) for m in range(1, 2 * degree + 1)}
        return df.withColumns(cos | sin), list(cos), list(sin)
    names = ["_t"]
    for m in range(2, 2 * degree + 1):  # each step is a projection of its own, so expressions stay small
        before = F.col(names[-2]) if m > 2 else F.lit(1.0)
        df = df.withColumn(f"_t{m}", F.lit(2.0) * F.col("_t") * F.col(names[-1]) - before)
        names.append(f"_t{m}")
    return df, names[: 2 * degree], []


def moment_sums(df: DataFrame, fam: Basis, degree: int, x_min, x_max, keys: Sequence[str] = ()) -> DataFrame:
    """One row (a group): n, yy, y0, ys array, and the sums of the inner functions."""
    df, cos, sin = with_functions(df, fam, degree, inner_variable(fam, F.col("_x"), x_min, x_max))
    y = F.col("_y")
    first = [F.col(c) for pair in zip(sin[:degree], cos[:degree]) for c in pair] if isinstance(fam, FourierBasis) else [F.col(c) for c in cos[:degree]]
    aggs = [F.count("*").alias("n"), F.sum(y).alias("y0"), F.sum(y * y).alias("yy")]
    aggs += [F.sum(c).alias(f"m{i}") for i, c in enumerate(map(F.col, cos + sin))] + [F.sum(y * c).alias(f"q{i}") for i, c in enumerate(first)]
    out = (df.groupBy(*keys) if keys else df.groupBy()).agg(*aggs)
    pack = lambda p, n: (F.array(*[F.col(f"{p}{i}") for i in range(n)]) if n else F.array().cast("array<double>")).alias(p)
    return out.select(*keys, "n", "y0", "yy", pack("m", len(cos) + len(sin)), pack("q", len(first)))


def normal_equations(fam: Basis, degree: int, n: int, y0: float, m: Sequence[float], q: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """(Gram matrix, right side) of the inner functions."""
    d = degree
    b = np.array([y0, *q], float)
    if isinstance(fam, FourierBasis):
        cos, sin = np.array([n, *m[: 2 * d]], float), np.array([0.0, *m[2 * d :]], float)
        k = 1 + 2 * d
        g = np.empty((k, k))
        which = [(0, "c")] + [(h, w) for h in range(1, d + 1) for w in "sc"]
        for i, (a, u) in enumerate(which):
            for j, (c, v) in enumerate(which):
                if u == v == "c":
                    g[i, j] = (cos[a + c] + cos[abs(a - c)]) / 2
                elif u == v == "s":
                    g[i, j] = (cos[abs(a - c)] - cos[a + c]) / 2
                else:
                    s, o = (a, c) if u == "s" else (c, a)
                    g[i, j] = (sin[s + o] + np.sign(s - o) * sin[abs(s - o)]) / 2
        return g, b
    s = np.array([n, *m], float)
    i = np.arange(d + 1)
    return (s[i[:, None] + i] + s[np.abs(i[:, None] - i)]) / 2, b


def condition(gram: np.ndarray) -> float:
    """Of the design matrix, from its Gram matrix."""
    e = np.linalg.eigvalsh(gram)
    return float(np.sqrt(e[-1] / e[0])) if e[0] > 0 else float("inf")


def triangles(df: DataFrame, design, k: int) -> np.ndarray:
    """R of [X | y] by QR in every partition, stacked in a small tree; k + 1 square."""
    w = k + 1

    def fold(batches: Iterator[pa.RecordBatch], rows) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, w))
        for b in batches:
            r = np.linalg.qr(np.vstack([r, rows(b)]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([np.pad(r, ((0, w - len(r)), (0, 0))).ravel().tolist()], pa.list_(pa.float64()))], ["r"])

    def leaf(batches):
        return fold(batches, lambda b: np.hstack([design(b.column("_x").to_numpy()), b.column("_y").to_numpy()[:, None]]))

    def node(batches):
        return fold(batches, lambda b: np.array(b.column("r").to_pylist()).reshape(-1, w))

    out = df.select("_x", "_y").mapInArrow(leaf, "r array<double>").repartition(16).mapInArrow(node, "r array<double>").collect()  # 16 rows at most
    return np.linalg.qr(np.vstack([np.array(x["r"]).reshape(w, w) for x in out]), mode="r")
