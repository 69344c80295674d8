"""Points, their range, and a distributed row index.

Rows whose x or y is null or not finite take no part in fits and statistics.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import NoData


def as_double(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def epoch_seconds(ts: Column | str) -> Column:
    """Seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz")) / F.lit(1e6)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def points(df: DataFrame, x, y, keys: Sequence[str] = (), order=None) -> DataFrame:
    """keys, _x, _y[, _o]: only what a fit needs, so scans read two columns."""
    cols = [*keys, as_double(x).alias("_x"), as_double(y).alias("_y")]
    if order is not None:
        cols.append((F.col(order) if isinstance(order, str) else order).alias("_o"))
    return df.select(*cols).where(finite(F.col("_x")) & finite(F.col("_y")))


def x_range(pts: DataFrame) -> tuple[int, float, float]:
    """(rows, least x, greatest x) in one aggregate."""
    n, lo, hi = pts.agg(F.count("*"), F.min("_x"), F.max("_x")).first()
    if not n:
        raise NoData("no rows with finite x and y")
    return n, lo, hi


def spread_rows(df: DataFrame, n: int, rows_a_task: int = 1_000_000) -> DataFrame:
    """Rows dealt evenly over all cores."""
    return df.repartition(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-n // rows_a_task)))


MOST_BUCKETS = 4096


def below(c: Column, cuts: Sequence, kind) -> Column:
    """How many of the rising cuts lie below a value, in two short scans: of every
    step-th cut, then of the cuts between two of those."""
    step = math.ceil(math.sqrt(len(cuts)))
    lit = lambda v: F.lit(v).cast(kind)
    runs = [list(cuts[i : i + step]) for i in range(0, len(cuts), step)]
    fine = F.array(*[F.array(*[lit(v) for v in run]) for run in runs])
    if len(runs) == 1:
        return F.size(F.filter(F.get(fine, F.lit(0)), lambda e: e < c))
    run = F.size(F.filter(F.array(*[lit(r[0]) for r in runs[1:]]), lambda e: e < c))
    return run * step + F.size(F.filter(F.get(fine, run), lambda e: e < c))


def with_index(df: DataFrame, *order: str, into: str = "_i", rows_a_bucket: int = 1_000_000, keys: Sequence[str] = ()) -> DataFrame:
    """A row number from 0 along the order columns (within each key, if given) without
    sorting all rows, or all rows of a key, in one task: rows are cut into buckets at
    quantiles of the first column, buckets are counted, and each is numbered by
    itself from the rows before it."""
    first = order[0]
    n = df.count()
    cuts = []
    rows_a_bucket = max(rows_a_bucket, n // MOST_BUCKETS)
    if n > rows_a_bucket:
        shares = [i * rows_a_bucket / n for i in range(1, -(-n // rows_a_bucket))]
        cuts = sorted({c for c in df.agg(F.percentile_approx(F.col(first), F.array(*[F.lit(s) for s in shares]), F.lit(10_000))).first()[0] or []})
    own = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)).cast("long") - 1
    if not cuts:
        return df.withColumn("_bucket", F.lit(0)).withColumn(into, own).drop("_bucket")
    rows = df.withColumn("_bucket", below(F.col(first), cuts, df.schema[first].dataType))
    counts = rows.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_kb")).count()
    before = F.sum("count").over(Window.partitionBy(*[f"_k_{k}" for k in keys] or [F.lit(0)]).orderBy("_kb").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.withColumn("_before", F.coalesce(before, F.lit(0))).drop("count")  # a row for each key and bucket
    same = F.col("_bucket").eqNullSafe(F.col("_kb"))  # with ==, the optimizer carries the bucket's lambdas to the other side
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    both = rows.withColumn(into, own).join(starts, same)
    return both.withColumn(into, F.col(into) + F.col("_before")).select(*df.columns, into)


def fold_of(index: Column, n: int, folds: int) -> Column:
    """Contiguous folds of n // folds rows; the last takes the rest."""
    size = max(1, n // folds)
    return F.least(F.floor(index / F.lit(size)), F.lit(folds - 1)).cast("int")
