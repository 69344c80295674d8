"""Least squares in event-time windows of a stream.

State is one row of sums a window and key, whatever the number of events; late
events within the watermark change their window's sums. x is the time within the
window, scaled by the window's length, so its domain is known in advance.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import moments as mm
from ..operators.fit import _solve
from ..operators.points import as_double, epoch_seconds, finite
from ..plans.bases import basis
from ..plans.model import Curve
from ..storage import shared_dir


def windowed_moments(events: DataFrame, time: str, y: str, size: str, degree: int, keys: Sequence[str] = (), late: str = "1 hour") -> DataFrame:
    """keys, start, end, n, y0, yy, m, q: sums of Chebyshev functions of the time in
    each tumbling window. events may be a stream or a table."""
    fam = basis("chebyshev")
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events
    rows = rows.where(finite(as_double(y)) & F.col(time).isNotNull())
    rows = rows.withColumn("_w", F.window(time, size)).withColumn("_y", as_double(y))
    lo, hi = epoch_seconds(F.col("_w.start")), epoch_seconds(F.col("_w.end"))
    rows = rows.withColumn("_x", (epoch_seconds(time) - lo) / (hi - lo))
    sums = mm.moment_sums(rows, fam, degree, 0.0, 1.0, [*keys, "_w"])
    return sums.select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n", "y0", "yy", "m", "q")


def solved(sums: DataFrame, degree: int, keys: Sequence[str] = ()) -> DataFrame:
    """keys, start, end, n, coefficients over [0, 1] of the window, mse; windows with
    too few events or too little spread have null coefficients."""
    fam = basis("chebyshev")
    head = [f for f in sums.schema.fields if f.name in (*keys, "start", "end")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in head)

    def run(batches):
        for b in batches:
            coefs, mse = [], []
            for r in b.itertuples(index=False):
                g, rhs = mm.normal_equations(fam, degree, int(r.n), r.y0, list(r.m), list(r.q))
                if r.n <= degree or mm.condition(g) > 1e8:
                    coefs.append(None)
                    mse.append(None)
                    continue
                c = _solve(g, rhs)
                coefs.append([float(v) for v in c])
                mse.append(max(0.0, float(r.yy - 2 * c @ rhs + c @ g @ c)) / int(r.n))
            out = b[[f.name for f in head]].copy()
            out["n"], out["coefficients"], out["mse"] = b["n"], coefs, pd.array(mse, "Float64")
            yield out

    return sums.mapInPandas(run, f"{schema}, n long, coefficients array<double>, mse double")


def window_curve(row) -> Curve:
    """The curve of one solved window, over [0, 1]."""
    return Curve("chebyshev", tuple(row["coefficients"]), 0.0, 1.0)


def stream_to_rows(sums: DataFrame) -> DataFrame:
    """Runs a streaming aggregate over all that is there now and gives its rows. Each
    batch writes its whole state to a folder of its own; the last one is read."""
    spark, last = sums.sparkSession, {}
    base = shared_dir(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        last["at"] = f"{base}/rows-{number}"
        batch.write.mode("overwrite").parquet(last["at"])

    q = sums.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    if not last:
        return spark.createDataFrame([], sums.schema)
    return spark.read.schema(sums.schema).parquet(last["at"])
