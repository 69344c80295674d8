"""Readers of point files, and sinks for models and drawings.

Readers are plain Spark scans, so a folder of any number of files is read in
parallel and columns prune as usual. Both keep the order of a file in ``ord``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.display import equation
from ..plans.model import MODEL_SCHEMA, Curve


def points_csv(spark: SparkSession, path: str) -> DataFrame:
    """(x, y) from the first two comma fields. The first line of a file may be a
    heading; any other line that isn't two numbers stops the job."""
    lines = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("ord"))
    part = lambda i: F.expr(f"try_cast(trim(split_part(value, ',', {i})) as double)")
    rows = lines.where("trim(value) <> ''").select("ord", part(1).alias("x"), part(2).alias("y"), "value", "_at")
    # only the first line of a file can be a heading: its split starts at byte 0 and its id ends in 0
    heading = (F.col("_at") == 0) & (F.col("ord").bitwiseAND(F.lit((1 << 33) - 1)) == 0)
    bad = F.col("x").isNull() | F.col("y").isNull()
    rows = rows.where(~(bad & heading))
    stop = F.raise_error(F.concat(F.lit("not a point: "), F.col("value"))).cast("double")
    return rows.select("ord", F.when(bad, stop).otherwise(F.col("x")).alias("x"), F.when(bad, stop).otherwise(F.col("y")).alias("y"))


def points_json(spark: SparkSession, path: str) -> DataFrame:
    """(ord, x, y) of files that hold [[x, y], ...]."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<array<double>>").alias("p"))
    return text.select(F.posexplode("p").alias("ord", "p")).select(F.col("ord").cast("long").alias("ord"), F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"))


def points_memory(spark: SparkSession, pairs: Iterable[tuple[float, float]]) -> DataFrame:
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, "ord long, x double, y double")


def write_model(spark: SparkSession, curve: Curve, path: str) -> None:
    """One row of Parquet: the model and its equation."""
    row = spark.createDataFrame([curve.row()], MODEL_SCHEMA)
    row.withColumn("equation", F.lit(equation(curve))).coalesce(1).write.mode("overwrite").parquet(path)


def read_model(spark: SparkSession, path: str) -> Curve:
    return Curve.from_row(spark.read.parquet(path).first())


def write_svg(plot_df: DataFrame, path: str, options=None) -> None:
    """Draws a plot and writes it through Spark's own file system."""
    from ..operators.plots import svg

    spark = plot_df.sparkSession
    spark.createDataFrame([(svg(plot_df, options),)], "value string").coalesce(1).write.mode("overwrite").text(path)
