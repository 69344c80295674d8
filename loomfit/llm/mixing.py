"""Mixing sources to target weights along a time-varying curriculum [native].

Only DataFrame functions: no Python runs on the executors. Every document takes
part; a hot source is dealt over many buckets of a hash order, bucket sums are
aggregated before any shuffle and only their prefix sums are joined back.

Defined results: a null text has size 0; a null source is a source of its own
and sorts last; a null doc_id hashes by its text, so many of them fall into many
buckets; repeated rows are separate
documents (equal rows are interchangeable); an empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_RE, parallelism, written

#: Weight over training time (0 to 1) as straight lines between knots, dealt to
#: the ranked sources in turn: early, level, late.
CURRICULUM = (((0.0, 2.0), (1.0, 0.0)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.0), (1.0, 2.0)))


def when_demanded(u: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Time at which the integral of a weight schedule reaches the share u of its whole."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
    whole = sum(areas)
    if whole <= 0 or any(w < 0 for _, w in knots):
        raise ValueError("a schedule needs weights that are not negative and not all 0")
    out, before = F.lit(knots[-1][0]), whole
    for (t0, w0), (t1, w1), area in reversed(list(zip(knots, knots[1:], areas))):
        before -= area
        need = F.greatest(u * whole - before, F.lit(0.0))
        slope = (w1 - w0) / (t1 - t0)
        # area from t0 is w0 x + slope x^2 / 2; this root also holds at slope 0
        x = F.when(need <= 0, 0.0).otherwise(2 * need / (w0 + F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * need, F.lit(1e-300)))))
        out = F.when(u * whole < before + area, F.least(F.lit(t0) + x, F.lit(t1))).otherwise(out)
    return out


def source_targets(stats: DataFrame, weights: Sequence[float], max_epochs: int) -> DataFrame:
    """stats(source, source_size) -> + rank, target. One row a source: the water
    level of weights under the limits max_epochs * size, in closed form."""
    every = Window.partitionBy(F.lit(1))
    w = F.array(*[F.lit(float(x)) for x in weights])
    ranked = stats.withColumn("rank", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("w", F.element_at(w, F.col("rank") % len(weights) + 1)).withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    up = every.orderBy(F.col("cap") / F.col("w"), "rank")
    ranked = ranked.withColumns({
        "full": F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "open": F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing)),
        "total": F.sum("source_size").over(every).cast("double"),
        "at": F.row_number().over(up),
    })
    level = (F.col("total") - F.col("full")) / F.col("open")
    fits = F.when(level <= F.col("cap") / F.col("w"), F.struct("at", level.alias("level")))
    ranked = ranked.withColumn("level", F.min(fits).over(every)["level"])
    return ranked.select("source", "rank", F.coalesce(F.least("cap", F.col("w") * F.col("level")), F.col("cap")).alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_epochs: int = 3, curriculum=CURRICULUM, carry: Sequence[str] = ()) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken,
    positions (training time of each pass over it), then the columns to carry.

    A source's documents stand in hash order; its target takes whole passes over
    them and a part of one more, so words taken differ from the target by less
    than one word. Pass e of the document at offset c starts at the time when
    the source's cumulative demand reaches e * source_size + c.
    """
    n = 2 * parallelism(docs.sparkSession)
    # {"size": words}: the only pass over texts; everything below moves a few numbers a document
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_RE)), F.lit(0)).cast("long")
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.xxhash64("text").cast("string")))
    sized = written(docs.select("doc_id", "source", size.alias("size"), F.md5(name.cast("binary")).alias("h"), *carry), "sizes")
    sized = sized.withColumn("bucket", F.shiftright(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * n, 32))
    stats = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    by_source = Window.partitionBy("source")
    stats = stats.withColumns({
        "before": F.coalesce(F.sum("words").over(by_source.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "source_size": F.sum("words").over(by_source),
    })
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    t = targets.select(F.col("source").alias("t_source"), "rank", "target")
    stats = stats.join(t, F.col("source").eqNullSafe(F.col("t_source"))).select(F.col("source").alias("s_source"), F.col("bucket").alias("s_bucket"), "before", "source_size", "rank", "target")
    both = sized.join(stats, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("bucket") == F.col("s_bucket")))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("c", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    both = both.withColumn("goal", F.floor(F.col("target") + 0.5)).withColumn("passes", F.when(F.col("source_size") > 0, F.expr("goal div source_size")).otherwise(F.lit(0).cast("long")))
    left = F.col("goal") - F.col("passes") * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left - F.col("c")))
    both = both.withColumn("part", part).withColumn("taken", F.col("passes") * F.col("size") + F.col("part"))
    takes = F.col("passes") + F.when(F.col("part") > 0, 1).otherwise(0)

    def at(e: Column) -> Column:
        u = (e * F.col("source_size") + F.col("c")) / F.col("target")
        out = when_demanded(u, curriculum[-1])
        for i, knots in list(enumerate(curriculum))[-2::-1]:
            out = F.when(F.col("rank") % len(curriculum) == i, when_demanded(u, knots)).otherwise(out)
        return out

    positions = F.when((F.col("taken") > 0) & (takes > 0), F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(takes - 1, F.lit(0))), at))
    return both.select("doc_id", "source", "size", "source_size", "target", "taken", positions.alias("positions"), *carry)


def training_order(mixed: DataFrame) -> DataFrame:
    """A row for each pass over a document, range-sorted by training position."""
    each = mixed.where("taken > 0").select("doc_id", "source", "size", F.posexplode("positions").alias("epoch", "position"))
    return each.repartitionByRange("position", "doc_id", "epoch").sortWithinPartitions("position", "doc_id", "epoch")
