"""Survival of conclusions under corrupted knowledge: curves, areas under them, and their checks.

draws: instance, network, d (corruption depth), contradictory, survived; a row a draw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def curve(draws: DataFrame, keys: tuple[str, ...] = ("instance", "d")) -> DataFrame:
    """keys, n_eval, n_contradictory, n_survived, s (null where nothing was evaluated) and s_fail (contradictions as failures)."""
    count = lambda c: F.count_if(c)
    found = draws.groupBy(*keys).agg(
        count(~F.col("contradictory")).alias("n_eval"),
        count("contradictory").alias("n_contradictory"),
        count(~F.col("contradictory") & F.col("survived")).alias("n_survived"),
    )
    return found.withColumns({"s": F.try_divide("n_survived", "n_eval"), "s_fail": F.col("n_survived") / (F.col("n_eval") + F.col("n_contradictory"))})


def area_at_fractions(curves: DataFrame, depth: int, least: int = 1, steps: int = 10) -> DataFrame:
    """instance, auc: mean of s over the targets depth * 1/steps ... depth, each at the nearest depth where s is defined.

    Ties go to the smaller depth; depths with under ``least`` evaluated draws don't count. An instance's
    curve has few points, so each finds its nearest within its own array.
    """
    points = curves.filter(F.col("s").isNotNull() & (F.col("n_eval") >= least))
    lists = points.groupBy("instance").agg(F.sort_array(F.collect_list(F.struct("d", "s"))).alias("points"))

    def nearest(target: Column) -> Column:
        near = F.array_min(F.transform("points", lambda p: F.struct(F.abs(p["d"] - target).alias("gap"), p["d"].alias("d"), p["s"].alias("s"))))
        return near["s"]

    at = F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda i: nearest(i * F.lit(depth) / F.lit(steps)))
    return lists.select("instance", (F.aggregate(at, F.lit(0.0), lambda a, x: a + x) / steps).alias("auc"))


def non_monotonic(curves: DataFrame) -> DataFrame:
    """Instances, and how many have a curve that rises somewhere."""
    before = F.lag("s").over(Window.partitionBy("instance").orderBy("d"))
    rises = curves.filter("s is not null").withColumn("rises", F.coalesce((F.col("s") > before).cast("int"), F.lit(0)))
    return rises.groupBy("instance").agg(F.max("rises").alias("rises")).agg(F.count("*").alias("n_instances"), F.sum("rises").alias("n_rising"))


def bin_left(x: Column, width: float) -> Column:
    """Left edge of the bin of a width that x falls into."""
    return F.round(F.floor(F.round(x / F.lit(width), 9)) * F.lit(width), 9)
