"""Rank statistics: Kendall's tau-b, Spearman, percentile ranks, skylines, bootstraps, intraclass correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(value: Column, *keys: str) -> Column:
    """Rank from 1 where ties share the mean of their places."""
    order = Window.partitionBy(*keys).orderBy(value)
    ties = Window.partitionBy(*keys, value)
    return F.rank().over(order) + (F.count("*").over(ties) - 1) / 2


def kendall_tau_b(rows: DataFrame, group: str, x: str, y: str, levels: list[int]) -> DataFrame:
    """group, n, tau: Kendall's tau-b of x, which has few levels, and y.

    Pairs are counted, not made: rows are summed by y and level of x, and running counts over y give
    for each row how many rows with less y have a lower, or a higher, level.
    """
    cells = rows.groupBy(group, y).agg(*[F.count_if(F.col(x) == v).alias(f"n{i}") for i, v in enumerate(levels)])
    below = Window.partitionBy(group).orderBy(y).rowsBetween(Window.unboundedPreceding, -1)
    run = cells.withColumns({f"c{i}": F.coalesce(F.sum(f"n{i}").over(below), F.lit(0)) for i in range(len(levels))})
    zero = F.lit(0).cast("long")
    pairs = lambda keep: sum((F.col(f"n{i}") * F.col(f"c{j}") for i in range(len(levels)) for j in range(len(levels)) if keep(i, j)), zero)
    same_y = sum((F.col(f"n{i}") for i in range(len(levels))), zero)
    sums = run.groupBy(group).agg(
        F.sum(pairs(lambda i, j: j < i)).alias("concordant"),
        F.sum(pairs(lambda i, j: j > i)).alias("discordant"),
        F.sum(same_y * (same_y - 1) / 2).alias("ties_y"),
        F.sum(same_y).alias("n"),
        *[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(levels))],
    )
    ties_x = sum((F.col(f"n{i}") * (F.col(f"n{i}") - 1) / 2 for i in range(len(levels))), F.lit(0.0))
    all_pairs = F.col("n") * (F.col("n") - 1) / 2
    scale = F.sqrt((all_pairs - ties_x) * (all_pairs - F.col("ties_y")))
    return sums.select(group, "n", F.try_divide(F.col("concordant") - F.col("discordant"), scale).alias("tau"))


def skyline(rows: DataFrame, group: str, first: str, second: str) -> DataFrame:
    """Rows of each group that no other row equals or exceeds in both columns and exceeds in one.

    Of each value of the first column only the greatest second can stay, and only if it is greater
    than all with a greater first.
    """
    best = rows.groupBy(group, first).agg(F.max(second).alias("_best"))
    above = Window.partitionBy(group).orderBy(F.desc(first)).rowsBetween(Window.unboundedPreceding, -1)
    front = best.withColumn("_above", F.max("_best").over(above)).filter("_above is null or _best > _above").drop("_above")
    return rows.join(front, [group, first]).filter(F.col(second) == F.col("_best")).drop("_best")


def cluster_bootstrap(sums: DataFrame, replicates: int, clusters: int, draw: Column) -> DataFrame:
    """replicate, mean: means of total / n over clusters drawn with replacement.

    sums: cluster (0, 1, ...), n, total. draw gives the cluster for columns replicate and slot; only
    sums by cluster are repeated, so the size of the data doesn't matter.
    """
    spark = sums.sparkSession
    drawn = spark.range(replicates * clusters).select((F.col("id") / clusters).cast("long").alias("replicate"), (F.col("id") % clusters).alias("slot"))
    times = drawn.select("replicate", draw.alias("cluster")).groupBy("replicate", "cluster").agg(F.count("*").alias("times"))
    joined = times.join(sums, "cluster")
    return joined.groupBy("replicate").agg((F.sum(F.col("times") * F.col("total")) / F.sum(F.col("times") * F.col("n"))).alias("mean"))


def intraclass(rows: DataFrame, group: str, value: str) -> DataFrame:
    """One-way intraclass correlation from sums by group: n_groups, n, icc."""
    by = rows.groupBy(group).agg(F.count(value).alias("k"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    sums = by.agg(
        F.count("*").alias("n_groups"), F.sum("k").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"),
        F.sum(F.col("s") * F.col("s") / F.col("k")).alias("b"), F.sum(F.col("k") * F.col("k")).alias("kk"),
    )
    between = (F.col("b") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n_groups") - 1)
    within = (F.col("q") - F.col("b")) / (F.col("n") - F.col("n_groups"))
    k0 = (F.col("n") - F.col("kk") / F.col("n")) / (F.col("n_groups") - 1)
    return sums.select("n_groups", "n", ((between - within) / (between + (k0 - 1) * within)).alias("icc"))
