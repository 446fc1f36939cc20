"""Kendall's tau-b under resampling of whole clusters.

What pairs of rows say is summed by pair of clusters once: a, how many pairs with a row of g above a row of h in y are in the same
order in x, less those in the other; tx and ty, pairs that tie in x or in y. A resample that takes cluster g w(g) times has
the sums over g and h of w(g) w(h) times these, so no row is repeated, whatever the number of resamples.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixpoint import settle

#: Most values that x may have: the sums within a block are a matrix of clusters times values.
MOST_LEVELS = 256


def concordances(rows: DataFrame, cluster: str, x: str, y: str, blocks: int = 64) -> DataFrame:
    """g, h, a, tx, ty for every pair of clusters, both orders, and n, the rows of g.

    rows without a cluster, x or y do not count. x has at most MOST_LEVELS values. Values of y are dealt by its quantiles
    into blocks; pairs within a block are counted in one pass over its sorted values, pairs between blocks from their totals. Rows
    that agree in all three are one cell, so no value of y is too frequent for a task.
    """
    told = rows.select(F.col(cluster).alias("g"), F.col(x).alias("x"), F.col(y).alias("y")).dropna()
    cells = settle(told.groupBy("g", "x", "y").agg(F.count("*").alias("n")))
    bounds = cells.agg(F.percentile_approx("y", F.array(*[F.lit(i / blocks) for i in range(1, blocks)]), 10_000)).first()[0] or []
    names = {c: [r[0] for r in cells.select(c).distinct().orderBy(c).limit(MOST_LEVELS + 1 if c == "x" else 10_000).collect()] for c in ("g", "x")}
    if len(names["x"]) > MOST_LEVELS:
        raise ValueError(f"{x} has over {MOST_LEVELS} values")
    place = lambda c: F.array_position(F.array(*[F.lit(v) for v in names[c]]), F.col(c)) - 1
    if not names["g"]:
        return cells.select("g", F.col("g").alias("h"), *[F.lit(0.0).alias(c) for c in ("a", "tx", "ty")], F.lit(0.0).alias("n"))
    block = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col("y"))) if bounds else F.lit(0)
    placed = settle(cells.select(place("g").cast("int").alias("gi"), place("x").cast("int").alias("xi"), "y", "n", block.alias("block")))
    n_g, n_x = len(names["g"]), len(names["x"])

    def within(part: pa.Table) -> pa.Table:
        gi, xi, n = (part.column(c).to_numpy() for c in ("gi", "xi", "n"))
        values, at = np.unique(part.column("y").to_numpy(), return_inverse=True)
        counts = np.zeros((len(values), n_g, n_x))
        np.add.at(counts, (at, gi, xi), n)
        below = np.cumsum(counts, axis=0) - counts
        lower = np.cumsum(below, axis=2) - below  # rows with less y and less x
        higher = below.sum(axis=2, keepdims=True) - below - lower
        a = np.einsum("ugl,uhl->gh", counts, lower - higher)
        sums = counts.sum(axis=2)
        g, h = np.divmod(np.arange(n_g * n_g), n_g)
        return pa.table({"gi": pa.array(g, pa.int32()), "hi": pa.array(h, pa.int32()), "a": a.ravel(), "ty": (sums.T @ sums).ravel()})

    own = placed.groupBy("block").applyInArrow(within, "gi int, hi int, a double, ty double")
    totals = placed.groupBy("block", "gi", "xi").agg(F.sum("n").alias("n"))
    # Rows of lower blocks, by cluster and x: blocks times clusters times values of x, whatever the number of rows.
    earlier = totals.select(F.explode(F.sequence(F.col("block") + 1, F.lit(blocks))).alias("block"), F.col("gi").alias("hi"), F.col("xi").alias("xj"), F.col("n").alias("m"))
    before = earlier.groupBy("block", "hi", "xj").agg(F.sum("m").alias("m"))
    order = F.signum((F.col("xi") - F.col("xj")).cast("double"))
    between = totals.join(before, "block").groupBy("gi", "hi").agg(F.sum(order * F.col("n") * F.col("m")).alias("a")).withColumn("ty", F.lit(0.0))
    levels = totals.groupBy("gi", "xi").agg(F.sum("n").alias("n"))
    tied = levels.join(levels.select("xi", F.col("gi").alias("hi"), F.col("n").alias("m")), "xi").groupBy("gi", "hi").agg(F.sum(F.col("n") * F.col("m")).cast("double").alias("tx"))
    sizes = levels.groupBy("gi").agg(F.sum("n").cast("double").alias("n"))
    summed = own.unionByName(between).groupBy("gi", "hi").agg(F.sum("a").alias("a"), F.sum("ty").alias("ty"))
    name = lambda c: F.get(F.array(*[F.lit(v) for v in names["g"]]), F.col(c))
    joined = summed.join(tied, ["gi", "hi"], "left").join(sizes, "gi")
    return joined.select(name("gi").alias("g"), name("hi").alias("h"), "a", F.coalesce("tx", F.lit(0.0)).alias("tx"), "ty", "n")


def tau(a: Column, tx: Column, ty: Column, n: Column) -> Column:
    """tau-b from sums over all pairs of clusters (a row ties with itself in tx and ty); null where x or y has one value."""
    pairs = n * (n - 1) / 2
    scale = F.sqrt(F.greatest(F.lit(0.0), (pairs - (tx - n) / 2) * (pairs - (ty - n) / 2)))
    return F.when(scale > 0, a / scale)


_SUMS = ("a", "tx", "ty")


def tau_leave_one_out(pairs: DataFrame) -> DataFrame:
    """left_out, tau: without each cluster of concordances() in turn; null for the tau of all."""
    whole = pairs.agg(*[F.sum(c).alias(f"{c}_all") for c in _SUMS], F.sum(F.when(F.col("g") == F.col("h"), F.col("n"))).alias("n_all"))
    rows = pairs.groupBy(F.col("g").alias("left_out")).agg(*[F.sum(c).alias(f"{c}_row") for c in _SUMS], F.first("n").alias("n_out"))
    columns = pairs.groupBy(F.col("h").alias("left_out")).agg(*[F.sum(c).alias(f"{c}_col") for c in _SUMS])
    cell = pairs.filter("g = h").select(F.col("g").alias("left_out"), *[F.col(c).alias(f"{c}_own") for c in _SUMS])
    each = rows.join(columns, "left_out").join(cell, "left_out").join(F.broadcast(whole))  # one row
    less = [F.col(f"{c}_all") - F.col(f"{c}_row") - F.col(f"{c}_col") + F.col(f"{c}_own") for c in _SUMS]
    every = whole.select(F.lit(None).cast(pairs.schema["g"].dataType).alias("left_out"), tau(*[F.col(f"{c}_all") for c in _SUMS], F.col("n_all")).alias("tau"))
    return each.select("left_out", tau(*less, F.col("n_all") - F.col("n_out")).alias("tau")).unionByName(every)


def resampled_tau(pairs: DataFrame, times: DataFrame) -> DataFrame:
    """replicate, tau. times: replicate, cluster, times, how often each resample takes a cluster (absent: never)."""
    w = times.select("replicate", F.col("cluster").alias("g"), F.col("times").alias("wg"))
    both = w.join(w.select("replicate", F.col("g").alias("h"), F.col("wg").alias("wh")), "replicate").join(F.broadcast(pairs), ["g", "h"])
    weight = (F.col("wg") * F.col("wh")).cast("double")
    sums = both.groupBy("replicate").agg(*[F.sum(weight * F.col(c)).alias(c) for c in _SUMS], F.sum(F.when(F.col("g") == F.col("h"), F.col("wg") * F.col("n"))).alias("n"))
    return sums.select("replicate", tau(*[F.col(c) for c in _SUMS], F.col("n")).alias("tau"))


def drawn_clusters(pairs: DataFrame, replicates: int, tag: str = "r") -> DataFrame:
    """replicate, cluster, times: in each resample as many draws as there are clusters, with replacement, by the hash of replicate and slot."""
    names = sorted(r[0] for r in pairs.select("g").distinct().collect())
    draws = pairs.sparkSession.range(replicates * len(names)).select(F.expr(f"id div {max(1, len(names))}").alias("replicate"), F.expr(f"id % {max(1, len(names))}").alias("slot"))
    at = F.conv(F.substring(F.md5(F.concat_ws("|", "replicate", "slot", F.lit(tag))), 1, 8), 16, 10).cast("long") % max(1, len(names))
    named = draws.select("replicate", F.get(F.array(*[F.lit(v) for v in names]), at.cast("int")).alias("cluster"))
    return named.groupBy("replicate", "cluster").agg(F.count("*").alias("times"))


def paired_difference(first: DataFrame, second: DataFrame, replicates: int = 10_000, tag: str = "r") -> DataFrame:
    """delta, low, high, frac_above, n_valid: tau of the first predictor less that of the second, with the 2.5 and 97.5 % points over
    resamples that both share, the share of them above 0, and how many had both taus.

    first, second: concordances() of either predictor over the same rows.
    """
    times = settle(drawn_clusters(first, replicates, tag))
    both = resampled_tau(first, times).withColumnRenamed("tau", "one").join(resampled_tau(second, times).withColumnRenamed("tau", "two"), "replicate")
    deltas = both.select((F.col("one") - F.col("two")).alias("d")).filter("d is not null")
    points = [tau_leave_one_out(p).filter("left_out is null").select(F.col("tau").alias(c)) for p, c in ((first, "p"), (second, "q"))]
    told = deltas.agg(F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.975)).alias("high"), F.avg((F.col("d") > 0).cast("double")).alias("frac_above"), F.count("*").alias("n_valid"))
    whole = points[0].join(points[1])  # one row each
    return whole.join(told).select((F.col("p") - F.col("q")).alias("delta"), "low", "high", "frac_above", "n_valid")
