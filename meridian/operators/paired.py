"""Tests of paired differences: signs and signed ranks, by group."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Up to so many untied differences the distribution of the signed ranks is counted; beyond, or with ties, the normal one is taken.
COUNTED = 50


def sign_p(positive: int, n: int) -> float:
    """Two-sided: how often a fair coin thrown n times is at least as far from n / 2. Terms are summed from the largest down."""
    k = min(positive, n - positive)
    first = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)
    i = np.arange(k, max(0, k - 50 - int(12 * math.sqrt(n))), -1, dtype=float)
    terms = np.exp(first + np.append(0.0, np.cumsum(np.log(i / (n - i + 1)))))
    return float(min(1.0, 2 * terms.sum()))


def signed_rank_p(least: float, n: int, ties: int) -> float:
    """Two-sided, for the lesser sum of ranks. ties: sum of t^3 - t over groups of t equal sizes of difference."""
    if n <= COUNTED and not ties:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1.0
        for r in range(1, n + 1):
            ways[r:] += ways[:-r].copy()
        return float(min(1.0, 2 * ways[: int(least) + 1].sum() / 2.0**n))
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return math.erfc(abs(least - n * (n + 1) / 4) / spread / math.sqrt(2))


def paired_tests(rows: DataFrame, group: str, difference: str, least: int = 6, blocks: int = 64) -> DataFrame:
    """group, n, mean, n_pos, n_neg, n_zero, w_plus, w_minus, z, sign_p, signed_rank_p.

    Zero differences count in n, mean and n_zero alone. z is the standard score of w_plus, with ties. Null differences are left out;
    a group of zeros alone has null sums, scores and shares, one of fewer than ``least`` others no signed_rank_p. NaN and infinite
    differences are ranked as Spark orders them and make the mean what they make a sum.

    Ranks are counted within ranges of sizes (``blocks`` a group), to which the rows of lower ranges are added, so no task sees a whole
    group; equal sizes are one row by then and can't be torn apart.
    """
    given = rows.filter(F.col(difference).isNotNull()).select(F.col(group).alias("_g"), F.col(difference).cast("double").alias("_d"))
    size = F.abs("_d")
    # Row counts by size: equal ones meet before any range is drawn.
    sizes = given.filter("_d != 0").groupBy("_g", size.alias("_s")).agg(F.count("*").alias("_t"), F.count_if(F.col("_d") > 0).alias("_up"))
    cuts = sizes.groupBy("_g").agg(F.percentile_approx("_s", [i / blocks for i in range(1, blocks)], 20 * blocks).alias("_cuts")) if blocks > 1 else sizes.select("_g").distinct().withColumn("_cuts", F.array().cast("array<double>"))
    placed = sizes.join(cuts.withColumnRenamed("_g", "_h"), F.col("_g").eqNullSafe(F.col("_h"))).select("_g", "_s", "_t", "_up", F.size(F.filter("_cuts", lambda c: c < F.col("_s"))).alias("_b"))
    lower = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("_g", "_b").agg(F.sum("_t").alias("_n")).select(F.col("_g").alias("_h"), F.col("_b").alias("_c"), F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_before"))
    ranked = placed.join(before, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_b") == F.col("_c")))
    within = Window.partitionBy("_g", "_b").orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    rank = F.col("_before") + F.sum("_t").over(within) - (F.col("_t") - 1) / 2
    sums = ranked.withColumn("_rank", rank).groupBy("_g").agg(
        F.sum("_t").alias("_m"),
        F.sum(F.col("_rank") * F.col("_up")).alias("w_plus"),
        F.sum(F.col("_rank") * (F.col("_t") - F.col("_up"))).alias("w_minus"),
        F.sum(F.col("_t") * F.col("_t") * F.col("_t") - F.col("_t")).alias("_ties"),
    )
    counts = given.groupBy("_g").agg(
        F.count("*").alias("n"), F.avg("_d").alias("mean"), F.count_if(F.col("_d") > 0).alias("n_pos"), F.count_if(F.col("_d") < 0).alias("n_neg"), F.count_if(F.col("_d") == 0).alias("n_zero")
    )
    m = F.col("_m").cast("double")
    z = (F.col("w_plus") - m * (m + 1) / 4) / F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - F.col("_ties") / 48)
    told = counts.join(sums.withColumnRenamed("_g", "_h"), F.col("_g").eqNullSafe(F.col("_h")), "left").drop("_h").withColumn("z", z)

    def chances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:  # a row a group
            some = batch["_m"].notna()
            batch["sign_p"] = [sign_p(int(p), int(p + q)) if s else None for p, q, s in zip(batch["n_pos"], batch["n_neg"], some, strict=True)]
            lesser = np.minimum(batch["w_plus"], batch["w_minus"])
            batch["signed_rank_p"] = [signed_rank_p(w, int(k), int(t)) if s and k >= least else None for w, k, t, s in zip(lesser, batch["_m"], batch["_ties"], some, strict=True)]
            yield batch.drop(columns=["_m", "_ties"])

    kept = [f for f in told.schema if f.name not in ("_m", "_ties")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return told.mapInPandas(chances, f"{schema}, sign_p double, signed_rank_p double").withColumnRenamed("_g", group)
