"""Sequential tests of a mean against a threshold: how many draws are looked at until an interval leaves the threshold out.

Draws of a key come in an order; looks are at a first number of draws and at every step of draws after it. All looks are worked
out from running sums at once, and the first that decides is the key's. Each look spends a part of the error: all of it
('fixed'), an equal part of it ('bonferroni'), or 6 / (pi k)^2 of it at look k, which never adds up to more ('peeling').
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEDULES, BOUNDS = ("fixed", "bonferroni", "peeling"), ("normal", "bernstein")
FALLBACKS = ("point_estimate", "conservative_cross")


def spent(schedule: str, alpha: float, look: int, n_looks: int) -> float:
    """The error that the look-th look (from 1) may make."""
    return {"fixed": alpha, "bonferroni": alpha / max(1, n_looks), "peeling": alpha * 6 / (math.pi * look) ** 2}[schedule]


def running(draws: DataFrame, key: str) -> DataFrame:
    """draws (key, k from 1, value) with mean and variance (n - 1 below) of the first k of each key."""
    so_far = Window.partitionBy(key).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return draws.withColumns({"mean": F.avg("value").over(so_far), "variance": F.coalesce(F.var_samp("value").over(so_far), F.lit(0.0))})


def half_width(bound: str, error: Column, z: Column, variance: Column, m: Column, total: Column, span: Column) -> Column:
    """Half an interval's width at m of total draws without replacement; span is the greatest value there can be. The empirical-Bernstein
    form is 2 v ln(2/a) / m under the root, and 7 span ln(2/a) / 3 (m - 1) beside it."""
    logs = F.log(2 / error)
    plain = z * F.sqrt(variance / m) if bound == "normal" else F.sqrt(2 * variance * logs / m) + 7 * span * logs / (3 * (m - 1))
    return F.when((m < 2) | (m >= total), 0.0).otherwise(plain * F.sqrt(F.greatest(F.lit(0.0), 1 - m / total)))


def decide(
    draws: DataFrame, key: str, epsilon: float, *, first: int = 25, step: int = 25, cap: int = 1000, alpha: float = 0.05,
    schedule: str = "peeling", bound: str = "bernstein", fallback: str = "conservative_cross",
) -> DataFrame:
    """key, n_drawn, look, crosses, capped, mean: whether each key's mean exceeds epsilon, and at which look that was decided.

    draws: key, k (1, 2, ... in the order of drawing), value, total (how many there are in all), span (their range). A key whose draws are
    all seen is decided by their mean; one that is open when cap, or its draws, end is capped, and told by the
    mean ('point_estimate') or taken to cross ('conservative_cross'). No draw after cap is looked at.
    """
    if schedule not in SCHEDULES or bound not in BOUNDS or fallback not in FALLBACKS:
        raise ValueError(f"choose from {SCHEDULES}, {BOUNDS} and {FALLBACKS}")
    n_looks = max(1, math.ceil(max(0, cap - first) / step) + 1)
    errors = [spent(schedule, alpha, k, n_looks) for k in range(1, n_looks + 1)]
    known = F.array(*[F.struct(F.lit(e).alias("a"), F.lit(NormalDist().inv_cdf(1 - min(max(e, 1e-12), 0.999999) / 2)).alias("z")) for e in errors])
    last = F.least(F.lit(cap), F.max("k").over(Window.partitionBy(key)))
    k = F.col("k")
    # A look is at a whole step, or where the draws end.
    at = running(draws.filter(k <= cap), key).withColumn("last", last).filter((k >= F.least(F.lit(first), F.col("last"))) & (((k - first) % step == 0) | (k == F.col("last"))))
    look = F.greatest(F.lit(0), F.ceil((k - first) / step)).cast("int") + 1
    told = at.withColumn("look", look).withColumn("spent", F.get(known, F.col("look") - 1))
    wide = told.withColumn("half", half_width(bound, F.col("spent.a"), F.col("spent.z"), F.col("variance"), k, F.col("total"), F.col("span")))
    low, high, whole = F.greatest(F.lit(0.0), F.col("mean") - F.col("half")), F.col("mean") + F.col("half"), k >= F.col("total")
    judged = wide.withColumns({"decided": whole | (high < epsilon) | (low > epsilon), "crosses": F.when(whole, F.col("mean") > epsilon).otherwise(low > epsilon)})
    ended = judged.filter(F.col("decided") | (k == F.col("last")))
    one = ended.groupBy(key).agg(F.min(F.struct("k", "look", "decided", "crosses", "mean")).alias("s")).select(key, "s.*")
    open_ = F.lit(True) if fallback == "conservative_cross" else F.col("mean") > epsilon
    return one.select(key, F.col("k").cast("long").alias("n_drawn"), "look", F.when(F.col("decided"), F.col("crosses")).otherwise(open_).alias("crosses"), (~F.col("decided")).alias("capped"), "mean")
