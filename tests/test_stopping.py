import math
import random
from statistics import NormalDist

import numpy as np
import pytest

from meridian.operators import stopping as T


def one_by_one(values, total, span, eps, first, step, cap, alpha, schedule, bound, fallback):
    """Look after look, as the rule is written."""
    n_looks = max(1, math.ceil(max(0, cap - first) / step) + 1)
    end, look = min(cap, len(values)), 0
    target = min(first, end)
    while True:
        look += 1
        arr, m = np.array(values[:target]), target
        a = T.spent(schedule, alpha, look, n_looks)
        var = arr.var(ddof=1) if m > 1 else 0.0
        if m < 2 or m >= total:
            half = 0.0
        elif bound == "normal":
            half = NormalDist().inv_cdf(1 - a / 2) * math.sqrt(var / m) * math.sqrt(1 - m / total)
        else:
            half = (math.sqrt(2 * var * math.log(2 / a) / m) + 7 * span * math.log(2 / a) / (3 * (m - 1))) * math.sqrt(1 - m / total)
        mean, lo, hi = arr.mean(), max(0.0, arr.mean() - half), arr.mean() + half
        if m >= total or hi < eps or lo > eps:
            return m, look, bool(mean > eps if m >= total else lo > eps), False
        if target >= end:
            return m, look, True if fallback == "conservative_cross" else bool(mean > eps), True
        target = min(target + step, end)


@pytest.mark.parametrize("schedule", T.SCHEDULES)
@pytest.mark.parametrize("bound,fallback", [("normal", "point_estimate"), ("bernstein", "conservative_cross")])
def test_decisions(spark, schedule, bound, fallback):
    rnd = random.Random(5)
    rows, expected = [], {}
    how = dict(first=10, step=15, cap=200, alpha=0.05, schedule=schedule, bound=bound, fallback=fallback)
    for key in range(60):
        total = rnd.choice([1, 2, 8, 40, 300, 5000])
        n, p = min(total, rnd.choice([5, 60, 400])), rnd.choice([0.02, 0.3, 0.5, 0.9])
        values = [float(rnd.random() < p) * rnd.choice([0.5, 1.0]) for _ in range(n)]
        rows += [(key, k, v, total, 1.0) for k, v in enumerate(values, 1)]
        expected[key] = one_by_one(values, total, 1.0, 0.25, **how)
    rnd.shuffle(rows)
    draws = spark.createDataFrame(rows, "key long, k int, value double, total long, span double")
    found = {r.key: (r.n_drawn, r.look, r.crosses, r.capped) for r in T.decide(draws, "key", 0.25, **how).collect()}
    assert found == expected
    assert {c for *_, c in expected.values()} == {True, False} and len({n for n, *_ in expected.values()}) > 4
    assert T.decide(draws.filter("false"), "key", 0.25, **how).collect() == []


def test_error_is_spent_once():
    assert sum(T.spent("peeling", 0.05, k, 1) for k in range(1, 100_000)) < 0.05
    assert sum(T.spent("bonferroni", 0.05, k, 40) for k in range(1, 41)) == pytest.approx(0.05)
