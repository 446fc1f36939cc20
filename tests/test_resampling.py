import itertools
import math
import random

import numpy as np
import pytest

from meridian.operators import resampling as T


def tau_b(x, y):
    """Over all pairs."""
    num = tx = ty = pairs = 0
    for (a, b), (c, d) in itertools.combinations(list(zip(x, y, strict=True)), 2):
        num += np.sign(a - c) * np.sign(b - d)
        tx, ty, pairs = tx + (a == c), ty + (b == d), pairs + 1
    scale = math.sqrt((pairs - tx) * (pairs - ty))
    return num / scale if scale else None


@pytest.fixture(scope="module")
def rows():
    """Clusters of 1 to 60 rows, ties in both, one frequent value."""
    rnd = random.Random(9)
    out = []
    for c in range(9):
        for _ in range(rnd.choice([1, 4, 25, 60])):
            x = rnd.randint(-1, 4)
            out.append((c, x, rnd.randint(0, 6), rnd.choice([7.0, x + rnd.gauss(0, 2), float(rnd.randint(0, 5))])))
    return out


@pytest.mark.parametrize("blocks", [1, 7, 64])
def test_tau_without_each_cluster(spark, rows, blocks):
    given = spark.createDataFrame([*rows, (None, 1, 1, 1.0), (3, None, 1, 1.0)], "c int, x int, x2 int, y double")
    found = {r.left_out: r.tau for r in T.tau_leave_one_out(T.concordances(given, "c", "x", "y", blocks)).collect()}
    for out in [None, *range(9)]:
        kept = [r for r in rows if r[0] != out]
        assert found[out] == pytest.approx(tau_b([r[1] for r in kept], [r[3] for r in kept]))
    assert len(found) == 10


def test_resamples_repeat_rows(spark, rows):
    given = spark.createDataFrame(rows, "c int, x int, x2 int, y double")
    one, two = (T.concordances(given, "c", x, "y", 8) for x in ("x", "x2"))
    times = T.drawn_clusters(one, 12).collect()
    expected = {}
    for rep in range(12):
        drawn = {r.cluster: r.times for r in times if r.replicate == rep}
        assert sum(drawn.values()) == 9
        many = [r for r in rows for _ in range(drawn.get(r[0], 0))]
        expected[rep] = [tau_b([r[i] for r in many], [r[3] for r in many]) for i in (1, 2)]
    for i, pairs in enumerate((one, two)):
        found = {r.replicate: r.tau for r in T.resampled_tau(pairs, T.drawn_clusters(one, 12)).collect()}
        assert all(found[rep] == pytest.approx(e[i]) for rep, e in expected.items())
    told = T.paired_difference(one, two, 12).first()
    deltas = [a - b for a, b in expected.values()]
    assert told.n_valid == 12 and told.frac_above == pytest.approx(np.mean(np.array(deltas) > 0))
    assert [told.low, told.high] == pytest.approx(list(np.percentile(deltas, [2.5, 97.5])))
    assert told.delta == pytest.approx(tau_b([r[1] for r in rows], [r[3] for r in rows]) - tau_b([r[2] for r in rows], [r[3] for r in rows]))


def test_constant_and_empty(spark):
    flat = spark.createDataFrame([(1, 2, 0.5), (2, 2, 0.7), (3, 2, 0.9)], "c int, x int, y double")
    assert {r.tau for r in T.tau_leave_one_out(T.concordances(flat, "c", "x", "y")).collect()} == {None}
    assert T.concordances(flat.filter("false"), "c", "x", "y").collect() == []
    many = spark.range(300).selectExpr("1 as c", "id as x", "id as y")
    with pytest.raises(ValueError):
        T.concordances(many, "c", "x", "y")
