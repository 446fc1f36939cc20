"""Mean profiles of shells too large to go through way by way: nothing is sampled."""

import itertools
import math

import numpy as np
import pyarrow as pa
import pytest

from meridian.operators import models as L
from meridian.operators import shells as H
from meridian.operators import steps
from meridian.plans import model_queries
from meridian.plans.registry import queries

COLUMNS = {"gid": "long", "labels": "array<int>", "fixed": "array<long>", "loose": "array<long>", "pa": "array<long>", "nb": "array<long>", "x": "int", "y": "int", "sigma": "array<double>", "theta": "double"}


def ordered(gid, n, x, y):
    """A complete DAG, all edges of which are known and none by its CPDAG."""
    sigma = [float(min(i, j) + 1) + (0.3 * (i * 14 % 5 + 1) if i == j else 0.0) for i in range(n) for j in range(n)]
    return gid, list(range(n)), [0] * n, [(1 << n) - 1 & ~(1 << j) for j in range(n)], [(1 << j) - 1 for j in range(n)], [0] * n, x, y, sigma, 0.7


def chain(gid, n):
    """A known chain with coefficients and variances of 1: its first edge directs all, and y has no effect of x left beside the second node."""
    beside = [sum(1 << i for i in (j - 1, j + 1) if 0 <= i < n) for j in range(n)]
    sigma = [float(min(i, j) + 1) for i in range(n) for j in range(n)]
    return gid, list(range(n)), [0] * n, beside, [0, *[1 << j for j in range(n - 1)]], [0] * n, 0, n - 1, sigma, 1.0


def batch(*rows):
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(zip(*rows, strict=True), COLUMNS.values(), strict=True)], names=list(COLUMNS))


def by_definition(row):
    """Every way of a complete graph, from the orders of its nodes that keep what is kept: worst bias and common edges."""
    _, labels, _, _, _, _, x, y, sigma, theta = row
    n, sigma = len(labels), np.array(sigma).reshape(len(labels), -1)
    edges = list(itertools.combinations(range(n), 2))
    worst, common = np.full(1 << len(edges), -1.0), np.full(1 << len(edges), (1 << len(edges)) - 1)
    for order in itertools.permutations(range(n)):
        at = {v: k for k, v in enumerate(order)}
        before, effect = [v for v in range(n) if at[v] < at[x]], 0.0
        if y not in before:
            on = [x, *before]
            effect = np.linalg.solve(sigma[np.ix_(on, on)], sigma[on, y])[0]
        own, off = sum(1 << e for e, (i, j) in enumerate(edges) if at[i] < at[j]), abs(theta - effect)
        worst[own] = max(worst[own], off if off > L.ZERO else 0.0)
        common[own] = own
    kept = np.arange(1 << len(edges))
    for e in range(len(edges)):
        without = kept[kept >> e & 1 == 0]
        worst[without] = np.maximum(worst[without], worst[without | 1 << e])
        common[without] &= common[without | 1 << e]
    return [(worst[at], len(np.unique(common[at]))) for d in range(len(edges) + 1) for at in [np.bitwise_count(kept) == len(edges) - d]]


def held(profile, expected):
    assert [r["d"] for r in profile] == list(range(len(expected)))
    for r, (b, n_states) in zip(profile, expected, strict=True):
        assert (r["n_subsets"], r["n_evaluated"], r["n_states"], r["se"]) == (len(b), len(b), n_states, 0.0)
        assert [r[c] for c in ("mean", "beta_up", "min_nonzero", "frac_nonzero")] == pytest.approx([b.mean(), b.max(), b[b > 0].min() if (b > 0).any() else 0.0, (b > 0).mean()])


def told(part):
    return [dict(zip(made, r, strict=True)) for _, made in H._near(part) for r in zip(*[c.to_pylist() for c in made.values()], strict=True)]


def test_large_shells_are_whole(spark, monkeypatch):
    """15 and 17 known edges, whose shells of 6,435 and 24,310 ways were sampled once: over tables, and in a batch where so many are let in."""
    rows = [ordered(1, 6, 1, 4), chain(2, 18)]
    found = {}
    for r in H.mean_profile(spark.createDataFrame(rows, ", ".join(f"{c} {k}" for c, k in COLUMNS.items()))).orderBy("gid", "d").collect():
        found.setdefault(r.gid, []).append(r.asDict())
    expected = by_definition(rows[0])
    assert max(len(b) for b, _ in expected) == 6435 and len({r["mean"] for r in found[1]}) > 4
    held(found[1], expected)
    assert [(r["n_evaluated"], r["n_states"]) for r in found[2]] == [(math.comb(17, d), min(d + 1, 17) if d < 17 else 1) for d in range(18)]
    assert [r["mean"] for r in found[2]] == pytest.approx([d / 17 for d in range(18)])
    monkeypatch.setattr(steps, "MOST_STEPS", 17)
    held(told(batch(rows[0])), expected)
    assert [r["mean"] for r in told(batch(rows[1]))] == pytest.approx([d / 17 for d in range(18)])


def test_more_ways_than_can_be_listed(monkeypatch):
    monkeypatch.setattr(steps, "MOST_STEPS", 61)
    found = told(batch(chain(1, 62)))
    assert [r["n_evaluated"] for r in found] == [math.comb(61, d) for d in range(62)]
    assert [r["mean"] for r in found] == pytest.approx([d / 61 for d in range(62)]) and [r["frac_nonzero"] for r in found] == pytest.approx([d / 61 for d in range(62)])


def test_missing_ways_are_an_error():
    one = np.ones(1, np.int64)
    with pytest.raises(ValueError, match="not all the ways"):
        H._sums(0 * one, 2 * one, 0 * one, one, np.zeros(1), one)


def test_in_a_batch_and_over_tables(spark, sf_dir):
    states = model_queries._states(spark, sf_dir).filter("gid % 3 = 0").select(*[c for c in COLUMNS if c != "loose"]).cache()
    rows = lambda found: sorted(map(tuple, found.collect()))
    found, expected = rows(H.mean_profile(states)), rows(H._by_levels(states))
    assert len(found) == len(expected) > 100 and max(r[1] for r in found) > 3
    assert np.allclose(np.array(found, float), np.array(expected, float), rtol=1e-12)


def test_query_takes_whole_shells(spark, sf_dir):
    found = queries()["mean_profile"](spark, sf_dir).collect()
    known = {}
    for r in found:
        known[r.gid] = max(known.get(r.gid, 0), r.d)
    assert all(r.n_subsets == math.comb(known[r.gid], r.d) for r in found) and len(found) == sum(n + 1 for n in known.values())
