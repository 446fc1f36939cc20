"""Linear models, possible parents and bias staircases against their definitions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.functions import bits as B
from meridian.operators import criterion as C
from meridian.operators import equivalence as Q
from meridian.operators import meek
from meridian.operators import models as L
from meridian.operators import shells as H
from meridian.operators import space as S
from meridian.operators.extensions import extensions
from meridian.sources.population import dags as population_of
from meridian.sources.population import models, pack


def packed(spark, graphs):
    edges = [(g, a, b, k) for g, (_, es) in graphs.items() for a, b, k in es]
    nodes = [(g, v) for g, (n, _) in graphs.items() for v in range(n)]
    return pack(spark.createDataFrame(edges, "gid long, a int, b int, kind string"), spark.createDataFrame(nodes, "gid long, v int"))


@pytest.fixture(scope="module")
def population(spark):
    """Random DAGs of one to six nodes with their models' moments."""
    rnd = random.Random(11)
    graphs = {}
    for g in range(80):
        n = 1 if g == 0 else rnd.randint(3, 6)
        order = rnd.sample(range(n), n)
        graphs[g] = (n, [(order[i], order[j], "d") for i in range(n) for j in range(i + 1, n) if rnd.random() < 0.6])
    return L.moments(models(packed(spark, graphs).select("gid", "labels", "pa"))).cache()


def arrays(r):
    n = len(r.labels)
    return n, np.array(r.weights).reshape(n, n), np.array(r.noise), np.array(r.effects).reshape(n, n), np.array(r.sigma).reshape(n, n)


def test_moments(population):
    """Effects by walking every directed path, covariances by the sum over common sources; a chain of two by hand."""
    for r in population.collect():
        n, w, noise, effects, sigma = arrays(r)
        assert all((w[j, i] != 0) == bool(r.pa[j] >> i & 1) for i in range(n) for j in range(n))
        assert ((np.abs(w[w != 0]) >= 0.3) & (np.abs(w[w != 0]) < 1.5)).all() and ((noise >= 0.5) & (noise < 1.5)).all()
        walk = lambda a, b, n=n, w=w: (a == b) + sum(w[c, a] * walk(c, b) for c in range(n) if w[c, a])  # noqa: B023, E731
        slow = np.array([[walk(a, b) for a in range(n)] for b in range(n)])
        assert np.allclose(effects, slow)
        assert np.allclose(sigma, sum(noise[k] * np.outer(slow[:, k], slow[:, k]) for k in range(n)))


def test_two_nodes(spark):
    pair = packed(spark, {1: (2, [(0, 1, "d")])}).withColumns({"weights": F.array(*[F.lit(v) for v in (0.0, 0.0, 0.7, 0.0)]), "noise": F.array(F.lit(2.0), F.lit(0.5))})
    r = L.moments(pair).first()
    assert np.allclose(r.sigma, [2.0, 1.4, 1.4, 0.7**2 * 2 + 0.5]) and np.allclose(r.effects, [1, 0, 0.7, 1])
    told = L.adjusted(L.moments(pair).withColumns({"x": F.lit(0), "y": F.lit(1), "z": F.lit(0).cast("long")})).first()
    assert np.allclose([told.theta, told.bias, told.variance], [0.7, 0, 0.25])


def plain_regression(sigma, x, y, z):
    on = [x, *z]
    found = np.linalg.solve(sigma[np.ix_(on, on)], sigma[on, y])
    return found[0], sigma[y, y] - found @ sigma[on, y]


def test_adjustment(population):
    """Every pair with every set: coefficient, bias and variance; valid sets have no bias, and there are others."""
    rows = population.filter(F.size("labels") >= 3)
    n = F.size("labels")
    pairs = rows.withColumn("x", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("y", F.pmod(F.col("x") + 1 + F.col("gid") % 2, n).cast("int"))
    asked = pairs.withColumn("z", F.explode(F.sequence(F.lit(0).cast("long"), B.bit(n) - 1))).filter(~B.has(F.col("z"), F.col("x")) & ~B.has(F.col("z"), F.col("y")))
    told = L.adjusted(asked.withColumn("nb", F.transform("pa", lambda _: B.zero()))).collect()
    zero = 0
    for r in told:
        n, _, _, effects, sigma = arrays(r)
        z = [v for v in range(n) if r.z >> v & 1]
        theta, left = plain_regression(sigma, r.x, r.y, z)
        before = sigma[r.x, r.x] - (sigma[r.x, z] @ np.linalg.solve(sigma[np.ix_(z, z)], sigma[z, r.x]) if z else 0)
        assert np.allclose([r.theta, r.bias, r.variance], [theta, theta - effects[r.y, r.x], left / before])
        one = lambda v: np.array([v], np.int64)
        valid = not C.fails(np.array([r.pa]), np.array([r.nb]), one(r.x), one(r.y), one(r.z))[0]
        assert not valid or abs(r.bias) < 1e-9
        zero += valid
    assert 100 < zero < len(told) and max(abs(r.bias) for r in told) > 0.1


@pytest.fixture(scope="module")
def states(spark, population):
    """CPDAGs with a random part of their open edges known as in the DAG."""
    rnd = random.Random(4)
    rows = population.filter(F.size("labels") >= 3)
    cpdags = meek.cpdag(rows.select("gid", "labels", "pa")).withColumns({"fixed": F.col("pa"), "loose": F.col("nb")}).cache()
    truth = {r.gid: r.pa for r in rows.select("gid", "pa").collect()}
    claims = [(r.gid, i, j) for r in cpdags.collect() for j, m in enumerate(r.nb) for i in range(len(r.nb)) if m >> i & 1 and truth[r.gid][j] >> i & 1 and rnd.random() < 0.6]
    known = meek.apply_knowledge(cpdags, spark.createDataFrame(claims, "gid long, a int, b int")).drop("status")
    n = F.size("labels")
    asked = known.withColumns({"x": F.pmod(F.col("gid"), n).cast("int"), "y": F.pmod(F.col("gid") + 1, n).cast("int")})
    law = rows.select("gid", "weights", "noise", "effects", "sigma")
    return L.adjusted(asked.join(law, "gid").withColumn("z", F.lit(0).cast("long"))).cache()


def every_dag(states):
    found = {}
    for r in extensions(states.select("gid", "labels", F.col("fixed").alias("pa"), F.col("loose").alias("nb"))).collect():
        found.setdefault(r.gid, []).append(r.pa)
    return found


def test_parent_sets(states):
    """Found around x alone, they are those of all DAGs; for every node of every state."""
    every = _cache(states)
    for r in states.collect():
        n = len(r.labels)
        allowed = [d for d in every[r.gid] if all(p & q == p for p, q in zip(r.pa, d, strict=True))]
        for x in range(n):
            g, sets = L.parent_sets(np.array([r.pa], np.int64), np.array([r.nb], np.int64), np.array([x]))
            assert len(set(sets.tolist())) == len(sets) and set(sets.tolist()) == {d[x] for d in allowed}


_known = {}


def _cache(states):
    if not _known:
        _known.update(every_dag(states))
    return _known


def test_worst_case_bias(states):
    every = _cache(states)
    for r in L.worst_case_bias(states).collect():
        n, _, _, _, sigma = arrays(r)
        allowed = [d for d in every[r.gid] if all(p & q == p for p, q in zip(r.pa, d, strict=True))]
        effects = {d[r.x]: 0.0 if d[r.x] >> r.y & 1 else plain_regression(sigma, r.x, r.y, [v for v in range(n) if d[r.x] >> v & 1])[0] for d in allowed}
        assert r.n_parent_sets == len(effects)
        assert np.allclose([r.worst, r.effect_min, r.effect_max], [max(abs(r.theta - e) for e in effects.values()), min(effects.values()), max(effects.values())])
        assert abs(abs(r.theta - effects[r.parents]) - r.worst) < 1e-9


def test_profile_and_radii(states):
    """Depth by depth over the states themselves, dropped one subset of known edges after the other; ends early where asked."""
    every = _cache(states)
    profile = {}
    for r in L.bias_profile(states).collect():
        profile.setdefault(r.gid, {})[r.d] = r
    rows = states.collect()
    whole = {}
    for r in rows:
        n, _, _, _, sigma = arrays(r)
        known = [(i, j) for j in range(n) for i in range(n) if (r.pa[j] & ~r.fixed[j]) >> i & 1]
        beta = {}
        for d in range(len(known) + 1):
            worst = 0.0
            for kept in itertools.combinations(known, len(known) - d):
                for dag in every[r.gid]:
                    if all(dag[j] >> i & 1 for i, j in kept):
                        e = 0.0 if dag[r.x] >> r.y & 1 else plain_regression(sigma, r.x, r.y, [v for v in range(n) if dag[r.x] >> v & 1])[0]
                        worst = max(worst, abs(r.theta - e))
            beta[d] = worst
        assert np.allclose([profile[r.gid][d].beta_up for d in range(len(known) + 1)], list(beta.values())) and len(profile[r.gid]) == len(known) + 1
        whole[r.gid] = (beta, abs(r.theta), len(known))
    assert max(k for _, _, k in whole.values()) >= 4
    radii = {}
    for r in L.epsilon_radii(L.bias_profile(states, above=1.0), states).collect():
        radii.setdefault(r.gid, {})[r.epsilon] = r.r_eps
    for gid, (beta, theta, _) in whole.items():
        if theta < 1e-12:
            assert set(radii[gid].values()) == {None}
            continue
        for e in L.EPSILONS:
            if all(abs(b - e * theta) > 1e-9 for b in beta.values()):
                assert radii[gid][e] == next((d for d, b in beta.items() if b > e * theta), -1)
    assert len({r for own in radii.values() for r in own.values()}) >= 4


def test_bands(spark):
    radii = spark.createDataFrame([(1, 0.1, 1), (1, 0.5, 3), (1, 1.0, -1), (2, 0.1, None)], "gid long, epsilon double, r_eps int")
    budgets = spark.createDataFrame([(g, k) for g in (1, 2) for k in range(4)], "gid long, k int")
    found = {(r.gid, r.k): (r.lower, r.upper) for r in L.certified_band(radii, budgets).collect()}
    assert found == {(1, 0): (None, 0.1), (1, 1): (0.1, 0.5), (1, 2): (0.1, 0.5), (1, 3): (0.5, 1.0)}


def test_empty(states):
    none = states.filter("false")
    assert L.bias_profile(none).collect() == [] and L.worst_case_bias(none).collect() == [] and L.moments(none).collect() == []
    assert S.retract(none).collect() == []


def test_subsets_and_draws():
    for n in range(7):
        for d in range(n + 1):
            ways = [H.subset(r, n, d) for r in range(math.comb(n, d))]
            assert len(set(ways)) == len(ways) and all(m.bit_count() == d and m < 1 << n for m in ways)
    assert H.subset(math.comb(60, 30) - 1, 60, 30) == sum(1 << i for i in range(30, 60))
    assert H.drawn(5, 5, "s") == [0, 1, 2, 3, 4]
    counts = np.zeros(10)
    for s in range(4000):
        found = H.drawn(10, 3, str(s))
        assert len(set(found)) == 3 and max(found) < 10
        counts[found] += 1
    assert abs(counts / 4000 - 0.3).max() < 0.04
    assert len(set(H.drawn(10**30, 50, "t"))) == 50


def shells(states, every):
    """By definition: the worst bias after dropping each subset of the known edges."""
    out = {}
    for r in states.collect():
        n, _, _, _, sigma = arrays(r)
        known = [(i, j) for j in range(n) for i in range(n) if (r.pa[j] & ~r.fixed[j]) >> i & 1]
        off = [(d, abs(r.theta - (0.0 if d[r.x] >> r.y & 1 else plain_regression(sigma, r.x, r.y, [v for v in range(n) if d[r.x] >> v & 1])[0]))) for d in every[r.gid]]
        for d in range(len(known) + 1):
            worst = [max(b for dag, b in off if all(dag[j] >> i & 1 for i, j in kept)) for kept in itertools.combinations(known, len(known) - d)]
            out[r.gid, d] = np.where(np.array(worst) < L.ZERO, 0.0, worst)
    return out


def test_mean_profile(states):
    expected = shells(states, _cache(states))
    found = {(r.gid, r.d): r for r in H.mean_bounds(H.mean_profile(states)).collect()}
    assert set(found) == set(expected)
    for key, b in expected.items():
        r = found[key]
        assert (r.n_subsets, r.n_evaluated, r.se) == (len(b), len(b), 0.0)
        least = b[b > 0].min() if (b > 0).any() else 0.0
        assert np.allclose([r.mean, r.beta_up, r.min_nonzero, r.frac_nonzero], [b.mean(), b.max(), least, (b > 0).mean()])
        assert r.lower - 1e-9 <= r.mean <= r.upper + 1e-9
    radii = {r.gid: r.r_mean for r in H.mean_radius(H.mean_profile(states), 0.2).collect()}
    for gid in {g for g, _ in expected}:
        means = {d: b.mean() for (g, d), b in expected.items() if g == gid}
        assert radii[gid] == next((d for d in sorted(means) if means[d] > 0.2), -1)


def test_sampled_shells(states):
    """A sample never says more than the shell; its intervals hold the mean nearly always, over many seeds."""
    expected = shells(states, _cache(states))
    large = {k: b for k, b in expected.items() if len(b) > 8 and b.std() > 0}
    assert large
    held = []
    for seed in range(6):
        for r in H.mean_profile(states, most=8, seed=seed).collect():
            b = expected[r.gid, r.d]
            assert r.n_evaluated == min(8, len(b)) and r.beta_up <= b.max() + 1e-9 and (r.se == 0 or len(b) > 8)
            if (r.gid, r.d) in large:
                held.append(abs(r["mean"] - b.mean()) <= 3 * r.se + 1e-9)
    assert np.mean(held) > 0.85


def test_covered_edges_join_each_class(spark):
    """Every DAG of a class is as many turns away as it differs in edges; all classes of four nodes."""
    graphs = {}
    pairs = list(itertools.combinations(range(4), 2))
    for way in itertools.product((0, 1, 2), repeat=6):
        es = [p if w == 1 else p[::-1] for p, w in zip(pairs, way, strict=True) if w]
        if any(all(p.index(a) < p.index(b) for a, b in es) for p in itertools.permutations(range(4))):
            graphs[len(graphs)] = (4, [(a, b, "d") for a, b in es])
    assert len(graphs) == 543
    dags = packed(spark, graphs).select("gid", "labels", "pa").cache()
    members = {}
    for r in extensions(meek.cpdag(dags)).collect():
        members.setdefault(r.gid, set()).add(tuple(r.pa))
    own = {r.gid: tuple(r.pa) for r in dags.collect()}
    turned = {}
    for r in Q.turns(dags).collect():
        turned.setdefault(r.gid, set()).add(tuple(r.turned))
    assert all(t <= members[g] for g, t in turned.items())
    few = dags.filter("gid % 9 = 0")
    walked = {}
    for r in Q.class_walk(extensions(meek.cpdag(few)), few.select("gid", F.col("pa").alias("state"))).collect():
        walked.setdefault(r.gid, {})[tuple(r.state)] = r.distance
    for g, found in walked.items():
        assert found == {m: sum((a ^ b).bit_count() for a, b in zip(m, own[g], strict=True)) // 2 for m in members[g]}


def test_turns_apart_are_hops(spark, sf_dir):
    """The edges that differ number the steps which the search over covered edges takes."""
    few = population_of(spark, sf_dir).filter("gid % 9 = 0")
    walked = Q.class_walk(extensions(meek.cpdag(few)), few.select("gid", F.col("pa").alias("state")))
    told = walked.join(few.select("gid", F.col("pa").alias("own")), "gid").select("distance", Q.turns_apart(F.col("state"), F.col("own")).alias("apart"))
    assert told.count() > 300 and told.filter("distance != apart").isEmpty()
