import functools
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.operators import criterion as C
from meridian.operators import validity as V
from meridian.sources.population import edge_rows


def has_chordless_cycle(adj):
    """By definition: a set of four nodes or more whose induced graph is one cycle."""
    n = len(adj)
    for size in range(4, n + 1):
        for nodes in itertools.combinations(range(n), size):
            inside = {v: [u for u in nodes if adj[v] >> u & 1] for v in nodes}
            if all(len(near) == 2 for near in inside.values()):
                seen, todo = {nodes[0]}, [nodes[0]]
                while todo:
                    for u in inside[todo.pop()]:
                        if u not in seen:
                            seen.add(u)
                            todo.append(u)
                if len(seen) == size:
                    return True
    return False


def acyclic(parents):
    left = set(range(len(parents)))
    while left:
        roots = [v for v in left if not any(parents[v] >> u & 1 for u in left)]
        if not roots:
            return False
        left -= set(roots)
    return True


def colliders(parents, adj):
    n = len(parents)
    return {(a, m, b) for m in range(n) for a, b in itertools.combinations(range(n), 2) if parents[m] >> a & 1 and parents[m] >> b & 1 and not adj[a] >> b & 1}


def dags_of(pa, nb):
    return _dags_of(tuple(pa), tuple(nb))


@functools.cache
def _dags_of(pa, nb):
    """All ways to turn the open edges, by definition."""
    n, found = len(pa), set()
    adj = [pa[v] | nb[v] | sum(1 << c for c in range(n) if pa[c] >> v & 1) for v in range(n)]
    open_ = [(i, j) for j in range(n) for i in range(j) if nb[j] >> i & 1]
    for ways in itertools.product((0, 1), repeat=len(open_)):
        up = list(pa)
        for (i, j), back in zip(open_, ways, strict=True):
            up[i if back else j] |= 1 << (j if back else i)
        if acyclic(up) and colliders(up, adj) == colliders(pa, adj):
            found.add(tuple(up))
    return found


@pytest.fixture(scope="module")
def graphs(spark):
    """Random graphs of up to six nodes, some directed edges against the order, some open ones; one without edges, one without nodes."""
    rnd, rows = random.Random(3), [(0, [], [], []), (1, [5], [0], [0])]
    for gid in range(2, 500):
        n, share, loose = rnd.randint(2, 6), rnd.choice([0.3, 0.5, 0.8]), rnd.choice([0.2, 0.5, 0.8])
        pa, nb = [0] * n, [0] * n
        for i, j in itertools.combinations(range(n), 2):
            if rnd.random() < share:
                if rnd.random() < loose:
                    nb[i], nb[j] = nb[i] | 1 << j, nb[j] | 1 << i
                elif rnd.random() < 0.1:
                    pa[i] |= 1 << j
                else:
                    pa[j] |= 1 << i
        rows.append((gid, [10 * v for v in range(n)], pa, nb))
    return spark.createDataFrame(rows, "gid long, labels array<int>, pa array<long>, nb array<long>").cache()


def test_conditions_match_their_definitions(graphs):
    found = {r.gid: r for r in V.conditions(graphs.withColumn("valid", F.lit("other"))).collect()}
    seen = set()
    for r in graphs.collect():
        each = dags_of(r.pa, r.nb)
        told = found[r.gid]
        assert told.acyclic == acyclic(r.pa)
        assert told.chordal == (not has_chordless_cycle(r.nb)), r
        assert told.extendable == bool(each), r
        assert told.valid == (told.acyclic and told.meek_closed and told.chordal and told.extendable)
        if each and told.acyclic:  # nothing that all DAGs share is open in a closed graph, and what a rule forces is shared
            common = any(all(d[j] >> i & 1 for d in each) for j in range(len(r.nb)) for i in range(len(r.nb)) if r.nb[j] >> i & 1)
            assert told.meek_closed == (not common), r
        seen.add((told.acyclic, told.meek_closed, told.chordal, told.extendable))
    assert len(seen) >= 8


def test_one_extension_is_one_and_fits_tells(graphs):
    found = V.with_extension(graphs).collect()
    for r in found:
        each = dags_of(r.pa, r.nb)
        assert (tuple(r.dag) in each) if r.dag is not None else not each
    rnd, asked = random.Random(5), []
    for r in found:
        n = len(r.pa)
        tries = [list(r.pa), [rnd.getrandbits(n) & ~(1 << v) if n else 0 for v in range(n)], [*r.pa, 0]]
        tries += [list(d) for d in sorted(dags_of(r.pa, r.nb))[:2]]
        turned = [m | sum(1 << i for i in range(n) if nb >> i & 1 and i < v) for v, (m, nb) in enumerate(zip(r.pa, r.nb, strict=True))]
        asked += [(r.gid, t) for t in [*tries, turned]]
    spark = graphs.sparkSession
    tested = spark.createDataFrame(asked, "gid long, d array<long>").join(graphs, "gid")
    told = V.with_fit(tested, "d").select("pa", "nb", "d", "fits").collect()
    assert all(r.fits == (tuple(r.d) in dags_of(r.pa, r.nb)) for r in told)
    assert {r.fits for r in told} == {True, False}
    assert {r.fits for r in V.with_fit(graphs.withColumn("d", F.lit(None).cast("array<long>")), "d").collect()} == {None}


def test_chordality_of_wide_graphs():
    """Cycles and paths of 62 nodes, a cycle with all chords from one node, complete graphs of every size beside them."""
    n = 62
    ring = [1 << (v - 1) % n | 1 << (v + 1) % n for v in range(n)]
    path = [sum(1 << u for u in (v - 1, v + 1) if 0 <= u < n) for v in range(n)]
    fan = [ring[v] | 1 for v in range(1, n)]
    fan = [sum(1 << v for v in range(1, n)), *[m & ~(1 << v) for v, m in enumerate(fan, 1)]]
    full = [[((1 << k) - 1) & ~(1 << v) if v < k else 0 for v in range(n)] for k in range(1, n)]
    assert V.chordal(np.array([ring, path, fan, *full], np.int64)).tolist() == [False] + [True] * (2 + len(full))
    assert V.chordal(np.zeros((0, 0), np.int64)).tolist() == [] and V.chordal(np.zeros((2, 0), np.int64)).tolist() == [True, True]
    up, found = V.one_extension(np.zeros((2, n), np.int64), np.array([ring, path], np.int64))
    assert found.tolist() == [False, True] and C.acyclic(up).all()


def test_induced_and_unoriented(spark, graphs):
    keep = F.lit(0b1001101).cast("long")
    part = {r.gid: r for r in V.induced(graphs, keep).collect()}
    for r in graphs.collect():
        left = [i for i in range(len(r.labels)) if 0b1001101 >> i & 1]
        narrow = lambda m: sum(1 << k for k, i in enumerate(left) if m >> i & 1)  # noqa: B023, E731
        expected = ([r.labels[i] for i in left], [narrow(r.pa[i]) for i in left], [narrow(r.nb[i]) for i in left])
        assert (part[r.gid].labels, part[r.gid].pa, part[r.gid].nb) == expected
    directed = edge_rows(graphs).filter("kind = 'd' and (a + b) % 3 = 0")
    asked = directed.select("gid", "a", "b").union(directed.select("gid", "b", "a")).union(spark.createDataFrame([(-1, 0, 10), (2, None, 0)], "gid long, a int, b int"))
    loose = {(r.gid, r.a, r.b, r.kind) for r in edge_rows(V.unoriented(graphs, asked)).collect()}
    expected = {(r.gid, *((min(r.a, r.b), max(r.a, r.b), "u") if r.kind == "d" and (r.a + r.b) % 3 == 0 else (r.a, r.b, r.kind))) for r in edge_rows(graphs).collect()}
    assert loose == expected
    absent = spark.createDataFrame([(1, 5, 6)], "gid long, a int, b int")
    with pytest.raises(Exception, match="no directed edge"):
        V.unoriented(graphs, absent).collect()
    assert V.unoriented(graphs, absent.filter("false")).count() == graphs.count() and V.conditions(graphs.filter("false")).count() == 0
