"""Knowledge spaces and radii against their definitions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.functions import bits as B
from meridian.operators import adjustment as A
from meridian.operators import criterion as C
from meridian.operators import graphs as G
from meridian.operators import knowledge as K
from meridian.operators import meek
from meridian.operators import radius as R
from meridian.operators import space as S
from meridian.sources.population import edge_rows, pack

EDGES, NODES = "gid long, a int, b int, kind string", "gid long, v int"

# The worked example's nodes, edges and claims.
NAMES = ["Age", "BMI", "BP", "CRP", "CVD", "Chol", "Smoke", "Statin"]
TRUE = [("Smoke", "BMI"), ("BMI", "Chol"), ("Chol", "CRP"), ("CRP", "Statin"), ("Chol", "Statin"), ("Statin", "BP"), ("Age", "BP"), ("Statin", "CVD"), ("BP", "CVD"), ("Age", "CVD"), ("Smoke", "CVD")]
KNOWN = {"A": [("Smoke", "BMI"), ("BMI", "Chol"), ("Chol", "CRP")], "B": [("Smoke", "BMI"), ("BMI", "Chol"), ("Chol", "CRP"), ("Statin", "CRP")], "C": [("BMI", "Chol"), ("Chol", "CRP"), ("Statin", "CRP")]}
SHELLS = {"A": ([1, 3, 4, 7, 8, 9, 5, 6, 3, 2], [0, 0, 0, 1, 3, 5, 4, 5, 3, 2]), "C": ([1, 4, 6, 9, 8, 8, 4, 5, 2, 1], [0, 0, 1, 3, 4, 5, 3, 4, 2, 1])}


def packed(spark, graphs):
    """graphs: {gid: (n, [(a, b, kind)])}."""
    edges = [(g, a, b, k) for g, (_, es) in graphs.items() for a, b, k in es]
    nodes = [(g, v) for g, (n, _) in graphs.items() for v in range(n)]
    return pack(spark.createDataFrame(edges, EDGES), spark.createDataFrame(nodes, NODES))


@pytest.fixture(scope="module")
def worked(spark):
    """Cases of the worked example, one a scenario: x, y, and z the optimal set that the analyst's state identifies."""
    at = {v: i for i, v in enumerate(NAMES)}
    dag = packed(spark, {g: (8, [(at[a], at[b], "d") for a, b in TRUE]) for g in range(3)})
    base = meek.cpdag(dag).withColumns({"fixed": F.col("pa"), "loose": F.col("nb")})
    claims = spark.createDataFrame([(g, at[a], at[b]) for g, s in enumerate("ABC") for a, b in KNOWN[s]], "gid long, a int, b int")
    known = meek.apply_knowledge(base, claims)
    assert {r.status for r in known.collect()} == {"ok"}
    pairs = known.withColumns({"x": F.lit(at["Statin"]), "y": F.lit(at["CVD"])})
    mine = F.transform(F.arrays_zip("pa", "fixed"), lambda z: B.minus(z["pa"], z["fixed"]))
    return pairs.join(A.optimal_of_state(pairs), "gid").withColumns({"claims": mine, "legal": F.lit(True)}).cache()


def test_worked_example(spark, worked):
    assert {r.n for r in worked.select((F.aggregate("loose", F.lit(0), lambda a, m: a + F.bit_count(m)) / 2).alias("n")).collect()} == {5}
    base = worked.select("gid", "labels", F.col("fixed").alias("pa"), F.col("loose").alias("nb"))
    states, covers = S.space(base)
    assert {r.gid: r["count"] for r in states.groupBy("gid").count().collect()} == {0: 48, 1: 48, 2: 48}
    reached = S.bfs_shells(S.neighbours(covers), worked.select("gid", F.col("pa").alias("state")))
    asked = states.join(worked.select("gid", "x", "y", "z"), "gid")
    failing = C.why_invalid(asked).filter("reason != ''").select("gid", F.col("pa").alias("state"))
    sizes = {(r.gid, r.distance): (r.n_states, r.n_failing) for r in S.shell_sizes(reached, failing).collect()}
    assert {(r.gid, r.distance): r.n_states for r in S.shell_sizes(reached).collect()} == {k: n for k, (n, _) in sizes.items()}
    for gid, name in ((0, "A"), (2, "C")):
        assert [sizes[gid, d] for d in range(10)] == list(zip(*SHELLS[name], strict=True))
    assert [r.radius for r in R.up_radius(worked).orderBy("gid").collect()] == [3, 3, 2]


def test_distances_are_differences(spark, worked):
    """Hops between any two states are the edges that one directs and the other does not; so is each step of a cover."""
    base = worked.filter("gid = 0").select("gid", "labels", F.col("fixed").alias("pa"), F.col("loose").alias("nb"))
    states, covers = S.space(base)
    keyed = states.withColumn("source", F.xxhash64("pa"))
    every = S.neighbours(covers).crossJoin(keyed.select("source")).select(F.col("source").alias("gid"), "state", "next")
    reached = S.bfs_shells(every, keyed.select(F.col("source").alias("gid"), F.col("pa").alias("state")))
    told = reached.join(keyed.select(F.col("source").alias("gid"), "pa"), "gid").withColumn("d", S.state_distance(F.col("pa"), F.col("state"))).collect()
    assert len(told) == 48 * 48 and all(r.distance == r.d for r in told)


def test_search_stops(spark):
    """A ring of ten and a path, each a key: stops end a key's search and no other's; several sources; a last shell."""
    ring = [(1, str(i), str((i + s) % 10)) for i in range(10) for s in (1, 9)]
    path = [(2, str(i), str(i + 1)) for i in range(4)]
    edges = spark.createDataFrame(ring + path, "gid long, state string, next string")
    sources = spark.createDataFrame([(1, "0"), (2, "0")], "gid long, state string")
    counts = lambda df: sorted((r.gid, r.distance, r.n_states) for r in S.shell_sizes(df).collect())
    assert counts(S.bfs_shells(edges, sources)) == [(1, 0, 1), *[(1, d, 2) for d in range(1, 5)], (1, 5, 1), *[(2, d, 1) for d in range(5)]]
    stops = spark.createDataFrame([(1, "2")], "gid long, state string")
    assert counts(S.bfs_shells(edges, sources, stops)) == [(1, 0, 1), (1, 1, 2), (1, 2, 2), *[(2, d, 1) for d in range(5)]]
    assert counts(S.bfs_shells(edges, sources, most=1)) == [(1, 0, 1), (1, 1, 2), (2, 0, 1), (2, 1, 1)]
    both = sources.union(spark.createDataFrame([(1, "5")], "gid long, state string"))
    assert counts(S.bfs_shells(edges, both))[:3] == [(1, 0, 2), (1, 1, 4), (1, 2, 4)]
    assert S.bfs_shells(edges, sources.filter("false")).collect() == []


def dags_of(n):
    pairs = list(itertools.combinations(range(n), 2))
    for way in itertools.product((None, 0, 1), repeat=len(pairs)):
        es = [p if w else p[::-1] for p, w in zip(pairs, way, strict=True) if w is not None]
        left = set(range(n))
        while left and (free := {v for v in left if not any(h == v and t in left for t, h in es)}):
            left -= free
        if not left:
            yield es


def test_space_of_every_cpdag_of_four_nodes(spark):
    """States by closing all 3^k ways to direct the open edges; covers by inclusion of the DAGs that they allow, with none between."""
    dags = list(dags_of(4))
    assert len(dags) == 543
    cpdags = meek.cpdag(packed(spark, {g: (4, [(a, b, "d") for a, b in es]) for g, es in enumerate(dags)})).dropDuplicates(["pa", "nb"]).cache()
    rows = cpdags.collect()
    assert len(rows) == 185
    states, covers = S.space(cpdags)
    found = {}
    for r in states.collect():
        found.setdefault(r.gid, set()).add((tuple(r.pa), tuple(r.nb)))
    pairs = {}
    for r in covers.collect():
        pairs.setdefault(r.gid, set()).add((tuple(r.lower), tuple(r.upper)))
    masks = [tuple(sum(1 << a for a, b in es if b == v) for v in range(4)) for es in dags]
    for r in rows:
        open_ = [(i, j) for i in range(4) for j in range(i + 1, 4) if r.nb[j] >> i & 1]
        ways = list(itertools.product((0, 1, 2), repeat=len(open_)))
        up, loose = np.array([r.pa] * len(ways), np.int64), np.array([r.nb] * len(ways), np.int64)
        for k, way in enumerate(ways):
            for (i, j), w in zip(open_, way, strict=True):
                if w:
                    t, h = (i, j) if w == 1 else (j, i)
                    up[k, h] |= 1 << t
                    loose[k, h] &= ~(1 << t)
                    loose[k, t] &= ~(1 << h)
        before = np.array([r.pa] * len(ways), np.int64)
        up, loose, fine = C.close(up, loose)
        fine &= ~C.new_colliders(before, up, loose)
        expected = {(tuple(p), tuple(u)) for p, u, ok in zip(up.tolist(), loose.tolist(), fine, strict=True) if ok}
        assert found[r.gid] == expected
        skeleton = tuple(int(m) for m in (np.array(r.pa) | np.array(r.nb) | C.transpose(np.array([r.pa]))[0]))
        of_class = {d for d in masks if (tuple(d), (0, 0, 0, 0)) in expected and tuple(int(m) for m in np.array(d) | C.transpose(np.array([d]))[0]) == skeleton}
        allows = {p: frozenset(d for d in of_class if all(x & y == x for x, y in zip(p, d, strict=True))) for p, _ in expected}
        below = {(a, b) for a in allows for b in allows if allows[a] < allows[b]}
        assert pairs.get(r.gid, set()) == {(a, b) for a, b in below if not any((a, c) in below and (c, b) in below for c in allows)}


def test_chain_has_six_states(spark):
    states, covers = S.space(packed(spark, {1: (3, [(0, 1, "u"), (1, 2, "u")]), 2: (3, [(0, 1, "d"), (1, 2, "d"), (2, 0, "d")])}))
    assert [r.gid for r in states.collect()] == [1] * 6 and covers.count() == 6
    empty = states.filter("false")
    assert S.space(empty)[0].collect() == [] and S.space(empty)[1].collect() == []


def star(spark, n, x, y, gid=1):
    edges = [(gid, 0, v, "u") for v in range(1, n + 1)]
    graph = pack(spark.createDataFrame(edges, EDGES), spark.createDataFrame([(gid, v) for v in range(n + 1)], NODES))
    claims = spark.createDataFrame([(gid, 0, v) for v in range(1, n + 1)], "gid long, a int, b int")
    return graph.withColumns({"x": F.lit(x), "y": F.lit(y), "z": F.lit(0).cast("long")}), claims


@pytest.mark.parametrize("n", [6, 33, 60])
def test_star(spark, n):
    """Any number of claims: one to give up, whichever the others are."""
    graphs, claims = star(spark, n, 0, n)
    found = R.breakdown_radius(graphs, claims).collect()[0]
    assert (found.radius, found.lower, found.upper) == (1, 1, 1)


def brute_radius(n, fixed, loose, claims, x, y, z):
    """Least number of claims to drop, over all subsets of them; -1 if none fails, 0 for claims that contradict."""
    for k in range(len(claims) + 1):
        for gone in itertools.combinations(range(len(claims)), k):
            up, open_ = fixed.copy(), loose.copy()
            for i, (a, b) in enumerate(claims):
                if i not in gone and not up[b] >> a & 1:
                    up[b] |= 1 << a
                    open_[b] &= ~(1 << a)
                    open_[a] &= ~(1 << b)
            judged = C.judge(up[None], open_[None], np.array([x]), np.array([y]), np.array([z]))
            if judged[0][0]:
                return k
    return -1


@pytest.fixture(scope="module")
def searched(spark):
    """CPDAGs of random DAGs of up to six nodes, some or all of their open edges claimed (seldom wrongly), any pair and any set."""
    rnd = random.Random(8)
    graphs = {}
    for g in range(260):
        n = rnd.randint(3, 6)
        order = rnd.sample(range(n), n)
        graphs[g] = (n, [(order[i], order[j], "d") for i in range(n) for j in range(i + 1, n) if rnd.random() < 0.6])
    cpdags = meek.cpdag(packed(spark, graphs)).cache()
    claims, asked = [], []
    opened = {}
    for r in edge_rows(cpdags).filter("kind = 'u'").collect():
        opened.setdefault(r.gid, []).append((r.a, r.b))
    for g, (n, es) in graphs.items():
        own = [e if (*e, "d") in es else e[::-1] for e in opened.get(g, [])][:8]
        share = rnd.choice((0.5, 1, 1))
        held = [e for e in own if rnd.random() < share]
        claims += [(g, a, b) for a, b in held]
        x, y = rnd.sample(range(n), 2)
        parents = [a for a, b, _ in es if b == x and a != y]
        z = parents if rnd.random() < 0.6 else [v for v in range(n) if v not in (x, y) and rnd.random() < 0.4]
        asked.append((g, x, y, sum(1 << v for v in z)))
    return cpdags.join(spark.createDataFrame(asked, "gid long, x int, y int, z long"), "gid").cache(), spark.createDataFrame(claims, "gid long, a int, b int"), claims


@pytest.mark.parametrize("search", [False, True])
def test_radius_matches_all_subsets(searched, monkeypatch, search):
    """Also with bounds that tell nothing, so that all is searched."""
    graphs, frame, claims = searched
    if search:
        whole = R._bounded

        def blind(part):
            rows, new = whole(part)
            import pyarrow as pa

            radius, upper, method = (np.array(new[c].to_pylist(), dtype=object) for c in ("radius", "upper", "method"))
            open_ = np.array([m in ("one_step", "bounds", "search") for m in method])
            radius[open_], method[open_] = None, "search"
            return rows, new | {"radius": pa.array(radius, pa.int32()), "method": pa.array(method, pa.string()), "lower": pa.array([1 if o else 0 for o in open_], pa.int32()), "upper": pa.array([1000 if o else int(u) for o, u in zip(open_, upper, strict=True)], pa.int32())}

        monkeypatch.setattr(R, "_bounded", blind)
    own = {}
    for g, a, b in claims:
        own.setdefault(g, []).append((a, b))
    expected = {r.gid: brute_radius(len(r.labels), np.array(r.pa), np.array(r.nb), own.get(r.gid, []), r.x, r.y, r.z) for r in graphs.collect()}
    rows = R.breakdown_radius(graphs, frame).collect()
    assert {r.gid: r.radius for r in rows} == expected and len(rows) == len(expected)
    assert {-1, 0, 1, 2} <= set(expected.values())
    if not search:
        assert all(r.lower <= r.radius <= r.upper for r in rows if r.method in ("one_step", "bounds", "search"))
        assert {r.method for r in rows} >= {"degenerate", "unreached", "one_step", "bounds"}
    asked = {r.gid: r for r in graphs.collect()}
    for r in rows:
        q, up, loose = asked[r.gid], np.array(r.pa), np.array(r.nb)
        bad = C.fails(up[None], loose[None], np.array([q.x]), np.array([q.y]), np.array([q.z]))[0]
        assert bad == (r.radius >= 0)
        if r.radius > 0:
            assert r.radius == sum(not up[b] >> a & 1 for a, b in own[r.gid])


def test_contradictory_claims(spark):
    graphs, claims = star(spark, 3, 0, 3)
    wrong = claims.union(spark.createDataFrame([(1, 1, 0), (1, 2, 0)], "gid long, a int, b int"))
    found = R.breakdown_radius(graphs, wrong).collect()[0]
    assert (found.radius, found.method) == (0, "no_extensions")
    assert R.breakdown_radius(graphs, claims.filter("false")).collect()[0].radius == 0
    assert R.breakdown_radius(graphs.filter("false"), claims).collect() == []


def test_claims_into_a_new_collider_contradict(spark):
    """Both claims are edges, and no rule is left to fire; yet no DAG of the chain has them."""
    chain = packed(spark, {1: (3, [(0, 1, "u"), (1, 2, "u")]), 2: (3, [(0, 1, "u"), (1, 2, "u"), (0, 2, "u")])})
    known = meek.apply_knowledge(chain, spark.createDataFrame([(g, a, 1) for g in (1, 2) for a in (0, 2)], "gid long, a int, b int"))
    assert {r.gid: r.status for r in known.collect()} == {1: "contradiction", 2: "ok"}


def test_separation(spark):
    graphs = packed(spark, {1: (5, [(0, 1, "u"), (1, 2, "u"), (3, 4, "u")]), 2: (3, [(0, 1, "d")])})
    asked = graphs.crossJoin(spark.createDataFrame([(0, 4), (0, 2), (0, 8), (0, 12), (2, 1)], "x int, z long"))
    found = {(r.gid, r.x, r.z): (r.separation, r.status) for r in S.separation(asked).collect()}
    assert {k[1:]: v for k, v in found.items() if k[0] == 1} == {(0, 4): (2, "measured"), (0, 2): (1, "measured"), (0, 8): (None, "no_z_member_in_component"), (0, 12): (2, "measured"), (2, 1): (2, "measured")}
    assert {v for k, v in found.items() if k[0] == 2} == {(None, "x_not_in_component")}


def test_optimal_of_state(spark):
    """A set all DAGs agree on, one they do not, and no causal path."""
    graphs = packed(spark, {1: (3, [(2, 0, "d"), (2, 1, "d"), (0, 1, "d")]), 2: (3, [(0, 1, "u"), (1, 2, "u"), (0, 2, "u")]), 3: (2, [])})
    found = A.optimal_of_state(graphs.withColumns({"x": F.lit(0), "y": F.lit(1)}))
    assert {r.gid: r.z for r in found.collect()} == {1: 4, 2: None, 3: 0}
    assert G.edge_string(graphs) is not None


def test_flip_draws(spark):
    """Just d claims are turned at depth d; states, contradictions and verdicts are those of the DAGs with the drawn claims."""
    rnd = random.Random(6)
    graphs = {}
    for g in range(40):
        n = rnd.randint(3, 5)
        order = rnd.sample(range(n), n)
        graphs[g] = (n, [(order[i], order[j], "d") for i in range(n) for j in range(i + 1, n) if rnd.random() < 0.6])
    dags = packed(spark, graphs)
    true = {r.gid: r.pa for r in dags.collect()}
    cpdags = meek.cpdag(dags).select("gid", "labels", F.col("pa").alias("fixed"), F.col("nb").alias("loose"))
    cases = cpdags.join(dags.select("gid", "pa"), "gid").withColumn("claims", F.transform(F.arrays_zip("pa", "fixed"), lambda z: B.minus(z["pa"], z["fixed"]))).drop("pa")
    cases = cases.withColumns({"x": F.lit(0), "y": F.lit(1), "z": F.when(F.col("gid") % 2 == 0, 0).otherwise(4).cast("long")}).cache()
    held = {r.gid: r.claims for r in cases.collect()}
    every = {}
    for r in R.extensions(cpdags.select("gid", "labels", F.col("fixed").alias("pa"), F.col("loose").alias("nb"))).collect():
        every.setdefault(r.gid, []).append(r.pa)
    draws = K.flip_draws(cases, 6).cache()
    told = {(r.gid, r.d, r.rep): r for r in K.judged_draws(draws).collect()}
    seen = set()
    for r in draws.collect():
        n_claims = sum(m.bit_count() for m in held[r.gid])
        assert 1 <= r.d <= n_claims and sum((m & ~t).bit_count() for m, t in zip(r.claims, true[r.gid], strict=True)) == r.d
        assert sum(m.bit_count() for m in r.claims) == n_claims
        allowed = [d for d in every[r.gid] if all(c & p == c for c, p in zip(r.claims, d, strict=True))]
        one = lambda v: np.array([v], np.int64)
        bad = any(C.fails(np.array([d], np.int64), np.zeros((1, len(d)), np.int64), one(r.x), one(r.y), one(r.z))[0] for d in allowed)
        found = told[r.gid, r.d, r.rep]
        assert found.contradictory == (not allowed) and found.survived == (bool(allowed) and not bad)
        seen.add((found.contradictory, found.survived))
    assert len(told) == draws.count() and seen == {(True, False), (False, True), (False, False)}
    assert K.judged_draws(K.flip_draws(cases.filter("false"), 3)).collect() == []


def test_spaces_are_made_where_their_graphs_are(spark, sf_dir, monkeypatch):
    """No level of a small graph's space is written: one table of graphs is, whatever the number of their states."""
    from meridian.plans import space_queries as Q

    written = []
    whole = S.settle
    monkeypatch.setattr(S, "settle", lambda df: written.append(1) or whole(df))
    assert Q.space_distances(spark, sf_dir).count() > 10000 and Q.shell_sizes(spark, sf_dir).count() > 2000
    assert len(written) == 2


def test_large_spaces_by_levels(spark, sf_dir, monkeypatch):
    """Graphs beyond the limit take the other way to the same states and covers, and branches that wait are not lost."""
    from meridian.operators import extensions as X
    from meridian.operators import meek
    from meridian.sources.population import dags

    graphs = meek.cpdag(dags(spark, sf_dir).filter("gid % 7 = 0"))
    found = lambda: [sorted(map(repr, df.collect())) for df in (*S.space(graphs), X.extensions(graphs))]
    first = found()
    monkeypatch.setattr(S, "MOST_OPEN", 3)
    assert found() == first
    monkeypatch.setattr(X, "BRANCHES", 2)
    monkeypatch.setattr(S, "DAGS", 3)
    assert found() == first


def test_graphs_are_dealt_over_tasks(spark, sf_dir):
    """Short rows are not joined to one task, as what is done with them is long."""
    from meridian.sources.population import dags

    assert dags(spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_flip_outcomes(spark, monkeypatch):
    """Draws judged where their graph is are those judged as rows of their own, in parts of any size, and no table is written."""
    rnd = random.Random(8)
    graphs = {}
    for g in range(40):
        n = rnd.randint(2, 6)
        graphs[g] = (n, [(i, j, "d") for i in range(n) for j in range(i + 1, n) if rnd.random() < 0.6])
    known = C.over_graphs(packed(spark, graphs).select("gid", "labels", "pa"), K.known_half(1.0), "fixed array<long>, loose array<long>, pa array<long>, nb array<long>")
    cases = known.withColumn("claims", F.transform(F.arrays_zip("pa", "fixed"), lambda z: B.minus(z["pa"], z["fixed"]))).drop("pa", "nb")
    cases = cases.withColumns({"x": F.lit(0), "y": F.size("labels") - 1, "z": F.when(F.col("gid") % 2 == 0, 0).otherwise(2).cast("long")}).cache()
    columns = ["gid", "d", "rep", "contradictory", "survived"]
    expected = sorted(tuple(r) for r in K.judged_draws(K.flip_draws(cases, 7)).select(*columns).collect())
    assert {r[3:] for r in expected} >= {(True, False), (False, True), (False, False)} and max(r[1] for r in expected) > 5

    def refuse(_):
        raise AssertionError("a table is written")

    monkeypatch.setattr(K, "settle", refuse)
    for most in (1, 1 << 16):
        monkeypatch.setattr(K, "DRAWS", most)
        found = K.flip_outcomes(cases, 7)
        assert found.columns == columns and sorted(tuple(r) for r in found.collect()) == expected
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
    with pytest.raises(ValueError):
        K.flip_outcomes(cases, 0)
