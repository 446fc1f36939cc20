"""Graph operators against brute force over all orientations, and the streaming forms."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from meridian.operators import meek
from meridian.operators.radius import breakdown_radius, extensions
from meridian.sources.population import edge_rows, pack
from meridian.streaming.survival import stopping_rule, windowed_counts


def acyclic(nodes, edges):
    edges, left = set(edges), set(nodes)
    while left:
        free = [v for v in left if not any(h == v and t in left for t, h in edges)]
        if not free:
            return False
        left -= set(free)
    return True


def v_structures(edges):
    adjacent = {frozenset(e) for e in edges}
    return {(frozenset((a, b)), m) for a, m in edges for b, n in edges if m == n and a != b and frozenset((a, b)) not in adjacent}


def all_extensions(nodes, directed, undirected):
    out = []
    for way in itertools.product([0, 1], repeat=len(undirected)):
        edges = set(directed) | {(b, a) if w else (a, b) for (a, b), w in zip(undirected, way)}
        if acyclic(nodes, edges):
            out.append(edges)
    return out


def random_dags(n, seed):
    rnd = random.Random(seed)
    for gid in range(n):
        k = rnd.randint(2, 5)
        order = list(range(1, k + 1))
        rnd.shuffle(order)
        yield gid, order, [(order[i], order[j]) for i in range(k) for j in range(i + 1, k) if rnd.random() < 0.55]


@pytest.fixture(scope="module")
def population(spark):
    graphs = list(random_dags(40, 3))
    edges = spark.createDataFrame([(g, a, b, "d") for g, _, es in graphs for a, b in es], "gid long, a int, b int, kind string")
    nodes = spark.createDataFrame([(g, v) for g, vs, _ in graphs for v in vs], "gid long, v int")
    return graphs, pack(edges, nodes)


def test_cpdag_and_extensions_match_brute_force(population):
    graphs, packed = population
    cpdags = meek.cpdag(packed.select("gid", "labels", "pa"))
    rows = {}
    for r in edge_rows(cpdags).collect():
        rows.setdefault(r.gid, set()).add((r.a, r.b, r.kind))
    counts = {r.gid: r["count"] for r in extensions(cpdags).groupBy("gid").count().collect()}
    for gid, nodes, edges in graphs:
        pairs = [tuple(sorted(e)) for e in edges]
        alike = [es for es in all_extensions(nodes, [], pairs) if v_structures(es) == v_structures(set(edges))]
        expected = set()
        for a, b in pairs:
            ways = {(a, b) in es for es in alike}
            expected.add((a, b, "u") if len(ways) == 2 else ((a, b, "d") if ways.pop() else (b, a, "d")))
        assert rows.get(gid, set()) == expected
        assert counts[gid] == len(alike)


def valid(nodes, edges, x, y, z):
    """Back-door criterion by enumerating paths."""
    below, grown = {x}, True
    while grown:
        more = {h for t, h in edges if t in below} - below
        below, grown = below | more, bool(more)
    if set(z) & (below | {y}):
        return False

    def descends(v):
        seen = {v}
        while True:
            more = {h for t, h in edges if t in seen} - seen
            if not more:
                return seen
            seen |= more

    def walk(path):
        if path[-1] == y:
            return all(
                bool(descends(m) & set(z)) if (a, m) in edges and (b, m) in edges else m not in z
                for a, m, b in zip(path, path[1:], path[2:])
            )
        last = path[-1]
        return any(walk([*path, v]) for v in nodes if v not in path and ((v, last) in edges or ((last, v) in edges and len(path) > 1)))

    return not walk([x])


def test_radius_matches_brute_force(spark, population):
    graphs, packed = population
    cpdags = meek.cpdag(packed.select("gid", "labels", "pa"))
    opened, directed = {}, {}
    for r in edge_rows(cpdags).collect():
        (opened if r.kind == "u" else directed).setdefault(r.gid, []).append((r.a, r.b))
    truth = {g: set(es) for g, _, es in graphs}
    claims, queries, expected = [], [], {}
    for gid, nodes, edges in graphs:
        und = opened.get(gid, [])
        if len(nodes) < 3 or not 1 <= len(und) <= 4:
            continue
        x, y = sorted(nodes)[0], sorted(nodes)[-1]
        z = [p for p in nodes if (p, x) in truth[gid] and p != y]
        own = [e if e in truth[gid] else e[::-1] for e in und]
        claims += [(gid, a, b) for a, b in own]
        labels = sorted(nodes)
        queries.append((gid, labels.index(x), labels.index(y), sum(1 << labels.index(v) for v in z)))
        alike = [es for es in all_extensions(nodes, directed.get(gid, []), und) if v_structures(es) == v_structures(truth[gid])]
        expected[gid] = -1
        for k in range(3):
            fails = any(
                not all(valid(nodes, es, x, y, z) for es in alike if all(c in es for c in kept))
                for kept in itertools.combinations(own, len(own) - k)
            ) if len(own) >= k else False
            if fails:
                expected[gid] = k
                break
    asked = spark.createDataFrame(queries, "gid long, x int, y int, z long")
    found = breakdown_radius(cpdags.join(asked, "gid"), spark.createDataFrame(claims, "gid long, a int, b int"), most=2)
    assert {r.gid: r.radius for r in found.collect()} == expected
    assert len(set(expected.values())) > 1


def test_knowledge_contradictions(spark):
    edges = spark.createDataFrame([(1, 1, 2, "u"), (1, 2, 3, "u"), (2, 1, 3, "d"), (2, 2, 3, "d")], "gid long, a int, b int, kind string")
    nodes = spark.createDataFrame([(g, v) for g in (1, 2) for v in (1, 2, 3)], "gid long, v int")
    graphs = pack(edges, nodes)
    told = lambda rows: {r.gid: r.status for r in meek.apply_knowledge(graphs, spark.createDataFrame(rows, "gid long, a int, b int")).collect()}
    assert told([(1, 1, 2), (2, 1, 3)]) == {1: "ok", 2: "ok"}
    assert told([(1, 1, 2), (1, 3, 2), (2, 3, 1)])[2] == "contradiction"
    assert told([(1, 1, 3)])[1] == "contradiction"


def test_streams(spark, sf_dir, tmp_path):
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = windowed_counts(events, "ts", "event_type", "1 hour", late="3650 days").writeStream.format("memory").queryName("counts").outputMode("update").start()
    query.processAllAvailable()
    query.stop()
    best = spark.sql("select sum(n) as n from (select start, kind, max(n) as n from counts group by start, kind)").first().n
    assert best == source.count()
    draws = events.selectExpr("user_id % 5 as instance", "value > 0 as survived")
    query = stopping_rule(draws, half_width=0.05).writeStream.format("memory").queryName("stops").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    last = spark.sql("select instance, max(n) as n, max(stopped) as stopped from stops group by instance").collect()
    assert len(last) == 5 and all(r.n >= 30 for r in last)


def test_extensions_of_dense_graphs(spark):
    """All orders of a clique of six nodes (15 open edges), and one of its edges known."""
    edges = [(g, a, b, "d" if (g, a, b) == (2, 1, 2) else "u") for g in (1, 2) for a, b in itertools.combinations(range(1, 7), 2)]
    nodes = spark.createDataFrame([(g, v) for g in (1, 2) for v in range(1, 7)], "gid long, v int")
    found = extensions(pack(spark.createDataFrame(edges, "gid long, a int, b int, kind string"), nodes))
    assert found.columns == ["gid", "labels", "pa"]
    assert {r.gid: (r.n, r.d) for r in found.groupBy("gid").agg(F.count("*").alias("n"), F.count_distinct("pa").alias("d")).collect()} == {1: (720, 720), 2: (360, 360)}


def test_extensions_do_not_depend_on_the_bound(population):
    _, packed = population
    cpdags = meek.cpdag(packed.select("gid", "labels", "pa"))
    rows = lambda most: sorted((r.gid, r.pa) for r in extensions(cpdags, most).collect())
    assert rows(1) == rows(12)


def test_radius_beyond_the_third_shell(spark):
    """A path of five nodes, where each claim implies those after it; told by brute force over all claims."""
    path, own = range(1, 6), [(i, i + 1) for i in range(1, 5)]
    alike = [es for es in all_extensions(path, [], own) if not v_structures(es)]
    asked, expected = [], {}
    for gid, (x, y, z) in enumerate([(1, 2, []), (3, 5, [2]), (4, 5, [3]), (4, 5, [])]):
        fails = (k for k in range(5) if any(not all(valid(path, es, x, y, z) for es in alike if all(c in es for c in kept)) for kept in itertools.combinations(own, 4 - k)))
        expected[gid] = next(fails, -1)
        asked.append((gid, x - 1, y - 1, sum(1 << (v - 1) for v in z)))
    assert 4 in expected.values()
    edges = spark.createDataFrame([(g, a, b, "u") for g in expected for a, b in own], "gid long, a int, b int, kind string")
    nodes = spark.createDataFrame([(g, v) for g in expected for v in path], "gid long, v int")
    found = breakdown_radius(pack(edges, nodes).join(spark.createDataFrame(asked, "gid long, x int, y int, z long"), "gid"), edges.select("gid", "a", "b"))
    assert {r.gid: r.radius for r in found.collect()} == expected


def test_radius_query_takes_graphs_of_every_size(spark, sf_dir):
    """Every graph of three nodes or more that has a causal path gets a row."""
    from meridian.plans.graph_queries import _pairs, radius
    from meridian.functions import bits as B

    pairs = _pairs(spark, sf_dir).filter(B.has(F.get("de", F.col("x")), F.col("y")))
    assert {r.gid for r in radius(spark, sf_dir).collect()} == {r.gid for r in pairs.select("gid").collect()}
    assert pairs.filter(F.size("labels") == 7).count() > 0
