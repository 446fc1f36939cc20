from itertools import combinations, permutations

from pyspark.sql import functions as F

from meridian.operators import criterion as C
from meridian.operators import meek as M
from meridian.operators import paths as P
from meridian.sources.population import dags
from meridian.plans.criterion_queries import open_edges

SCHEMA = "gid long, labels array<int>, pa array<long>, nb array<long>, x int, y int"


def asked(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def of(found):
    return sorted((r.gid, tuple(r.path)) for r in found.collect())


def ways(r):
    """All paths from x to y, by trying every order of every choice of inner nodes."""
    n = len(r.labels)
    adjacent = lambda a, b: r.pa[b] >> a & 1 or r.pa[a] >> b & 1 or r.nb[a] >> b & 1
    inner = [v for v in range(n) if v not in (r.x, r.y)]
    for k in range(len(inner) + 1):
        for chosen in combinations(inner, k):
            for order in permutations(chosen):
                path = (r.x, *order, r.y)
                if all(adjacent(a, b) for a, b in zip(path, path[1:])):
                    yield path


def definite(r, path):
    arrow = lambda a, b: bool(r.pa[b] >> a & 1)
    loose = lambda a, b: bool(r.nb[b] >> a & 1)
    for u, v, w in zip(path, path[1:], path[2:]):
        near = arrow(u, w) or arrow(w, u) or loose(u, w)
        if not (arrow(u, v) and arrow(w, v) or arrow(v, u) or arrow(v, w) or loose(u, v) and loose(v, w) and not near):
            return False
    return True


def known(spark, sf_dir):
    """Graphs of the population, some with part of their knowledge, asked from the last node to the first and back."""
    graphs = M.apply_knowledge(M.cpdag(dags(spark, sf_dir).filter("gid % 5 = 0 and size(labels) >= 3")), open_edges(spark, sf_dir).filter("(a + b + gid) % 3 = 0"))
    fine = graphs.filter("status = 'ok'").drop("status")
    last = F.size("labels") - 1
    return fine.withColumns({"x": F.lit(0), "y": last}).unionByName(fine.withColumns({"gid": -F.col("gid"), "x": last, "y": F.lit(0)}))


def test_paths_by_trying_all_orders(spark, sf_dir):
    graphs = known(spark, sf_dir)
    rows = graphs.collect()
    back = lambda r, p: any(r.pa[a] >> b & 1 for a, b in zip(p, p[1:]))
    assert of(P.possibly_causal_paths(graphs)) == sorted((r.gid, p) for r in rows for p in ways(r) if not back(r, p))
    assert of(P.definite_non_causal_paths(graphs)) == sorted((r.gid, p) for r in rows for p in ways(r) if back(r, p) and definite(r, p))


def test_a_witness_where_and_only_where_the_criterion_finds_an_open_path(spark, sf_dir):
    graphs = known(spark, sf_dir).withColumn("k", F.explode(F.expr("sequence(0, size(labels) - 1)"))).filter("k <> x and k <> y").withColumn("z", F.expr("shiftleft(1L, k)"))
    judged = {(r.gid, r.k): r.reason for r in C.why_invalid(graphs).collect()}
    paths = {(r.gid, r.k): r.path for r in P.open_path_witness(graphs, ["gid", "k"]).collect()}
    assert {"", "open_noncausal_path"} <= set(judged.values())
    assert all(k in paths for k, reason in judged.items() if reason == "open_noncausal_path")
    assert not any(k in paths for k, reason in judged.items() if reason == "")


def test_witness_through_a_collider_and_a_fork(spark):
    # 0 -> 2 <- 1 and 3 below 2: conditioning on 2 or 3 opens 0 -> 2 <- 1; on nothing leaves it shut.
    graph = asked(spark, [(1, [0, 1, 2, 3], [0, 0, 3, 4], [0, 0, 0, 0], 0, 1)])
    given = graph.withColumn("z", F.explode(F.array(*[F.lit(z).cast("long") for z in (0, 4, 8)])))
    assert {(r.z, tuple(r.path)) for r in P.open_path_witness(given, ["gid", "z"]).collect()} == {(4, (0, 2, 1)), (8, (0, 2, 1))}
    # 0 <- 2 -> 1, z empty: the fork; z = {2} shuts it.
    fork = asked(spark, [(1, [0, 1, 2], [4, 4, 0], [0, 0, 0], 0, 1)]).withColumn("z", F.explode(F.array(*[F.lit(z).cast("long") for z in (0, 4)])))
    assert [(r.z, tuple(r.path)) for r in P.open_path_witness(fork, ["gid", "z"]).collect()] == [(0, (0, 2, 1))]


def test_causal_nodes_hold_what_a_path_with_a_chord_passes(spark):
    # 1 <- 0 -> 2, 0 - 3 - 1, from 1 to 0: by 3, though no DAG has a causal path from 1 to 0.
    graph = asked(spark, [(1, [0, 1, 2, 3], [0, 1, 1, 0], [8, 8, 0, 3], 1, 0)])
    r = P.causal_nodes(graph).first()
    assert (r.cn, r.forbidden) == (0b1001, 0b1111)


def test_no_path_no_graph_and_equal_ends(spark):
    apart = asked(spark, [(1, [0, 1], [0, 0], [0, 0], 0, 1), (2, [0, 1], [0, 1], [0, 0], 0, 0)])
    assert of(P.possibly_causal_paths(apart)) == [] and of(P.definite_non_causal_paths(apart)) == []
    assert of(P.possibly_causal_paths(apart.limit(0))) == []
    assert sorted((r.gid, r.cn, r.forbidden) for r in P.causal_nodes(apart).collect()) == [(1, 0, 1), (2, 0, 1)]


def test_extra_columns_stay(spark):
    graph = asked(spark, [(1, [0, 1], [0, 1], [0, 0], 0, 1)]).withColumn("note", F.lit("n"))
    assert [(r.note, r.path) for r in P.possibly_causal_paths(graph).collect()] == [("n", [0, 1])]
