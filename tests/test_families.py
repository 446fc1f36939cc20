from math import prod

import pytest
from pyspark.sql import functions as F

from meridian.functions import bits as B
from meridian.operators import families as R
from meridian.operators import graphs as G
from meridian.operators import meek as M
from meridian.sources import families as S
from meridian.sources.population import edge_rows


def sized(spark, *sizes):
    return spark.createDataFrame([(g, n) for g, n in enumerate(sizes)], "gid long, n int")


def edges(graphs):
    found = {}
    for r in edge_rows(graphs).collect():
        found.setdefault(r.gid, set()).add((r.a, r.b))
    return found


@pytest.mark.parametrize("attach", [1, 2, 3])
def test_preferential_attachment_has_all_edges_and_no_cycle(spark, attach):
    sizes = [attach + 1, attach + 2, 9, 14, 30]
    graphs = S.scale_free(sized(spark, *sizes), attach)
    found = edges(graphs)
    assert [len(found[g]) for g in range(5)] == [(n - attach) * attach for n in sizes]
    assert all(r.acyclic for r in G.acyclic(graphs).collect())
    # Every node after the first ones has joined as many earlier ones as asked.
    for g, n in enumerate(sizes):
        assert all(sum(v in e and sum(e) - v < v for e in found[g]) == attach for v in range(attach, n))


def test_hubs_get_more_than_an_even_share(spark):
    graphs = S.scale_free(spark.range(2000).select(F.col("id").alias("gid"), F.lit(30).alias("n")), 1)
    first = graphs.select(F.avg((F.size("labels") > 0).cast("int") * F.bit_count(F.get(G.adjacency(graphs), F.lit(0))))).first()[0]
    # With j edges so far a node of degree d is drawn with d / (2 j), so its mean grows by 1 + 1 / (2 j); even draws would give 4.
    assert abs(first - prod(1 + 1 / (2 * j) for j in range(1, 29))) < 0.25


def test_blocks_by_their_shares(spark):
    apart = edges(S.block(sized(spark, 9, 1), 3, 100, 0))
    assert {tuple(sorted(e)) for e in apart[0]} == {(i, j) for i in range(9) for j in range(i + 1, 9) if i % 3 == j % 3} and 1 not in apart
    between = edges(S.block(sized(spark, 6), 2, 0, 100))
    assert {tuple(sorted(e)) for e in between[0]} == {(i, j) for i in range(6) for j in range(i + 1, 6) if i % 2 != j % 2}
    assert all(r.acyclic for r in G.acyclic(S.block(sized(spark, 12, 20), 2, 80, 40)).collect())


def test_graphs_do_not_hang_on_partitions_and_keep_columns(spark):
    rows = sized(spark, 8, 9, 10, 11).withColumn("tag", F.lit("t"))
    one, many = (S.scale_free(rows.repartition(p), 2) for p in (1, 7))
    assert edges(one) == edges(many) and set(one.columns) == {"gid", "n", "tag", "labels", "pa"}
    assert S.block(rows.limit(0), 2, 50, 50).count() == 0


@pytest.mark.parametrize("n", [7, 8, 12])
def test_two_routes_apart_and_together(spark, n):
    rows = spark.createDataFrame([(0, n, 0.0), (1, n, 1.0), (2, n, 0.5)], "gid long, n int, coupling double")
    graphs = S.decoupled(rows)
    assert all(r.acyclic for r in G.acyclic(graphs).collect())
    known = M.cpdag(graphs)
    assert known.filter(B.has(F.get("pa", F.lit(1)), F.lit(0))).count() == 3
    parts = {}
    for r in G.components(known).collect():
        parts.setdefault(r.gid, {})[r.v] = r.component
    begin = 3 + (n - 2) // 2
    assert parts[0][3] != parts[0][begin] and parts[1][3] == parts[1][n - 1]
    assert all(v >= 3 for p in parts.values() for v in p)


@pytest.mark.parametrize("triangles", [0, 50, 100])
def test_components_are_what_was_asked_for(spark, triangles):
    rows = spark.createDataFrame([(100 * c + s, c, s) for c in range(2, 10) for s in range(1, c)], "gid long, size int, separation int")
    asked = S.component(rows, triangles)
    found = {r.gid: r for r in R.realised(asked.drop("size", "separation")).collect()}
    most = {0: lambda c, s: 0, 50: None, 100: lambda c, s: c - 1 - s}[triangles]
    for r in rows.collect():
        m = found[r.gid]
        assert (m.component_size, m.separation, m.settled) == (r["size"], r.separation, True)
        assert r["size"] - 1 <= m.component_edges <= 2 * r["size"] - 2 - r.separation
        if most:
            assert m.component_edges == r["size"] - 1 + most(r["size"], r.separation)


def test_realised_without_an_open_edge(spark):
    # 0 -> 2 <- 1: nothing is open, so no component holds x.
    graph = spark.createDataFrame([(1, [0, 1, 2], [0, 0, 3], 0, 2)], "gid long, labels array<int>, pa array<long>, x int, y int")
    r = R.realised(graph).first()
    assert (r.component_size, r.component_edges, r.separation, r.settled) == (0, 0, None, True)


@pytest.mark.parametrize(
    "make",
    [
        lambda s: S.scale_free(sized(s, 2), 2),
        lambda s: S.scale_free(sized(s, None), 2),
        lambda s: S.block(sized(s, 0), 2, 50, 50),
        lambda s: S.block(sized(s, 63), 2, 50, 50),
        lambda s: S.decoupled(sized(s, 6).withColumn("coupling", F.lit(0.0))),
        lambda s: S.decoupled(sized(s, 8).withColumn("coupling", F.lit(1.5))),
        lambda s: S.component(sized(s, 4).select("gid", F.col("n").alias("size"), F.lit(4).alias("separation")), 30),
    ],
)
def test_sizes_out_of_range_are_errors(spark, make):
    with pytest.raises(Exception, match="nodes"):
        make(spark).collect()


def test_shares_out_of_range_are_errors(spark):
    for make in (lambda r: S.block(r, 0, 50, 50), lambda r: S.block(r, 2, 101, 0), lambda r: S.component(r, -1), lambda r: S.scale_free(r, 0)):
        with pytest.raises(ValueError):
            make(sized(spark, 5))
