import itertools
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meridian.functions import bits as B
from meridian.operators import adjustment as A
from meridian.operators import criterion as C
from meridian.operators import knowledge as K
from meridian.operators import meek
from meridian.operators.radius import extensions
from meridian.sources.population import dags, edge_rows, pack


@pytest.fixture(scope="module")
def states(spark, sf_dir):
    """CPDAGs of random orders, and the same with half of their open edges known; x and y are any two nodes, z any small set."""
    graphs = dags(spark, sf_dir).filter((F.size("labels") >= 3) & (F.size("labels") <= 5) & (F.col("gid") % 5 == 0))
    cpdags = meek.cpdag(graphs).cache()
    known = meek.apply_knowledge(cpdags, K.draw_true(edge_rows(cpdags).filter("kind = 'u'"), 0.5)).filter("status = 'ok'").drop("status")
    both = cpdags.withColumn("kind", F.lit(0)).unionByName(known.withColumn("kind", F.lit(1)))
    n = F.size("labels")
    pairs = both.withColumn("x", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("y", F.explode(F.sequence(F.lit(0), n - 1))).filter("x != y")
    asked = pairs.withColumn("z", F.explode(F.array_distinct(F.array(F.lit(0).cast("long"), *[B.bit(F.pmod(F.col("x") + i, n)) for i in range(1, 4)], B.bit(F.pmod(F.col("x") + 1, n)).bitwiseOR(B.bit(F.pmod(F.col("x") + 2, n)))))))
    return asked.withColumn("gid", F.concat_ws("/", "gid", "kind", "x", "y", "z")).drop("kind").cache()


@pytest.mark.parametrize("judge,column", [(A.backdoor_valid, "reason"), (A.gac_valid, "reason_gac")])
def test_reasons_match_all_dags(states, judge, column):
    """z is valid by the criterion on the graph if and only if it is so in every DAG of it."""
    each = judge(A.with_order(extensions(states)), F.col("x"), F.col("y"), F.col("z"))
    expected = {r.gid: r.ok for r in each.groupBy("gid").agg(F.min("valid").alias("ok")).collect()}
    found = {r.gid: r[column] for r in C.why_invalid(states).collect()}
    assert {g: x == "" for g, x in found.items()} == expected
    assert len(set(found.values())) >= 4 and len(expected) > 1000


def test_possible_descendants_match_all_dags(states):
    graphs = states.filter("x = 0 and y = 1 and z = 0").drop("x", "y", "z")
    below = A.with_order(extensions(graphs)).select("gid", F.posexplode("de").alias("i", "m")).groupBy("gid", "i").agg(F.expr("bit_or(m)").alias("m"))
    expected = {(r.gid, r.i): r.m | 1 << r.i for r in below.collect()}
    found = C.with_possible_descendants(graphs).select("gid", F.posexplode("pd").alias("i", "m")).collect()
    assert {(r.gid, r.i): r.m for r in found} == expected


def test_known_cases(spark):
    """A triangle with one edge known; a cycle; the same node twice; too many nodes."""
    edges = [(1, 0, 1, "d"), (1, 0, 2, "u"), (1, 1, 2, "u"), (2, 0, 1, "d"), (2, 1, 2, "d"), (2, 2, 0, "d"), (3, 0, 1, "d"), (3, 1, 2, "d")]
    nodes = [(g, v) for g in (1, 2, 3) for v in range(3)]
    graphs = pack(spark.createDataFrame(edges, "gid long, a int, b int, kind string"), spark.createDataFrame(nodes, "gid long, v int"))
    told = lambda x, y: {r.gid: (r.reason, r.amenable) for r in C.why_invalid(graphs.selectExpr("*", f"{x} as x", f"{y} as y", "0L as z")).collect()}
    assert told(0, 1) == {1: ("not_amenable", False), 2: ("no_extensions", True), 3: ("", True)}
    assert told(1, 1)[3][0] == "degenerate_query"
    assert [r.pd for r in C.with_possible_descendants(graphs.filter("gid = 1")).collect()] == [[7, 6, 7]]
    with pytest.raises(ValueError):
        C._matrix(pa.array([[0] * 70], pa.list_(pa.int64())))


def test_claims(spark):
    rnd = random.Random(1)
    rows = [(g, a, b) for g in range(30) for a, b in itertools.combinations(range(5), 2) if rnd.random() < 0.6]
    claims = spark.createDataFrame(rows, "gid long, a int, b int")
    per_graph = lambda df: {r.gid: r["count"] for r in df.groupBy("gid").count().collect()}
    whole = per_graph(claims)
    for rate in (0.0, 0.25, 0.5, 1.0):
        gone = {g: n - round(rate * n) for g, n in whole.items()}  # half to even, as Python rounds
        assert per_graph(K.omit(claims, rate)) == {g: n for g, n in gone.items() if n}
        assert per_graph(K.draw_true(claims, rate)) == {g: whole[g] - n for g, n in gone.items() if n < whole[g]}
        turned = {r.gid: r.n for r in K.flip(claims, rate).groupBy("gid").agg(F.sum((F.col("a") > F.col("b")).cast("int")).alias("n")).collect()}
        assert turned == {g: round(rate * n) for g, n in whole.items()}
    assert {(r.gid, min(r.a, r.b), max(r.a, r.b)) for r in K.compound(claims, 0.5).collect()} == {tuple(r) for r in K.omit(claims, 0.5).collect()}
    with pytest.raises(ValueError):
        K.omit(claims, 1.5)


def test_tiers(spark):
    nodes = spark.createDataFrame([(g, v, v // 2) for g in range(20) for v in range(7)], "gid long, v int, depth int")
    for n_tiers in (1, 3):
        plain = {(r.gid, r.v): r.tier for r in K.tiers(nodes, n_tiers).collect()}
        assert plain == {(g, v): v * n_tiers // 7 for g in range(20) for v in range(7)}
    moved = {(r.gid, r.v): r.tier for r in K.tiers(nodes, 3, 0.4).collect()}
    assert all(0 <= t < 3 for t in moved.values())
    assert all(sum(moved[g, v] != plain[g, v] for v in range(7)) == round(0.4 * 7) for g in range(20))
    edges = spark.createDataFrame([(0, 0, 6), (0, 0, 1)], "gid long, a int, b int")
    assert [tuple(r) for r in K.tiered(edges, K.tiers(nodes, 3)).collect()] == [(0, 0, 6)]
