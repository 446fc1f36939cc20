"""Queries whose searches for a graph are made in its batch: few tables are written on the way, and the searches over tables that large graphs take give the same."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meridian.operators import criterion as C
from meridian.operators import meek as M
from meridian.operators import models as L
from meridian.operators import paths as P
from meridian.operators import radius as R
from meridian.operators import steps
from meridian.plans import family_queries, model_queries, registry
from meridian.sources import families as S


@pytest.fixture
def written(monkeypatch):
    """How many tables are written on the way, by operators and queries."""
    from meridian.operators import extensions, paths, space

    calls, real = [], L.settle
    for module in (L, R, extensions, paths, space, model_queries):
        monkeypatch.setattr(module, "settle", lambda df: calls.append(1) or real(df))
    return calls


@pytest.mark.parametrize(("name", "most"), [("bias_profile", 1), ("certificate", 1), ("open_path_witness", 1), ("total_effect_paths", 0)])
def test_few_tables_on_the_way(spark, sf_dir, written, name, most):
    assert registry.queries()[name](spark, sf_dir).count() > 50
    assert len(written) <= most


def test_effects_without_a_join(spark, sf_dir):
    plan = registry.queries()["total_effect_paths"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan


def test_witnesses_in_a_batch_and_over_tables(spark, sf_dir):
    """Of the population both ways to the same paths; of larger graphs, which are left to tables, too."""
    last = F.size("labels") - 1
    small = family_queries._asked(spark, sf_dir).filter("gid % 2 = 0")
    big = M.cpdag(S.block(spark.range(1, 25).select(F.col("id").alias("gid"), F.lit(10).alias("n")), 3, 60, 20)).select("gid", "labels", "pa", "nb")
    big = big.withColumns({"x": F.lit(0), "y": last, "k": F.explode(F.sequence(F.lit(1), last - 1))}).withColumn("z", F.expr("shiftleft(1L, k)"))
    back = small.withColumns({"gid": -F.col("gid"), "x": last, "y": F.lit(0)})
    asked = small.unionByName(back).unionByName(big.withColumn("gid", F.col("gid") + 10**9)).cache()
    told = lambda found: sorted((r.gid, r.k, r.path) for r in found.collect())
    expected = told(P._witness_by_turns(asked, ["gid", "k"]))
    assert expected[0][0] < 0 < 10**9 < expected[-1][0]
    assert told(P.open_path_witness(asked, ["gid", "k"])) == expected
    part = pa.RecordBatch.from_struct_array(asked.filter("size(labels) > 8").toArrow().combine_chunks().to_struct_array().combine_chunks())
    x, y, z = (part.column(c).to_numpy(zero_copy_only=False).astype("int64") for c in "xyz")
    gid, k = part.column("gid").to_pylist(), part.column("k").to_pylist()
    found = [(gid[r], k[r], p.tolist()) for rows, path in P.witnesses(C._matrix(part.column("pa")), C._matrix(part.column("nb")), x, y, z) for r, p in zip(rows, path, strict=True)]
    assert sorted(found) == [e for e in expected if e[0] > 10**9]


@pytest.mark.parametrize("above", [None, 0.1])
def test_profile_in_a_batch_and_over_tables(spark, sf_dir, above):
    states = model_queries._states(spark, sf_dir).filter("gid % 3 = 0").cache()
    columns = ["gid", "labels", "fixed", "pa", "nb", "x", "y", "sigma", "theta"]
    found = sorted(map(tuple, L.bias_profile(states, above).collect()))
    assert max(r[1] for r in found) > (0 if above else 2)
    assert found == sorted(map(tuple, L._profile_by_shells(states.select(*columns), above).collect()))


def test_radii_in_a_batch_and_over_tables(spark, sf_dir):
    graphs = model_queries._states(spark, sf_dir).cache()
    # Claims of which some are not true make bounds that differ.
    mine = F.transform(F.arrays_zip("pa", "fixed"), lambda z: z["pa"].bitwiseAND(F.bitwise_not(z["fixed"])))
    cases = graphs.withColumns({"claims": mine, "legal": F.lit(True)}).select("gid", "labels", "fixed", "loose", "pa", "nb", "x", "y", "z", "claims", "legal")
    expected = {r.gid: r.radius for r in R.up_radius(cases).collect()}
    part = pa.RecordBatch.from_struct_array(cases.toArrow().combine_chunks().to_struct_array().combine_chunks())
    radius, left = R.radii(part)
    assert not left.any() and dict(zip(part.column("gid").to_pylist(), radius.tolist(), strict=True)) == expected


def ordered(spark, n):
    """A complete DAG of n nodes, all edges of which are known: each two nodes are joined, so its CPDAG leaves all open."""
    pa_ = [(1 << j) - 1 for j in range(n)]
    all_ = (1 << n) - 1
    sigma = [float(min(i, j) + 1) + (0.3 * ((i * 7 + j * 7) % 5 + 1) if i == j else 0.0) for i in range(n) for j in range(n)]
    row = (1, list(range(n)), [0] * n, [all_ & ~(1 << j) for j in range(n)], pa_, [0] * n, 0, n - 1, (1 << n - 1) - 2, sigma, 0.7, 0.1)
    return spark.createDataFrame([row], "gid long, labels array<int>, fixed array<long>, loose array<long>, pa array<long>, nb array<long>, x int, y int, z long, sigma array<double>, theta double, bias double")


def test_many_steps_from_the_top(spark, monkeypatch):
    """15 known edges: over tables, and the same as in a batch where so many were let in."""
    states = ordered(spark, 6)
    assert steps.MOST_STEPS < 15
    found = sorted(map(tuple, L.bias_profile(states).collect()))
    told = model_queries._certified(states).first()
    part = pa.RecordBatch.from_struct_array(states.toArrow().combine_chunks().to_struct_array().combine_chunks())
    assert list(L._shells(part, None)) == []
    for module in (steps, L):
        monkeypatch.setattr(module, "MOST_STEPS", 15)
    shells, beta = list(L._shells(part, None)), 0.0
    assert len(found) == len(shells) == 16
    for (_, d, many, most, up), (_, k, n, worst) in zip(found, shells, strict=True):
        beta = max(beta, worst[0])
        assert (d, many) == (k, n[0]) and most == pytest.approx(worst[0]) and up == pytest.approx(beta)
    made = L.certificate_kernel(part)[1]
    assert (told.r_val, told.r_eps_10) == (made["r_val"][0].as_py(), made["r_eps_10"][0].as_py()) and told.beta_top == pytest.approx(made["beta_top"][0].as_py())


@pytest.mark.parametrize("name", ["parse_bnjson", "parse_dagitty", "parse_bif"])
def test_files_are_read_once(spark, sf_dir, name):
    plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan


def test_edges_of_files_in_parts_and_large(spark):
    """Rows of a name are one file, names of one file don't serve another, and a large file is no more than its edges."""
    import json

    from meridian.sources import networks as N

    n = 20_000
    large = json.dumps({"nodes": [f"n {i}" for i in range(n)], "arcs": [[f"n {i}", f"n {i + 1}"] for i in range(n - 1)]})
    files = [("p", '{"nodes": ["a", "b c"], "arcs": [["a", "b c"], ["a", "b c"]]}'), ("p", '{"nodes": ["b_c"], "arcs": [["b_c", "b_c2"], ["a", "b c"]]}'), ("p", '{"nodes": ["b_c2"], "arcs": []}'), ("l", large), (None, '{"nodes": ["x", null, "y"], "arcs": [["x", "y"]]}')]
    rows = N.parse_json(spark.createDataFrame(files, "name string, text string")).collect()
    found = {(r.name, r.a, r.b) for r in rows}
    assert len(rows) == len(found) == n - 1 + 3
    assert {f for f in found if f[0] != "l"} == {("p", "a", "b_c"), ("p", "b_c__2", "b_c2"), (None, "x", "y")} and ("l", "n_7", "n_8") in found
    with pytest.raises(Exception, match="undeclared node or self-loop: a b"):
        N.parse_json(spark.createDataFrame([("p", '{"nodes": ["a"], "arcs": [["a", "b"]]}'), ("q", '{"nodes": ["b"], "arcs": []}')], "name string, text string")).collect()
