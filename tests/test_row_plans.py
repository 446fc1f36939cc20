"""Queries whose work on a graph needs nothing but its row: they deal rows once, write no table, and give what the operators on tables give."""

import pytest
from pyspark.sql import functions as F

from meridian.operators import adjustment as A
from meridian.operators import criterion as C
from meridian.operators import knowledge as K
from meridian.operators import meek as M
from meridian.plans import criterion_queries, registry
from meridian.sources.population import dags


def exchanges(df):
    return df._jdf.queryExecution().sparkPlan().toString().count("RepartitionByExpression") + df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_corrupted_validity(spark, sf_dir):
    found = criterion_queries.corrupted_validity(spark, sf_dir)
    assert exchanges(found) <= 2
    whole = dags(spark, sf_dir).filter("size(labels) >= 3")
    graphs, claims = M.cpdag(whole), K.flip(criterion_queries.open_edges(spark, sf_dir), 0.5)
    asked = A.with_order(whole).withColumns({"x": F.lit(0), "y": F.size("labels") - 1})
    asked = asked.withColumn("z", A.optimal(F.col("x"), F.col("y"))).select("gid", "x", "y", "z")
    known = M.apply_knowledge(graphs, claims).cache()
    judged = {r.gid: r.reason for r in C.why_invalid(known.filter("status = 'ok'").join(asked, "gid")).collect()}
    status, expected = {r.gid: r.status for r in known.collect()}, {}
    for r in claims.groupBy("gid").count().collect():
        if r.gid in status:
            row = expected.setdefault(r["count"], [0, 0, 0])
            row[0] += 1
            row[1] += status[r.gid] != "ok"
            row[2] += judged.get(r.gid) == ""
    assert len(expected) > 3 and {r.n_claims: [r.n_graphs, r.n_contradictory, r.n_survived] for r in found.collect()} == expected


@pytest.mark.parametrize("name", ["claim_contradiction"])
def test_rows_are_dealt_once(spark, sf_dir, name):
    assert exchanges(registry.queries()[name](spark, sf_dir)) == 1
