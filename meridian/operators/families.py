"""What graphs made to order turn out to be, and which of them can tell anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bits as B
from . import adjustment as A
from . import meek as M


def realised(dags: DataFrame) -> DataFrame:
    """dags (gid, labels, pa, x, y) with what is measured on their CPDAGs, never read off a request.

    component_size and component_edges: nodes and edges of the open component that holds x (0 where x has no open edge); separation: open
    edges from x to the nearest node of the optimal set of x and y in the DAG, null where the component holds none; settled: whether the
    CPDAG has x -> y. gid tells the rows apart; pa and nb of the result are the CPDAG's.
    """
    asked = A.with_order(dags).withColumn("z", A.optimal(F.col("x"), F.col("y"))).drop("pa", "labels", "ch", "an", "de")
    both = M.cpdag(dags).join(asked, "gid")
    held = B.reach(B.bit(F.col("x")), F.col("nb"), B.zero())
    inside = both.withColumn("_held", F.when(F.get("nb", "x") != 0, held).otherwise(B.zero()))
    ends = F.aggregate("nb", F.lit(0), lambda acc, m: acc + F.when(B.overlap(m, F.col("_held")), B.count(m)).otherwise(0))

    def step(acc, k):
        ball = acc["ball"].bitwiseOR(B.union_over(acc["ball"], F.col("nb")))
        return F.struct(ball.alias("ball"), F.coalesce(acc["hops"], F.when(B.overlap(ball, F.col("z")), k + 1)).alias("hops"))

    start = F.struct(B.bit(F.col("x")).alias("ball"), F.lit(None).cast("int").alias("hops"))
    found = F.aggregate(B.indices(F.col("nb")), start, step, lambda acc: acc["hops"])
    told = inside.withColumns({"component_size": B.count(F.col("_held")), "component_edges": (ends / 2).cast("int"), "separation": found})
    return told.withColumn("settled", B.has(F.get("pa", "y"), F.col("x"))).drop("_held")
