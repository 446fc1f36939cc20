"""Meek's rules, their closure, CPDAGs and background knowledge, over many graphs at once.

A graph is one row of masks. One pass of a rule is a column expression; fixpoints run in Arrow batches
(criterion.close), where a round looks at the graphs' edges that are still undirected and at nothing else.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits as B
from . import criterion as C
from .graphs import v_structures, with_adjacency


class State:
    """Masks of a graph while rules run: parents and neighbours change, adjacency stays."""

    def __init__(self, pa: Column, nb: Column, adj: Column) -> None:
        self.pa, self.nb, self.adj = pa, nb, adj

    def children(self, i: Column) -> Column:
        return F.aggregate(B.indices(self.pa), B.zero(), lambda acc, j: F.when(B.has(F.get(self.pa, j), i), acc.bitwiseOR(B.bit(j))).otherwise(acc))

    def rule_1(self, i: Column, j: Column) -> Column:
        """k -> i - j with k and j not adjacent."""
        return B.overlap(F.get(self.pa, i), F.bitwise_not(F.get(self.adj, j).bitwiseOR(B.bit(j))))

    def rule_2(self, i: Column, j: Column) -> Column:
        """i -> k -> j."""
        return B.overlap(self.children(i), F.get(self.pa, j))

    def rule_3(self, i: Column, j: Column) -> Column:
        """i - k -> j and i - l -> j with k and l not adjacent."""
        middle = F.get(self.nb, i).bitwiseAND(F.get(self.pa, j))
        return F.exists(B.indices(self.pa), lambda k: B.has(middle, k) & (B.minus(middle, F.get(self.adj, k).bitwiseOR(B.bit(k))) != 0))

    def rule_4(self, i: Column, j: Column) -> Column:
        """i - k -> l -> j with k and j not adjacent."""
        far = B.minus(F.get(self.nb, i), F.get(self.adj, j).bitwiseOR(B.bit(j)))
        return F.exists(B.indices(self.pa), lambda m: B.has(F.get(self.pa, j), m) & B.overlap(F.get(self.pa, m), far))


RULES = {1: State.rule_1, 2: State.rule_2, 3: State.rule_3, 4: State.rule_4}


def undirected(nb: Column) -> Column:
    """Array of (i, j) for every undirected edge, in both directions."""
    idx = B.indices(nb)
    return F.flatten(F.transform(nb, lambda m, j: F.transform(F.filter(idx, lambda i: B.has(m, i)), lambda i: F.struct(i.alias("i"), j.alias("j")))))


def forced(df: DataFrame, rule: int) -> DataFrame:
    """gid, a, b: orientations a -> b that one pass of a rule forces."""
    state = State(F.col("pa"), F.col("nb"), F.col("adj"))
    fires = F.filter(undirected(F.col("nb")), lambda e: RULES[rule](state, e["i"], e["j"]))
    return (
        with_adjacency(df)
        .select("gid", "labels", F.explode(fires).alias("e"))
        .select("gid", F.get("labels", F.col("e.i")).alias("a"), F.get("labels", F.col("e.j")).alias("b"))
    )


def close(df: DataFrame) -> DataFrame:
    """df with pa and nb closed under Meek's rules, in Arrow batches.

    Both directions of an edge may be forced in one round only where knowledge contradicts itself; the
    edge then ends directed both ways, which contradictory() tells.
    """

    def kernel(part: pa.RecordBatch) -> tuple[None, dict[str, pa.Array]]:
        up, loose, _ = C.close(C._matrix(part.column("pa")), C._matrix(part.column("nb")))
        return None, {"pa": C.lists_of(up, part.column("pa")), "nb": C.lists_of(loose, part.column("pa"))}

    return C.over_graphs(df, kernel, "pa array<long>, nb array<long>").select(*df.columns)


def pattern(dags: DataFrame) -> DataFrame:
    """The graphs with only the edges of v-structures directed: gid, labels, pa, nb."""
    idx = B.indices(F.col("pa"))
    kept = F.transform("pa", lambda p, m: F.aggregate(F.filter(idx, lambda a: B.has(p, a) & (B.minus(p, F.get("adj", a).bitwiseOR(B.bit(a))) != 0)), B.zero(), lambda acc, a: acc.bitwiseOR(B.bit(a))))
    with_kept = with_adjacency(dags.select("gid", "labels", "pa")).withColumn("kept", kept)
    nb = F.transform(F.arrays_zip("adj", "kept", B.transpose(F.col("kept")).alias("out")), lambda z: B.minus(z["adj"], z["kept"].bitwiseOR(z["out"])))
    return with_kept.withColumn("nb", nb).select("gid", "labels", F.col("kept").alias("pa"), "nb")


def completed(parents: C.Masks) -> tuple[C.Masks, C.Masks]:
    """Parents and open neighbours of the completed partially directed graph of each DAG: its pattern, closed."""
    adj, kept = parents | C.transpose(parents), np.zeros_like(parents)
    for m in range(parents.shape[1]):
        for a in C._members(parents[:, m]):
            collides = C._has(parents[:, m], a) & (parents[:, m] & ~(adj[:, a] | C._bit(a)) != 0)
            kept[:, m] |= np.where(collides, C._bit(a), 0)
    up, loose, _ = C.close(kept, adj & ~(kept | C.transpose(kept)))
    return up, loose


def cpdag(dags: DataFrame) -> DataFrame:
    """gid, labels, pa, nb: the completed partially directed graph of each DAG."""

    def kernel(part: pa.RecordBatch) -> tuple[None, dict[str, pa.Array]]:
        up, loose = completed(C._matrix(part.column("pa")))
        return None, {"pa": C.lists_of(up, part.column("pa")), "nb": C.lists_of(loose, part.column("pa"))}

    return C.over_graphs(dags.select("gid", "labels", "pa"), kernel, "pa array<long>, nb array<long>")


def apply_knowledge(graphs: DataFrame, claims: DataFrame) -> DataFrame:
    """graphs with the claimed orientations imposed and closed, and status.

    claims: gid, a, b for a -> b. status is 'ok', or 'contradiction' where a claim is no edge, is
    reversed by the graph, or the closure directs an edge both ways, in a cycle or into a new v-structure.
    """
    lists = claims.groupBy("gid").agg(F.collect_set(F.struct("a", "b")).alias("claims"))
    joined = graphs.join(lists, "gid", "left").withColumn("claims", F.coalesce("claims", F.array().cast("array<struct<a:int,b:int>>")))
    placed = joined.withColumn(
        "claims", F.transform("claims", lambda c: F.struct((F.array_position("labels", c["a"]) - 1).alias("i"), (F.array_position("labels", c["b"]) - 1).alias("j")))
    )
    legal = F.forall("claims", lambda c: (c["i"] >= 0) & (c["j"] >= 0) & (B.has(F.get("nb", c["j"].cast("int")), c["i"]) | B.has(F.get("pa", c["j"].cast("int")), c["i"])))
    to = lambda j: F.aggregate("claims", B.zero(), lambda acc, c: F.when(c["j"] == j, acc.bitwiseOR(B.bit(c["i"]))).otherwise(acc))
    out = lambda j: F.aggregate("claims", B.zero(), lambda acc, c: F.when(c["i"] == j, acc.bitwiseOR(B.bit(c["j"]))).otherwise(acc))
    imposed = placed.withColumns({"_from": F.col("pa"), "legal": legal}).withColumns(
        {
            "pa": F.when(F.col("legal"), F.transform("pa", lambda m, j: m.bitwiseOR(to(j)))).otherwise(F.col("pa")),
            "nb": F.when(F.col("legal"), F.transform("nb", lambda m, j: B.minus(m, to(j).bitwiseOR(out(j))))).otherwise(F.col("nb")),
        }
    )

    def kernel(part: pa.RecordBatch) -> tuple[None, dict[str, pa.Array]]:
        like, before = part.column("pa"), C._matrix(part.column("_from"))
        up, loose, fine = C.close(C._matrix(like), C._matrix(part.column("nb")))
        fine &= part.column("legal").to_numpy(zero_copy_only=False) & ~C.new_colliders(before, up, loose)
        return None, {"pa": C.lists_of(up, like), "nb": C.lists_of(loose, like), "status": pa.array(np.where(fine, "ok", "contradiction"), pa.string())}

    return C.over_graphs(imposed, kernel, "pa array<long>, nb array<long>, status string").select(*graphs.columns, "status")


def same_pattern(left: DataFrame, right: DataFrame) -> DataFrame:
    """gids whose v-structures are the same in both populations."""
    l, r = (v_structures(d).groupBy("gid").agg(F.sort_array(F.collect_list(F.struct("a", "m", "b"))).alias(s)) for d, s in ((left, "l"), (right, "r")))
    return l.join(r, "gid", "full").filter(F.col("l").eqNullSafe(F.col("r"))).select("gid")
