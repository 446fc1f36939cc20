"""Adjustment sets: d-separation, back-door and generalised criteria, causal, forbidden and optimal sets.

Queries are columns of the graph's row: x and y are places of nodes, z a mask.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits as B
from . import criterion as C
from .extensions import extensions


def upward(mask: Column, pa: Column) -> Column:
    """mask and all ancestors of its nodes."""
    return B.reach(mask, pa, B.zero())


def separation(df: DataFrame, pa: str, x: Column, y: Column, z: Column, name: str) -> DataFrame:
    """df and a boolean: whether mask z separates masks x and y in the DAG of parents pa.

    That is so if no walk in the moral graph of their ancestors avoids z. Steps are columns, as an
    expression inside a lambda would be worked out again for every node.
    """
    kept = df.withColumn("_kept", upward(x.bitwiseOR(y).bitwiseOR(z), F.col(pa)))
    inside = kept.withColumn("_inside", F.transform(pa, lambda p, i: F.when(B.has(F.col("_kept"), i), p.bitwiseAND(F.col("_kept"))).otherwise(B.zero())))
    parents = lambda c: F.get("_inside", c)
    moral = F.aggregate(
        B.indices(F.col("_inside")),
        F.transform("_inside", lambda _: B.zero()),
        lambda acc, c: F.transform(
            acc, lambda m, i: F.when(B.has(parents(c), i), m.bitwiseOR(parents(c)).bitwiseOR(B.bit(c))).when(i == c, m.bitwiseOR(parents(c))).otherwise(m)
        ),
    )
    walked = inside.withColumn("_moral", moral).withColumn("_walk", B.reach(x, F.col("_moral"), z))
    return walked.withColumn(name, ~B.overlap(F.col("_walk"), y)).drop("_kept", "_inside", "_moral", "_walk")


def with_order(df: DataFrame) -> DataFrame:
    """df with ch, an and de."""
    return df.withColumn("ch", B.transpose(F.col("pa"))).withColumn("an", B.closure(F.col("pa"))).withColumn("de", B.transpose(F.col("an")))


def causal_nodes(x: Column, y: Column) -> Column:
    """Nodes on directed paths from x to y, without x (df with an and de)."""
    return F.get("de", x).bitwiseAND(F.get("an", y).bitwiseOR(B.bit(y)))


def forbidden(x: Column, y: Column) -> Column:
    """Nodes on or below a causal path, x and y."""
    cn = causal_nodes(x, y)
    return cn.bitwiseOR(B.union_over(cn, F.col("de"))).bitwiseOR(B.bit(x)).bitwiseOR(B.bit(y))


def optimal(x: Column, y: Column) -> Column:
    """Parents of causal nodes that are neither causal nor x."""
    cn = causal_nodes(x, y)
    return B.minus(B.union_over(cn, F.col("pa")), cn.bitwiseOR(B.bit(x)))


def optimal_sets(up: C.Masks, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """causal_nodes() and optimal() of places x and y, for DAGs by their parents."""
    above, n, row = up.copy(), up.shape[1], np.arange(len(up))
    if not n:
        return np.zeros(len(up), np.int64), np.zeros(len(up), np.int64)
    for k in range(n):  # paths through node k, for one k after the other
        above |= np.where(C._has(above, k), above[:, [k]], 0)
    causal = C.transpose(above)[row, x] & (above[row, y] | C._bit(y))
    z = np.zeros(len(up), np.int64)
    for v in range(n):
        z |= np.where(C._has(causal, v), up[:, v], 0)
    return causal, z & ~(causal | C._bit(x))


def optimal_of_ends(part: pa.RecordBatch) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """The kernel that keeps DAGs (pa) with a causal path from their first node x to their last one y, and gives x, y and z, the optimal set."""
    up = C._matrix(part.column("pa"))
    sizes = part.column("pa").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    x, y = np.zeros(len(up), np.int64), np.maximum(sizes - 1, 0)
    causal, z = optimal_sets(up, x, y)
    at = np.flatnonzero((sizes >= 3) & ((causal >> y) & 1 == 1))
    return at, {"x": pa.array(np.zeros(len(at)), pa.int32()), "y": pa.array(y[at], pa.int32()), "z": pa.array(z[at], pa.int64())}


def backdoor_valid(df: DataFrame, x: Column, y: Column, z: Column) -> DataFrame:
    """df and valid, by the back-door criterion: z avoids x, y and what is below x, and separates them without the edges out of x."""
    cut = df.withColumn("_cut", F.transform("pa", lambda m: B.minus(m, B.bit(x))))
    clean = ~B.overlap(z, F.get("de", x).bitwiseOR(B.bit(x)).bitwiseOR(B.bit(y)))
    return separation(cut, "_cut", B.bit(x), B.bit(y), z, "valid").withColumn("valid", F.col("valid") & clean).drop("_cut")


def gac_valid(df: DataFrame, x: Column, y: Column, z: Column) -> DataFrame:
    """df and valid, by the generalised adjustment criterion: z avoids the forbidden set, and separates without the first causal edges."""
    causal = df.withColumn("_cn", causal_nodes(x, y))
    cut = causal.withColumn("_cut", F.transform("pa", lambda m, i: F.when(B.has(F.col("_cn"), i), B.minus(m, B.bit(x))).otherwise(m)))
    clean = ~B.overlap(z, forbidden(x, y))
    return separation(cut, "_cut", B.bit(x), B.bit(y), z, "valid").withColumn("valid", F.col("valid") & clean).drop("_cn", "_cut")


def optimal_of_state(states: DataFrame) -> DataFrame:
    """gid, z: the optimal set of places x and y where all DAGs that a closed graph allows have the same one; null where they differ.

    states: gid, labels, pa, nb, x, y. A graph that allows no DAG has no row.
    """


    def kernel(part: pa.RecordBatch) -> tuple[None, dict[str, pa.Array]]:
        x, y = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in "xy")
        return None, {"z": pa.array(optimal_sets(C._matrix(part.column("pa")), x, y)[1])}

    each = C.over_graphs(extensions(states.select("gid", "pa", "nb", "x", "y")), kernel, "z long").select("gid", "z")
    found = each.groupBy("gid").agg(F.min("z").alias("least"), F.max("z").alias("most"))
    return found.select("gid", F.when(F.col("least") == F.col("most"), F.col("least")).alias("z"))
