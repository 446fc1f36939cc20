"""Walks inside a Markov equivalence class by turning covered edges.

An edge is covered if its head has no other parents than its tail has, besides the tail. Turning it gives a DAG with the same
independences, and any two DAGs of a class are joined by as many such turns as they differ in edges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import criterion as C
from .fixpoint import settle
from .space import bfs_shells
from .steps import steps


def covered(parents: C.Masks) -> C.Masks:
    """For each node the parents whose edge to it is covered."""
    out, n = np.zeros_like(parents), parents.shape[1]
    for j in range(n):
        for i in C._members(parents[:, j]):
            out[:, j] |= np.where(C._has(parents[:, j], i) & (parents[:, j] & ~C._bit(i) == parents[:, i]), C._bit(i), 0)
    return out


def turns(dags: DataFrame) -> DataFrame:
    """dags (gid, labels, pa and others), a row for each covered edge: tail and head (places), and turned, the parents with it turned."""

    def kernel(part: pa.RecordBatch) -> tuple[np.ndarray, dict[str, pa.Array]]:
        up = C._matrix(part.column("pa"))
        g, i, j = steps(covered(up))
        new, row = up[g], np.arange(len(g))
        new[row, j] &= ~C._bit(i)
        new[row, i] |= C._bit(j)
        return g, {"tail": pa.array(i, pa.int32()), "head": pa.array(j, pa.int32()), "turned": C.lists_of(new, part.column("pa").take(pa.array(g)))}

    return C.over_graphs(dags, kernel, "tail int, head int, turned array<long>")


def covered_edges(dags: DataFrame) -> DataFrame:
    """gid, a, b for each covered edge a -> b."""
    return turns(dags).select("gid", F.get("labels", F.col("tail")).alias("a"), F.get("labels", F.col("head")).alias("b"))


def turns_apart(left: Column, right: Column) -> Column:
    """Least number of turns of covered edges between two DAGs of one class, given by their parents: the edges in which they differ."""
    return F.aggregate(F.zip_with(left, right, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda acc, k: acc + k)


def class_walk(members: DataFrame, sources: DataFrame) -> DataFrame:
    """gid, state (parents), distance: turns of covered edges from each source to the members of its class (gid, labels, pa).

    sources: gid, state.
    """
    edges = settle(turns(members)).select("gid", F.col("pa").alias("state"), F.col("turned").alias("next"))
    return bfs_shells(edges, sources)
