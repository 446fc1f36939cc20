"""All DAGs that a partly directed graph allows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits as B
from . import criterion as C
from .fixpoint import settle


def _n_open() -> Column:
    return F.aggregate("nb", F.lit(0), lambda acc, m: acc + B.count(m)) / 2


def _turned(up: C.Masks, loose: C.Masks, before: C.Masks) -> tuple[np.ndarray, C.Masks, C.Masks]:
    """Graphs with open edges, each as two with its first one turned either way and closed; those that no DAG fits are left out."""
    row = np.arange(len(up))
    head = (loose != 0).argmax(axis=1)
    bit = loose[row, head] & -loose[row, head]
    tail = np.bitwise_count(bit - 1).astype(np.int64)
    up, loose, both = np.concatenate([up, up]), np.concatenate([loose, loose]), np.concatenate([row, row])
    one, two = row, row + len(row)
    up[one, head] |= bit
    up[two, tail] |= C._bit(head)
    for half in (one, two):
        loose[half, head] &= ~bit
        loose[half, tail] &= ~C._bit(head)
    up, loose, fine = C.close(up, loose)
    fine &= ~C.new_colliders(before[both], up, loose)
    order = np.flatnonzero(fine)
    order = order[np.argsort(both[order], kind="stable")]
    return both[order], up[order], loose[order]


#: Graphs that are branched at a time.
BRANCHES = 1 << 14


def dags_of(parents: C.Masks, open_: C.Masks) -> Iterator[tuple[np.ndarray, C.Masks]]:
    """graph, parents: every DAG that each graph allows, in parts. One half of what is begun waits where there is much, so that few are kept at a time."""
    up, loose, fine = C.close(parents, open_)
    fine &= ~C.new_colliders(parents, up, loose)
    g = np.flatnonzero(fine)
    stack = [(g, up[g], loose[g])]
    while stack:
        g, up, loose = stack.pop()
        while len(g):
            whole = ~loose.any(axis=1)
            if whole.any():
                yield g[whole], up[whole]
            g, up, loose = (c[~whole] for c in (g, up, loose))
            if len(g) > BRANCHES:
                half = len(g) // 2
                stack.append((g[half:], up[half:], loose[half:]))
                g, up, loose = g[:half], up[:half], loose[:half]
            if len(g):
                at, up, loose = _turned(up, loose, parents[g])
                g = g[at]


def branched(graphs: DataFrame, most: int) -> DataFrame:
    """graphs (with _from, their parents), those of more than ``most`` open edges as branches of fewer.

    A branch turns one edge and is closed, so that ways which no DAG allows are not followed.
    """
    # Settled, as a filter would be moved below the steps that made the graphs and repeat them.
    left, done = settle(graphs), []

    def kernel(part: pa.RecordBatch) -> tuple[np.ndarray, dict[str, pa.Array]]:
        g, up, loose = _turned(*[C._matrix(part.column(c)) for c in ("pa", "nb", "_from")])
        like = part.column("pa").take(pa.array(g))
        return g, {"pa": C.lists_of(up, like), "nb": C.lists_of(loose, like)}

    while True:
        done.append(left.filter(_n_open() <= most))
        left = left.filter(_n_open() > most)
        if left.isEmpty():
            return reduce(DataFrame.union, done)
        left = settle(C.over_graphs(left, kernel, "pa array<long>, nb array<long>").select(*graphs.columns))


def extensions(graphs: DataFrame, most: int = 12) -> DataFrame:
    """graphs' keys and pa for every DAG that a graph allows: each way to turn its open edges that makes
    no cycle and no new v-structure.

    The DAGs of up to ``most`` open edges are made together; graphs with more are branched down to so many
    first, and their branches are dealt over tasks. It decides the cost and nothing else.
    """
    keys = [c for c in graphs.columns if c not in ("pa", "nb")]

    def kernel(part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, dict[str, pa.Array]]]:
        before = C._matrix(part.column("_from"))
        for g, up in dags_of(C._matrix(part.column("pa")), C._matrix(part.column("nb"))):
            fits = ~C.new_colliders(before[g], up, np.zeros_like(up))
            g, up = g[fits], up[fits]
            yield g, {"pa": C.lists_of(up, part.column("pa").take(pa.array(g)))}

    listed = branched(graphs.withColumn("_from", F.col("pa")), most)
    return C.over_graphs_in_parts(listed, kernel, "pa array<long>").select(*keys, "pa")
