"""What makes a partly directed graph a valid one, and parts of graphs.

The four conditions (no directed cycle, nothing left for Meek's rules, chordal undirected components, some DAG that fits) are
each polynomial: none lists DAGs. They are told for all graphs of a batch at once, a step for one node of each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits as B
from . import criterion as C


def chordal(open_: C.Masks) -> np.ndarray:
    """Whether each undirected graph has no cycle of four nodes or more without a chord.

    Nodes are taken by how many of their neighbours were taken before. The graph is chordal if and only if, for every node, all
    such neighbours but the latest are adjacent to the latest.
    """
    g, n = open_.shape
    row, nodes = np.arange(g), np.arange(n)
    taken, at, weight, fine = np.zeros(g, np.int64), np.full((g, n), -1), np.zeros((g, n), np.int64), np.ones(g, bool)
    for step in range(n):
        v = np.where(at >= 0, -1, weight).argmax(axis=1)
        around = open_[row, v]
        before = around & taken
        latest = np.where((before[:, None] >> nodes) & 1 == 1, at, -1).argmax(axis=1)
        fine &= before & ~(open_[row, latest] | C._bit(latest)) == 0
        weight += (around[:, None] >> nodes) & 1
        at[row, v] = step
        taken |= C._bit(v)
    return fine


def one_extension(parents: C.Masks, open_: C.Masks) -> tuple[C.Masks, np.ndarray]:
    """Parents in one DAG that each graph allows (same v-structures), and whether there is any; open edges of a graph without stay open.

    A node that may come last (no edge leaves it, and each of its open neighbours is adjacent to all its others) takes its open
    edges in and is removed, again and again. Graphs need not be closed.
    """
    up, loose, n = parents.copy(), open_.copy(), parents.shape[1]
    children = C.transpose(parents)
    adj = parents | children | open_
    left = np.full(len(parents), (1 << n) - 1, np.int64)
    for _ in range(n):
        last = np.full(len(parents), -1)
        for v in range(n):
            at = np.flatnonzero((last < 0) & C._has(left, v) & (children[:, v] & left == 0))
            near = adj[at, v] & left[at]
            ends = np.ones(len(at), bool)
            for u in C._members(loose[at, v]):
                ends &= ~C._has(loose[at, v], u) | (near & ~(adj[at, u] | C._bit(u)) == 0)
            last[at[ends]] = v
        at = np.flatnonzero(last >= 0)
        v = last[at]
        up[at, v] |= loose[at, v]
        for u in range(n):
            loose[at, u] &= ~C._bit(v)
        loose[at, v] = 0
        left[at] &= ~C._bit(v)
    found = left == 0
    return np.where(found[:, None], up, parents), found


def conditions(graphs: DataFrame) -> DataFrame:
    """graphs (pa and nb, not null) and acyclic, meek_closed, chordal, extendable, valid (all four).

    A graph without edges or nodes is valid.
    """

    def kernel(part: pa.RecordBatch) -> tuple[None, dict[str, pa.Array]]:
        parents, open_ = C._matrix(part.column("pa")), C._matrix(part.column("nb"))
        told = {
            "acyclic": C.acyclic(parents),
            "meek_closed": (C.close(parents, open_)[0] == parents).all(axis=1),
            "chordal": chordal(open_),
            "extendable": one_extension(parents, open_)[1],
        }
        told["valid"] = np.logical_and.reduce(list(told.values()))
        return None, {name: pa.array(flags) for name, flags in told.items()}

    return C.over_graphs(graphs, kernel, "acyclic boolean, meek_closed boolean, chordal boolean, extendable boolean, valid boolean")


def with_extension(graphs: DataFrame) -> DataFrame:
    """graphs and dag: the parents of each node in one DAG that the graph allows, null where it allows none."""

    def kernel(part: pa.RecordBatch) -> tuple[None, dict[str, pa.Array]]:
        like = part.column("pa")
        up, found = one_extension(C._matrix(like), C._matrix(part.column("nb")))
        lists = C.lists_of(up, like)
        return None, {"dag": pa.ListArray.from_arrays(lists.offsets, lists.values, mask=pa.array(~found))}

    return C.over_graphs(graphs, kernel, "dag array<long>")


def with_fit(graphs: DataFrame, dag: str) -> DataFrame:
    """graphs and fits: whether the parents in column ``dag`` make a DAG on the same nodes that the graph allows. Each directed edge is
    kept, each open one turned one way, and there is no other edge, no cycle, and no collider of two nodes that are not adjacent but
    the graph's own. Null where dag is; masks in it must not be null.
    """

    def kernel(part: pa.RecordBatch) -> tuple[None, dict[str, pa.Array]]:
        given = part.column(dag)
        parents, open_ = C._matrix(part.column("pa")), C._matrix(part.column("nb"))
        same = given.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == part.column("pa").value_lengths().to_numpy(zero_copy_only=False)
        up = np.zeros_like(parents)
        at = np.flatnonzero(same)
        narrow = C._matrix(given.take(pa.array(at)))
        up[at, : narrow.shape[1]] = narrow
        children = C.transpose(up)
        edges = ((up | children) == (parents | C.transpose(parents) | open_)) & (parents & ~up == 0) & (up & children == 0)
        fine = same & edges.all(axis=1) & C.acyclic(up) & ~C.new_colliders(parents, up, np.zeros_like(up))
        return None, {"fits": pa.array(fine, mask=~given.is_valid().to_numpy(zero_copy_only=False))}

    return C.over_graphs(graphs, kernel, "fits boolean")


def induced(df: DataFrame, keep: Column) -> DataFrame:
    """gid, labels, pa, nb: the graph on the nodes in mask ``keep``, its edges as they are. Bits of nodes that a graph lacks are ignored."""
    n = F.size("labels")
    kept = df.withColumn("_keep", F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: B.has(keep, i) & (i < n)))
    narrow = lambda m: F.aggregate(
        F.transform("_keep", lambda i, k: F.struct(i.alias("i"), k.alias("k"))), B.zero(), lambda acc, z: F.when(B.has(m, z["i"]), acc.bitwiseOR(B.bit(z["k"]))).otherwise(acc)
    )
    of_kept = lambda masks: F.transform("_keep", lambda i: narrow(F.get(masks, i)))
    return kept.select("gid", F.transform("_keep", lambda i: F.get("labels", i)).alias("labels"), of_kept("pa").alias("pa"), of_kept("nb").alias("nb"))


def unoriented(df: DataFrame, edges: DataFrame) -> DataFrame:
    """df with the directed edges between nodes a and b of rows gid, a, b made undirected (either order; repeated rows count once).

    A pair that no directed edge joins is an error; pairs of unknown graphs and null nodes are ignored.
    """
    lists = edges.filter("a is not null and b is not null").groupBy("gid").agg(F.collect_set(F.struct("a", "b")).alias("_pairs"))
    place = lambda v: (F.array_position("labels", v) - 1).cast("int")
    placed = df.join(lists, "gid", "left").withColumn("_pairs", F.transform("_pairs", lambda e: F.struct(place(e["a"]).alias("i"), place(e["b"]).alias("j"))))
    joined = lambda e: (e["i"] >= 0) & (e["j"] >= 0) & (B.has(F.get("pa", e["j"]), e["i"]) | B.has(F.get("pa", e["i"]), e["j"]))
    legal = F.when(F.forall("_pairs", joined), F.col("_pairs")).otherwise(F.raise_error(F.concat(F.lit("no directed edge to retract in graph "), F.col("gid").cast("string"))))
    checked = placed.withColumn("_pairs", F.when(F.col("_pairs").isNull(), F.array().cast("array<struct<i:int,j:int>>")).otherwise(legal))
    loose = checked.withColumn(
        "_loose",
        F.transform("labels", lambda _, v: F.aggregate("_pairs", B.zero(), lambda acc, e: F.when(e["j"] == v, acc.bitwiseOR(B.bit(e["i"]))).when(e["i"] == v, acc.bitwiseOR(B.bit(e["j"]))).otherwise(acc))),
    )
    masks = lambda column, f: F.transform(F.arrays_zip(F.col(column).alias("m"), F.col("_loose").alias("l")), lambda z: f(z["m"], z["l"]))
    return loose.withColumns({"pa": masks("pa", B.minus), "nb": masks("nb", lambda m, l: m.bitwiseOR(l))}).select(*df.columns)
