"""Paths themselves: of possible causes, of definite status, and a shortest one that a set leaves open.

Paths grow by a node a turn, all graphs at once: the frontier is a table with a row for each path begun, and what rules a path out
looks at its last three nodes only, so it leaves as early as it can. A graph can have as many paths as its nodes have orders; verdicts
come from criterion.py, which lists none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits as B
from . import criterion as C
from .criterion import with_possible_descendants
from .fixpoint import settle
from .graphs import adjacency

Allowed = Callable[[Column], Column]


def _extended(front: DataFrame, allowed: Allowed) -> DataFrame:
    """front with each path one node longer, in every way that ``allowed`` (a function of that node) admits."""
    ends = front.withColumns({"_v": F.element_at("path", -1), "_u": F.get("path", F.size("path") - 2)})
    new = lambda w: B.has(F.get("_adj", F.col("_v")), w) & ~F.array_contains("path", w)
    more = ends.withColumn("_w", F.explode(F.filter(B.indices(F.col("pa")), lambda w: new(w) & allowed(w))))
    back = F.col("_back") | B.has(F.get("pa", F.col("_v")), F.col("_w"))
    return more.withColumns({"path": F.array_append("path", F.col("_w")), "_back": back}).drop("_u", "_v", "_w")


def _status(w: Column) -> tuple[Column, Column]:
    """Whether the last node v of a path that came from u is a collider, and surely none, if w is next."""
    u, v = F.col("_u"), F.col("_v")
    collider = B.has(F.get("pa", v), u) & B.has(F.get("pa", v), w)
    loose = B.has(F.get("nb", v), u) & B.has(F.get("nb", v), w) & ~B.has(F.get("_adj", u), w)
    return collider, B.has(F.get("pa", u), v) | B.has(F.get("pa", w), v) | loose


def _grown(asked: DataFrame, allowed: Allowed, key: list[str] | None = None) -> DataFrame:
    """asked with path (places from x to y) and _back, a row a path; with a key only for as long as none of that key has come to y."""
    first = asked.filter("x != y").withColumns({"_adj": adjacency(asked), "path": F.array(F.col("x").cast("int")), "_back": F.lit(False)})
    front, done = settle(first), []
    while not front.isEmpty():
        longer = settle(_extended(front, allowed))
        come = longer.filter(F.element_at("path", -1) == F.col("y"))
        front = longer.filter(F.element_at("path", -1) != F.col("y"))
        if key:
            come = come.filter("_back")
            front = front.join(come.select(*key).distinct(), key, "left_anti")
        done.append(come)
    found = reduce(DataFrame.unionByName, done) if done else first.limit(0)
    return found.drop("_adj")


def possibly_causal_paths(asked: DataFrame) -> DataFrame:
    """asked (gid, labels, pa, nb, x, y) with path: places of each way from x to y without a step backwards. A pair without one has no row."""
    return _grown(asked, lambda w: ~B.has(F.get("pa", F.col("_v")), w)).drop("_back")


def definite_non_causal_paths(asked: DataFrame) -> DataFrame:
    """asked with path: each way from x to y with a step backwards, and of whose inner nodes each is a collider or surely none."""

    def allowed(w: Column) -> Column:
        collider, surely_none = _status(w)
        return (F.size("path") == 1) | collider | surely_none

    return _grown(asked, allowed).filter("_back").drop("_back")


#: Nodes of the graphs whose witnesses are sought in one place, so of few paths; those of larger ones grow over all tasks.
MOST_IN_PLACE = 8
#: Paths that rows sought together may begin.
PATHS = 1 << 20


def witnesses(up: C.Masks, loose: C.Masks, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows, and the places of their witness, a column a node: those of one length after the other."""
    children, below = C.transpose(up), C.possible_descendants(up, loose)
    adj = up | children | loose
    g = np.flatnonzero(x != y)
    path, back = x[g][:, None], np.zeros(len(g), bool)
    used = C._bit(x[g])
    while len(g):
        v = path[:, -1]
        ahead = adj[g, v] & ~used
        if path.shape[1] > 1:
            u = path[:, -2]
            above, near = up[g, v], loose[g, v]
            collider = np.where(C._has(above, u) & (below[g, v] & z[g] != 0), above, 0)
            none = children[g, v] | np.where(C._has(near, u), near & ~adj[g, u], 0) | np.where(C._has(up[g, u], v), np.int64(-1), 0)
            ahead &= collider | np.where(C._has(z[g], v), 0, none)
        found = [(at, np.full(len(at), w)) for w in C._members(ahead) if len(at := np.flatnonzero(C._has(ahead, w)))]
        if not found:
            return
        at, w = (np.concatenate(c) for c in zip(*found, strict=True))
        # Paths of a row stay in order, so its first one to come to y is the least.
        order = np.argsort(at, kind="stable")
        at, w = at[order], w[order]
        back = back[at] | C._has(up[g[at], v[at]], w)
        g, path, used = g[at], np.column_stack([path[at], w]), used[at] | C._bit(w)
        come = np.flatnonzero((w == y[g]) & back)
        rows, first = np.unique(g[come], return_index=True)
        yield rows, path[come[first]]
        on = (w != y[g]) & ~np.isin(g, rows)
        g, path, used, back = g[on], path[on], used[on], back[on]


def open_path_witness(asked: DataFrame, key: list[str]) -> DataFrame:
    """asked (z too, a mask) with path: the shortest definite_non_causal_paths() that z leaves open, the least of these; without one no row.

    key: columns that tell the rows of asked apart. Graphs are closed under Meek's rules. In graphs of few nodes paths grow beside the
    row, without a table on the way.
    """

    names = [*asked.columns, "path"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C._slices(batches):
            sizes = part.column("pa").value_lengths().to_numpy(zero_copy_only=False)
            near = part.filter(pa.array(sizes <= MOST_IN_PLACE))
            inner = max(0, min(MOST_IN_PLACE, int(sizes.max(initial=0))) - 2)
            step = max(1, PATHS // sum(factorial(inner) // factorial(k) for k in range(inner + 1)))
            for begin in range(0, near.num_rows, step):
                own = near.slice(begin, step)
                x, y, z = (own.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in "xyz")
                for rows, path in witnesses(C._matrix(own.column("pa")), C._matrix(own.column("nb")), x, y, z):
                    ends = pa.array(np.arange(len(rows) + 1) * path.shape[1], pa.int32())
                    lists = pa.ListArray.from_arrays(ends, pa.array(path.ravel(), pa.int32()))
                    yield pa.RecordBatch.from_arrays([*own.take(pa.array(rows)).columns, lists], names=names)
            far = part.filter(pa.array(sizes > MOST_IN_PLACE))
            if far.num_rows:
                yield pa.RecordBatch.from_arrays([*far.columns, pa.nulls(far.num_rows, pa.list_(pa.int32()))], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema)
    told = settle(asked.mapInArrow(work, f"{schema}, path array<int>"))
    near, far = told.filter("path is not null"), told.filter("path is null").drop("path")
    return near if far.isEmpty() else near.unionByName(_witness_by_turns(far, key).select(*near.columns))


def _witness_by_turns(asked: DataFrame, key: list[str]) -> DataFrame:
    """open_path_witness() with the paths of all rows in one table."""

    def allowed(w: Column) -> Column:
        collider, surely_none = _status(w)
        passes = (collider & B.overlap(F.get("pd", F.col("_v")), F.col("z"))) | (surely_none & ~B.has(F.col("z"), F.col("_v")))
        return (F.size("path") == 1) | passes

    found = _grown(with_possible_descendants(asked), allowed, key)
    least = found.groupBy(*key).agg(F.min("path").alias("path"))
    return asked.join(least, key)


def causal_nodes(asked: DataFrame) -> DataFrame:
    """asked with cn, a mask: nodes on possibly_causal_paths(), without x; and forbidden: x and the possible descendants of these.

    These are the sets of the literature, by paths. A path with a chord may be causal in no DAG, so on graphs with background knowledge they
    can hold more than what lies on a causal path in some DAG. gid tells the rows of asked apart.
    """
    inner = F.aggregate("path", B.zero(), lambda acc, v: acc.bitwiseOR(B.bit(v)))
    on = possibly_causal_paths(asked).groupBy("gid").agg(F.bit_or(B.minus(inner, B.bit(F.col("x")))).alias("cn"))
    told = with_possible_descendants(asked).join(on, "gid", "left").withColumn("cn", F.coalesce("cn", B.zero()))
    return told.withColumn("forbidden", B.union_over(F.col("cn"), F.col("pd")).bitwiseOR(B.bit(F.col("x")))).drop("pd")
