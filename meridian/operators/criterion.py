"""Adjustment criteria on partly directed graphs themselves, without a look at the DAGs that they allow.

Whether a set is valid in every DAG of a Meek-closed graph hangs on what can be reached by steps of which
each is judged by the node before, the node and the node after. Such searches are fixpoints over pairs of
nodes; they run in Arrow batches, on masks, for all graphs of a batch at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.bits import MOST_NODES

REASONS = ("", "no_extensions", "degenerate_query", "not_amenable", "z_hits_forbidden", "open_noncausal_path")  # fixed values

Masks = np.ndarray  # graphs by nodes


def _bit(i: np.ndarray | int) -> np.ndarray:
    return np.int64(1) << np.asarray(i, np.int64)


def _has(mask: np.ndarray, i: int) -> np.ndarray:
    return (mask >> np.int64(i)) & 1 == 1


def _members(masks: np.ndarray) -> list[int]:
    """Nodes that are in one of the masks or more."""
    whole = int(np.bitwise_or.reduce(masks)) if len(masks) else 0
    return [k for k in range(whole.bit_length()) if whole >> k & 1]


def transpose(masks: Masks) -> Masks:
    out = np.zeros_like(masks)
    for j in range(masks.shape[1]):
        for i in _members(masks[:, j]):
            out[:, i] |= np.where(_has(masks[:, j], i), _bit(j), 0)
    return out


def acyclic(parents: Masks) -> np.ndarray:
    up, n = parents.copy(), parents.shape[1]
    for k in range(n):  # paths through node k, for one k after the other
        up |= np.where(_has(up, k), up[:, [k]], 0)
    return ~np.any([_has(up[:, i], i) for i in range(n)], axis=0) if n else np.ones(len(parents), bool)


def close(parents: Masks, open_: Masks) -> tuple[Masks, Masks, np.ndarray]:
    """parents and undirected neighbours under Meek's four rules, and whether no edge ends directed both ways or in a cycle."""
    parents, open_, n = parents.copy(), open_.copy(), parents.shape[1]
    # A round looks at the graphs that the one before has changed, as far as they have open edges.
    left = np.flatnonzero(open_.any(axis=1))
    while len(left):
        whole, free = parents[left], open_[left]
        children, new = transpose(whole), np.zeros_like(whole)
        adj = whole | children | free
        for j in range(n):
            for i in _members(free[:, j]):
                at = np.flatnonzero(_has(free[:, j], i))
                up, far = whole[at], ~(adj[at, j] | _bit(j))
                fires = (up[:, i] & far != 0) | (children[at, i] & up[:, j] != 0)
                middle, apart = free[at, i] & up[:, j], free[at, i] & far
                for k in _members(up[:, j]):
                    fires |= _has(middle, k) & (middle & ~(adj[at, k] | _bit(k)) != 0)
                    fires |= _has(up[:, j], k) & (up[:, k] & apart != 0)
                new[at[fires], j] |= _bit(i)
        changed = new.any(axis=1)
        left, new = left[changed], new[changed]
        parents[left] |= new
        open_[left] &= ~(new | transpose(new))
        left = left[open_[left].any(axis=1)]
    return parents, open_, acyclic(parents)


def new_colliders(before: Masks, parents: Masks, open_: Masks) -> np.ndarray:
    """Whether two nodes that are not adjacent have a common child now and not both had it before."""
    adj, out = parents | transpose(parents) | open_, np.zeros(len(parents), bool)
    for m in range(parents.shape[1]):
        for a in range(parents.shape[1]):
            others = parents[:, m] & ~(adj[:, a] | _bit(a))
            others &= np.where(_has(before[:, m], a), ~before[:, m], np.int64(-1))
            out |= _has(parents[:, m], a) & (others != 0)
    return out


def possible_descendants(parents: Masks, open_: Masks) -> Masks:
    """For each node the nodes below it in some DAG of a closed graph, itself included: those that unshielded paths without a backward step reach."""
    children, n = transpose(parents), parents.shape[1]
    adj, forth = parents | children | open_, children | open_
    # last[g, s, u]: the nodes that a path from s can enter from u.
    last = np.zeros((len(parents), n, n), np.int64)
    for s in range(n):
        last[:, s, s] = forth[:, s]
    while True:
        before = last.copy()
        for u in range(n):
            for v in _members(forth[:, u]):
                further = forth[:, v] & ~(adj[:, u] | _bit(u))
                last[:, :, v] |= np.where(_has(last[:, :, u], v), further[:, None], 0)
        if (last == before).all():
            return np.bitwise_or.reduce(last, axis=2) | _bit(np.arange(n))


def open_path(parents: Masks, open_: Masks, below: Masks, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Whether z leaves a path from x to y open that has a backward step, and of whose nodes each is a collider or surely none."""
    children, n = transpose(parents), parents.shape[1]
    adj = parents | children | open_
    # came[f][g, u]: the nodes entered from u; f tells whether some step went backwards.
    came = [np.zeros_like(parents), np.zeros_like(parents)]
    for u in range(n):
        came[0][:, u] = np.where(x == u, children[:, u] | open_[:, u], 0)
        came[1][:, u] = np.where(x == u, parents[:, u], 0)
    while True:
        before = [c.copy() for c in came]
        for u in range(n):
            for v in _members(adj[:, u]):
                free = np.where(_has(z, v), np.int64(0), np.int64(-1))  # a node in z lets only colliders pass
                collider = np.where(below[:, v] & z != 0, parents[:, v], 0)
                forward, back, loose = _has(children[:, u], v), _has(parents[:, u], v), _has(open_[:, u], v)
                on = np.where(forward | back | loose, children[:, v] & free, 0)  # an edge out of v
                on |= np.where(back, open_[:, v] & free, 0) | np.where(loose, open_[:, v] & ~adj[:, u] & free, 0)
                against = np.where(forward, collider, 0) | np.where(back, parents[:, v] & free, 0)
                allowed = ~(_bit(u) | _bit(x))
                for f in (0, 1):
                    here = _has(came[f][:, u], v) & (y != v)
                    came[f][:, v] |= np.where(here, on & allowed, 0)
                    came[1][:, v] |= np.where(here, against & allowed, 0)
        if all((a == b).all() for a, b in zip(came, before, strict=True)):
            return (np.bitwise_or.reduce(came[1], axis=1) >> y) & 1 == 1


def possibly_below(parents: Masks, open_: Masks, start: np.ndarray) -> np.ndarray:
    """possible_descendants() of one node a graph."""
    adj, n, row = parents | transpose(parents) | open_, parents.shape[1], np.arange(len(start))
    forth = adj & ~parents
    last = np.zeros_like(parents)
    last[row, start] = forth[row, start]
    while True:
        before = last.copy()
        for u in range(n):
            for v in _members(last[:, u]):
                at = np.flatnonzero(_has(last[:, u], v))
                if len(at):
                    last[at, v] |= forth[at, v] & ~(adj[at, u] | _bit(u))
        if (last == before).all():
            return np.bitwise_or.reduce(last, axis=1) | _bit(start)


def amenable(parents: Masks, open_: Masks, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether no DAG of a closed graph has a causal path from x to y whose first edge the graph leaves open."""
    out, row = np.ones(len(parents), bool), np.arange(len(x))
    found = [(at, np.full(len(at), v)) for v in range(parents.shape[1]) if len(at := np.flatnonzero(_has(open_[row, x], v)))]
    if not found:
        return out
    # Every open edge at x is tried forwards, each in a graph of its own.
    g, v = (np.concatenate(c) for c in zip(*found, strict=True))
    up, loose, own = parents[g], open_[g], np.arange(len(g))
    up[own, v] |= _bit(x[g])
    loose[own, v] &= ~_bit(x[g])
    loose[own, x[g]] &= ~_bit(v)
    up, loose, fine = close(up, loose)
    out[g[fine & ((possibly_below(up, loose, v) >> y[g]) & 1 == 1)]] = False
    return out


def judge(parents: Masks, open_: Masks, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places in REASONS by the back-door and by the generalised criterion, amenability, and the two forbidden sets."""
    up, loose, fine = close(parents, open_)
    row, children = np.arange(len(x)), transpose(up)
    below = possible_descendants(up, loose)
    backdoor = below[row, x] | _bit(x) | _bit(y)
    general = _bit(x) | _bit(y)
    for v in range(up.shape[1]):
        causal = _has(children[row, x], v) & ((below[:, v] >> y) & 1 == 1)
        general = general | np.where(causal, below[:, v], 0)
    may, path = amenable(up, loose, x, y), open_path(up, loose, below, x, y, z)
    reasons = [np.select([~fine, x == y, ~may, z & bad != 0, path], [1, 2, 3, 4, 5], 0) for bad in (backdoor, general)]
    return *reasons, may, backdoor, general


#: Numbers that the search for possible descendants keeps at a time.
WORK = 1 << 22


def fails(parents: Masks, open_: Masks, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Whether z is no back-door set of (x, y) in some DAG of a closed graph that has one; later tests see only what earlier ones leave."""
    out = x == y
    step = max(1, WORK // max(1, parents.shape[1] ** 2))
    for begin in range(0, len(x), step):
        at = np.arange(begin, min(begin + step, len(x)))
        below = possible_descendants(parents[at], open_[at])
        out[at] |= z[at] & (below[np.arange(len(at)), x[at]] | _bit(x[at]) | _bit(y[at])) != 0
        left = np.flatnonzero(~out[at])
        i = at[left]
        out[i] = open_path(parents[i], open_[i], below[left], x[i], y[i], z[i])
        i = i[~out[i]]
        out[i] = ~amenable(parents[i], open_[i], x[i], y[i])
    return out


def _matrix(lists: pa.ListArray) -> Masks:
    """Masks of all graphs of a batch, with zeros for nodes that smaller ones lack."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(sizes.max()) if len(sizes) else 0
    if width > MOST_NODES:
        raise ValueError(f"a graph has {width} nodes; sets of nodes are masks of {MOST_NODES} at most")
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def lists_of(masks: Masks, like: pa.ListArray) -> pa.ListArray:
    """Back from _matrix: as many masks a graph as ``like`` has."""
    sizes = like.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = masks[np.arange(masks.shape[1]) < sizes[:, None]]
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(flat, pa.int64()))


#: Graphs worked on at a time: what is between stays in cache, and each step, which costs something itself, serves many.
GRAPHS = 8192


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Graphs of about one size at a time, as a slice costs what its widest graph does."""
    for batch in batches:
        sizes = batch.column("pa").value_lengths().to_numpy(zero_copy_only=False)
        if batch.num_rows and sizes.max() > 2 * sizes.min():
            batch = batch.take(pa.array(np.argsort(sizes, kind="stable")))
        for at in range(0, batch.num_rows, GRAPHS):
            yield batch.slice(at, GRAPHS)


def over_graphs(df: DataFrame, kernel: Callable[[pa.RecordBatch], tuple[np.ndarray | None, dict[str, pa.Array]]], made: str) -> DataFrame:
    """df with the columns of schema ``made``, which a kernel works out for a slice of graphs at a time.

    The kernel gives places of rows (null: all rows, in order) and the new columns for them; new ones replace those of df.
    """
    return over_graphs_in_parts(df, lambda part: iter([kernel(part)]), made)


def over_graphs_in_parts(df: DataFrame, kernel: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray | None, dict[str, pa.Array]]]], made: str) -> DataFrame:
    """over_graphs() with a kernel that yields the rows of a slice of graphs in several parts, as there may be many a graph."""
    names = [part.split()[0] for part in made.split(", ")]
    keep = [c for c in df.columns if c not in names]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            for rows, new in kernel(part):
                own = part.select(keep) if rows is None else part.select(keep).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*own.columns, *[new[n] for n in names]], names=[*keep, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    return df.mapInArrow(work, f"{schema}, {made}" if schema else made)


Kernel = Callable[[pa.RecordBatch], tuple[np.ndarray | None, dict[str, pa.Array]]]


def chained(*kernels: Kernel) -> Kernel:
    """One kernel of several, each of which sees the columns that those before it made: rows cross to Python and back once."""

    def kernel(part: pa.RecordBatch) -> tuple[np.ndarray | None, dict[str, pa.Array]]:
        rows, made = None, {}
        for step in kernels:
            own, new = step(part)
            if own is not None:
                at = pa.array(own)
                part, made, rows = part.take(at), {n: c.take(at) for n, c in made.items()}, own if rows is None else rows[own]
            made |= new
            kept = [n for n in part.schema.names if n not in new]
            part = pa.RecordBatch.from_arrays([*[part.column(n) for n in kept], *new.values()], names=[*kept, *new])
        return rows, made

    return kernel


def why_invalid(states: DataFrame) -> DataFrame:
    """states and why mask z is no valid adjustment set for places x and y in some DAG of the graph.

    reason: by the back-door criterion; reason_gac: by the generalised one; '' where z is valid. amenable,
    forbidden and forbidden_gac (masks). A graph whose closure contradicts itself has 'no_extensions'. x, y,
    z, pa and nb must not be null.
    """
    keep = [c for c in states.columns if c not in ("reason", "reason_gac", "amenable", "forbidden", "forbidden_gac")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(REASONS, dtype=object)
        for part in _slices(batches):
            x, y, z = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in "xyz")
            reason, general, may, bad, bad_general = judge(_matrix(part.column("pa")), _matrix(part.column("nb")), x, y, z)
            more = [pa.array(names[reason], pa.string()), pa.array(names[general], pa.string()), pa.array(may), pa.array(bad), pa.array(bad_general)]
            yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*keep, "reason", "reason_gac", "amenable", "forbidden", "forbidden_gac"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in states.select(*keep).schema)
    return states.select(*keep).mapInArrow(work, f"{schema}, reason string, reason_gac string, amenable boolean, forbidden long, forbidden_gac long")


def with_possible_descendants(graphs: DataFrame) -> DataFrame:
    """graphs (closed) and pd: for each node the mask of its possible descendants, itself included."""
    keep = [c for c in graphs.columns if c != "pd"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            found = possible_descendants(_matrix(part.column("pa")), _matrix(part.column("nb")))
            lists = lists_of(found, part.column("pa"))
            yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*keep, "pd"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in graphs.select(*keep).schema)
    return graphs.select(*keep).mapInArrow(work, f"{schema}, pd array<long>")
