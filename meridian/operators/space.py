"""The space of knowledge states of a graph: what its CPDAG becomes under any knowledge that does not contradict it.

States are ordered by the DAGs they allow. The edges that knowledge directs in a state are a closed set; taking
one edge back gives a state again if and only if the others do not imply it, and every step up in the order
is a chain of such single steps. So the whole space is reached from the DAGs, level by level, each level
deduplicated, without a look at the 3^k ways to direct k edges. Two states meet in the state of the edges that they
share, so the number of steps between them is the number of edges that one of them directs as the other does not.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits as B
from . import criterion as C
from .extensions import _n_open, dags_of, extensions
from .fixpoint import settle
from .steps import distinct, implied, opened, steps


def retract(states: DataFrame) -> DataFrame:
    """The states one step above each state: its other columns, pa and nb of the upper one, and tail and head (places) of
    the edge that is open again.

    states: closed graphs with ``fixed``, the parents that the CPDAG itself directs.
    """

    def kernel(part: pa.RecordBatch) -> tuple[np.ndarray, dict[str, pa.Array]]:
        up, loose = C._matrix(part.column("pa")), C._matrix(part.column("nb"))
        g, i, j = steps(up & ~C._matrix(part.column("fixed")) & ~implied(up, loose))
        up, loose = opened(up[g], loose[g], i, j)
        like = part.column("pa").take(pa.array(g))
        return g, {"pa": C.lists_of(up, like), "nb": C.lists_of(loose, like), "tail": pa.array(i, pa.int32()), "head": pa.array(j, pa.int32())}

    return C.over_graphs(states, kernel, "pa array<long>, nb array<long>, tail int, head int")


def up_covers(states: DataFrame) -> DataFrame:
    """gid, a, b: the edges a -> b that lead from a state (gid, labels, pa, nb, fixed) to one that covers it when taken back."""
    return retract(states).select("gid", F.get("labels", F.col("tail")).alias("a"), F.get("labels", F.col("head")).alias("b"))


#: Open edges of the graphs whose whole space is made in one place; that of a larger one is made level by level over all tasks.
MOST_OPEN = 12
#: DAGs from which a space is made at a time.
DAGS = 1 << 15


def _levels(part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, C.Masks, C.Masks, tuple[np.ndarray, C.Masks, C.Masks]]]:
    """graph, parents, open neighbours of the states of a level, and its covers (graph, lower and upper parents), from the DAGs upwards."""
    fixed = C._matrix(part.column("pa"))
    made = list(dags_of(fixed, C._matrix(part.column("nb"))))
    if not made:
        return
    g, up = (np.concatenate(c) for c in zip(*made, strict=True))
    order = np.argsort(g, kind="stable")
    g, up = g[order], up[order]
    # Whole graphs at a time.
    piece = np.searchsorted(g, g) // DAGS
    for begin, end in zip(*(lambda e: (np.append(0, e), np.append(e, len(g))))(np.flatnonzero(np.diff(piece)) + 1), strict=True):
        own, p = g[begin:end], up[begin:end]
        u = np.zeros_like(p)
        while len(own):
            at, i, j = steps(p & ~fixed[own] & ~implied(p, u))
            above, loose = opened(p[at], u[at], i, j)
            yield own, p, u, (own[at], p[at], above)
            first = distinct(own[at], above)
            own, p, u = own[at][first], above[first], loose[first]


def state_texts(states: C.Masks, labels: list[list[int]], g: np.ndarray) -> pa.Array:
    """'a->b ...' of the directed edges in masks of parents, by tail and then head; ``labels`` of the graphs g. Equal texts are made once."""
    numbers = {}
    names = np.array([numbers.setdefault(tuple(own), len(numbers)) for own in labels], np.int64)
    lists = list(numbers)
    row = names[g] if len(g) else g
    first = distinct(row, states)
    texts = []
    for k, masks in zip(row[first].tolist(), states[first].tolist(), strict=True):
        edges = [(i, j) for j, m in enumerate(masks) if m for i in range(m.bit_length()) if m >> i & 1]
        texts.append(" ".join(f"{lists[k][i]}->{lists[k][j]}" for i, j in sorted(edges)))
    # distinct() goes through rows in order, so a row's text is that of the last first one before it.
    n = states.shape[1]
    keys = [np.bitwise_or.reduce(states << (n * np.arange(n, dtype=np.int64)), axis=1)] if 0 < n <= 7 else list(states.T)
    order = np.lexsort([*keys, row])
    new = np.zeros(len(row), np.int64)
    new[first] = 1
    at = np.empty(len(row), np.int64)
    at[order] = np.cumsum(new[order]) - 1
    return pa.array(texts, pa.string()).take(pa.array(at))


def _split(cpdags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graphs (settled) whose space is made in one place, and the larger ones."""
    whole = settle(cpdags)
    return whole.filter(_n_open() <= MOST_OPEN), whole.filter(_n_open() > MOST_OPEN)


def states(cpdags: DataFrame) -> DataFrame:
    """The states of all graphs: the columns of cpdags (gid, labels, pa, nb and others), pa and nb being those of the state, and fixed, the CPDAG's parents."""
    few, many = _split(cpdags)

    def kernel(part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, dict[str, pa.Array]]]:
        for g, up, loose, _ in _levels(part):
            like = part.column("pa").take(pa.array(g))
            yield g, {"fixed": like, "pa": C.lists_of(up, like), "nb": C.lists_of(loose, like)}

    columns = [*[c for c in cpdags.columns if c not in ("fixed", "pa", "nb")], "fixed", "pa", "nb"]
    found = C.over_graphs_in_parts(few, kernel, "fixed array<long>, pa array<long>, nb array<long>").select(*columns)
    if many.isEmpty():
        return found
    others = [c for c in columns if c not in ("labels", "fixed", "pa", "nb")]
    return found.union(_by_levels(many)[0].join(many.select(*others), "gid").select(*columns))


def covers(cpdags: DataFrame) -> DataFrame:
    """gid, labels, fixed, lower, upper: pairs of states of which one covers the other, by their parents. cpdags: gid, labels, pa, nb."""
    few, many = _split(cpdags.select("gid", "labels", "pa", "nb"))

    def kernel(part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, dict[str, pa.Array]]]:
        for *_, (g, lower, upper) in _levels(part):
            like = part.column("pa").take(pa.array(g))
            yield g, {"fixed": like, "lower": C.lists_of(lower, like), "upper": C.lists_of(upper, like)}

    found = C.over_graphs_in_parts(few, kernel, "fixed array<long>, lower array<long>, upper array<long>").select("gid", "labels", "fixed", "lower", "upper")
    if many.isEmpty():
        return found
    return found.union(_by_levels(many)[1].join(many.select("gid", "labels", F.col("pa").alias("fixed")), "gid").select(*found.columns))


def space(cpdags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """states (gid, labels, fixed, pa, nb, n_directed) and covers (gid, lower, upper: parents of either) of all graphs.

    cpdags: gid, labels, pa, nb. A graph with contradictions has no state.
    """
    base = cpdags.select("gid", "labels", "pa", "nb")
    total = F.aggregate("pa", F.lit(0), lambda acc, m: acc + B.count(m))
    return states(base).select("gid", "labels", "fixed", "pa", "nb").withColumn("n_directed", total), covers(base).select("gid", "lower", "upper")


def _by_levels(cpdags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """space() of large graphs: levels are deduplicated by graph and state, so the states of one are spread like those of many."""
    base = cpdags.select("gid", "labels", "pa", "nb", F.col("pa").alias("fixed"))
    whole = extensions(base).select("gid", "labels", "fixed", "pa", F.transform("pa", lambda _: B.zero()).alias("nb"))
    level, found, pairs = settle(whole), [], []
    while not level.isEmpty():
        found.append(level)
        above = settle(retract(level.withColumn("lower", F.col("pa"))))
        pairs.append(above.select("gid", "lower", F.col("pa").alias("upper")))
        level = settle(above.select(*whole.columns).dropDuplicates(["gid", "pa"]))
    none = "gid long, lower array<long>, upper array<long>"
    return reduce(DataFrame.union, found or [whole]), reduce(DataFrame.union, pairs) if pairs else cpdags.sparkSession.createDataFrame([], none)


def state_distance(left: Column, right: Column) -> Column:
    """Steps between two states of one graph, given by their parents: edges that one directs as the other does not."""
    pairs = F.arrays_zip(left.alias("l"), right.alias("r"))
    return F.aggregate(pairs, F.lit(0), lambda acc, z: acc + B.count(z["l"].bitwiseXOR(z["r"])))


def neighbours(covers: DataFrame) -> DataFrame:
    """gid, state, next: both directions of every cover."""
    one = covers.select("gid", F.col("lower").alias("state"), F.col("upper").alias("next"))
    return one.unionByName(one.select("gid", F.col("next").alias("state"), F.col("state").alias("next")))


def bfs_shells(edges: DataFrame, sources: DataFrame, stops: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """gid, state, distance: hops from each key's sources, for all keys at once; what is not reached has no row.

    edges: gid, state, next (both directions where a graph is undirected). sources: gid, state, several a key if need
    be. stops: gid, state; a key's search ends with the shell that holds one of its stops. most: last shell.
    """
    shell = settle(sources.select("gid", "state").distinct().withColumn("distance", F.lit(0)))
    shells, depth, before = [shell], 0, None
    edges = settle(edges.select("gid", "state", "next"))
    while most is None or depth < most:
        alive = shell
        if stops is not None:
            over = shell.join(stops.select("gid", "state"), ["gid", "state"], "left_semi").select("gid").distinct()
            done = over if before is None else before.union(over)
            before = settle(done)
            alive = shell.join(before, "gid", "left_anti")
        # A hop from a shell ends in the one before, in itself or in the next one.
        seen = reduce(DataFrame.union, [s.select("gid", "state") for s in shells[-2:]])
        depth += 1
        beyond = alive.join(edges, ["gid", "state"]).select("gid", F.col("next").alias("state")).distinct()
        shell = settle(beyond.join(seen, ["gid", "state"], "left_anti").withColumn("distance", F.lit(depth)))
        if shell.isEmpty():
            break
        shells.append(shell)
    return reduce(DataFrame.union, shells)


def shell_sizes(reached: DataFrame, failing: DataFrame | None = None) -> DataFrame:
    """gid, distance, n_states and, with states (gid, state) that fail, n_failing."""
    if failing is None:
        return reached.groupBy("gid", "distance").agg(F.count("*").alias("n_states"))
    told = reached.join(failing.select("gid", "state").withColumn("_fails", F.lit(1)), ["gid", "state"], "left")
    return told.groupBy("gid", "distance").agg(F.count("*").alias("n_states"), F.count("_fails").alias("n_failing"))


def separation(cases: DataFrame) -> DataFrame:
    """cases (gid, labels, nb, x, z and others) with separation, the least number of open edges between place x and a node of mask z, and
    status: 'measured', or why there is none ('x_not_in_component', 'no_z_member_in_component'); then separation is null.
    """
    start = F.struct(B.bit(F.col("x")).alias("seen"), F.when(B.has(F.col("z"), F.col("x")), F.lit(0)).alias("hops"))

    def hop(acc: Column, k: Column) -> Column:
        seen = acc["seen"].bitwiseOR(B.union_over(acc["seen"], F.col("nb")))
        return F.struct(seen.alias("seen"), F.coalesce(acc["hops"], F.when(B.overlap(seen, F.col("z")), k.cast("int"))).alias("hops"))

    searched = cases.withColumn("separation", F.aggregate(F.sequence(F.lit(1), F.size("nb")), start, hop)["hops"])
    alone = F.get("nb", F.col("x")) == 0
    told = searched.withColumn("separation", F.when(~alone, F.col("separation")))
    return told.withColumn("status", F.when(alone, "x_not_in_component").when(F.col("separation").isNull(), "no_z_member_in_component").otherwise("measured"))
