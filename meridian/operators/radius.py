"""Breakdown radius: how many asserted orientations must go before an adjustment set fails.

A state is a CPDAG with some of the claims, closed. Taking a claim back that the others do not imply moves a step
up; the radius is the least number of steps to a state with a DAG for which the set is invalid. Failure goes
upwards, so a set that holds in the CPDAG never fails, and no step is taken from a state that fails.

Bounds come first, for each graph in one pass. From below: the cheapest way to turn claims so that a node of the set
is below x, or that a back-door walk is open; where this says 1, the states one step up are judged. From above: claims
are put back into the CPDAG as long as the set still fails. Only where the bounds differ, states are searched upwards, step by step for all graphs at once, each
shell deduplicated; no state below the lower bound is judged, none beyond the upper one is made.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bits as B
from . import criterion as C
from .extensions import extensions as extensions
from .fixpoint import settle
from .meek import apply_knowledge
from .steps import distinct, implied, opened, pieces, steps

#: A graph without a failing state.
UNREACHED = -1
#: More than any number of claims.
NEVER = 1 << 14

METHODS = ("degenerate", "no_extensions", "unreached", "one_step", "bounds", "search")


def valid_everywhere(states: DataFrame, key: list[str]) -> DataFrame:
    """key and valid: whether mask z is a valid back-door set of (x, y) in every DAG a state allows; false where it allows none."""
    return C.why_invalid(states).select(*key, (F.col("reason") == "").alias("valid"))


def _costs(fixed: C.Masks, claims: C.Masks, up: C.Masks, open_: C.Masks) -> np.ndarray:
    """graph, v, w: how many claims stand against v -> w: none where the state has or leaves it; NEVER where the CPDAG does, or where no edge is."""
    n = up.shape[1]
    out = np.full((len(up), n, n), NEVER, np.int16)
    for w in range(n):
        for v in range(n):
            out[C._has(up[:, w] | open_[:, w], v), v, w] = 0
            against = C._has(up[:, v] & ~fixed[:, v], w)
            out[against, v, w] = C._has(claims[:, v], w)[against]
    return out


def _settled(dist: np.ndarray, costs: np.ndarray) -> np.ndarray:
    """Least costs of walks that go on from where dist is known."""
    while True:
        more = np.minimum(dist, (dist[:, :, None] + costs).min(axis=1))
        if (more == dist).all():
            return dist
        dist = np.minimum(more, NEVER)


def lower_bound(fixed: C.Masks, claims: C.Masks, up: C.Masks, open_: C.Masks, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At least so many claims must go before a node of z is below x, or before a back-door walk from x to y is open; NEVER where neither can be.

    Walks may pass a collider that is not in z if a directed walk could lead from it into z; what that costs is not
    counted, so the second number is a bound and no more.
    """
    n, row = up.shape[1], np.arange(len(up))
    if not len(up):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    costs = _costs(fixed, claims, up, open_)
    in_z = np.array([C._has(z, v) for v in range(n)]).T
    below = np.full((len(up), n), NEVER, np.int16)
    below[row, x] = 0
    descent = np.where(in_z, _settled(below, costs), NEVER).min(axis=1)
    may_reach = _settled(np.where(in_z, 0, NEVER).astype(np.int16), costs.transpose(0, 2, 1)) < NEVER
    inner = np.ones((len(up), n), bool)
    inner[row, x] = inner[row, y] = False
    passes, meets = (inner & ~in_z)[:, :, None], (inner & may_reach)[:, :, None]
    # Walks so far by their last edge: it points at the node, or away from it. The first one points at x.
    at, away = np.full((len(up), n), NEVER, np.int16), np.minimum(costs[row, :, x], NEVER)
    away[row, x] = NEVER
    back = costs.transpose(0, 2, 1)
    while True:
        either = np.where(passes, np.minimum(at, away)[:, :, None], NEVER)
        onward = np.minimum((either + costs).min(axis=1), NEVER)
        turned = np.minimum(np.where(passes, away[:, :, None], NEVER), np.where(meets, at[:, :, None], NEVER))
        backward = np.minimum((turned + back).min(axis=1), NEVER)
        onward[row, x] = backward[row, x] = NEVER
        new_at, new_away = np.minimum(at, onward), np.minimum(away, backward)
        if (new_at == at).all() and (new_away == away).all():
            return descent.astype(np.int64), np.minimum(at, away)[row, y].astype(np.int64)
        at, away = new_at, new_away


def failing_state(fixed: C.Masks, loose: C.Masks, wanted: C.Masks, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[C.Masks, C.Masks]:
    """A state in which z fails, and to which no claim of ``wanted`` can be added so that it still does; z must fail in the CPDAG."""
    up, open_, n = fixed.copy(), loose.copy(), fixed.shape[1]
    for j in range(n):
        for i in C._members(wanted[:, j]):
            at = np.flatnonzero(C._has(wanted[:, j] & ~up[:, j], i))
            if not len(at):
                continue
            p, u = up[at], open_[at]
            p[:, j] |= C._bit(i)
            u[:, j] &= ~C._bit(i)
            u[:, i] &= ~C._bit(j)
            p, u, _ = C.close(p, u)
            still = C.fails(p, u, x[at], y[at], z[at])
            up[at[still]], open_[at[still]] = p[still], u[still]
    return up, open_


def _count(masks: C.Masks) -> np.ndarray:
    return np.bitwise_count(masks).sum(axis=1, dtype=np.int64)


def _columns(part: pa.RecordBatch) -> list[np.ndarray]:
    return [C._matrix(part.column(c)) for c in ("fixed", "loose", "claims", "pa", "nb")] + [part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in "xyz"]


def one_less(fixed: C.Masks, loose: C.Masks, claims: C.Masks, up: C.Masks, open_: C.Masks) -> tuple[np.ndarray, C.Masks, C.Masks]:
    """Every state with one claim less, which the others do not imply: graph, parents, open neighbours."""
    mine = claims & up & ~fixed
    # Where all that knowledge directs is claimed, a state stays closed without the claim; else it is closed anew.
    whole = (up & ~fixed & ~claims == 0).all(axis=1)
    again = np.zeros_like(up)
    again[whole] = implied(up[whole], open_[whole])
    g, i, j = steps(mine & ~again)
    p, u = opened(up[g], open_[g], i, j)
    anew = np.flatnonzero(~whole[g])
    rest = mine[g[anew]]
    rest[np.arange(len(anew)), j[anew]] &= ~C._bit(i[anew])
    p[anew], u[anew], _ = C.close(fixed[g[anew]] | rest, loose[g[anew]] & ~(rest | C.transpose(rest)))
    kept = ~C._has(p[np.arange(len(g)), j], i)
    return g[kept], p[kept], u[kept]


def _bounded(part: pa.RecordBatch) -> tuple[None, dict[str, pa.Array]]:
    """Bounds, and the radius where they decide it."""
    fixed, loose, claims, up, open_, x, y, z = _columns(part)
    held = _count(claims & up)
    legal = part.column("legal").to_numpy(zero_copy_only=False)
    radius, method = np.full(len(x), NEVER), np.full(len(x), METHODS.index("search"))
    lower, upper = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    far, wide = up.copy(), open_.copy()
    radius[~legal], method[~legal] = 0, METHODS.index("no_extensions")
    left = np.flatnonzero(legal)
    bad = C.fails(up[left], open_[left], x[left], y[left], z[left])
    radius[left[bad]], method[left[bad]] = 0, METHODS.index("degenerate")
    left = left[~bad]
    top = C.fails(fixed[left], loose[left], x[left], y[left], z[left])
    radius[left[~top]], method[left[~top]] = UNREACHED, METHODS.index("unreached")
    left = left[top]
    args = [c[left] for c in (fixed, claims, up, open_, x, y, z)]
    lower[left] = np.maximum(1, np.minimum(*lower_bound(*args)))
    # Most radii are 1: all states one step up are judged at once.
    near = left[lower[left] == 1]
    g, p, u = one_less(*[c[near] for c in (fixed, loose, claims, up, open_)])
    bad = C.fails(p, u, x[near[g]], y[near[g]], z[near[g]])
    first = np.flatnonzero(bad)[np.unique(g[bad], return_index=True)[1]]
    hit = near[g[first]]
    far[hit], wide[hit] = p[first], u[first]
    radius[hit], upper[hit], method[hit] = 1, 1, METHODS.index("one_step")
    lower[np.setdiff1d(near, hit)] = 2
    left = left[radius[left] == NEVER]
    far[left], wide[left] = failing_state(fixed[left], loose[left], (claims & up)[left], x[left], y[left], z[left])
    upper[left] = held[left] - _count(claims & far)[left]
    sure = left[lower[left] >= upper[left]]
    radius[sure], method[sure] = upper[sure], METHODS.index("bounds")
    names = np.array(METHODS, dtype=object)
    open_case = radius == NEVER
    return None, {
        "lower": pa.array(lower, pa.int32()), "upper": pa.array(upper, pa.int32()), "radius": pa.array(radius, pa.int32(), mask=open_case), "method": pa.array(names[method], pa.string()),
        "far_pa": C.lists_of(far, part.column("pa")), "far_nb": C.lists_of(wide, part.column("pa")),
    }


def radii(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Radii of a batch of cases as up_radius() has them, without a table on the way, and which of them are left to it, as there are too many claims."""
    _, told = _bounded(part)
    lower, upper = (told[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lower", "upper"))
    radius = told["radius"].fill_null(NEVER).to_numpy(zero_copy_only=False).astype(np.int64)
    fixed, loose, claims, up, open_, x, y, z = _columns(part)
    asked = np.flatnonzero(radius == NEVER)
    for own in pieces(_count(claims[asked])):
        g, shell = asked[own], 0
        p, u = up[g], open_[g]
        while len(g):
            # One step short of the upper bound, that bound is the radius.
            last = upper[g] == shell + 1
            radius[g[last]] = shell + 1
            g, p, u, shell = g[~last], p[~last], u[~last], shell + 1
            at, p, u = one_less(fixed[g], loose[g], claims[g], p, u)
            g = g[at]
            first = distinct(g, p)
            g, p, u = g[first], p[first], u[first]
            bad, near = np.zeros(len(g), bool), np.flatnonzero(lower[g] <= shell)
            bad[near] = C.fails(p[near], u[near], x[g[near]], y[g[near]], z[g[near]])
            radius[g[bad]] = shell
            on = radius[g] == NEVER
            g, p, u = g[on], p[on], u[on]
    return radius, radius == NEVER


def _above(part: pa.RecordBatch) -> tuple[np.ndarray, dict[str, pa.Array]]:
    g, up, open_ = one_less(*_columns(part)[:5])
    like = part.column("pa").take(pa.array(g))
    return g, {"pa": C.lists_of(up, like), "nb": C.lists_of(open_, like)}


def _judged(shell: int):
    def kernel(part: pa.RecordBatch) -> tuple[None, dict[str, pa.Array]]:
        _, _, _, up, open_, x, y, z = _columns(part)
        bad = np.zeros(len(x), bool)
        at = np.flatnonzero(part.column("lower").to_numpy(zero_copy_only=False) <= shell)
        bad[at] = C.fails(up[at], open_[at], x[at], y[at], z[at])
        return None, {"bad": pa.array(bad)}

    return kernel


def up_radius(cases: DataFrame) -> DataFrame:
    """gid, radius (UNREACHED if no state fails), lower, upper, method, and labels, pa, nb of a nearest failing state (the state itself
    where it is degenerate, the CPDAG's where nothing fails).

    cases: gid, labels; fixed, loose: parents and open neighbours of the CPDAG; pa, nb: the closed state; claims: masks of the parents
    that are claimed for each node, which make the state of the CPDAG; x, y, z; legal: false where the claims contradict each other.
    """
    told = settle(C.over_graphs(cases, _bounded, "lower int, upper int, radius int, method string, far_pa array<long>, far_nb array<long>"))
    columns = ("gid", "radius", "lower", "upper", "method", "labels")
    far = told.withColumns({"far_pa": F.when(F.col("method") == "unreached", F.col("fixed")).otherwise(F.col("far_pa")), "far_nb": F.when(F.col("method") == "unreached", F.col("loose")).otherwise(F.col("far_nb"))})
    done = [far.filter("radius is not null").select(*columns, F.col("far_pa").alias("pa"), F.col("far_nb").alias("nb"))]
    level, shell = told.filter("radius is null").drop("radius"), 0
    while True:
        # One step short of the upper bound, that bound is the radius.
        last = level.filter(F.col("upper") == shell + 1).dropDuplicates(["gid"])
        done.append(last.select("gid", F.col("upper").alias("radius"), "lower", "upper", "method", "labels", F.col("far_pa").alias("pa"), F.col("far_nb").alias("nb")))
        level, shell = level.filter(F.col("upper") > shell + 1), shell + 1
        if level.isEmpty():
            return reduce(DataFrame.unionByName, done)
        above = C.over_graphs(level, _above, "pa array<long>, nb array<long>").dropDuplicates(["gid", "pa"])
        judged = settle(C.over_graphs(above, _judged(shell), "bad boolean"))
        hit = settle(judged.filter("bad").groupBy("gid").agg(F.min(F.struct("pa", "nb", "lower", "upper", "method", "labels")).alias("s")).withColumn("radius", F.lit(shell)))
        done.append(hit.select("gid", "radius", *[F.col(f"s.{c}").alias(c) for c in (*columns[2:], "pa", "nb")]))
        level = settle(judged.join(hit.select("gid"), "gid", "left_anti").drop("bad"))


def breakdown_radius(graphs: DataFrame, claims: DataFrame, most: int | None = None) -> DataFrame:
    """gid, radius: least number of claims (gid, a, b) whose removal makes z fail; UNREACHED if none does, or none up
    to ``most`` where that is given. Further columns as up_radius gives them.

    graphs: gid, labels, pa, nb (CPDAGs), x, y, z. Claims that contradict the graph or each other leave no state, which
    counts as failing from the start.
    """
    base = graphs.withColumns({"fixed": F.col("pa"), "loose": F.col("nb")})
    lists = claims.groupBy("gid").agg(F.collect_set(F.struct("a", "b")).alias("_listed"))
    at = lambda c: F.array_position("labels", c) - 1
    held = F.transform("labels", lambda v: F.aggregate(F.filter("_listed", lambda c: (c["b"] == v) & (at(c["a"]) >= 0)), B.zero(), lambda acc, c: acc.bitwiseOR(B.bit(at(c["a"])))))
    known = settle(apply_knowledge(base, claims))
    cases = known.join(lists, "gid", "left").withColumn("_listed", F.coalesce("_listed", F.array().cast("array<struct<a:int,b:int>>")))
    ready = cases.withColumn("claims", held).withColumn("legal", F.col("status") == "ok").drop("_listed", "status")
    found = up_radius(ready)
    return found if most is None else found.withColumn("radius", F.when(F.col("radius") <= most, F.col("radius")).otherwise(UNREACHED))
