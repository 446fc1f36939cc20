"""Linear models over graphs, and the bias that a knowledge state leaves possible.

A model is two arrays in a graph's row: ``weights``, for each node the coefficients of its parents (n x n numbers, 0 where no
edge is), and ``noise``, its variance. All moments are those of the population, without a draw; matrices of a slice of graphs
are worked out together in Arrow batches.

One law and one reported coefficient theta, of x in the regression of y on x and z, are held fixed. What a state leaves
open is which DAG is true; a DAG in which x has the parents p gives the effect beta(p), the coefficient of x beside p, or 0
if y is among them. The worst case is the largest |theta - beta(p)| over the parent sets that are possible in the state.
It only grows as knowledge is taken back, so its maxima by steps taken back are a staircase, and a threshold's radius
is where the staircase first exceeds it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import criterion as C
from .fixpoint import settle
from .radius import UNREACHED, radii
from .space import retract
from .steps import MOST_STEPS, distinct, implied, opened, pieces, steps

#: An effect or a bias below is rounding, and told as none.
ZERO = 1e-9
#: Thresholds as shares of the reported coefficient (fixed values).
EPSILONS = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0)


def _squares(lists: pa.ListArray, n: int) -> np.ndarray:
    """graph, n, n: matrices from flat rows, with zeros for nodes that smaller graphs lack."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    starts, flat = np.append(0, np.cumsum(sizes)), lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), n, n))
    for size in np.unique(sizes):
        k, at = int(np.sqrt(size)), np.flatnonzero(sizes == size)
        out[at, :k, :k] = flat[starts[at][:, None] + np.arange(size)].reshape(-1, k, k)
    return out


def _rows(squares: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """Back to flat rows of k x k numbers, k being the graph's size."""
    inside = np.arange(squares.shape[1]) < sizes[:, None]
    flat = squares[inside[:, :, None] & inside[:, None, :]]
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes**2)), pa.int32()), pa.array(flat, pa.float64()))


def moment_kernel(part: pa.RecordBatch) -> tuple[None, dict[str, pa.Array]]:
    sizes = part.column("pa").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    n = int(sizes.max()) if len(sizes) else 0
    effects = _effects(part, n)
    noise = np.zeros((len(sizes), n))
    noise[np.arange(n) < sizes[:, None]] = part.column("noise").flatten().to_numpy(zero_copy_only=False)
    sigma = (effects * noise[:, None, :]) @ effects.transpose(0, 2, 1)
    return None, {"effects": _rows(effects, sizes), "sigma": _rows(sigma, sizes)}


def _effects(part: pa.RecordBatch, n: int) -> np.ndarray:
    return np.linalg.inv(np.eye(n) - _squares(part.column("weights"), n))


def moments(models: DataFrame) -> DataFrame:
    """models (pa, weights, noise) with effects and sigma, flat n x n: total effects (row: on, column: of; 1 of a node on itself) and
    the covariance matrix. With B the weights, effects are (I - B)^-1 = I + B + B^2 + ..., the sums over directed paths."""
    return C.over_graphs(models, moment_kernel, "effects array<double>, sigma array<double>")


def total_effects(models: DataFrame) -> DataFrame:
    """gid, a, b, effect: the total effect of every node of a DAG (labels, pa, weights) on each of its descendants."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C._slices(batches):
            above = C._matrix(part.column("pa"))
            n = above.shape[1]
            for k in range(n):  # paths through node k, for one k after the other
                above |= np.where(C._has(above, k), above[:, [k]], 0)
            g, i, j = steps(above)
            sizes, labels = part.column("labels").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), part.column("labels").flatten()
            at = (np.cumsum(sizes) - sizes)[g]
            yield pa.RecordBatch.from_arrays([part.column("gid").take(pa.array(g)), labels.take(pa.array(at + i)), labels.take(pa.array(at + j)), pa.array(_effects(part, n)[g, j, i])], names=["gid", "a", "b", "effect"])

    kind = dict(models.dtypes)
    label = kind["labels"].removeprefix("array<").removesuffix(">")
    return models.select("gid", "labels", "pa", "weights").mapInArrow(work, f"gid {kind['gid']}, a {label}, b {label}, effect double")


def entries(matrices: DataFrame, column: str, name: str) -> DataFrame:
    """gid, a, b and the number in row a, column b of a flat n x n column."""
    flat = matrices.select("gid", "labels", F.posexplode(column).alias("k", name))
    at = lambda i: F.get("labels", i.cast("int"))
    return flat.select("gid", at(F.floor(F.col("k") / F.size("labels"))).alias("a"), at(F.col("k") % F.size("labels")).alias("b"), name)


def regressed(sigma: np.ndarray, on: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of the target, one node a graph, on the nodes of mask ``on`` (0 for others), and the variance that is left."""
    n, row = sigma.shape[1], np.arange(len(sigma))
    inside = np.array([C._has(on, v) for v in range(n)]).T if n else np.zeros((len(on), 0), bool)
    block = np.where(inside[:, :, None] & inside[:, None, :], sigma, np.eye(n))
    right = np.where(inside, sigma[row, :, target], 0.0)
    found = np.linalg.solve(block, right[:, :, None])[:, :, 0] if len(sigma) else right
    return found, sigma[row, target, target] - (found * right).sum(axis=1)


def adjusted_kernel(part: pa.RecordBatch) -> tuple[None, dict[str, pa.Array]]:
    n = int(part.column("pa").value_lengths().to_numpy(zero_copy_only=False).max()) if part.num_rows else 0
    x, y, z = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in "xyz")
    sigma, effects, row = _squares(part.column("sigma"), n), _squares(part.column("effects"), n), np.arange(len(x))
    beside = z & ~(C._bit(x) | C._bit(y))
    found, left_y = regressed(sigma, beside | C._bit(x), y)
    _, left_x = regressed(sigma, beside, x)
    theta = found[row, x]
    return None, {"theta": pa.array(theta), "bias": pa.array(theta - effects[row, y, x]), "variance": pa.array(left_y / left_x)}


def adjusted(models: DataFrame) -> DataFrame:
    """models (pa, effects, sigma; places x and y, mask z) with theta, the coefficient of x in the regression of y on x and z; bias, by
    which it is off the total effect; and variance, that of its estimator times the number of observations."""
    return C.over_graphs(models, adjusted_kernel, "theta double, bias double, variance double")


def parent_sets(parents: C.Masks, open_: C.Masks, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """graph, mask: every set of parents that node x has in some DAG of a closed graph.

    Open neighbours that become parents together must be adjacent, so cliques of them are grown, in ascending order of
    nodes; each is kept if its orientation of all open edges at x can be closed without a contradiction.
    """
    row, n = np.arange(len(x)), parents.shape[1]
    adj = parents | C.transpose(parents) | open_
    near = open_[row, x]
    g, chosen, may = row, np.zeros(len(x), np.int64), near.copy()
    grown = [(g, chosen)]
    while len(g):
        more = [(g[at], chosen[at] | C._bit(v), may[at] & adj[g[at], v] & ~np.int64((1 << v + 1) - 1)) for v in range(n) if len(at := np.flatnonzero(C._has(may, v)))]
        if not more:
            break
        g, chosen, may = (np.concatenate(c) for c in zip(*more, strict=True))
        grown.append((g, chosen))
    g, chosen = (np.concatenate(c) for c in zip(*grown, strict=True))
    up, loose, own, at_x = parents[g], open_[g], np.arange(len(g)), x[g]
    up[own, at_x] |= chosen
    loose[own, at_x] = 0
    for v in range(n):
        at = np.flatnonzero(C._has(near[g], v))
        loose[at, v] &= ~C._bit(at_x[at])
        out = at[~C._has(chosen[at], v)]
        up[out, v] |= C._bit(at_x[out])
    before = parents[g]
    up, loose, fine = C.close(up, loose)
    fine &= ~C.new_colliders(before, up, loose)
    order = np.flatnonzero(fine)
    order = order[np.argsort(g[order], kind="stable")]
    return g[order], parents[g[order], at_x[order]] | chosen[order]


Law = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # by graph: x, y, theta and sigma


def _law(part: pa.RecordBatch, n: int) -> Law:
    x, y = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in "xy")
    return x, y, part.column("theta").to_numpy(zero_copy_only=False), _squares(part.column("sigma"), n)


def _judged(up: C.Masks, loose: C.Masks, law: Law, of: np.ndarray) -> tuple[np.ndarray, ...]:
    """worst, effect_min, effect_max, n_parent_sets and parents of states, of which each is one of graph ``of``."""
    x, y, theta = (c[of] for c in law[:3])
    g, sets = parent_sets(up, loose, x)
    effect = np.zeros(len(g))
    step = max(1, C.WORK // max(1, up.shape[1] ** 2))
    for begin in range(0, len(g), step):
        own = g[begin : begin + step]
        found, _ = regressed(law[3][of[own]], sets[begin : begin + step] & ~C._bit(y[own]) | C._bit(x[own]), y[own])
        effect[begin : begin + step] = found[np.arange(len(own)), x[own]]
    # An outcome that comes first has no effect to take; what is rounding would tip thresholds that a missing effect just meets.
    effect[((sets >> y[g]) & 1 == 1) | (np.abs(effect) < ZERO)] = 0.0
    off = np.abs(theta[g] - effect)
    # By graph; of equal biases the smallest set tells.
    order = np.lexsort((sets, -off, g))
    first = np.flatnonzero(np.diff(g[order], prepend=-1))
    here = g[order][first]
    many = np.bincount(g, minlength=len(x))
    if len(here) < len(x):
        raise ValueError("a state allows no DAG, so it has no bias")
    worst = np.where(off[order][first] < ZERO, 0.0, off[order][first])
    ends = [f.reduceat(effect[order], first) if len(first) else np.zeros(0) for f in (np.minimum, np.maximum)]
    return worst, *ends, many, sets[order][first]


def _worst(part: pa.RecordBatch) -> tuple[None, dict[str, pa.Array]]:
    up, loose = C._matrix(part.column("pa")), C._matrix(part.column("nb"))
    worst, least, most, many, sets = _judged(up, loose, _law(part, up.shape[1]), np.arange(len(up)))
    return None, {"worst": pa.array(worst), "effect_min": pa.array(least), "effect_max": pa.array(most), "n_parent_sets": pa.array(many, pa.int32()), "parents": pa.array(sets)}


def worst_case_bias(states: DataFrame) -> DataFrame:
    """states (closed: pa, nb; places x and y; sigma, theta) with worst, the largest bias that a DAG of the state gives theta; effect_min and
    effect_max, the effects it leaves open; n_parent_sets; and parents, a set that gives the worst."""
    return C.over_graphs(states, _worst, "worst double, effect_min double, effect_max double, n_parent_sets int, parents long")


Shell = tuple[np.ndarray, int, np.ndarray, np.ndarray]  # graphs, depth, and by graph: states and their worst bias


def _shells(part: pa.RecordBatch, above: float | None) -> Iterator[Shell]:
    """The shells of the states of a batch that are few steps from the top, depth by depth, many graphs together."""
    fixed, up, loose = (C._matrix(part.column(c)) for c in ("fixed", "pa", "nb"))
    law = _law(part, up.shape[1])
    for g in pieces(_known(part)):
        p, u, d = up[g], loose[g], 0
        while len(g):
            worst, first = _judged(p, u, law, g)[0], np.flatnonzero(np.diff(g, prepend=-1))
            here, most = g[first], np.maximum.reduceat(worst, first)
            yield here, d, np.diff(first, append=len(g)), most
            if above is not None:
                on = ~np.isin(g, here[most > above * np.abs(law[2][here])])
                g, p, u = g[on], p[on], u[on]
            at, i, j = steps(p & ~fixed[g] & ~implied(p, u))
            p, u = opened(p[at], u[at], i, j)
            first = distinct(g[at], p)
            g, p, u, d = g[at][first], p[first], u[first], d + 1


def _known(part: pa.RecordBatch) -> np.ndarray:
    """How many edges knowledge directs in each state."""
    masks = C._matrix(part.column("pa")) & ~C._matrix(part.column("fixed"))
    return np.bitwise_count(masks).sum(axis=1, dtype=np.int64)


def bias_profile(states: DataFrame, above: float | None = None) -> DataFrame:
    """gid, d, n_states, shell_max, beta_up: the worst bias over all states d steps above each state, and over those up to d.

    states: gid, labels, pa, nb, fixed, x, y, sigma, theta. The shells of a state that is few steps from the top are made in its batch,
    without a table on the way; those of others from one another over all tasks. With ``above`` a graph's profile ends with the step that
    exceeds so many times |theta|.
    """
    columns, made = ["gid", "labels", "fixed", "pa", "nb", "x", "y", "sigma", "theta"], ["d", "n_states", "shell_max", "beta_up"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C._slices(batches):
            beta = np.zeros(part.num_rows)
            for g, d, many, most in _shells(part, above):
                beta[g] = np.maximum(beta[g], most)
                told = [pa.array(np.full(len(g), d), pa.int32()), pa.array(many, pa.int64()), pa.array(most), pa.array(beta[g])]
                own = [part.column("gid").take(pa.array(g)), *[pa.nulls(len(g), part.schema.field(c).type) for c in columns[1:]]]
                yield pa.RecordBatch.from_arrays([*own, *told], names=[*columns, *made])
            far = part.filter(pa.array(_known(part) > MOST_STEPS))
            if far.num_rows:
                told = [pa.nulls(far.num_rows, t) for t in (pa.int32(), pa.int64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([*far.columns, *told], names=[*columns, *made])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in states.select(*columns).schema)
    told = settle(states.select(*columns).mapInArrow(work, f"{schema}, d int, n_states long, shell_max double, beta_up double"))
    near, far = told.filter("d is not null").select("gid", *made), told.filter("d is null").select(*columns)
    return near if far.isEmpty() else near.union(_profile_by_shells(far, above))


def _profile_by_shells(states: DataFrame, above: float | None) -> DataFrame:
    """bias_profile() where a state may have many above it: shells are deduplicated by graph and state, for all graphs at once."""
    level, d, found, top = states, 0, [], None
    while not level.isEmpty():
        judged = worst_case_bias(level).groupBy("gid").agg(F.count("*").alias("n_states"), F.max("worst").alias("shell_max"), F.first("theta").alias("theta"))
        step = settle(judged.withColumn("d", F.lit(d)))
        found.append(step.drop("theta"))
        if above is not None:
            over = step.filter(F.col("shell_max") > above * F.abs("theta")).select("gid")
            top = over if top is None else settle(top.union(over))
            level = level.join(top, "gid", "left_anti")
        level, d = settle(retract(level).select(*states.columns).dropDuplicates(["gid", "pa"])), d + 1
    so_far = Window.partitionBy("gid").orderBy("d")
    return reduce(DataFrame.union, found).withColumn("beta_up", F.max("shell_max").over(so_far)).select("gid", "d", "n_states", "shell_max", "beta_up")


#: The share of the reported coefficient whose radius a certificate tells.
CERTIFIED = 0.1


def certificate_kernel(part: pa.RecordBatch) -> tuple[None, dict[str, pa.Array]]:
    """For states (fixed, loose, pa, nb; x, y, z, sigma, theta) r_val, beta_top and r_eps_10. Of a state that is many steps from the top r_val and
    r_eps_10 are left null, and its columns stay; those of others are null then, as nobody needs them."""
    fixed, loose, up = (C._matrix(part.column(c)) for c in ("fixed", "loose", "pa"))
    law = _law(part, up.shape[1])
    claimed = pa.RecordBatch.from_arrays([*part.columns, C.lists_of(up & ~fixed, part.column("pa")), pa.array(np.ones(len(up), bool))], names=[*part.schema.names, "claims", "legal"])
    radius, left = radii(claimed)
    left |= _known(part) > MOST_STEPS
    first = np.full(len(up), UNREACHED)
    for g, d, _, most in _shells(part, CERTIFIED):
        over = g[most > CERTIFIED * np.abs(law[2][g])]
        first[over] = np.where(first[over] == UNREACHED, d, first[over])
    told = {"r_val": pa.array(radius, pa.int32(), mask=left), "beta_top": pa.array(_judged(fixed, loose, law, np.arange(len(up)))[0]), "r_eps_10": pa.array(first, pa.int32(), mask=left | (np.abs(law[2]) < 1e-12))}
    kept = {c: pc.if_else(pa.array(left), part.column(c), pa.scalar(None, part.column(c).type)) for c in ("labels", "fixed", "loose", "pa", "nb", "sigma")}
    return None, told | kept


def epsilon_radii(profile: DataFrame, theta: DataFrame, epsilons: tuple[float, ...] = EPSILONS) -> DataFrame:
    """gid, epsilon, r_eps: the first depth at which the staircase exceeds epsilon times |theta|; UNREACHED if none does. theta: gid, theta.

    Where theta is 0 no share of it is defined, and r_eps is null.
    """
    grid = F.explode(F.array(*[F.lit(float(e)) for e in epsilons]))
    each = profile.join(theta.select("gid", "theta"), "gid").withColumn("epsilon", grid)
    first = F.coalesce(F.min(F.when(F.col("beta_up") > F.col("epsilon") * F.abs("theta"), F.col("d"))), F.lit(UNREACHED))
    return each.groupBy("gid", "epsilon").agg(F.when(F.first(F.abs("theta")) >= 1e-12, first).alias("r_eps"))


def certified_band(radii: DataFrame, budgets: DataFrame) -> DataFrame:
    """gid, k, lower, upper: with k claims wrong, a bias above lower can be, and none above upper; null where the grid does not say.

    radii: gid, epsilon, r_eps. budgets: gid, k.
    """
    each = budgets.join(radii.filter("r_eps is not null"), "gid")
    within = (F.col("r_eps") != UNREACHED) & (F.col("r_eps") <= F.col("k"))
    return each.groupBy("gid", "k").agg(F.max(F.when(within, F.col("epsilon"))).alias("lower"), F.min(F.when(~within, F.col("epsilon"))).alias("upper"))
