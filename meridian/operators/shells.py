"""The bias of a state when some of its claims go: its distribution over all ways to drop d of them.

A shell has as many ways as there are subsets of d claims; each counts once, though many close to the same state. What is kept
closes to a state if and only if it lies in the state and holds those of its edges that its others do not imply: no two edges imply
each other beside a closed set, so no two states claim a subset, and each is claimed by its closure. So the ways to a
state are a binomial coefficient, and a whole shell takes a look at its states, not at its ways. The ways of each shell must add up to all there are, or it is an error.

Only where a caller names a size are larger shells sampled, without replacement: ways are numbered, numbers are drawn, and
a number is turned into its subset without a look at the others.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import criterion as C
from .fixpoint import settle
from .models import _judged, _known, _law, _worst, worst_case_bias
from .radius import UNREACHED
from .space import retract
from .steps import MOST_STEPS, distinct, implied, opened, pieces, steps

#: What a profile tells of a graph's shell.
PROFILE = "d int, n_subsets double, n_evaluated long, n_states long, mean double, se double, beta_up double, min_nonzero double, frac_nonzero double"


def subset(rank: int, n: int, d: int) -> int:
    """The mask of the rank-th (from 0) of the d-subsets of n things: subsets without thing 0 come last."""
    mask = 0
    for i in range(n):
        if not d:
            break
        with_it = math.comb(n - i - 1, d - 1)
        if rank < with_it:
            mask, d = mask | 1 << i, d - 1
        else:
            rank -= with_it
    return mask


def drawn(total: int, most: int, seed: str) -> list[int]:
    """All numbers below total, or ``most`` of them, every set being as likely (Floyd's draws), in order."""
    if total <= most:
        return list(range(total))
    rnd, found = random.Random(seed), set()
    for top in range(total - most, total):
        pick = rnd.randrange(top + 1)
        found.add(top if pick in found else pick)
    return sorted(found)


def _dropped(most: int, seed: int):
    """Closed states of the ways drawn at each depth, equal ones of a graph and depth counted together."""

    def kernel(part: pa.RecordBatch) -> tuple[np.ndarray, dict[str, pa.Array]]:
        fixed, loose, up = (C._matrix(part.column(c)) for c in ("fixed", "loose", "pa"))
        depth, gid = part.column("d").to_pylist(), part.column("gid").to_pylist()
        mine = up & ~fixed
        g, i, j = steps(mine)
        begin = np.searchsorted(g, np.arange(len(depth) + 1))
        row, kept, count, totals = [], [], [], np.zeros(len(depth))
        for k, d in enumerate(depth):
            n = int(begin[k + 1] - begin[k])
            total = math.comb(n, d)
            totals[k] = total
            for rank in drawn(total, most, f"{seed}|{gid[k]}|{d}"):
                gone, left = subset(rank, n, d), mine[k].copy()
                for e in range(n):
                    if gone >> e & 1:
                        left[j[begin[k] + e]] &= ~C._bit(i[begin[k] + e])
                row.append(k)
                kept.append(left)
        row, kept = np.array(row, np.int64), np.array(kept, np.int64).reshape(len(row), up.shape[1])
        p, u, _ = C.close(fixed[row] | kept, loose[row] & ~(kept | C.transpose(kept)))
        _, first, count = np.unique(np.column_stack([row, p]), axis=0, return_index=True, return_counts=True)
        like = part.column("pa").take(pa.array(row[first]))
        return row[first], {"pa": C.lists_of(p[first], like), "nb": C.lists_of(u[first], like), "n": pa.array(count, pa.int64()), "n_subsets": pa.array(totals[row[first]], pa.float64())}

    return kernel


def _choose(n: np.ndarray, k: np.ndarray, kind: type) -> np.ndarray:
    """n over k; as int64 an error where it does not fit."""
    found, back = np.unique(n << 12 | k, return_inverse=True)
    return np.array([math.comb(c >> 12, c & 4095) for c in found.tolist()], kind)[back]


def _sums(g: np.ndarray, known: np.ndarray, lost: np.ndarray, free: np.ndarray, worst: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Graph and PROFILE of each shell, by graph and depth, from all states above the graphs' own, ``many`` alike in a row: the edges that the graph
    knows, those that the state lost, those of the rest that its others do not imply, and its worst bias."""
    each = known - lost - free + 1
    row = np.repeat(np.arange(len(g)), each)
    d = lost[row] + np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    order = np.lexsort((d, g[row]))
    row, d = row[order], d[order]
    first = np.flatnonzero((np.diff(g[row], prepend=-1) != 0) | (np.diff(d, prepend=-1) != 0))
    shell = row[first]
    # A way drops what the state lost, none that is free, and any of the edges that are implied.
    ways, b = _choose((known - lost - free)[row], d - lost[row], float) * many[row], worst[row]
    total = _choose(known[shell], d[first], float)
    if not np.allclose(np.add.reduceat(ways, first), total, rtol=1e-9, atol=0):
        raise ValueError("the ways to the states of a shell are not all the ways there are")
    least = np.minimum.reduceat(np.where(b > 0, b, np.inf), first)
    return g[shell], {
        "d": pa.array(d[first], pa.int32()), "n_subsets": pa.array(total), "n_evaluated": pa.array(_choose(known[shell], d[first], np.int64)),
        "n_states": pa.array(np.add.reduceat(many[row], first)), "mean": pa.array(np.add.reduceat(ways * b, first) / total), "se": pa.array(np.zeros(len(first))),
        "beta_up": pa.array(np.maximum.reduceat(b, first)), "min_nonzero": pa.array(np.where(np.isinf(least), 0.0, least)),
        "frac_nonzero": pa.array(np.add.reduceat(np.where(b > 0, ways, 0.0), first) / total),
    }


def _free(up: C.Masks, loose: C.Masks, fixed: C.Masks) -> C.Masks:
    """The known edges of states that their others do not imply."""
    return up & ~fixed & ~implied(up, loose)


def _count(masks: C.Masks) -> np.ndarray:
    return np.bitwise_count(masks).sum(axis=1, dtype=np.int64)


def _near(part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, dict[str, pa.Array]]]:
    """_sums() of the states of a batch that are few steps from the top, many graphs together."""
    fixed, up, loose = (C._matrix(part.column(c)) for c in ("fixed", "pa", "nb"))
    law, known = _law(part, up.shape[1]), _known(part)
    for own in pieces(known):
        g, p, u, lost, levels = own, up[own], loose[own], 0, []
        while len(g):
            free = _free(p, u, fixed[g])
            levels.append((g, np.full(len(g), lost), _count(free), _judged(p, u, law, g)[0]))
            at, i, j = steps(free)
            p, u = opened(p[at], u[at], i, j)
            first = distinct(g[at], p)
            g, p, u, lost = g[at][first], p[first], u[first], lost + 1
        g, depth, free, worst = (np.concatenate(c) for c in zip(*levels, strict=True))
        yield _sums(g, known[g], depth, free, worst, np.ones(len(g), np.int64))


def _by_levels(states: DataFrame) -> DataFrame:
    """gid and PROFILE where a state may have many above it: these are made level by level over all tasks, and states alike are counted together."""

    def kernel(part: pa.RecordBatch) -> tuple[None, dict[str, pa.Array]]:
        fixed, up, loose = (C._matrix(part.column(c)) for c in ("fixed", "pa", "nb"))
        return None, {"left": pa.array(_known(part)), "free": pa.array(_count(_free(up, loose, fixed)))}

    def sums(alike: pa.Table) -> pa.Table:
        left, free, lost, worst, n = (alike.column(c).to_numpy() for c in ("left", "free", "lost", "worst", "n"))
        rows, made = _sums(np.zeros(len(n), np.int64), left + lost, lost, free, worst, n)
        return pa.table({"gid": alike.column("gid").take(pa.array(rows)), **made})

    level, lost, found = states, 0, []
    while not level.isEmpty():
        judged = C.over_graphs(level, C.chained(kernel, _worst), "left long, free long, worst double")
        found.append(settle(judged.groupBy("gid", "left", "free", "worst").agg(F.count("*").alias("n")).withColumn("lost", F.lit(lost).cast("long"))))
        level, lost = settle(retract(level).select(*states.columns).dropDuplicates(["gid", "pa"])), lost + 1
    return reduce(DataFrame.union, found).groupBy("gid").applyInArrow(sums, f"gid {dict(states.dtypes)['gid']}, {PROFILE}")


def _whole(states: DataFrame) -> DataFrame:
    """mean_profile() of whole shells: those of a state that is few steps from the top in its batch, those of others over tables."""
    columns, made = ["gid", "labels", "fixed", "pa", "nb", "x", "y", "sigma", "theta"], [c.split()[0] for c in PROFILE.split(", ")]
    kinds = [{"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[c.split()[1]] for c in PROFILE.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C._slices(batches):
            for g, told in _near(part):
                own = [part.column("gid").take(pa.array(g)), *[pa.nulls(len(g), part.schema.field(c).type) for c in columns[1:]]]
                yield pa.RecordBatch.from_arrays([*own, *[told[c] for c in made]], names=[*columns, *made])
            far = part.filter(pa.array(_known(part) > MOST_STEPS))
            if far.num_rows:
                yield pa.RecordBatch.from_arrays([*far.columns, *[pa.nulls(far.num_rows, t) for t in kinds]], names=[*columns, *made])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in states.select(*columns).schema)
    told = settle(states.select(*columns).mapInArrow(work, f"{schema}, {PROFILE}"))
    near, far = told.filter("d is not null").select("gid", *made), told.filter("d is null").select(*columns)
    return near if far.isEmpty() else near.union(_by_levels(far))


def mean_profile(states: DataFrame, most: int | None = None, seed: int = 0) -> DataFrame:
    """gid, d and the distribution of the worst bias over the ways to drop d of the edges that knowledge directs: n_subsets (ways, as a
    double: there may be very many), n_evaluated, n_states, mean, se, beta_up (the greatest), min_nonzero (0 if all are 0) and frac_nonzero.

    states: gid, labels, fixed, loose, pa, nb, x, y, sigma, theta. Shells are whole, whatever their size (2^63 ways or more are an error, as
    n_evaluated does not hold them), and se is 0. Only with ``most`` a shell of more ways is sampled: beta_up is a lower bound then,
    and se, 0 for whole shells, is corrected for the share of the ways that was seen.
    """
    return _whole(states) if most is None else _sampled(states, most, seed)


def _sampled(states: DataFrame, most: int, seed: int) -> DataFrame:
    """mean_profile() from at most ``most`` ways of each shell."""
    law = states.select("gid", "x", "y", "sigma", "theta")
    edges = F.aggregate(F.arrays_zip("pa", "fixed"), F.lit(0), lambda acc, z: acc + F.bit_count(z["pa"]) - F.bit_count(z["fixed"]))
    depths = states.select("gid", "fixed", "loose", "pa").withColumn("d", F.explode(F.sequence(F.lit(0), edges)))
    # Dealt by graph and depth: a large shell is a row like any other, but long work.
    ways = C.over_graphs(depths.repartition("gid", "d"), _dropped(most, seed), "pa array<long>, nb array<long>, n long, n_subsets double")
    reached = settle(ways.select("gid", "d", "pa", "nb", "n", "n_subsets"))
    judged = worst_case_bias(reached.select("gid", "pa", "nb").dropDuplicates(["gid", "pa"]).join(law, "gid")).select("gid", "pa", "worst")
    each = reached.join(judged, ["gid", "pa"])
    b, n = F.col("worst"), F.col("n")
    sums = each.groupBy("gid", "d").agg(
        F.first("n_subsets").alias("n_subsets"), F.sum("n").alias("n_evaluated"), F.count("*").alias("n_states"), (F.sum(n * b) / F.sum("n")).alias("mean"),
        F.sum(n * b * b).alias("_squares"), F.max("worst").alias("beta_up"), F.coalesce(F.min(F.when(b > 0, b)), F.lit(0.0)).alias("min_nonzero"),
        (F.sum(F.when(b > 0, n).otherwise(0)) / F.sum("n")).alias("frac_nonzero"),
    )
    m = F.col("n_evaluated")
    variance = F.greatest(F.lit(0.0), (F.col("_squares") - m * F.col("mean") * F.col("mean")) / (m - 1))
    whole = (m >= F.col("n_subsets")) | (m < 2)
    return sums.withColumn("se", F.when(whole, 0.0).otherwise(F.sqrt(variance / m * F.greatest(F.lit(0.0), 1 - m / F.col("n_subsets"))))).select(
        "gid", "d", "n_subsets", "n_evaluated", "n_states", "mean", "se", "beta_up", "min_nonzero", "frac_nonzero"
    )


def mean_bounds(profile: DataFrame) -> DataFrame:
    """profile with lower and upper, between which a shell's mean lies: the share of ways with a bias times the least and the greatest one."""
    return profile.withColumns({"lower": F.col("frac_nonzero") * F.col("min_nonzero"), "upper": F.col("frac_nonzero") * F.col("beta_up")})


def mean_radius(profile: DataFrame, epsilon: float, z: float = 0.0) -> DataFrame:
    """gid, r_mean: the first depth at which the mean, plus z standard errors (z < 0: at least 0), exceeds epsilon; UNREACHED if none does."""
    bound = F.greatest(F.lit(0.0), F.col("mean") + F.lit(float(z)) * F.col("se"))
    return profile.groupBy("gid").agg(F.coalesce(F.min(F.when(bound > epsilon, F.col("d"))), F.lit(UNREACHED)).alias("r_mean"))
