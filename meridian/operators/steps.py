"""Single steps between knowledge states, on masks of many graphs at once."""

from __future__ import annotations

import numpy as np

from . import criterion as C


def implied(parents: C.Masks, open_: C.Masks) -> C.Masks:
    """For each node the parents whose edge to it the rest of a closed graph directs again, were it open."""
    children, n = C.transpose(parents), parents.shape[1]
    adj, out = parents | children | open_, np.zeros_like(parents)
    for j in range(n):
        far = ~(adj[:, j] | C._bit(j))
        for i in C._members(parents[:, j]):
            at = np.flatnonzero(C._has(parents[:, j], i))
            up, middle, apart = parents[at], open_[at, i] & parents[at, j], open_[at, i] & far[at]
            again = (up[:, i] & far[at] != 0) | (children[at, i] & up[:, j] != 0)
            for k in C._members(up[:, j]):
                again |= C._has(middle, k) & (middle & ~(adj[at, k] | C._bit(k)) != 0)
                again |= C._has(up[:, j], k) & (up[:, k] & apart != 0)
            out[at[again], j] |= C._bit(i)
    return out


def steps(free: C.Masks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Graph, tail and head of every edge in masks of parents, graph by graph."""
    found = [(at, np.full(len(at), i), np.full(len(at), j)) for j in range(free.shape[1]) for i in C._members(free[:, j]) if len(at := np.flatnonzero(C._has(free[:, j], i)))]
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    g, i, j = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(g, kind="stable")
    return g[order], i[order], j[order]


#: Steps up to the top of the states whose whole search is made in one place; others are searched shell by shell over all tasks.
MOST_STEPS = 12
#: States, at most, of the graphs that are searched together (of one graph, if it has more).
STATES = 1 << 17


def pieces(n_steps: np.ndarray) -> list[np.ndarray]:
    """Places of the graphs that are no more than MOST_STEPS steps from the top, in parts to be searched together: k steps have up to 2^k states."""
    few = np.flatnonzero(n_steps <= MOST_STEPS)
    begins = np.cumsum(1 << n_steps[few]) - (1 << n_steps[few])
    return np.split(few, np.flatnonzero(np.diff(begins // STATES)) + 1) if len(few) else []


def distinct(g: np.ndarray, up: C.Masks) -> np.ndarray:
    """Places of the first of equal rows, graph by graph."""
    n = up.shape[1]
    keys = [np.bitwise_or.reduce(up << (n * np.arange(n, dtype=np.int64)), axis=1)] if 0 < n <= 7 else list(up.T)
    order = np.lexsort([*keys, g])
    new = np.ones(len(g), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in (*keys, g)], axis=0)
    return order[new]


def opened(parents: C.Masks, open_: C.Masks, i: np.ndarray, j: np.ndarray) -> tuple[C.Masks, C.Masks]:
    """The graphs with edge i -> j, one a graph, open again."""
    up, loose, row = parents.copy(), open_.copy(), np.arange(len(i))
    up[row, j] &= ~C._bit(i)
    loose[row, j] |= C._bit(i)
    loose[row, i] |= C._bit(j)
    return up, loose
