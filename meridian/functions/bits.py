"""Sets of nodes as bit masks, and graphs as arrays of masks.

A graph of up to 62 nodes is one row: ``labels`` (its nodes, ascending), and arrays of 64-bit masks
with one entry a node (``pa``: parents, ``nb``: neighbours by undirected edges). All functions here are
column expressions, so a population of graphs is worked on row by row, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Most nodes of a graph whose sets of nodes are 64-bit masks.
MOST_NODES = 62


def zero() -> Column:
    return F.lit(0).cast("long")


def bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))


def has(mask: Column, i: Column) -> Column:
    return F.call_function("shiftright", mask, i.cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1


def minus(a: Column, b: Column) -> Column:
    return a.bitwiseAND(F.bitwise_not(b))


def overlap(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b) != 0


def indices(masks: Column) -> Column:
    """0, 1, ... for the nodes of a graph that has at least one."""
    return F.sequence(F.lit(0), F.size(masks) - 1)


def union_over(mask: Column, masks: Column) -> Column:
    """Union of the masks of the nodes in mask."""
    return F.aggregate(indices(masks), zero(), lambda acc, j: F.when(has(mask, j), acc.bitwiseOR(F.get(masks, j))).otherwise(acc))


def transpose(masks: Column) -> Column:
    """Children from parents, and back."""
    return F.transform(
        indices(masks),
        lambda i: F.aggregate(indices(masks), zero(), lambda acc, j: F.when(has(F.get(masks, j), i), acc.bitwiseOR(bit(j))).otherwise(acc)),
    )


def closure(masks: Column) -> Column:
    """Transitive closure: after each step paths of twice the length are covered."""
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(F.size(masks) + 1)).cast("int")))
    return F.aggregate(steps, masks, lambda acc, _: F.transform(acc, lambda m: m.bitwiseOR(union_over(m, acc))))


def reach(start: Column, masks: Column, blocked: Column) -> Column:
    """Nodes that walks along masks reach from start without entering blocked; start included."""
    return F.aggregate(
        indices(masks), start, lambda acc, _: acc.bitwiseOR(minus(union_over(acc, masks), blocked))
    )


def members(mask: Column, labels: Column) -> Column:
    """Labels of the nodes in mask, ascending."""
    return F.filter(labels, lambda _, i: has(mask, i))


def count(mask: Column) -> Column:
    return F.bit_count(mask)
