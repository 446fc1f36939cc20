"""Families of random DAGs in which it is known what drives an answer: communities, hubs, two back-door routes, one open component.

A family takes one row a graph (gid and its sizes) and gives gid, labels (0, 1, ...) and pa beside what the row had. Draws are hashes of
gid and what is drawn, so a graph is the same wherever it is made, and making one needs no shuffle. Sizes out of range are errors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits as B
from .population import hash_percent


def drawn(*parts: Column) -> Column:
    """0 to 16,777,215, from the first six hexadecimal digits of the md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 6), 16, 10).cast("long")


def _percent(**shares: int) -> None:
    for name, share in shares.items():
        if not 0 <= share <= 100:
            raise ValueError(f"{name} is a share in percent, got {share}")


def _sized(rows: DataFrame, nodes: Column, fine: Column, told: str) -> DataFrame:
    """rows with labels; an error where a size is null, not fine, or more than masks hold."""
    checked = F.when(fine & (nodes >= 1) & (nodes <= B.MOST_NODES), nodes.cast("int")).otherwise(F.raise_error(told).cast("int"))
    return rows.withColumn("labels", F.sequence(F.lit(0), checked - 1))


def _any(nodes: Column) -> Column:
    """Mask of a list of nodes."""
    return F.aggregate(nodes, B.zero(), lambda acc, i: acc.bitwiseOR(B.bit(i)))


def _ordered(rows: DataFrame, links: Column) -> DataFrame:
    """rows with pa: links (masks of neighbours) directed along an order of the nodes that a hash draws for each graph."""
    keyed = rows.withColumns({"_links": links, "_key": F.transform("labels", lambda v: drawn(F.col("gid"), v, F.lit("o")))})
    rank = lambda v: F.struct(F.get("_key", v), v)
    parents = F.transform("_links", lambda m, j: _any(F.filter("labels", lambda i: B.has(m, i) & (rank(i) < rank(j)))))
    return keyed.withColumn("pa", parents).drop("_links", "_key")


def block(rows: DataFrame, blocks: int, within: int, between: int) -> DataFrame:
    """rows (gid, n) with DAGs of communities: node i is in block i mod ``blocks``; ``within`` and ``between`` percent of the pairs are edges."""
    if blocks < 1:
        raise ValueError(f"blocks is at least 1, got {blocks}")
    _percent(within=within, between=between)

    def linked(i: Column, j: Column) -> Column:
        low, high = F.least(i, j), F.greatest(i, j)
        return (i != j) & (hash_percent(F.col("gid"), low, high, F.lit("b")) < F.when(i % blocks == j % blocks, within).otherwise(between))

    sized = _sized(rows, F.col("n"), F.lit(True), f"a graph has 1 to {B.MOST_NODES} nodes")
    return _ordered(sized, F.transform("labels", lambda j: _any(F.filter("labels", lambda i: linked(i, j)))))


def scale_free(rows: DataFrame, attach: int) -> DataFrame:
    """rows (gid, n) with DAGs grown by preferential attachment: (n - attach) * attach edges.

    Each new node takes ``attach`` different earlier ones, drawn by degree: a place in the list of all ends of edges so far, without those
    taken already. ``attach`` is at least 1 and less than n.
    """
    if attach < 1:
        raise ValueError(f"attach is at least 1, got {attach}")
    sized = _sized(rows, F.col("n"), F.col("n") > attach, f"a graph has more than {attach} and at most {B.MOST_NODES} nodes")

    def joined(ends: Column, new: Column) -> Column:
        def one_more(taken: Column, k: Column) -> Column:
            pool = F.filter(ends, lambda v: ~F.array_contains(taken, v))
            return F.array_append(taken, F.get(pool, (drawn(F.col("gid"), new, k, F.lit("s")) % F.size(pool)).cast("int")))

        taken = F.aggregate(F.sequence(F.lit(0), F.lit(attach - 1)), F.array().cast("array<int>"), one_more)
        return F.concat(ends, F.flatten(F.transform(F.array_sort(taken), lambda v: F.array(v, new))))

    first = F.array(*[F.lit(v) for t in range(attach) for v in (t, attach)])
    grown = sized.withColumn("_ends", F.aggregate(F.filter("labels", lambda v: v > attach), first, joined))
    # Ends stand in pairs, the earlier node first.
    pairs = F.transform(F.sequence(F.lit(0), F.size("_ends") - 1, F.lit(2)), lambda k: F.array(F.get("_ends", k), F.get("_ends", k + 1)))
    paired = grown.withColumn("_pairs", pairs)
    met = lambda j: F.transform(F.filter("_pairs", lambda p: F.array_contains(p, j)), lambda p: F.when(p[0] == j, p[1]).otherwise(p[0]))
    return _ordered(paired, F.transform("labels", lambda j: _any(met(j)))).drop("_ends", "_pairs")


def decoupled(rows: DataFrame) -> DataFrame:
    """rows (gid, n, coupling) with two back-door routes from x to y through two chains of confounders, and places x and y.

    Nodes: 0 is x, 1 is y, 2 a cause of y alone (which settles x -> y), then the first chain and the second, of about equal length; the last
    of each causes x and y. The last but one of the first chain also causes the last round(coupling * length) nodes of the second: at 0 the
    chains are two open components of the CPDAG, at 1 one. n is 7 or more, coupling from 0 to 1.
    """
    fine = (F.col("n") >= 7) & F.col("coupling").between(0, 1)
    sized = _sized(rows, F.col("n"), fine, f"two chains need 7 to {B.MOST_NODES} nodes and a coupling from 0 to 1")
    begin = F.lit(3) + F.ceil((F.col("n") - 3) / 2).cast("int")  # of the second chain
    crossed = F.col("n") - F.bround(F.col("coupling") * (F.col("n") - begin)).cast("int")  # the first that the first chain causes
    split = sized.withColumns({"_begin": begin, "_crossed": crossed})
    both = B.bit(F.col("_begin") - 1).bitwiseOR(B.bit(F.col("n") - 1))

    def parents(v: Column) -> Column:
        before = F.when((v > 3) & (v != F.col("_begin")), B.bit(v - 1)).otherwise(B.zero())
        across = F.when((v >= F.col("_begin")) & (v >= F.col("_crossed")), B.bit(F.col("_begin") - 2)).otherwise(B.zero())
        ends = F.when(v == 0, both).when(v == 1, both.bitwiseOR(F.lit(0b101).cast("long")))
        return ends.when(v == 2, B.zero()).otherwise(before.bitwiseOR(across))

    return split.withColumns({"pa": F.transform("labels", parents), "x": F.lit(0), "y": F.lit(1)}).drop("_begin", "_crossed")


def component(rows: DataFrame, triangles: int) -> DataFrame:
    """rows (gid, size, separation) with one open component of ``size`` nodes that holds x, and places x and y.

    Nodes 0 to separation are a chain from an anchor to x; every further node of the component joins an earlier one and, ``triangles`` percent
    of the time, one of its neighbours, so no collider arises, all edges stay open in the CPDAG and x stays ``separation`` steps from the
    anchor. Then y, a child of x, of the anchor and of the last node, which has no other edge and so settles the edges into y.
    """
    _percent(triangles=triangles)
    fine = F.col("separation").between(1, F.col("size") - 1)
    sized = _sized(rows, F.col("size") + 2, fine, f"a component has a separation from 1 to its size less 1, and at most {B.MOST_NODES - 2} nodes")

    def joined(pa: Column, new: Column) -> Column:
        base = (drawn(F.col("gid"), new, F.lit("a")) % new).cast("int")
        near = F.filter(F.sequence(F.lit(0), new - 1), lambda i: B.has(F.get(pa, base), i) | B.has(F.get(pa, i), base))
        other = F.get(near, (drawn(F.col("gid"), new, F.lit("n")) % F.size(near)).cast("int"))
        triangle = hash_percent(F.col("gid"), new, F.lit("t")) < triangles
        return F.array_append(pa, B.bit(base).bitwiseOR(F.when(triangle, B.bit(other)).otherwise(B.zero())))

    chain = F.transform(F.sequence(F.lit(0), F.col("separation")), lambda j: F.when(j == 0, B.zero()).otherwise(B.bit(j - 1)))
    rest = F.filter("labels", lambda j: (j > F.col("separation")) & (j < F.col("size")))
    causes = reduce(lambda a, b: a.bitwiseOR(b), [B.bit(F.col("separation")), B.bit(F.lit(0)), B.bit(F.col("size") + 1)])
    grown = sized.withColumn("pa", F.concat(F.aggregate(rest, chain, joined), F.array(causes, B.zero())))
    return grown.withColumns({"x": F.col("separation").cast("int"), "y": F.col("size").cast("int")})
