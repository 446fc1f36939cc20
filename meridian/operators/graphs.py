"""Views of graphs: skeleton, degrees, orders, components, distances between graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits as B


def adjacency(df: DataFrame) -> Column:
    """Masks of all adjacent nodes, whatever the edge is."""
    children = B.transpose(F.col("pa"))
    both = F.transform(F.arrays_zip(F.col("pa").alias("p"), children.alias("c")), lambda z: z["p"].bitwiseOR(z["c"]))
    if "nb" not in df.columns:
        return both
    return F.transform(F.arrays_zip(both.alias("d"), F.col("nb").alias("u")), lambda z: z["d"].bitwiseOR(z["u"]))


def with_adjacency(df: DataFrame) -> DataFrame:
    return df.withColumn("adj", adjacency(df))


def skeleton(df: DataFrame) -> DataFrame:
    """gid, a, b with a < b for each pair of adjacent nodes."""
    pairs = F.flatten(
        F.transform(
            "adj",
            lambda m, j: F.transform(F.filter(B.indices(F.col("adj")), lambda i: B.has(m, i) & (i < j)), lambda i: F.struct(F.get("labels", i).alias("a"), F.get("labels", j).alias("b"))),
        )
    )
    return with_adjacency(df).select("gid", F.explode(pairs).alias("p")).select("gid", "p.a", "p.b")


def v_structures(df: DataFrame) -> DataFrame:
    """gid, a, m, b: a -> m <- b with a < b not adjacent."""
    idx = B.indices(F.col("pa"))
    triples = F.flatten(
        F.transform(
            "pa",
            lambda p, m: F.flatten(
                F.transform(
                    F.filter(idx, lambda a: B.has(p, a)),
                    lambda a: F.transform(
                        F.filter(idx, lambda b: B.has(p, b) & (a < b) & ~B.has(F.get("adj", a), b)),
                        lambda b: F.struct(F.get("labels", a).alias("a"), F.get("labels", m).alias("m"), F.get("labels", b).alias("b")),
                    ),
                )
            ),
        )
    )
    return with_adjacency(df).select("gid", F.explode(triples).alias("v")).select("gid", "v.a", "v.m", "v.b")


def moral_edges(df: DataFrame) -> DataFrame:
    """gid, a, b: the moral graph of a DAG, parents of a common child married."""
    idx = B.indices(F.col("pa"))
    married = F.aggregate("pa", F.col("adj"), lambda acc, p: F.transform(acc, lambda m, i: F.when(B.has(p, i), m.bitwiseOR(B.minus(p, B.bit(i)))).otherwise(m)))
    wed = with_adjacency(df).withColumn("moral", married)
    pairs = F.flatten(F.transform("moral", lambda m, j: F.transform(F.filter(idx, lambda i: B.has(m, i) & (i < j)), lambda i: F.struct(F.get("labels", i).alias("a"), F.get("labels", j).alias("b")))))
    return wed.select("gid", F.explode(pairs).alias("p")).select("gid", "p.a", "p.b")


def ancestors(df: DataFrame) -> DataFrame:
    """df with an (ancestors of each node) and de (descendants), nodes themselves excluded."""
    return df.withColumn("an", B.closure(F.col("pa"))).withColumn("de", B.transpose(F.col("an")))


def descendant_pairs(df: DataFrame) -> DataFrame:
    """gid, a, d for each node and each of its descendants."""
    pairs = F.flatten(F.transform("de", lambda m, i: F.transform(B.members(m, F.col("labels")), lambda d: F.struct(F.get("labels", i).alias("a"), d.alias("d")))))
    return ancestors(df).select("gid", F.explode(pairs).alias("p")).select("gid", "p.a", "p.d")


def acyclic(df: DataFrame) -> DataFrame:
    """gid, acyclic: no node is its own ancestor by directed edges."""
    return df.withColumn("an", B.closure(F.col("pa"))).select("gid", (~F.exists(F.transform("an", lambda m, i: B.has(m, i)), lambda x: x)).alias("acyclic"))


def depths(df: DataFrame) -> DataFrame:
    """gid, v, depth: edges of the longest directed path into each node of a DAG."""
    idx = B.indices(F.col("pa"))
    none = F.transform("pa", lambda _: F.lit(0))
    deeper = lambda acc, m: F.coalesce(F.array_max(F.transform(F.filter(idx, lambda i: B.has(m, i)), lambda i: F.get(acc, i) + 1)), F.lit(0))
    found = F.aggregate(idx, none, lambda acc, _: F.transform("pa", lambda m: deeper(acc, m)))
    return df.select("gid", F.explode(F.arrays_zip(F.col("labels").alias("v"), found.alias("depth"))).alias("z")).select("gid", "z.v", "z.depth")


def components(df: DataFrame) -> DataFrame:
    """gid, v, component: least node that undirected edges connect v with; nodes without such edges are left out."""
    spread = F.transform("nb", lambda m, i: B.reach(m.bitwiseOR(B.bit(i)), F.col("nb"), B.zero()))
    rows = F.arrays_zip(F.col("labels").alias("v"), F.col("nb").alias("m"), F.transform(spread, lambda m: F.element_at(B.members(m, F.col("labels")), 1)).alias("component"))
    return df.select("gid", F.explode(rows).alias("z")).filter("z.m != 0").select("gid", "z.v", "z.component")


def edge_string(df: DataFrame) -> Column:
    """One-line rendering 'a->b ... a-b ...', edges sorted; names a graph among those of the same nodes."""
    idx = B.indices(F.col("labels"))
    name = lambda i: F.get("labels", i).cast("string")

    def told(masks: str, sign: str, once: bool) -> Column:
        # Each mask is looked at for its own node only, and edges are sorted as pairs of places.
        tails = lambda m, j: F.filter(idx, lambda i: B.has(m, i) & (i < j)) if once else F.filter(idx, lambda i: B.has(m, i))
        heads = F.transform(masks, lambda m, j: F.transform(tails(m, j), lambda i: F.struct(i.alias("i"), j.alias("j"))))
        return F.transform(F.sort_array(F.flatten(heads)), lambda e: F.concat(name(e["i"]), F.lit(sign), name(e["j"])))

    parts = F.concat(told("pa", "->", False), told("nb", "-", True)) if "nb" in df.columns else told("pa", "->", False)
    return F.array_join(parts, " ")


def hamming(left: DataFrame, right: DataFrame) -> DataFrame:
    """gid, shd: pairs of nodes whose edge state (none, ->, <-, -) differs; graphs share labels."""
    l, r = (d.select("gid", *[F.col(c).alias(f"{c}_{s}") for c in ("pa", "nb", "labels")]) for d, s in ((left, "l"), (right, "r")))
    idx = F.sequence(F.lit(0), F.size("labels_l") - 1)
    differs = lambda s, i, j: B.has(F.get(f"{s}_l", j), i) != B.has(F.get(f"{s}_r", j), i)
    total = F.aggregate(
        idx,
        F.lit(0),
        lambda acc, j: acc + F.size(F.filter(idx, lambda i: (i < j) & (differs("pa", i, j) | differs("pa", j, i) | differs("nb", i, j)))),
    )
    return l.join(r, "gid").select("gid", total.alias("shd"))
