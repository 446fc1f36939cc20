"""Populations of causal graphs derived from the order tables.

Every order is a graph: its nodes are its distinct line numbers, and nodes u < v are joined by an edge
u -> v where a hash of order and nodes says so. Graphs are acyclic by construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits as B

#: Share of the node pairs that are edges, in percent.
DENSITY = 45


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_percent(*parts: Column) -> Column:
    """0 to 99, from the first four hexadecimal digits of the md5 of the parts."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 4), 16, 10).cast("long") % 100).cast("int")


def node_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gid, labels: the sorted nodes of each graph. The only shuffle that a population needs."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("gid"), F.col("l_linenumber").cast("int").alias("v"))
    # Rows are short and what is done with them is long: joined to the usual sizes, a million graphs would be one task. A number keeps them apart.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    lines = lines.repartition(tasks, "gid")
    return lines.groupBy("gid").agg(F.array_sort(F.collect_set("v")).alias("labels")).withColumn("labels", _fitting("labels"))


def dags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gid, labels, pa: the population, a row a graph."""
    label = lambda i: F.get("labels", i)
    parents = F.transform(
        "labels",
        lambda v, j: F.aggregate(
            F.sequence(F.lit(0), F.size("labels") - 1),
            B.zero(),
            lambda acc, i: F.when((i < j) & (hash_percent(F.col("gid"), label(i), v) < DENSITY), acc.bitwiseOR(B.bit(i))).otherwise(acc),
        ),
    )
    return node_lists(spark, sf_dir).withColumn("pa", parents)


def _fitting(labels: str) -> Column:
    """labels; more than masks hold are an error, as they would be lost without one."""
    told = F.concat(F.lit("a graph has "), F.size(labels).cast("string"), F.lit(f" nodes; sets of nodes are masks of {B.MOST_NODES} at most"))
    return F.when(F.size(labels) > B.MOST_NODES, F.raise_error(told)).otherwise(F.col(labels))


def pack(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Graphs (gid, labels, pa, nb) from rows gid, a, b, kind ('d': a -> b, 'u': a - b) and gid, v."""
    labels = nodes.groupBy("gid").agg(F.array_sort(F.collect_set("v")).alias("labels")).withColumn("labels", _fitting("labels"))
    lists = edges.groupBy("gid").agg(F.collect_set(F.struct("a", "b", "kind")).alias("edges"))
    joined = labels.join(lists, "gid", "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<struct<a:int,b:int,kind:string>>")))

    def masks(keep):
        return F.transform(
            "labels",
            lambda v, _: F.aggregate(
                F.filter("edges", lambda e: keep(e, v)),
                B.zero(),
                lambda acc, e: acc.bitwiseOR(B.bit(F.array_position("labels", F.when(e["b"] == v, e["a"]).otherwise(e["b"])) - 1)),
            ),
        )

    parents = masks(lambda e, v: (e["kind"] == "d") & (e["b"] == v))
    neighbours = masks(lambda e, v: (e["kind"] == "u") & ((e["a"] == v) | (e["b"] == v)))
    return joined.select("gid", "labels", parents.alias("pa"), neighbours.alias("nb"))


def edge_rows(graphs: DataFrame) -> DataFrame:
    """gid, a, b, kind: back to one row an edge; undirected edges once, a < b."""

    def listed(masks: str, kind: str) -> Column:
        def into(m: Column, j: Column) -> Column:
            tails = F.filter(B.indices(F.col("labels")), lambda i: B.has(m, i) & ((F.lit(kind) == "d") | (i < j)))
            return F.transform(tails, lambda i: F.struct(F.get("labels", i).alias("a"), F.get("labels", j).alias("b"), F.lit(kind).alias("kind")))

        return F.flatten(F.transform(masks, into))

    found = F.concat(listed("pa", "d"), listed("nb", "u")) if "nb" in graphs.columns else listed("pa", "d")
    return graphs.select("gid", F.explode(found).alias("e")).select("gid", "e.a", "e.b", "e.kind")


def models(graphs: DataFrame) -> DataFrame:
    """graphs (gid, labels, pa) with a linear model each: weights, a row of parents' coefficients for every node (0 where no edge is), and
    noise, a variance for every node. Hashes decide sign and size: coefficients from 0.3 to 1.5, variances from 0.5 to 1.5."""
    digest = lambda *parts: F.md5(F.concat_ws("|", *parts))
    unit = lambda d: F.conv(F.substring(d, 1, 4), 16, 10).cast("double") / F.lit(65537.0)  # a prime, so no number ends on a digit
    sign = lambda d: F.when(F.substring(d, 5, 1) < "8", F.lit(-1.0)).otherwise(F.lit(1.0))

    def weight(u: Column, v: Column) -> Column:
        d = digest(F.col("gid"), u, v, F.lit("w"))
        return sign(d) * (F.lit(0.3) + unit(d) * F.lit(1.2))

    rows = F.transform("labels", lambda v, j: F.transform("labels", lambda u, i: F.when(B.has(F.get("pa", j), i), weight(u, v)).otherwise(F.lit(0.0))))
    noise = F.transform("labels", lambda v: F.lit(0.5) + unit(digest(F.col("gid"), v, F.lit("n"))))
    return graphs.withColumn("weights", F.flatten(rows)).withColumn("noise", noise)
