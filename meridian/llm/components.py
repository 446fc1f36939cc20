"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Tables, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Join neighbours to the least node around u; large-star moves larger neighbours, small-star the others and u."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    around = both if large else both.filter("v < u")
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = around.join(least, "u")
    if large:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.filter("u != v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (its least node) for every node of links (a, b: long); nodes without links don't appear.

    Aggregates combine before the shuffle and joins may be split, so a hub of any degree is spread out.
    """
    tables = Tables(links.sparkSession)
    edges = tables.write(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        edges = tables.write(_star(_star(edges, large=True), large=False), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    heads = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = materialize(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(heads), "components")
    tables.drop()
    return found
