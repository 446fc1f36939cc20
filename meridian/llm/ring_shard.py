"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a ring; a document belongs to the first point clockwise of its
own hash. Each shard has a capacity; documents that find their shard full continue clockwise to the
next shard with room. Only the counts of the arcs between points travel to the driver (shards times
vnodes numbers, whatever the size of the corpus); the fill is simulated on them, and documents take
their planned places by their rank within the arc.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import rank_within

Plan = list[tuple[int, int, int, int, int]]


def ring(n_shards: int, vnodes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Points of the ring in ascending order (below 2^32) and the shard that owns each."""
    at = np.array([[xxhash.xxh64_intdigest(f"{s}/{v}", seed) >> 32 for v in range(vnodes)] for s in range(n_shards)])
    owner = np.repeat(np.arange(n_shards), vnodes)
    order = np.lexsort((owner, at.ravel()))
    return at.ravel()[order], owner[order]


def capacities(n: int, n_shards: int, slack: float) -> np.ndarray:
    """Without slack the capacities add up to n, so that counts end at most one apart."""
    if slack > 0:
        return np.full(n_shards, int(np.ceil((1 + slack) * n / n_shards)))
    return np.array([n // n_shards + (s < n % n_shards) for s in range(n_shards)])


def plan_fill(arc_counts: dict[int, int], owner: np.ndarray, room: np.ndarray) -> Plan:
    """Rows (arc, first rank, end rank, shard, first slot): who goes where.

    First every arc fills its own shard, clockwise; then what is left walks on clockwise.
    """
    room, used, plan = room.copy(), np.zeros(len(room), dtype=np.int64), []
    done: dict[int, int] = {}

    def put(arc: int, shard: int) -> None:
        take = min(arc_counts[arc] - done[arc], int(room[shard]))
        if take:
            plan.append((arc, done[arc], done[arc] + take, int(shard), int(used[shard])))
            done[arc] += take
            room[shard] -= take
            used[shard] += take

    for arc in sorted(arc_counts):
        done[arc] = 0
        put(arc, owner[arc])
    for arc in sorted(arc_counts):
        at = arc
        while done[arc] < arc_counts[arc]:
            at = (at + 1) % len(owner)
            put(arc, owner[at])
    return plan


def bounded_ring(docs: DataFrame, n_shards: int = 40, vnodes: int = 64, slack: float = 0.0, seed: int = 11) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 16), text_crc32, shard, slot (gapless from 0 in each shard).

    Null text counts as empty; a null doc_id has one place on the ring; repeated rows take a slot each;
    within an arc, documents are in the order of a hash, then of doc_id, text_crc32 and size. An empty table gives no rows.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    points, owner = ring(n_shards, vnodes, seed)
    shared = spark.sparkContext.broadcast(points)

    @F.pandas_udf("int")
    def arc_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at = shared.value
        for pos in batches:
            yield pd.Series(np.searchsorted(at, pos.to_numpy()) % len(at), dtype="int32")

    pos: Column = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 32)
    keyed = docs.select(
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        pos.alias("pos"),
        arc_of(pos).alias("arc"),
    )
    counts = {r["arc"]: r["count"] for r in keyed.groupBy("arc").count().collect()}  # n_shards * vnodes rows at most
    plan = plan_fill(counts, owner, capacities(sum(counts.values()), n_shards, slack))
    plan_df = spark.createDataFrame(plan, "arc int, lo long, hi long, shard int, slot0 long")
    ranked = rank_within(keyed, "arc", ["pos", "doc_id", "text_crc32", "size"])
    # The plan has at most 2 * n_shards * vnodes + n_shards rows: each step ends an arc or fills a shard.
    return ranked.join(
        F.broadcast(plan_df),
        (ranked["arc"] == plan_df["arc"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")),
    ).select("doc_id", "size", "text_crc32", "shard", (F.col("slot0") + F.col("rank") - F.col("lo")).alias("slot"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """The texts themselves, one folder a shard, in slot order."""
    (
        docs.join(placed.select("doc_id", "shard", "slot"), "doc_id")
        .repartition("shard")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
