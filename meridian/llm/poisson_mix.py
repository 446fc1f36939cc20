"""Mixing sources to target weights by Poisson replication.

A source with share w of the wanted total T and size S is repeated at the rate w * T / S on average.
Each document gets a count by inverting the Poisson distribution of that mean at a number hashed from
the document and the seed, is exploded by its count, and the copies are shuffled over the whole corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, hash_uniform

#: Sources up to which the table of rates is broadcast (a name and two numbers each); beyond, it is joined by shuffle.
BROADCAST_SOURCES = 10_000


def poisson_count(rate: Column, u: Column) -> Column:
    """Least k with P(X <= k) > u: walks up from 0, or for a great rate from 12 deviations below it, where doubles begin to tell.

    Sums logarithms, so any rate will do; takes as many steps as k is over the start, with a few numbers in hand.
    """
    deviation = F.sqrt(rate)
    first = F.greatest(F.lit(0), F.floor(rate - 12 * deviation - 20)).cast("int")
    steps = F.sequence(first, F.ceil(rate + 12 * deviation + 20).cast("int"))
    log_rate = F.log(F.greatest(rate, F.lit(1e-300)))
    # log_p: that of the number that the next step adds; n: numbers whose distribution function is not over u.
    begin = F.struct((first * log_rate - rate - _log_factorial(first)).alias("log_p"), F.lit(0.0).cast("double").alias("c"), first.alias("n"))

    def step(acc: Column, k: Column) -> Column:
        c = acc["c"] + F.exp(acc["log_p"])
        return F.struct((acc["log_p"] + log_rate - F.log(k + F.lit(1.0))).alias("log_p"), c.alias("c"), (acc["n"] + (c <= u).cast("int")).alias("n"))

    return F.aggregate(steps, begin, step, lambda acc: acc["n"])


def _log_factorial(n: Column) -> Column:
    """By Stirling's series, which for n over 20 is exact to 1e-12 of its value; 0 for n = 0."""
    x = F.greatest(n, F.lit(1)).cast("double")
    series = x * F.log(x) - x + F.log(F.lit(2 * math.pi) * x) / 2 + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3.0)))
    return F.when(n == 0, F.lit(0.0)).otherwise(series)


def source_rates(docs: DataFrame, weights: dict[str, float] | None, temperature: float, total: float) -> DataFrame:
    """source, size and rate: a row for each source.

    Sizes are characters and one for each document. Without weights, shares are proportional to
    size ** temperature. A source that the weights leave out gets the rate 0.
    """
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long") + 1
    sizes = docs.groupBy("source").agg(F.sum(size).alias("size"))
    if weights is None:
        share = F.pow(F.col("size").cast("double"), F.lit(temperature))
    else:
        known = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.lit(None).cast("map<string,double>")
        share = F.coalesce(F.try_element_at(known, F.coalesce("source", F.lit(""))), F.lit(0.0)).cast("double")
    shared = sizes.withColumn("share", share)
    sums = shared.agg(F.sum("size").alias("all_size"), F.sum("share").alias("all_share"))
    rates = shared.crossJoin(F.broadcast(sums)).withColumn(  # one row of sums
        "rate",
        F.coalesce(F.try_divide(F.col("share") * F.col("all_size") * F.lit(total), F.col("all_share") * F.col("size")), F.lit(0.0)),
    )
    return rates.select("source", "size", "rate")


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, total: float = 1.0, seed: int = 5
) -> DataFrame:
    """All columns of docs and mix_rate, mix_copies, mix_copy (from 0), mix_key; a row for each copy, in shuffled order.

    total: wanted size of the result as a multiple of the input. The count hangs on doc_id, source and
    seed alone: repeated rows get the same count each. Null source is a source of its own (weighted as
    ''), null text has size 1, a null doc_id hashes as ''. Columns of docs that are called like the new
    ones are replaced. An empty table gives no rows.
    """
    docs = docs.drop("mix_rate", "mix_copies", "mix_copy", "mix_key")
    (name,) = fresh(docs, "rate_of")
    rates = source_rates(docs, weights, temperature, total).select(F.col("source").alias(name), F.col("rate").alias("mix_rate"))
    if docs.select(F.approx_count_distinct("source")).first()[0] <= BROADCAST_SOURCES // 2:
        rates = F.broadcast(rates)
    joined = docs.join(rates, docs["source"].eqNullSafe(rates[name])).drop(name)
    u = hash_uniform(docs["doc_id"], docs["source"], seed=seed)
    counted = joined.withColumn("mix_copies", poisson_count(F.col("mix_rate"), u))
    copies = counted.filter("mix_copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("mix_copies") - 1)))
    key = F.xxhash64("doc_id", "mix_copy", F.lit(seed))
    return copies.withColumn("mix_key", key).repartition("mix_key").sortWithinPartitions("mix_key")
