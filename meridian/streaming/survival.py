"""Draws as a stream: windowed counts with late data, and a stopping rule for each instance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """window start, kind and count; events later than ``late`` behind the newest are dropped."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    events = events.withColumn(time, F.col(time).cast("timestamp"))  # a watermark needs a zoned time
    counted = events.withWatermark(time, late).groupBy(window.alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "kind", "n")


def stopping_rule(draws: DataFrame, half_width: float, least: int = 30) -> DataFrame:
    """instance, n, s, stopped as draws (instance, survived) arrive.

    An instance stops when the 95 % interval of its survival share (Wilson's) is no wider than twice
    ``half_width``; later draws of it are ignored. State is two counts and a flag for each instance.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, hits, stopped = state.get if state.exists else (0, 0, False)
        for batch in batches:
            if stopped:
                break
            runs = np.cumsum(batch["survived"].to_numpy().astype(np.int64))
            ns, z = n + np.arange(1, len(runs) + 1), 1.96
            p = (hits + runs) / ns
            wide = z * np.sqrt((p * (1 - p) + z * z / (4 * ns)) / ns) / (1 + z * z / ns)
            ends = np.flatnonzero((ns >= least) & (wide <= half_width))
            last = int(ends[0]) if len(ends) else len(runs) - 1
            if last >= 0:
                n, hits, stopped = int(ns[last]), hits + int(runs[last]), bool(len(ends))
        state.update((n, hits, bool(stopped)))
        yield pd.DataFrame({"instance": [key[0]], "n": [n], "s": [hits / n if n else None], "stopped": [bool(stopped)]})

    return draws.groupBy("instance").applyInPandasWithState(
        update, "instance long, n long, s double, stopped boolean", "n long, hits long, stopped boolean", "update", "NoTimeout"
    )
