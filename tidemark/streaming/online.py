"""Structured Streaming forms: event-time windows with a watermark, online moments by key, and mini-batch fits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import ship


def windowed(stream: DataFrame, at: str, value: str, keys: list[str], size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """n and total by window and keys; rows later than ``late`` behind the newest are dropped."""
    timed = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    window = F.window("_at", size, slide) if slide else F.window("_at", size)
    return timed.groupBy(window.alias("window"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(stream: DataFrame, at: str, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    timed = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(F.session_window("_at", gap).alias("window"), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def online_moments(stream: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, mean, m2) so far, updated by each batch: states merge by Chan's formula."""
    kind = dict(stream.dtypes)[key]

    def update(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
        for part in parts:
            x = part[value].dropna().to_numpy(float)
            if len(x):
                d, m = x.mean() - mean, n + len(x)
                m2 += ((x - x.mean()) ** 2).sum() + d * d * n * len(x) / m
                mean, n = mean + d * len(x) / m, m
        state.update((n, mean, m2))
        yield pd.DataFrame({key: [k[0]], "n": [n], "mean": [mean], "m2": [m2]})

    ship(stream.sparkSession)
    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n long, mean double, m2 double", "n long, mean double, m2 double", "update", "NoTimeout")


def partial_fit(stream: DataFrame, fit: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that hands each micro-batch to ``fit`` with its number; a batch may come again after a failure."""
    return stream.writeStream.foreachBatch(fit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
