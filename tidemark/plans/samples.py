"""Made-up data, and Python functions applied in parallel."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ship


def correlated_2d(spark: SparkSession, means: Sequence[tuple[float, float]], deviations: Sequence[tuple[float, float]], correlations: Sequence[float], sizes: Sequence[int], seed: int = 0) -> DataFrame:
    """(mode, x, y): normal points of several modes with a correlation each."""
    parts = []
    for k, (m, s, r, n) in enumerate(zip(means, deviations, correlations, sizes, strict=True)):
        z = spark.range(n).select(F.randn(2 * k + seed).alias("a"), F.randn(2 * k + 1 + seed + 1_000_003).alias("b"))
        y = m[1] + s[1] * (r * F.col("a") + (1 - r * r) ** 0.5 * F.col("b"))
        parts.append(z.select(F.lit(k).alias("mode"), (m[0] + s[0] * F.col("a")).alias("x"), y.alias("y")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def log_uniform(low: float = 1, high: float = 100, seed: int = 0) -> Column:
    """Random numbers whose logarithms are spread evenly."""
    return low * F.exp(F.rand(seed) * float(np.log(high / low)))


def map_items(spark: SparkSession, f: Callable[[Any], Any], items: Iterable[Any], partitions: int | None = None) -> list:
    """f of each item, in order: one row an item, spread over the executors. Items and results pass through the driver, so they should be small."""
    rows = [(i, bytearray(cloudpickle.dumps(x))) for i, x in enumerate(items)]
    if not rows:
        return []

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"i": part["i"], "out": [cloudpickle.dumps(f(cloudpickle.loads(bytes(x)))) for x in part["item"]]})

    ship(spark)
    asked = spark.createDataFrame(rows, "i long, item binary").repartition(partitions or len(rows), "i")
    return [cloudpickle.loads(bytes(r["out"])) for r in asked.mapInPandas(run, "i long, out binary").orderBy("i").collect()]


def map_vectors(df: DataFrame, vector: str, f: Callable[[np.ndarray], np.ndarray], out: str) -> DataFrame:
    """Adds f of each row's vector, in Arrow batches."""

    @F.pandas_udf("array<double>")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else np.asarray(f(np.asarray(r, float)), float) for r in rows])

    ship(df.sparkSession)
    return df.withColumn(out, run(F.col(vector)))
