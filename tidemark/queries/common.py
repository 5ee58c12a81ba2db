"""How queries are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Rounded to 6 places, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + 0.0


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, oracle: str | None = None):
        def keep(f: Callable[[SparkSession, str], DataFrame]):
            self.queries[f.__name__] = f
            if oracle:
                self.oracles[f.__name__] = oracle
            return f

        return keep
