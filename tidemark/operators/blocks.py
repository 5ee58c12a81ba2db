"""Long series in blocks: positions without a task a series, and frames over blocks that carry their neighbours' edge rows.

A series with a third of all rows would be one task of a window on its keys. Here no task holds more than a cell or a block.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.spec import SeriesSpec


def long_positions(df: DataFrame, spec: SeriesSpec, cell: Column, out: str = "t") -> DataFrame:
    """Adds the 0-based position in the series, as ``SeriesSpec.indexed`` does.

    ``cell`` never falls along the order (the day of a time, a number over a width; null only where the first order column
    is). Rows are counted by cell, the counts before a cell summed in a table of one row a cell, and rows numbered within it.
    """
    part = df.withColumn("_cell", cell)
    keys = [*spec.keys, "_cell"]
    count = part.groupBy(*keys).agg(F.count("*").alias("_m"))
    before = Window.partitionBy(*spec.keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    count = count.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_base"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)))
    at = F.col("_base") + F.row_number().over(Window.partitionBy(*keys).orderBy(*spec.order)) - 1
    return part.join(count, same).withColumn(out, at.cast("long")).drop("_cell", "_base", *(f"_key{i}" for i in range(len(keys))))


def in_blocks(df: DataFrame, spec: SeriesSpec, size: int, before: int, after: int, run: Callable[[DataFrame, SeriesSpec], DataFrame], at: str = "t") -> DataFrame:
    """``run(part, spec)`` on blocks of ``size`` positions (column ``at``) of each series, for operators whose rows look at most
    ``before`` rows back and ``after`` rows on; they get the blocks as series.

    Blocks hold the rows that their own look at, which are left out of the result; (size + before + after) / size times the
    rows are shuffled. Rows with a null position are left out. ``run`` keeps the columns ``at`` and ``_block``.
    """
    if size < 1 or before < 0 or after < 0:
        raise ValueError("blocks need a size of 1 or more and reaches of 0 or more")
    block = lambda t: F.floor(t / size).cast("long")
    t = F.col(at)
    spread = df.where(t.isNotNull()).withColumn("_block", F.explode(F.sequence(block(F.greatest(t - after, F.lit(0))), block(t + before))))
    return run(spread, SeriesSpec((*spec.keys, "_block"), (at,), spec.value)).where(block(F.col(at)) == F.col("_block")).drop("_block")
