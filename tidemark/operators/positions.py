"""Positions in a series and flags at positions: conversions, searches and look-ups."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.spec import SeriesSpec


def positions(df: DataFrame, spec: SeriesSpec, flag: Column) -> DataFrame:
    """(keys, t): 0-based positions of the true rows of each series."""
    return spec.indexed(df.withColumn("_b", F.coalesce(flag, F.lit(False)))).where("_b").select(*spec.keys, "t")


def flags(at: DataFrame, keys: Sequence[str], position: str, length: int | None = None) -> DataFrame:
    """(keys, t, flag): for every position below the length, or up to the largest one, whether it is in the list; missing positions are left out."""
    held = at.where(F.col(position).isNotNull() & ~F.isnan(F.col(position).cast("double"))).select(*keys, F.col(position).cast("long").alias("t")).distinct()
    end = F.lit(length) if length is not None else F.max("t") + 1
    every = held.groupBy(*keys).agg(end.cast("long").alias("_n")).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("t"))
    return every.join(held.withColumn("flag", F.lit(True)), [*keys, "t"], "left").withColumn("flag", F.coalesce("flag", F.lit(False)))


def nth_true(df: DataFrame, spec: SeriesSpec, flag: Column, n: int) -> DataFrame:
    """(keys, t): position of the n-th true row of each series, from 0, or from the end if negative; series with fewer have no row."""
    found = positions(df, spec, flag)
    order = SeriesSpec(spec.keys, ("t",))
    if n >= 0:
        return order.indexed(found, "_k").where(F.col("_k") == n).drop("_k")
    size = F.count("*").over(order.whole)
    return order.indexed(found.withColumn("_n", size), "_k").where(F.col("_k") == F.col("_n") + n).drop("_k", "_n")


def last_true(df: DataFrame, spec: SeriesSpec, flag: Column) -> DataFrame:
    return positions(df, spec, flag).groupBy(*spec.keys).agg(F.max("t").alias("t"))


def search(df: DataFrame, spec: SeriesSpec, wanted: DataFrame, value: str) -> DataFrame:
    """Adds to ``wanted`` the smallest position of its value in the series' sorted values, -1 where it isn't there: an equi-join instead of a search a value."""
    ranked = SeriesSpec(spec.keys, (spec.value, *spec.order)).indexed(df, "_t")
    held = ranked.groupBy(*spec.keys, F.col(spec.value).alias(value)).agg(F.min("_t").alias("position"))
    return wanted.join(held, [*spec.keys, value], "left").withColumn("position", F.coalesce("position", F.lit(-1)).cast("long"))


def take(values: DataFrame, spec: SeriesSpec, index: DataFrame, at: str) -> DataFrame:
    """Adds to ``index`` the series' value at a position; null where the position is null, NaN or outside."""
    held = spec.indexed(values, "_at").select(*spec.keys, "_at", F.col(spec.value).alias("taken"))
    whole = F.nanvl(F.col(at).cast("double"), F.lit(None).cast("double")).cast("long")
    return index.withColumn("_at", whole).join(held, [*spec.keys, "_at"], "left").drop("_at")


def path_between(previous: DataFrame, start: int, end: int, most: int = 9999) -> DataFrame:
    """(step, node) from start to end by (target, node, previous) rows of a shortest-path table, as a recursive query; a negative previous is none.

    Where there is no path, its last node isn't ``end``.
    """
    view = f"previous_{uuid.uuid4().hex}"
    previous.where((F.col("target") == end) & (F.col("previous") >= 0)).select("node", "previous").createOrReplaceTempView(view)
    return previous.sparkSession.sql(f"""
        with recursive walk(step, node) as (
          select 0, cast({int(start)} as bigint)
          union all select step + 1, cast(e.previous as bigint) from walk join {view} e on e.node = walk.node where walk.node <> {int(end)} and step < {int(most)})
        select step, node from walk""")


def sorted_positions(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """(keys, rank, t): the positions of each series in order of value, ties by position."""
    held = spec.indexed(df)
    return SeriesSpec(spec.keys, (spec.value, "t")).indexed(held, "rank").select(*spec.keys, "rank", "t")


def extreme_positions(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """(keys, argmin, argmax): positions of the least and largest value of each series, the first on ties."""
    held = spec.indexed(df).where(F.col(spec.value).isNotNull())
    v, t = F.col(spec.value), F.col("t")
    top = F.max(F.struct(v.alias("v"), (-t).alias("t")))["t"]
    return held.groupBy(*spec.keys).agg(F.min(F.struct(v.alias("v"), t.alias("t")))["t"].alias("argmin"), (-top).alias("argmax"))


def random_batches(df: DataFrame, size: int, seed: int = 0, *by: str) -> DataFrame:
    """Adds the batch of a row, by hash of the columns ``by`` (all by default): about ``size`` rows each, in no order, without moving a row."""
    n = max(1, -(-df.count() // size))
    return df.withColumn("batch", F.pmod(F.xxhash64(F.lit(seed), *(by or df.columns)), F.lit(n)))


def random_chunks(df: DataFrame, spec: SeriesSpec, size: int, seed: int = 0) -> DataFrame:
    """(keys, chunk, offset, value): whole consecutive chunks of each series, which begin at a place by the hash of its keys; their order is by hash, too."""
    part = spec.indexed(df.withColumn("_x", spec.x)).withColumns({"_n": F.count("*").over(spec.whole), "_s": F.pmod(F.xxhash64(F.lit(seed), *spec.keys), F.lit(size))})
    part = part.withColumn("_c", F.floor((F.col("t") - F.col("_s")) / size))
    whole = (F.col("t") >= F.col("_s")) & (F.col("_s") + (F.col("_c") + 1) * size <= F.col("_n"))
    return part.where(whole).select(*spec.keys, F.xxhash64(F.lit(seed + 1), *spec.keys, "_c").alias("chunk"), F.pmod(F.col("t") - F.col("_s"), F.lit(size)).alias("offset"), F.col("_x").alias("value"))
