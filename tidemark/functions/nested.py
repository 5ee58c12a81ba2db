"""Maps, structs and JSON: the operations on nested parameters, as column expressions."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_items(a: Column, b: Column) -> Column:
    """Entries that both maps have with the same value."""
    return F.map_filter(a, lambda k, v: F.map_contains_key(b, k) & F.element_at(b, k).eqNullSafe(v))


def differing_items(a: Column, b: Column) -> Column:
    """Entries of a whose key b has with another value."""
    return F.map_filter(a, lambda k, v: F.map_contains_key(b, k) & ~F.element_at(b, k).eqNullSafe(v))


def missing_keys(a: Column, b: Column) -> Column:
    """Keys that only one of the maps has."""
    x, y = F.map_keys(a), F.map_keys(b)
    return F.array_sort(F.array_union(F.array_except(x, y), F.array_except(y, x)))


def merged(a: Column, b: Column) -> Column:
    """All entries; b's value where both have the key."""
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def inverted(m: Column) -> Column:
    return F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(e["value"], e["key"])))


def map_values(m: Column, f) -> Column:
    return F.transform_values(m, lambda k, v: f(v))


def flattened(df: DataFrame, separator: str = ".") -> DataFrame:
    """Nested struct fields as columns of dotted names."""
    out: list[Column] = []

    def walk(schema: StructType, path: tuple[str, ...]) -> None:
        for f in schema:
            at = (*path, f.name)
            if isinstance(f.dataType, StructType):
                walk(f.dataType, at)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in at)).alias(separator.join(at)))

    walk(df.schema, ())
    return df.select(*out)


def with_key(struct: Column, path: str, value: Column) -> Column:
    return struct.withField(path, value)


def find_keys(df: DataFrame, pattern: str) -> list[str]:
    """Dotted names of the leaves that match the pattern."""
    import re

    return [c for c in flattened(df).columns if re.search(pattern, c)]


def changing(df: DataFrame, params: Column) -> DataFrame:
    """(key, n_values, changes) over all rows' parameter maps."""
    each = df.select(F.explode(params).alias("key", "value"))
    return each.groupBy("key").agg(F.count_distinct("value").alias("n_values"), (F.count_distinct("value") > 1).alias("changes"))


def grid(spark: SparkSession, space: dict[str, list]) -> DataFrame:
    """One row for each combination of the listed values."""
    return spark.createDataFrame([tuple(p) for p in product(*space.values())], list(space))


def flat(values: Column, depth: int) -> Column:
    """An array of arrays, ``depth`` levels deep, as one array."""
    for _ in range(depth - 1):
        values = F.flatten(values)
    return values
