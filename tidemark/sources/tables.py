"""Reading, writing and cataloguing: thin over Spark's own sources, with the safe defaults (no overwriting)."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ship


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True) if schema is not None else spark.read.json(path, multiLine=True)


def write_json(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def write_parquet(df: DataFrame, path: str, overwrite: bool = False, by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy(*by).parquet(path)


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def find_paths(spark: SparkSession, root: str, pattern: str = "*", recursive: bool = True, name_matches: str | None = None) -> DataFrame:
    """(path, name, size, modified) of files, from a listing on the executors."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(root)
    out = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return out if name_matches is None else out.where(F.col("name").rlike(name_matches))


def natural_order(name: Column) -> list[Column]:
    """Sort keys by which img2 comes before img10."""
    return [F.regexp_replace(name, r"\d+", ""), F.nullif(F.regexp_extract(name, r"(\d+)", 1), F.lit("")).try_cast("long"), name]


def hash_files(spark: SparkSession, root: str, kind: str = "MD5") -> DataFrame:
    content = F.col("content")
    digest = {"MD5": F.md5(content), "SHA1": F.sha1(content), "SHA256": F.sha2(content, 256), "SHA512": F.sha2(content, 512)}[kind]
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", digest.alias("hash"))


def compare_hashes(expected: DataFrame, found: DataFrame, on: str = "name") -> DataFrame:
    """(name, expected, found, same) of a full outer join; same is false where either is absent."""
    both = expected.select(on, F.col("hash").alias("expected")).join(found.select(on, F.col("hash").alias("found")), on, "full_outer")
    return both.withColumn("same", F.coalesce(F.col("expected") == F.col("found"), F.lit(False)))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key it hasn't."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def jdbc_table(spark: SparkSession, url: str, table: str, limit: int | None = None, **options: str) -> DataFrame:
    df = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return df if limit is None else df.limit(limit)


def databases(spark: SparkSession) -> DataFrame:
    return spark.sql("show databases")


def tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    return spark.sql("show tables" + (f" in `{database}`" if database else ""))


def columns(spark: SparkSession, table: str) -> DataFrame:
    return spark.sql(f"describe table {table}")


def create_table(spark: SparkSession, name: str, schema: dict[str, str]) -> None:
    spark.sql(f"create table `{name}` ({', '.join(f'`{c}` {t}' for c, t in schema.items())}) using parquet")


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"drop table if exists `{name}`")


def create_database(spark: SparkSession, name: str) -> None:
    spark.sql(f"create database if not exists `{name}`")


def drop_database(spark: SparkSession, name: str) -> None:
    spark.sql(f"drop database if exists `{name}` cascade")


def parse_url(url: Column) -> Column:
    """Dialect, user, host, port and database of a connection URL; missing parts are null."""
    part = lambda g: F.nullif(F.regexp_extract(url, r"^([\w+]+)://(?:([^:@/]*)(?::([^@/]*))?@)?([^:/?]*)(?::(\d+))?(?:/([^?]*))?", g), F.lit(""))
    return F.struct(part(1).alias("dialect"), part(2).alias("user"), part(4).alias("host"), part(5).try_cast("int").alias("port"), part(6).alias("database"))


def read_arrays(spark: SparkSession, root: str, names: str = "*.npy") -> DataFrame:
    """(path, i, row): the rows of .npy files (``names`` is a glob) of one or two dimensions, decoded on the executors; a file is the unit of memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                a = a.reshape(len(a), -1) if a.ndim else a.reshape(1, 1)
                for lo in range(0, len(a), 4096):
                    part = a[lo : lo + 4096].astype(float)
                    yield pd.DataFrame({"path": path, "i": np.arange(lo, lo + len(part)), "row": list(part)})

    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", names).option("recursiveFileLookup", "true").load(root)
    return files.select("path", "content").mapInPandas(run, "path string, i long, row array<double>")


def read_archives(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, content): the files in .zip archives, unpacked on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if not name.endswith("/"):
                            yield pd.DataFrame({"path": [path], "name": [name], "content": [z.read(name)]})

    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(root)
    return files.select("path", "content").mapInPandas(run, "path string, name string, content binary")


def read_traces(spark: SparkSession, root: str) -> DataFrame:
    """(folder, roi, t, F, Fneu, spks, iscell): the traces of recordings, one folder each, whose arrays are F.npy, Fneu.npy,
    spks.npy (regions by times) and iscell.npy. What a folder doesn't have is null. A region's traces are the unit of memory;
    arrays of pickled objects are never read."""
    names = ("F", "Fneu", "spks", "iscell")
    rows = read_arrays(spark, root, "{F,Fneu,spks,iscell}.npy").select(
        F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", r"([^/]*)\.npy$", 1).alias("_name"), F.col("i").alias("roi"), "row")
    wide = rows.groupBy("folder", "roi").agg(*(F.any_value(F.when(F.col("_name") == n, F.col("row")), True).alias(n) for n in names))
    traces = F.posexplode(F.arrays_zip(*(F.coalesce(n, F.array().cast("array<double>")).alias(n) for n in names[:-1]))).alias("t", "_v")
    return wide.select("folder", "roi", F.get("iscell", F.lit(0)).alias("iscell"), traces).select("folder", "roi", "t", *(f"_v.{n}" for n in names[:-1]), "iscell")


def read_yaml(spark: SparkSession, root: str) -> DataFrame:
    """(path, value): YAML files as JSON text, for ``parse_json`` and ``from_json``; only plain values are read, and
    files without a byte have no row. Needs PyYAML on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for b in batches:
            yield pd.DataFrame({"path": b["path"], "value": [json.dumps(yaml.safe_load(c), default=str) for c in b["content"]]})

    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{yaml,yml}").option("recursiveFileLookup", "true").load(root)
    return files.select("path", "content").mapInPandas(run, "path string, value string")
