"""Session factory with the settings the operators expect."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def session(master: str = "local[8]", partitions: int = 8, **conf: str) -> SparkSession:
    """ANSI mode, UTC, adaptive execution and skew handling; further settings by name."""
    base = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.shuffle.partitions": str(partitions), "spark.ui.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.driver.memory": "8g",
    }
    spark = SparkSession.builder.master(master).config(map=base | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Lets Python workers that share this file system import the package; elsewhere it comes with --py-files."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(":")
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = ":".join([ROOT, *filter(None, paths)])
