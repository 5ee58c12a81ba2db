"""Connected components by minimum-label propagation with pointer jumping, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.spool import Spool


def components(spool: Spool, edges: DataFrame, name: str) -> DataFrame:
    """``edges`` (a, b: long) to (id, comp), comp being the smallest id of the component; nodes without an edge have no row.

    Each round is two equi-joins and a partially aggregated minimum, so a hub's edges are split like any
    skewed join. Each round's labels are written, and the loop ends with the first that changes none.
    """
    both = edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).where("src <> dst")
    both = spool.cut(both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), f"{name}_both")
    labels = spool.cut(both.groupBy(F.col("src").alias("id")).agg(F.least("id", F.min("dst")).alias("comp")), f"{name}_0")
    turn = 0
    while True:
        turn += 1
        near = (
            both.join(labels.withColumnRenamed("id", "src"), "src")
            .groupBy(F.col("dst").alias("id")).agg(F.min("comp").alias("near"))
        )
        near = spool.cut(labels.join(near, "id").select("id", F.col("comp").alias("was"), F.least("comp", "near").alias("mid")), f"{name}_near{turn}")
        up = near.select(F.col("id").alias("mid"), F.col("mid").alias("top"))
        new = spool.cut(near.join(up, "mid").select("id", "was", F.least("mid", "top").alias("comp")), f"{name}_{turn}")
        changed = new.where("comp <> was").limit(1).count()
        spool.drop(f"{name}_near{turn}", f"{name}_{turn - 1}")
        labels = new.select("id", "comp")
        if not changed:
            spool.drop(f"{name}_both")
            return labels
