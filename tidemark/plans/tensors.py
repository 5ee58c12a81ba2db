"""Non-negative CP factors of sparse tensors in long form (i0, i1, ..., v).

The tensor stays distributed: a pass over it gives, for one mode, the products with the other modes' factors, summed by
index. Factors, one small matrix a mode, are on the driver, so the sizes of the modes are bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import ship

#: Numbers of all factors together.
MOST = 16_000_000


@dataclass
class Factors:
    """CP factors, a matrix (index, rank) a mode, and the explained share after each sweep."""

    matrices: list[np.ndarray]
    shares: list[float] = field(default_factory=list)

    def rows(self, df: DataFrame) -> DataFrame:
        """(mode, idx, r, v), as ``matrix.from_factors`` takes them."""
        out = [(m, i, r, float(a[i, r])) for m, a in enumerate(self.matrices) for i in range(a.shape[0]) for r in range(a.shape[1])]
        return df.sparkSession.createDataFrame(out, "mode int, idx long, r int, v double")


def _products(df: DataFrame, matrices: list[np.ndarray], mode: int, value: str) -> np.ndarray:
    """Sum over the tensor's cells of v times the other modes' rows, by index of one mode."""
    shared = df.sparkSession.sparkContext.broadcast(matrices)
    axes = [f"i{m}" for m in range(len(matrices))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shared.value[mode].shape)
        for b in batches:
            part = b[value].to_numpy(float)[:, None]
            for m, a in enumerate(axes):
                if m != mode:
                    part = part * shared.value[m][b[a].to_numpy(int)]
            np.add.at(total, b[axes[mode]].to_numpy(int), part)
        some = np.flatnonzero(total.any(axis=1))
        yield pd.DataFrame({"i": some, "row": total[some].tolist()})

    ship(df.sparkSession)
    each = df.select(*axes, value).mapInPandas(run, "i long, row array<double>").select("i", F.posexplode("row").alias("r", "v"))
    summed = each.groupBy("i", "r").agg(F.sum("v").alias("v")).groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda c: c["v"]).alias("row"))
    out = np.zeros(matrices[mode].shape)
    for r in summed.collect():
        out[r["i"]] = r["row"]
    return out


def fit(df: DataFrame, shape: tuple[int, ...], rank: int, sweeps: int = 20, value: str = "v", seed: int = 0, inner: int = 3) -> Factors:
    """Non-negative factors by hierarchical alternating least squares: each column of a mode in turn, from the products of one pass. Absent cells are zero."""
    if sum(shape) * rank > MOST:
        raise ValueError("the factors are too large for the driver")
    rng = np.random.default_rng(seed)
    out = Factors([rng.random((n, rank)) for n in shape])
    square = float(df.agg(F.sum(F.col(value) * F.col(value))).first()[0] or 0.0)
    for _ in range(sweeps):
        for mode, a in enumerate(out.matrices):
            found = _products(df, out.matrices, mode, value)
            cross = np.prod([m.T @ m for k, m in enumerate(out.matrices) if k != mode], axis=0)
            for _ in range(inner):
                for r in range(rank):
                    if cross[r, r] > 0:
                        a[:, r] = np.maximum(a[:, r] + (found[:, r] - a @ cross[:, r]) / cross[r, r], 0)
            if mode < len(shape) - 1:  # the last mode carries the scale
                norm = np.linalg.norm(a, axis=0)
                a /= np.where(norm > 0, norm, 1)
        model = float((cross * (a.T @ a)).sum())
        out.shares.append(1 - (square - 2 * float((found * a).sum()) + model) / square if square else 0.0)
    return out


def explained_variance(dense: DataFrame, model: DataFrame, modes: int, value: str = "v") -> DataFrame:
    """(explained): 1 - var(tensor - model) / var(tensor) over the cells of the dense tensor; cells the model hasn't count as 0."""
    axes = [f"i{m}" for m in range(modes)]
    both = dense.select(*axes, F.col(value).alias("x")).join(model.select(*axes, F.col("v").alias("y")), axes, "left")
    gap = F.col("x") - F.coalesce("y", F.lit(0.0))
    return both.agg((1 - F.try_divide(F.var_pop(gap), F.nullif(F.var_pop("x"), F.lit(0.0)))).alias("explained"))


def order_by_explained(dense: DataFrame, factors: DataFrame, modes: int, value: str = "v") -> DataFrame:
    """(r, explained, place): each rank-one part's share of the tensor's variance after its best scaling, the largest first.

    ``factors``: (mode, idx, r, v). A cell meets its own index's factor rows, so the parts are never made dense on their own.
    """
    part = dense.select(*(f"i{m}" for m in range(modes)), F.col(value).alias("x"))
    for m in range(modes):
        one = factors.where(F.col("mode") == m).select(F.col("idx").alias(f"i{m}"), "r", F.col("v").alias("_f"))
        part = part.join(one, [f"i{m}"] if m == 0 else [f"i{m}", "r"])
        part = part.withColumn("p", F.col("_f") if m == 0 else F.col("p") * F.col("_f")).drop("_f")
    share = part.groupBy("r").agg(F.coalesce(F.pow(F.corr("x", "p"), 2), F.lit(0.0)).alias("explained"))
    from pyspark.sql import Window

    return share.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("explained"), "r")) - 1)  # one row a rank
