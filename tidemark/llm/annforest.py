"""Approximate nearest neighbours by a hash-prefix forest (LSH Forest).

Each tree gives a vector a long string of hash bits: the sides of random hyperplanes through the sample's medians. A
tree is the sorted array of these strings. A query descends to its longest matching prefix in every tree and then
ascends in all trees at once, one bit at a time, until the prefixes hold enough vectors; these are its candidates, all
of them. Where even ROOT bits hold too few, it ascends to the empty prefix: the whole table. Distances are exact.

Vectors that are null, empty, zero, or that hold null or non-finite components take no part, neither as queries nor as
candidates. Vectors of different lengths have no distance: each length is a table of its own. Repeated ids count once,
with the smallest of their vectors. Equal distances go to the smaller id. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.spool import Spool

TREES, BITS, ROOT = 10, 32, 2
#: Vectors of one sorted array; a tree's cell of ROOT bits is dealt over as many arrays as that needs.
ARRAY = 4096
#: Entries over all trees at which ascending stops, as a share of the table. Vectors without any structure, like those
#: spread evenly over a sphere, need a large share for a recall of 0.9; clustered ones a small one.
SHARE = 1.3
#: Vectors a forest is fitted on, and lengths of vectors that get a forest, the most frequent first; of other lengths the whole table is searched.
SAMPLE, FORESTS = 20_000, 4
#: Queries that are compared with an array at once.
STRIP = 256


def usable(vector: Column) -> Column:
    value = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(value, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


class Forest:
    """Hyperplanes and thresholds, fitted on a bounded sample."""

    def __init__(self, sample: np.ndarray, trees: int, bits: int, seed: int = 7):
        self.trees, self.bits = trees, bits
        self.planes = np.random.default_rng(seed).normal(size=(sample.shape[1], trees * bits))
        self.cuts = np.median(sample @ self.planes, axis=0)

    def keys(self, x: np.ndarray) -> np.ndarray:
        """One integer of ``bits`` bits for each vector and tree, the first bit the highest."""
        side = (x @ self.planes > self.cuts).reshape(len(x), self.trees, self.bits)
        return side.astype(np.int64) @ (1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64))


def _counts(bits: int, root: int):
    """How many strings of the array share the first root..bits bits with each query."""

    def run(points: pa.Table, queries: pa.Table) -> pa.Table:
        keys = np.sort(points.column("key").to_numpy())
        mine = queries.column("key").to_numpy()
        levels = np.arange(bits - root, -1, -1)
        low = mine[:, None] >> levels << levels
        n = np.searchsorted(keys, low + (1 << levels)) - np.searchsorted(keys, low)
        return pa.table({"query_id": queries.column("query_id"), "n": pa.array(list(n.astype(np.int64)), pa.list_(pa.int64()))})

    return run


def _nearest(bits: int, k: int):
    """The k nearest of the array's vectors within each query's prefix; ties to the smaller id.

    Products of whole strips of queries with the array give distances that are right but for rounding; what may be
    among the k by these is measured again by differences.
    """

    def run(points: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if points.num_rows and queries.num_rows:
            order = np.argsort(points.column("key").to_numpy(), kind="stable")
            keys, ids = points.column("key").to_numpy()[order], points.column("vec_id").to_numpy()[order]
            x = _matrix(points.column("vector").combine_chunks(), len(order))[order]
            q = _matrix(queries.column("embedding").combine_chunks(), queries.num_rows)
            asked, key = queries.column("query_id").to_numpy(), queries.column("key").to_numpy()
            level = bits - queries.column("depth").to_numpy().astype(np.int64)
            lo = np.searchsorted(keys, key >> level << level)
            hi = np.searchsorted(keys, (key >> level) + 1 << level)
            norm, place = (x * x).sum(axis=1), np.arange(len(keys))
            for at in range(0, len(q), STRIP):
                v = q[at : at + STRIP]
                mine = (v * v).sum(axis=1)
                far = norm[None] - 2 * (v @ x.T) + mine[:, None]
                far[(place < lo[at : at + STRIP, None]) | (place >= hi[at : at + STRIP, None]) | (ids == asked[at : at + STRIP, None])] = np.inf
                last = np.partition(far, k - 1, axis=1)[:, k - 1] if far.shape[1] > k else np.full(len(v), np.inf)
                slack = 1e-9 * (mine + norm.max())
                r, c = np.nonzero((far <= (last + slack)[:, None]) & np.isfinite(far))
                exact = np.sqrt(((x[c] - v[r]) ** 2).sum(axis=1))
                best = np.lexsort((ids[c], exact, r))
                r, c, exact = r[best], c[best], exact[best]
                first = np.arange(len(r)) - np.searchsorted(r, r) < k
                out.append((asked[at + r[first]], ids[c[first]], exact[first]))
        a, b, c = (np.concatenate(z) for z in zip(*out, strict=True)) if out else ([], [], [])
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    return run


HIT = "query_id long, vec_id long, score double"
GROUP = ["tree", "cell", "salt"]


def _pair(points: DataFrame, queries: DataFrame, run, schema: str) -> DataFrame:
    return points.groupBy(*GROUP).cogroup(queries.groupBy(*GROUP)).applyInArrow(run, schema)


def _dealt(query: DataFrame, salts: int, *columns) -> DataFrame:
    """Every query goes to each of the salts its cell is dealt over."""
    return query.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt")).select(*columns)


def _searched_whole(rows: DataFrame, asked: DataFrame, most: int, k: int) -> DataFrame:
    """The k nearest in each array of the whole table, by length of the vectors: the empty prefix. ``most``: vectors of one length."""
    salts = max(1, -(-most // ARRAY))
    one = [F.lit(0).alias("tree"), F.size("embedding").cast("long").alias("cell")]
    zero = F.lit(0).cast("long").alias("key")
    points = rows.select(*one, F.pmod(F.xxhash64("vec_id"), F.lit(salts)).alias("salt"), zero, "vec_id", F.col("embedding").alias("vector"))
    queries = _dealt(asked.select(F.col("vec_id").alias("query_id"), "embedding"), salts, *one, "salt", zero, "query_id", "embedding", F.lit(0).alias("depth"))
    return _pair(points, queries, _nearest(BITS, k), HIT)


def _searched(spool: Spool, rows: DataFrame, width: int, n: int, k: int, trees: int, share: float) -> DataFrame:
    """Candidates by the forest for all vectors of one length."""
    spark = rows.sparkSession
    picked = rows.where(F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(1_000_000)) < min(1.0, SAMPLE / n) * 1_000_000).limit(2 * SAMPLE)
    sample = np.array([r["embedding"] for r in picked.select("embedding").collect()] or [[0.0] * width])
    forest = spark.sparkContext.broadcast(Forest(sample, trees, BITS))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = forest.value.keys(_matrix(batch.column(1), batch.num_rows)) if batch.num_rows else np.zeros((0, trees), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(keys), pa.list_(pa.int64()))], names=["vec_id", "embedding", "ask", "keys"])

    kind = dict(rows.dtypes)["embedding"]
    index = spool.cut(rows.mapInArrow(hashed, f"vec_id long, embedding {kind}, ask boolean, keys array<long>"), f"index{width}")
    salts = max(1, -(-n // (ARRAY << ROOT)))
    cell = F.shiftright("key", BITS - ROOT).alias("cell")
    points = index.select("vec_id", "embedding", F.posexplode("keys").alias("tree", "key")).select(
        "tree", cell, F.pmod(F.xxhash64("vec_id"), F.lit(salts)).alias("salt"), "key", "vec_id", F.col("embedding").alias("vector"))
    asked = index.where("ask").select(F.col("vec_id").alias("query_id"), "embedding", F.posexplode("keys").alias("tree", "key"))
    asked = _dealt(asked, salts, "tree", cell, "salt", "key", "query_id", "embedding")
    counts = _pair(points.drop("vector", "vec_id"), asked.drop("embedding"), _counts(BITS, ROOT), "query_id long, n array<long>")
    levels = counts.select("query_id", F.posexplode("n").alias("step", "n")).groupBy("query_id", "step").agg(F.sum("n").alias("n"))
    wanted = max(int(share * n), trees * (k + 1))  # a vector is at most one entry a tree, and the query is one of them
    deep = levels.where(F.col("n") >= wanted).groupBy("query_id").agg(F.max("step").alias("step"))
    depth = spool.cut(index.where("ask").select(F.col("vec_id").alias("query_id")).join(deep, "query_id", "left").select(
        "query_id", F.coalesce(F.col("step") + ROOT, F.lit(0)).cast("int").alias("depth")), f"depth{width}")
    found = _pair(points, asked.hint("merge").join(depth.where("depth > 0").hint("merge"), "query_id"), _nearest(BITS, k), HIT)
    wide = depth.where("depth = 0").select(F.col("query_id").alias("vec_id"))
    if wide.limit(1).count():
        found = found.unionByName(_searched_whole(index, index.where("ask").hint("merge").join(wide.hint("merge"), "vec_id"), n, k))
    return found


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, *, trees: int = TREES, share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row for which ``is_query`` holds, itself excepted.

    ``vectors``: (vec_id, embedding). Work in a group is bounded: a cell's array is dealt by id over as many salts as
    ARRAY needs, and its queries go to each of them. A query for which ROOT bits hold too few entries goes to the whole
    table, dealt likewise; k other vectors are thus found wherever the table has them.
    """
    spool = Spool(vectors.sparkSession)
    held = vectors.schema["embedding"].dataType
    single = getattr(held, "elementType", None) is not None and held.elementType.simpleString() == "float"
    vector = F.col("embedding") if single else F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("ask"))
    rows = spool.cut(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.max("ask").alias("ask")), "rows")
    sizes = [(r["w"], r["n"]) for r in rows.groupBy(F.size("embedding").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("w")).limit(FORESTS + 1).collect()]
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    parts = [_searched(spool, rows.where(F.size("embedding") == w), w, n, k, trees, share) for w, n in sizes[:FORESTS]]
    if len(sizes) > FORESTS:
        rest = rows.where(~F.size("embedding").isin([w for w, _ in sizes[:FORESTS]]))
        parts.append(_searched_whole(rest, rest.where("ask"), sizes[FORESTS][1], k))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
