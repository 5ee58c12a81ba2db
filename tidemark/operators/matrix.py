"""Matrices in long form (i, j, v): products, similarity, sparse algebra, tensors, clusters, polygons and paths."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def long_form(df: DataFrame, i: str, vector: str) -> DataFrame:
    return df.select(F.col(i).alias("i"), F.posexplode(vector).alias("j", "v")).withColumn("v", F.col("v").cast("double"))


def gram(x: DataFrame) -> DataFrame:
    """Raw second moments of the columns: (j, k, v) = sum over rows of x_j x_k."""
    return x.join(x.select("i", F.col("j").alias("k"), F.col("v").alias("w")), "i").groupBy("j", "k").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def gram_of_vectors(df: DataFrame, vector: str) -> DataFrame:
    """Column moments straight from array rows: each row gives its width ** 2 products to a partial sum, without a join."""
    x = F.transform(vector, lambda a: a.cast("double"))
    rows = df.select(x.alias("x")).select("x", F.posexplode("x").alias("j", "a")).select("j", "a", F.posexplode("x").alias("k", "b"))
    return rows.groupBy("j", "k").agg(F.sum(F.col("a") * F.col("b")).alias("v"), F.covar_samp("a", "b").alias("cov"), F.corr("a", "b").alias("corr"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, k, v) of A @ B for A (i, j, v) and B (j, k, v)."""
    return a.select("i", "j", F.col("v").alias("_a")).join(b.select("j", "k", F.col("v").alias("_b")), "j").groupBy("i", "k").agg(F.sum(F.col("_a") * F.col("_b")).alias("v"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)))


def angle(a: Column, b: Column, degrees: bool = False) -> Column:
    r = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(a, b))))
    return F.degrees(r) if degrees else r


def top_k(pairs: DataFrame, k: int) -> DataFrame:
    """The k smallest of each row i, ties to the smaller j."""
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("v", "j"))).where(F.col("rank") <= k)


def mask(x: DataFrame, by: DataFrame) -> DataFrame:
    return x.join(by.where("v <> 0").select("i", "j"), ["i", "j"], "left_semi")


def merge(parts: Sequence[DataFrame], order: str = "part") -> DataFrame:
    """Union of blocks (i, j, v); of a repeated cell the first block's value stays."""
    out = parts[0].withColumn(order, F.lit(0))
    for n, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn(order, F.lit(n)))
    return out.groupBy("i", "j").agg(F.min(F.struct(order, "v")).alias("m")).select("i", "j", F.col("m.v").alias("v"))


def roll(x: DataFrame, by: int, size: int, axis: str = "i") -> DataFrame:
    return x.withColumn(axis, F.pmod(F.col(axis) + by, F.lit(size)))


def diagonal(x: DataFrame) -> DataFrame:
    return x.where("i = j")


def off_diagonal(x: DataFrame) -> DataFrame:
    return x.where("i <> j")


def permute(x: DataFrame) -> DataFrame:
    return x.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def unravel(flat: Column, shape: Sequence[int]) -> Column:
    out, rest = [], flat
    for n in reversed(shape):
        out.append(F.pmod(rest, F.lit(n)))
        rest = F.floor(rest / n)
    return F.array(*reversed(out))


def cluster_similarity(s: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, mean, high, low) between clusters from (i, j, v) and (i, c): mean and max leave out self pairs; a missing pair counts 0."""
    size = labels.groupBy("c").agg(F.count("*").alias("n"))
    got = s.join(labels.select("i", F.col("c").alias("a")), "i").join(labels.select(F.col("i").alias("j"), F.col("c").alias("b")), "j")
    own = F.col("i") != F.col("j")
    got = got.groupBy("a", "b").agg(F.sum(F.when(own, F.col("v"))).alias("t"), F.max(F.when(own, F.col("v"))).alias("high"), F.min("v").alias("least"), F.count_if(F.col("v") != 0).alias("m"))
    return _between(got, size)


def _between(got: DataFrame, size: DataFrame) -> DataFrame:
    got = got.join(size.select(F.col("c").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("c").alias("b"), F.col("n").alias("nb")), "b")
    same = (F.col("a") == F.col("b")).cast("int")
    cells = F.col("na") * F.col("nb")
    return got.select("a", "b", F.try_divide("t", F.nullif(cells - same * F.col("na"), F.lit(0))).alias("mean"), F.coalesce("high", F.lit(0.0)).alias("high"),
                      F.when(F.col("m") < cells, 0.0).otherwise(F.col("least")).alias("low"))


#: Vectors of one side of a block product, and rows of it that are multiplied at once.
BLOCK, STRIP = 2048, 512


def block_products(v: DataFrame, i: str, vector: str, run: Callable, schema: str, block: int = BLOCK, *more: str) -> DataFrame:
    """Every vector against every vector: the tables of ``run(x, y)`` for each two blocks, of which y is x itself or another one.

    Vectors are dealt to blocks by the hash of their id and moved once; each task of a product of the blocks' partitions
    reads the few blocks of two of them, so nothing but the result grows with the square of the rows. ``x`` and ``y``:
    (ids, matrix, columns of ``more``), by ascending id. Rows with a null id or vector take no part.
    """
    rows = v.where(F.col(i).isNotNull() & F.col(vector).isNotNull()).select(F.col(i).cast("long").alias("i"), F.col(vector).alias("x"), *more)
    n = max(1, -(-rows.count() // block))
    dealt = rows.withColumn("p", F.pmod(F.xxhash64("i"), F.lit(n)).cast("int")).repartition(n, "p")
    left = dealt.groupBy("p").agg(F.collect_list(F.struct("i", "x", *more)).alias("a"))
    pairs = left.hint("shuffle_replicate_nl").join(left.select(F.col("p").alias("q"), F.col("a").alias("b")).hint("shuffle_replicate_nl"), F.col("p") <= F.col("q"))

    def side(block: pa.Array) -> tuple:
        got = pa.Table.from_struct_array(block.flatten()).sort_by("i").combine_chunks()
        x = got.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(got), -1)
        return got.column("i").to_numpy(), x, *(got.column(c).to_numpy() for c in more)

    def products(batches):
        for batch in batches:
            for k in range(len(batch)):
                x, y = (side(batch.column(c).slice(k, 1)) for c in "ab")
                for t in run(x, y):
                    yield from t.to_batches()

    return pairs.select("a", "b").mapInArrow(products, schema)


def cosines(v: DataFrame, i: str, vector: str, block: int = BLOCK) -> DataFrame:
    """(a, b, cosine) of all pairs a < b; null where a vector is zero."""

    def run(x, y):
        unit = [m / np.where(n := np.sqrt((m * m).sum(axis=1, keepdims=True)), n, np.nan) for m in (x[1], y[1])]
        same = np.array_equal(x[0], y[0])
        for at in range(0, len(x[0]), STRIP):
            a, b = np.meshgrid(x[0][at : at + STRIP], y[0], indexing="ij")
            keep = a < b if same else np.ones(a.shape, bool)
            a, b, c = a[keep], b[keep], (unit[0][at : at + STRIP] @ unit[1].T)[keep]
            yield pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "cosine": pa.array(c, mask=np.isnan(c))})

    return block_products(v, i, vector, run, "a long, b long, cosine double", block)


def nearest_by_dot(v: DataFrame, i: str, vector: str, k: int, block: int = BLOCK) -> DataFrame:
    """(i, j, rank): the k vectors of largest product with each vector, itself excepted; ties to the smaller j."""

    def best(x, y):
        for at in range(0, len(x[0]), STRIP):
            ids = x[0][at : at + STRIP]
            s = np.round(-(x[1][at : at + STRIP] @ y[1].T), 9)
            s[ids[:, None] == y[0][None]] = np.inf
            last = np.partition(s, k - 1, axis=1)[:, k - 1 : k] if s.shape[1] > k else np.inf
            r, c = np.nonzero((s <= last) & np.isfinite(s))
            order = np.lexsort((c, s[r, c], r))
            r, c = r[order], c[order]
            first = np.arange(len(r)) - np.searchsorted(r, r) < k
            yield ids[r[first]], y[0][c[first]], s[r[first], c[first]]

    def run(x, y):
        found = [*best(x, y), *([] if np.array_equal(x[0], y[0]) else best(y, x))]
        a, b, s = (np.concatenate(c) for c in zip(*found, strict=True)) if found else ([], [], [])
        yield pa.table({"i": pa.array(a, pa.int64()), "j": pa.array(b, pa.int64()), "v": pa.array(s, pa.float64())})

    return top_k(block_products(v, i, vector, run, "i long, j long, v double", block), k).select("i", "j", "rank")


def cluster_similarity_of_vectors(v: DataFrame, i: str, vector: str, label: str, block: int = BLOCK) -> DataFrame:
    """``cluster_similarity`` of all products of vectors, rounded to 6 places; labels are whole numbers. No pair leaves its block."""

    def run(x, y):
        (la, ra), (lb, rb) = (np.unique(m[2], return_inverse=True) for m in (x, y))
        order, same = np.argsort(rb, kind="stable"), np.array_equal(x[0], y[0])
        ids, z, starts = y[0][order], y[1][order], np.searchsorted(rb[order], np.arange(len(lb)))
        t, high, least, m = np.zeros((len(la), len(lb))), np.full((len(la), len(lb)), -np.inf), np.full((len(la), len(lb)), np.inf), np.zeros((len(la), len(lb)), np.int64)
        for at in range(0, len(x[0]) if len(lb) else 0, STRIP):
            r = ra[at : at + STRIP]
            s = np.round(x[1][at : at + STRIP] @ z.T, 6)
            np.minimum.at(least, r, np.minimum.reduceat(s, starts, axis=1))
            np.add.at(m, r, np.add.reduceat((s != 0).astype(np.int64), starts, axis=1))
            own = x[0][at : at + STRIP, None] == ids[None]
            np.maximum.at(high, r, np.maximum.reduceat(np.where(own, -np.inf, s), starts, axis=1))
            np.add.at(t, r, np.add.reduceat(np.where(own, 0.0, s), starts, axis=1))
        a, b = (g.ravel() for g in np.meshgrid(la, lb, indexing="ij"))
        part = [a, b, t.ravel(), high.ravel(), least.ravel(), m.ravel()]
        if not same:
            part = [np.concatenate(c) for c in zip(part, [b, a, *part[2:]], strict=True)]
        names = ("a", "b", "t", "high", "least", "m")
        yield pa.table([pa.array(c, pa.int64() if n in "abm" else pa.float64(), mask=~np.isfinite(c)) for n, c in zip(names, part, strict=True)], names=list(names))

    v = v.where(F.col(label).isNotNull())
    size = v.groupBy(F.col(label).cast("long").alias("c")).agg(F.count("*").alias("n"))
    got = block_products(v.withColumn("_c", F.col(label).cast("long")), i, vector, run, "a long, b long, t double, high double, least double, m long", block, "_c")
    got = got.groupBy("a", "b").agg(F.sum("t").alias("t"), F.max("high").alias("high"), F.min("least").alias("least"), F.sum("m").alias("m"))
    return _between(got, size)


def orthogonalise(df: DataFrame, keys: Sequence[str], v1: str, v2: str) -> DataFrame:
    """Residual of v1 after its projection on v2, both centred, with the explained share, by group."""
    fit = df.groupBy(*keys).agg(F.regr_slope(v1, v2).alias("_b"), F.avg(v1).alias("_m1"), F.avg(v2).alias("_m2"), F.pow(F.corr(v1, v2), 2).alias("evr"))
    return df.join(fit, list(keys)).withColumn("residual", F.col(v1) - F.col("_m1") - F.coalesce("_b", F.lit(0.0)) * (F.col(v2) - F.col("_m2"))).drop("_b", "_m1", "_m2")


def projection(df: DataFrame, keys: Sequence[str], v1: str, v2: str) -> DataFrame:
    """The score of v1 along v2 by group."""
    return df.groupBy(*keys).agg(F.try_divide(F.sum(F.col(v1) * F.col(v2)), F.nullif(F.sqrt(F.sum(F.col(v2) * F.col(v2))), F.lit(0.0))).alias("score"))


def from_factors(factors: DataFrame, modes: int = 3, weights: DataFrame | None = None) -> DataFrame:
    """Dense tensor (i0, i1, ..., v) of CP factors (mode, idx, r, v)."""
    out = factors.where("mode = 0").select("r", F.col("idx").alias("i0"), F.col("v").alias("p"))
    for m in range(1, modes):
        out = out.join(factors.where(F.col("mode") == m).select("r", F.col("idx").alias(f"i{m}"), F.col("v").alias("_q")), "r").withColumn("p", F.col("p") * F.col("_q")).drop("_q")
    out = out if weights is None else out.join(weights.select("r", F.col("v").alias("_w")), "r").withColumn("p", F.col("p") * F.col("_w"))
    return out.groupBy(*(f"i{m}" for m in range(modes))).agg(F.sum("p").alias("v"))


def edges_of(polygon: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    return [(*a, *b) for a, b in zip(polygon, [*polygon[1:], polygon[0]], strict=True)]


def in_polygon(x: Column, y: Column, polygon: Sequence[tuple[float, float]], eps: float = 1e-9, boundary: bool = True) -> Column:
    """Ray casting with the boundary, ``eps`` wide, inside: one expression over the polygon's edges, so points are never joined or moved.

    Without ``boundary`` the casting alone decides, by which points on a left or lower edge are inside and those on others
    outside. A null place is outside.
    """
    odd, on = F.lit(False), F.lit(False)
    for x1, y1, x2, y2 in edges_of(polygon):
        cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
        length = ((x2 - x1) ** 2 + (y2 - y1) ** 2) ** 0.5 or 1.0
        on = on | ((F.abs(cross) <= eps * length) & x.between(min(x1, x2) - eps, max(x1, x2) + eps) & y.between(min(y1, y2) - eps, max(y1, y2) + eps))
        if y1 != y2:
            meets = ((y < y1) != (y < y2)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            odd = odd != F.coalesce(meets, F.lit(False))
    return F.coalesce(on, F.lit(False)) | odd if boundary else odd


def polygon_distance(x: Column, y: Column, polygon: Sequence[tuple[float, float]]) -> Column:
    """Distance to the nearest point of the polygon's edges."""
    far = []
    for x1, y1, x2, y2 in edges_of(polygon):
        length = (x2 - x1) ** 2 + (y2 - y1) ** 2
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / length)) if length else F.lit(0.0)
        far.append(F.hypot(x - x1 - t * (x2 - x1), y - y1 - t * (y2 - y1)))
    return F.least(*far) if len(far) > 1 else far[0]


def within_polygons(points: DataFrame, corners: DataFrame, x: str, y: str, cell: float, eps: float = 1e-9, boundary: bool = True) -> DataFrame:
    """Each point with every polygon (column ``poly``) it lies in, by the rules of ``in_polygon``; points with a null or NaN place have none.

    ``corners``: (poly, k, px, py) in the order of k. Points and polygons meet in the cells, ``cell`` wide, that a polygon's
    bounds touch; there its edges, carried along as one array, are cast. A polygon is the unit of memory.
    """
    w = Window.partitionBy("poly").orderBy("k")
    last = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = {"x2": F.coalesce(F.lead("px").over(w), F.first("px").over(last)), "y2": F.coalesce(F.lead("py").over(w), F.first("py").over(last))}
    edge = F.struct(F.col("px").alias("x1"), F.col("py").alias("y1"), "x2", "y2")
    bounds = [f("p" + c).alias(n + c) for c in "xy" for n, f in (("lo_", F.min), ("hi_", F.max))]
    shapes = corners.withColumns(ends).groupBy("poly").agg(F.collect_list(edge).alias("_edges"), *bounds)
    at = lambda c: F.floor(c / cell)
    for c in "xy":
        shapes = shapes.withColumn(f"_c{c}", F.explode(F.sequence(at(F.col(f"lo_{c}") - eps), at(F.col(f"hi_{c}") + eps))))
    px, py = F.col(x), F.col(y)
    usable = px.isNotNull() & py.isNotNull() & ~F.isnan(px) & ~F.isnan(py)
    met = points.where(usable).withColumns({"_cx": at(px), "_cy": at(py)}).join(shapes, ["_cx", "_cy"])
    met = met.where(px.between(F.col("lo_x") - eps, F.col("hi_x") + eps) & py.between(F.col("lo_y") - eps, F.col("hi_y") + eps))

    def on(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        off = F.abs(dx * (py - e["y1"]) - dy * (px - e["x1"])) <= eps * F.greatest(F.hypot(dx, dy), F.lit(eps))
        inside = lambda v, a, b: v.between(F.least(a, b) - eps, F.greatest(a, b) + eps)
        return off & inside(px, e["x1"], e["x2"]) & inside(py, e["y1"], e["y2"])

    def crosses(e: Column) -> Column:
        return ((py < e["y1"]) != (py < e["y2"])) & (px < (e["x2"] - e["x1"]) * F.try_divide(py - e["y1"], e["y2"] - e["y1"]) + e["x1"])

    odd = F.size(F.filter("_edges", crosses)) % 2 == 1
    held = met.where(F.exists("_edges", on) | odd if boundary else odd)
    return held.select(*points.columns, "poly")


def paths(edges: DataFrame) -> DataFrame:
    """All paths from roots to leaves of (parent, child), as arrays; a recursive query, so the graph must have no cycle."""
    view, spark = f"edges_{uuid.uuid4().hex}", edges.sparkSession
    edges.select("parent", "child").createOrReplaceTempView(view)
    heads = edges.join(edges.select(F.col("child").alias("parent")).distinct(), "parent", "left_anti")
    heads.select("parent", "child").createOrReplaceTempView(f"{view}_heads")
    found = spark.sql(f"""
        with recursive p(path, tip) as (
          select array(parent, child), child from {view}_heads
          union all select array_append(p.path, e.child), e.child from p join {view} e on e.parent = p.tip)
        select path, tip from p""")
    return found.join(edges.select(F.col("parent").alias("tip")).distinct(), "tip", "left_anti").select("path")


def times(x: DataFrame, dense: DataFrame) -> DataFrame:
    """The cells of a sparse matrix times those of another; cells the other hasn't are zero and left out."""
    return x.join(dense.select("i", "j", F.col("v").alias("_w")), ["i", "j"]).select("i", "j", (F.col("v") * F.col("_w")).alias("v"))


def filled(x: DataFrame, height: int, width: int, value: float = 0.0) -> DataFrame:
    """All cells of a matrix, with a value for those it hasn't; made by rows, so the result is as large as asked."""
    rows = x.sparkSession.range(height).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))).alias("j"))
    return rows.join(x, ["i", "j"], "left").withColumn("v", F.coalesce("v", F.lit(float(value))))


def assignment(score: np.ndarray) -> np.ndarray:
    """For each row of a small matrix its column, all different, such that the scores add up to the most: shortest augmenting paths."""
    if score.shape[0] > score.shape[1]:
        back, out = assignment(score.T), np.full(score.shape[0], -1)
        out[back] = np.arange(score.shape[1])
        return out
    cost = score.max(initial=0) - score
    n, m = cost.shape
    row_price, column_price, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for r in range(n):
        far, came, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        at, base, column = r, 0.0, -1
        while True:
            new = base + cost[at] - row_price[at] - column_price
            better = ~done & (new < far)
            far[better], came[better] = new[better], column
            column = int(np.where(done, np.inf, far).argmin())
            base = far[column]
            done[column] = True
            if owner[column] < 0:
                break
            at = owner[column]
        used = done & (owner >= 0)
        row_price[owner[used]] += base - far[used]
        row_price[r] += base
        column_price[done] -= base - far[done]
        while column >= 0:
            before = came[column]
            owner[column] = owner[before] if before >= 0 else r
            column = before
    out = np.full(n, -1)
    out[owner[owner >= 0]] = np.flatnonzero(owner >= 0)
    return out


def best_permutation(a: DataFrame, b: DataFrame, kind: str = "pearson", most: int = 2000) -> list[tuple[int, int, float]]:
    """(column of a, column of b, similarity): the matching of the columns of two matrices (i, j, v) with the largest sum of products.

    The table of products, columns by columns, is collected, so more than ``most`` columns are an error. ``kind``: pearson or cosine.
    """
    met = a.select("i", F.col("j").alias("p"), F.col("v").alias("x")).join(b.select("i", F.col("j").alias("q"), F.col("v").alias("y")), "i")
    if max(a.select("j").distinct().count(), b.select("j").distinct().count()) > most:
        raise ValueError("too many columns to match")
    cosine_of = F.try_divide(F.sum(F.col("x") * F.col("y")), F.nullif(F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y"))), F.lit(0.0)))
    rows = met.groupBy("p", "q").agg(F.sum(F.col("x") * F.col("y")).alias("dot"), (F.corr("x", "y") if kind == "pearson" else cosine_of).alias("s")).collect()
    ps, qs = sorted({r["p"] for r in rows}), sorted({r["q"] for r in rows})
    dot = np.zeros((len(ps), len(qs)))
    like = {}
    for r in rows:
        dot[ps.index(r["p"]), qs.index(r["q"])] = r["dot"]
        like[r["p"], r["q"]] = r["s"]
    return [(ps[i], qs[k], like.get((ps[i], qs[k]))) for i, k in enumerate(assignment(dot)) if k >= 0]


def point_density(df: DataFrame, x: str, y: str, bins: tuple[int, int] = (1024, 1024), sigma: float = 1.0, bounds: tuple[tuple[float, float], tuple[float, float]] | None = None, eps: float = 1e-12, out: str = "density") -> DataFrame:
    """Adds a binned kernel density: counts by cell, blurred by a Gaussian of ``sigma`` cells (edge cells go on outside), read bilinearly at each point.

    Cells and the kernel are joined, so the work follows the cells that hold points. Points outside the bounds count in no cell and read the edge.
    """
    if bounds is None:
        r = df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
        bounds = ((r[0], r[1]), (r[2], r[3]))
    spark = df.sparkSession

    def weights(n: int) -> DataFrame:
        reach = int(4 * sigma + 0.5)
        w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
        w /= w.sum()
        rows: dict[tuple[int, int], float] = {}
        for t in range(n):
            for k in range(-reach, reach + 1):
                s = min(max(t + k, 0), n - 1)
                rows[t, s] = rows.get((t, s), 0.0) + float(w[k + reach])
        return spark.createDataFrame([(t, s, v) for (t, s), v in rows.items()], "t long, s long, w double")  # bins times the kernel's width

    cell = {}
    for name, (lo, hi), n in (("cx", bounds[0], bins[0]), ("cy", bounds[1], bins[1])):
        c = F.col(x if name == "cx" else y)
        cell[name] = F.when((c >= lo) & (c <= hi), F.least(F.floor((c - lo) / ((hi - lo) or 1) * n), F.lit(n - 1)))
    grid = df.select(cell["cx"].alias("cx"), cell["cy"].alias("cy")).where("cx is not null and cy is not null").groupBy("cx", "cy").agg(F.count("*").alias("n"))
    for name, n in (("cx", bins[0]), ("cy", bins[1])):
        other = "cy" if name == "cx" else "cx"
        grid = grid.join(F.broadcast(weights(n)), F.col(name) == F.col("s")).groupBy(F.col("t").alias(name), other).agg(F.sum(F.col("n") * F.col("w")).alias("n"))
    place = lambda c, lo, hi, n: F.greatest(F.lit(0.0), F.least(F.lit(float(n - 1)), (F.col(c) - lo) / (hi - lo + eps) * (n - 1)))
    points = df.withColumn("_row", F.monotonically_increasing_id())
    at = points.select("_row", place(x, *bounds[0], bins[0]).alias("px"), place(y, *bounds[1], bins[1]).alias("py"))
    fx, fy = F.floor("px"), F.floor("py")
    corners = F.explode(F.array(*(F.struct((fx + a).alias("cx"), (fy + b).alias("cy"), ((F.col("px") - fx if a else 1 - F.col("px") + fx) * (F.col("py") - fy if b else 1 - F.col("py") + fy)).alias("w")) for a in (0, 1) for b in (0, 1))))
    read = at.select("_row", corners.alias("c")).select("_row", "c.*").join(grid, ["cx", "cy"]).groupBy("_row").agg(F.sum(F.col("w") * F.col("n")).alias(out))
    return points.join(read, "_row", "left").withColumn(out, F.coalesce(out, F.lit(0.0))).drop("_row")
