"""Fits: what is fitted is a small model from sufficient statistics; scoring is again a plan."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import ship

#: A k x k moment matrix is collected, so the number of features is bounded.
MOST_FEATURES = 4096


def fold_of(n: int, *group: str, seed: int = 0) -> Column:
    """A fold by hash of the group: the same under any partitioning, and groups are never split."""
    return F.pmod(F.xxhash64(F.lit(seed), *group), F.lit(n)).cast("int")


def group_of(index: Column, size: int) -> Column:
    return F.floor(index / size).cast("long")


@dataclass
class Moments:
    """n, means and centred second moments of vectors, from one partially aggregated pass."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray


def moments(df: DataFrame, vector: str) -> Moments:
    """Each partition sums its own products in numpy; the partial sums, one small row a partition and column, are added in Spark."""
    width = df.select(F.size(vector).alias("k")).limit(1).collect()
    k = width[0]["k"] if width else 0
    if k > MOST_FEATURES:
        raise ValueError("too many features for a collected moment matrix")

    def part(batches):
        n, s, ss = 0, np.zeros(k), np.zeros((k, k))
        for b in batches:
            x = np.array(b["v"].tolist(), float).reshape(-1, k)
            n, s, ss = n + len(x), s + x.sum(axis=0), ss + x.T @ x
        yield pd.DataFrame({"j": range(-1, k), "row": [np.append(s, n).tolist(), *np.column_stack([ss, np.zeros(k)]).tolist()]})

    ship(df.sparkSession)
    rows = df.select(F.col(vector).alias("v")).mapInPandas(part, "j int, row array<double>")
    at = rows.select("j", F.posexplode("row").alias("i", "v")).groupBy("j", "i").agg(F.sum("v").alias("v"))
    m = np.zeros((k + 1, k + 1))
    for r in at.groupBy("j").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda c: c["v"]).alias("row")).collect():
        m[r["j"] + 1] = r["row"]
    n = m[0, k]
    mean = m[0, :k] / max(n, 1)
    return Moments(int(n), mean, m[1:, :k] - n * np.outer(mean, mean))


def _mapped(df: DataFrame, vector: Column, rows: np.ndarray, out: str) -> DataFrame:
    """Adds the products of a vector with each row of a small matrix, as native expressions."""
    one = lambda w: F.aggregate(F.zip_with(F.col("_c"), F.lit(w.tolist()), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return df.withColumn("_c", vector).withColumn(out, F.array(*(one(w) for w in rows))).drop("_c")


def unmixed(components: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weight vectors, given for the first components, in the space of the features."""
    weights = weights[:, None] if weights.ndim == 1 else weights
    return components[:, : len(weights)] @ weights


@dataclass
class PrincipalComponents:
    mean: np.ndarray
    components: np.ndarray
    variance: np.ndarray
    ratio: np.ndarray

    def scores(self, df: DataFrame, vector: str, whiten: bool = False) -> DataFrame:
        """Adds ``scores`` from the stored mean, as native expressions."""
        c = self.components / (np.sqrt(self.variance)[:, None] if whiten else 1)
        return _mapped(df, F.zip_with(vector, F.lit(self.mean.tolist()), lambda a, b: a - b), c, "scores")

    def restored(self, df: DataFrame, scores: str = "scores", out: str = "restored") -> DataFrame:
        """The vectors that the scores stand for."""
        back = _mapped(df, F.col(scores), self.components.T, "_back")
        return back.withColumn(out, F.zip_with("_back", F.lit(self.mean.tolist()), lambda a, b: a + b)).drop("_back")

    def zca(self, df: DataFrame, vector: str, n: int, eps: float = 1e-5, out: str = "whitened") -> DataFrame:
        """ZCA whitening by the components over their singular values; ``n``: the rows the components were fitted on."""
        w = self.components.T / (np.sqrt(self.variance * (n - 1)) + eps) @ self.components
        return _mapped(df, F.zip_with(vector, F.lit(self.mean.tolist()), lambda a, b: a - b), w.T, out)


def pca(df: DataFrame, vector: str, k: int) -> PrincipalComponents:
    """Components with the largest loading positive, variances (n - 1) and explained shares."""
    return components_of(moments(df, vector), k)


def components_of(m: Moments, k: int) -> PrincipalComponents:
    values, vectors = np.linalg.eigh(m.scatter / max(m.n - 1, 1))
    order = np.argsort(values)[::-1]
    v = vectors[:, order].T
    v = v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(axis=1)])[:, None]
    values = np.maximum(values[order], 0)
    return PrincipalComponents(m.mean, v[:k], values[:k], values[:k] / max(values.sum(), 1e-300))


def merge_moments(a: Moments, b: Moments) -> Moments:
    """For mini-batch PCA: the moments of both parts together."""
    n = a.n + b.n
    d = b.mean - a.mean
    return Moments(n, a.mean + d * b.n / max(n, 1), a.scatter + b.scatter + np.outer(d, d) * a.n * b.n / max(n, 1))


def ridge_sweep(df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, alphas: Sequence[float], folds: int = 3, group: Sequence[str] = (), fold: Column | None = None) -> DataFrame:
    """(keys, alpha, fold, theta, intercept, ev_train, ev_test) for every group, fold and alpha, from one pass of sums by (keys, fold).

    Folds go by the hash of ``group`` unless ``fold``, an integer of each row, is given.
    """
    names = [*features, target]
    p = len(names)
    sums = [F.count("*").alias("n"), *(F.sum(c).alias(f"s_{i}") for i, c in enumerate(names)), *(F.sum(F.col(a) * F.col(b)).alias(f"q_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i)]
    part = df.withColumn("fold", fold_of(folds, *(group or names)) if fold is None else fold.cast("int")).groupBy(*keys, "fold").agg(*sums)
    key_fields = [df.schema[k] for k in keys]
    from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

    schema = StructType([*key_fields, StructField("alpha", DoubleType()), StructField("fold", IntegerType()), StructField("theta", ArrayType(DoubleType())), *(StructField(c, DoubleType()) for c in ("intercept", "ev_train", "ev_test"))])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        def total(rows):
            n = rows["n"].sum()
            s = np.array([rows[f"s_{i}"].sum() for i in range(p)])
            q = np.array([[rows[f"q_{min(i, j)}_{max(i, j)}"].sum() for j in range(p)] for i in range(p)])
            return n, s, q

        def ev(n, s, q, theta, b):
            e = np.append(-theta, 1.0)
            sse = e @ q @ e - 2 * b * (e @ s) + n * b * b
            sst = q[-1, -1] - s[-1] ** 2 / n
            return 1 - sse / sst if sst > 0 else np.nan

        out = []
        for fold in sorted(pdf["fold"]):
            train, test = pdf[pdf["fold"] != fold], pdf[pdf["fold"] == fold]
            n, s, q = total(train)
            if n == 0:
                continue
            m = s / n
            c = q - n * np.outer(m, m)
            for alpha in alphas:
                theta = np.linalg.lstsq(c[:-1, :-1] + alpha * np.eye(p - 1), c[:-1, -1], rcond=None)[0]
                b = m[-1] - theta @ m[:-1]
                out.append((*(pdf[k].iloc[0] for k in keys), float(alpha), int(fold), theta.tolist(), b, ev(n, s, q, theta, b), ev(*total(test), theta, b)))
        return pd.DataFrame(out, columns=schema.names)

    ship(df.sparkSession)
    return part.groupBy(*keys).applyInPandas(solve, schema)


def best_alpha(sweep: DataFrame, keys: Sequence[str]) -> DataFrame:
    mean = sweep.groupBy(*keys, "alpha").agg(F.avg("ev_test").alias("ev"))
    return mean.groupBy(*keys).agg(F.max(F.struct("ev", "alpha")).alias("m")).select(*keys, F.col("m.alpha").alias("alpha"), F.col("m.ev").alias("ev"))


#: Two sets of points are compared pair by pair where they have at most so many pairs.
PAIRS = 1 << 18


def _distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def within(a: np.ndarray, b: np.ndarray, eps: float) -> bool:
    """Whether a point of one set (rows of x, y) lies within eps of one of the other; halves of sets whose bounds are farther apart are left out."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        for _ in range(2 if len(a) and len(b) else 0):
            gap = np.maximum(np.maximum(b.min(axis=0) - a, a - b.max(axis=0)), 0)
            a, b = b, a[np.sqrt((gap * gap).sum(axis=1)) <= eps]
            if not len(b):
                break
        if not len(a) or not len(b):
            continue
        first = a[0] - b[0]
        if np.sqrt((first * first).sum()) <= eps:
            return True
        if len(a) * len(b) <= PAIRS:
            d = a[:, None] - b[None]
            if (np.sqrt((d * d).sum(axis=2)) <= eps).any():
                return True
            continue
        a, b = (a, b) if len(a) >= len(b) else (b, a)
        a = a[np.argsort(a[:, np.ptp(a, axis=0).argmax()], kind="stable")]
        todo += [(a[: len(a) // 2], b), (a[len(a) // 2 :], b)]
    return False


def _linked_cells(cells: DataFrame, spots: DataFrame, eps: float) -> DataFrame:
    """(a, b): nodes of ``cells`` (cx, cy, node, ends: four of its points, which reach its bounds) that have points within eps.

    Most pairs are settled by the bounds and these points; of the others the points that are near the other cell's
    bounds go to one group, in which halves of them are left out by their bounds again. A cell is the unit of memory.
    """
    bound = lambda side, c, f: f(*(F.col(f"{side}.ends")[k][c] for k in range(4)))
    bounds = lambda side: F.struct(*(bound(side, c, f).alias(n + c) for c in "xy" for n, f in (("lo_", F.least), ("hi_", F.greatest))))
    steps = F.array(*(F.struct(F.lit(i).alias("x"), F.lit(j).alias("y")) for i in range(3) for j in range(-2, 3) if (i, j) > (0, 0)))
    left = cells.select(F.struct("cx", "cy", "node", "ends").alias("a"), F.explode(steps).alias("to"))
    left = left.select("a", (F.col("a.cx") + F.col("to.x")).alias("cx"), (F.col("a.cy") + F.col("to.y")).alias("cy"))
    pairs = left.join(cells.select("cx", "cy", F.struct("cx", "cy", "node", "ends").alias("b")), ["cx", "cy"]).select("a", "b", bounds("a").alias("p"), bounds("b").alias("q"))
    apart = [F.greatest(F.lit(0.0), F.col(f"q.lo_{c}") - F.col(f"p.hi_{c}"), F.col(f"p.lo_{c}") - F.col(f"q.hi_{c}")) for c in "xy"]
    some = F.exists("a.ends", lambda s: F.exists("b.ends", lambda t: _distance(s["x"], s["y"], t["x"], t["y"]) <= eps))
    pairs = pairs.where(_distance(*apart, F.lit(0.0), F.lit(0.0)) <= eps).withColumn("sure", some).checkpoint()
    sides = [pairs.where("not sure").select(F.col("a.node").alias("a"), F.col("b.node").alias("b"), F.lit(k).alias("side"), F.col(f"{own}.cx").alias("cx"), F.col(f"{own}.cy").alias("cy"), F.col(other).alias("r")) for k, (own, other) in enumerate((("a", "q"), ("b", "p")))]
    off = [F.greatest(F.lit(0.0), F.col(f"r.lo_{c}") - F.col(c), F.col(c) - F.col(f"r.hi_{c}")) for c in "xy"]
    open_ = sides[0].unionByName(sides[1]).join(spots, ["cx", "cy"]).where(_distance(*off, F.lit(0.0), F.lit(0.0)) <= eps).select("a", "b", "side", "x", "y")

    def judge(group: pa.Table) -> pa.Table:
        side, points = group.column("side").to_numpy(), np.column_stack([group.column(c).to_numpy() for c in "xy"])
        return group.select(["a", "b"]).slice(0, int(within(points[side == 0], points[side == 1], eps)))

    ship(cells.sparkSession)
    kind = cells.schema["node"].dataType.simpleString()
    found = open_.groupBy("a", "b").applyInArrow(judge, f"a {kind}, b {kind}")
    return pairs.where("sure").select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).unionByName(found)


def dbscan(df: DataFrame, key: str, x: str, y: str, eps: float, min_points: int) -> DataFrame:
    """(key, cluster) in the plane: clusters as least keys of the core points that links join; noise is -1, and so are null keys and places that are null or not finite.

    Points of one cell are all near each other. So a cell of ``min_points`` rows holds core points of one cluster only; the
    few points of other cells are counted against the cells around them, and cells are linked, not points: tables grow with
    the rows, however dense these lie. Rounds go on until none changes a label.
    """
    real = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = df.select(F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(real("x") & real("y"))
    # 0.707 is a little less than the root of 1/2, so that rounding never puts two points farther apart than eps into a cell
    rows = rows.select("k", "x", "y", *(F.floor(F.col(c) / (0.707 * eps)).alias(f"c{c}") for c in "xy")).checkpoint()
    at = ["cx", "cy"]

    def near(points: DataFrame, spots: DataFrame) -> DataFrame:
        for c in at:
            points = points.withColumn(c, F.explode(F.sequence(F.col(c) - 2, F.col(c) + 2)))
        return points.select("k", F.col("x").alias("px"), F.col("y").alias("py"), *at).join(spots, at).where(_distance(F.col("px"), F.col("py"), F.col("x"), F.col("y")) <= eps)

    spots = rows.groupBy(*at, "x", "y").agg(F.count("*").alias("m"))
    rows = rows.join(spots.groupBy(*at).agg(F.sum("m").alias("n")), at).checkpoint()
    small = rows.where(F.col("n") < min_points).drop("n")
    counts = near(small, spots).groupBy("k").agg(F.sum("m").alias("n")).unionByName(rows.where(F.col("n") >= min_points).select("k", "n"))
    core = counts.where("k is not null").groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") >= min_points).select("k").checkpoint()
    rows = rows.drop("n").join(core, "k").checkpoint()
    ends = [f(F.struct(*c)) for f in (F.min, F.max) for c in (("x", "y"), ("y", "x"))]
    cells = rows.groupBy(*at).agg(F.min("k").alias("node"), F.array(*(F.struct(e["x"].alias("x"), e["y"].alias("y")) for e in ends)).alias("ends")).checkpoint()
    spots = rows.select(*at, "x", "y").distinct()
    # a key that is repeated links the cells of its rows
    placed = rows.select("k", *at).join(cells.select(*at, "node"), at)
    many = placed.groupBy("k").agg(F.collect_set("node").alias("at")).where(F.size("at") > 1).select(F.explode("at").alias("a"), F.array_min("at").alias("b"))
    links = _linked_cells(cells, spots, eps).unionByName(many)
    links = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(cells.select(F.col("node").alias("a"), F.col("node").alias("b"))).distinct().checkpoint()
    label = links.groupBy("a").agg(F.min("b").alias("cluster")).checkpoint()
    done = False
    while not done:
        new = links.join(label.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("cluster").alias("cluster"))
        new = new.join(label.select(F.col("a").alias("cluster"), F.col("cluster").alias("up")), "cluster").select("a", F.least("cluster", "up").alias("cluster")).checkpoint()
        done = new.join(label.withColumnRenamed("cluster", "was"), "a").where("was <> cluster").limit(1).count() == 0
        label = new
    cells = cells.select(*at, F.col("node").alias("a")).join(label, "a").select(*at, "cluster")
    own = rows.select("k", *at).join(cells, at).groupBy("k").agg(F.min("cluster").alias("cluster"))
    edge = near(small.where("k is not null").join(core, "k", "left_anti"), spots.join(cells, at)).groupBy("k").agg(F.min("cluster").alias("cluster"))
    found = own.unionByName(edge).withColumnRenamed("k", key)
    return df.select(key).join(found, key, "left").select(key, F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def reduced_rank(df: DataFrame, xs: Sequence[str], ys: Sequence[str], rank: int, alpha: float = 0.0) -> np.ndarray:
    """Coefficients (features x targets) of rank-limited ridge regression on centred columns, from one moment pass."""
    m = moments(df.select(F.array(*(F.col(c).cast("double") for c in (*xs, *ys))).alias("v")), "v")
    p = len(xs)
    b = np.linalg.lstsq(m.scatter[:p, :p] + alpha * np.eye(p), m.scatter[:p, p:], rcond=None)[0]
    _, vectors = np.linalg.eigh(b.T @ m.scatter[:p, p:])
    v = vectors[:, ::-1][:, :rank]
    return b @ v @ v.T


def explained_dimension(df: DataFrame, ratio: str, order: str, target: float) -> DataFrame:
    """Interpolated number of components whose shares add up to the target; a table of one row a component."""
    w = Window.partitionBy(F.lit(0)).orderBy(order)
    c = df.withColumn("_c", F.sum(ratio).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_k", F.row_number().over(w))
    first = c.where(F.col("_c") >= target).agg(F.min(F.struct("_k", "_c", ratio)).alias("m"))
    return first.select((F.col("m._k") - F.try_divide(F.col("m._c") - target, F.col(f"m.{ratio}"))).alias("dimension"))


def _raw(m: Moments) -> np.ndarray:
    """Second moments about zero."""
    return m.scatter + m.n * np.outer(m.mean, m.mean)


def procrustes(df: DataFrame, a: str, b: str) -> tuple[np.ndarray, float]:
    """The rotation that takes the vectors of one column closest to those of another, and the sum of the cross product's singular values; from one moment pass."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.concat(a, b).alias("v"))
    cross = _raw(moments(both, "v"))
    k = len(cross) // 2
    u, s, v = np.linalg.svd(cross[:k, k:])
    return u @ v, float(s.sum())


def nearest_orthonormal(df: DataFrame, vector: str, centre: bool = True, out: str = "orthonormal") -> DataFrame:
    """The matrix with orthonormal columns nearest to the one whose rows are given: each row times the inverse root of the second moments. Directions without any spread become zero."""
    m = moments(df, vector)
    values, vectors = np.linalg.eigh(m.scatter if centre else _raw(m))
    root = np.where(values > values.max(initial=0) * 1e-12, 1 / np.sqrt(np.maximum(values, 1e-300)), 0)
    shift = F.lit((m.mean if centre else np.zeros(len(m.mean))).tolist())
    return _mapped(df, F.zip_with(vector, shift, lambda x, c: x - c), vectors * root @ vectors.T, out)


def orthogonalise_from(df: DataFrame, targets: Sequence[str], others: Sequence[str], threshold: float = 1e-15) -> tuple[DataFrame, dict[str, float], float]:
    """Adds ``<target>_rest``, what the other columns leave of each target, around its mean; with the explained share of each target and of all.

    From one pass of moments; directions of the others that hold less than ``threshold`` of their variance are left out.
    """
    names = [*targets, *others]
    m = moments(df.select(F.array(*(F.col(c).cast("double") for c in names)).alias("v")), "v")
    t = len(targets)
    values, vectors = np.linalg.eigh(m.scatter[t:, t:])
    keep = values > threshold * max(values.sum(), 1e-300)
    weights = (vectors[:, keep] / values[keep]) @ vectors[:, keep].T @ m.scatter[t:, :t]
    total, taken = np.diag(m.scatter)[:t], np.einsum("ij,ij->j", m.scatter[t:, :t], weights)
    rest = {}
    for j, name in enumerate(targets):
        fitted = F.lit(0.0)
        for i, other in enumerate(others):
            fitted = fitted + float(weights[i, j]) * (F.col(other) - float(m.mean[t + i]))
        rest[f"{name}_rest"] = F.col(name) - fitted
    share = {name: float(taken[j] / total[j]) if total[j] else float("nan") for j, name in enumerate(targets)}
    return df.withColumns(rest), share, float(taken.sum() / total.sum()) if total.sum() else float("nan")


def incremental_pca(parts: Iterable[DataFrame], vector: str, k: int) -> PrincipalComponents:
    """Components of batches that come one after the other: only moments are kept between them."""
    held = None
    for part in parts:
        m = moments(part, vector)
        held = m if held is None or not held.n else merge_moments(held, m) if m.n else held
    if held is None or not held.n:
        raise ValueError("no rows")
    return components_of(held, k)


def predicted(df: DataFrame, xs: Sequence[str], coefficients: np.ndarray, means: tuple[np.ndarray, np.ndarray], out: str = "predicted") -> DataFrame:
    """Adds the array of targets by coefficients (features x targets) about the means of features and targets."""
    centred = F.array(*(F.col(c).cast("double") - float(a) for c, a in zip(xs, means[0], strict=True)))
    back = _mapped(df, centred, coefficients.T, "_y")
    return back.withColumn(out, F.zip_with("_y", F.lit(np.asarray(means[1], float).tolist()), lambda a, b: a + b)).drop("_y")


def shuffle_splits(df: DataFrame, group: Sequence[str], splits: int, test_share: float = 0.5, seed: int = 0) -> DataFrame:
    """Every row once a split, with ``test``: groups are dealt by hash, so a group is never split and about ``test_share`` of them are tests."""
    each = df.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    return each.withColumn("test", F.pmod(F.xxhash64(F.lit(seed), "split", *group), F.lit(1_000_000)) < test_share * 1_000_000)
