"""Images and stacks in long form (img, y, x, v): coordinates are columns, so geometry is arithmetic on them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import ship


def whole():
    """All pixels of an image. A function, as a window can't be made before there is a session."""
    return Window.partitionBy("img")


def grid(spark: SparkSession, height: int, width: int) -> DataFrame:
    n = spark.range(height * width)
    return n.select(F.floor(F.col("id") / width).alias("y"), F.pmod("id", F.lit(width)).alias("x"))


def distance_grid(spark: SparkSession, height: int, width: int, p: float = 2, centre: tuple[float, float] | None = None) -> DataFrame:
    cy, cx = centre or ((height - 1) / 2, (width - 1) / 2)
    d = F.pow(F.pow(F.abs(F.col("y") - cy), p) + F.pow(F.abs(F.col("x") - cx), p), 1 / p)
    return grid(spark, height, width).withColumn("v", d)


def gaussian_2d(spark: SparkSession, height: int, width: int, sigma: float) -> DataFrame:
    g = distance_grid(spark, height, width).withColumn("v", F.exp(-F.pow("v", F.lit(2)) / (2 * sigma * sigma)))
    total = g.agg(F.sum("v").alias("s"))
    return g.crossJoin(total).select("y", "x", (F.col("v") / F.col("s")).alias("v"))  # one row of one number


def cosine_2d(spark: SparkSession, height: int, width: int, radius: float) -> DataFrame:
    d = distance_grid(spark, height, width)
    return d.withColumn("v", F.when(F.col("v") < radius, (F.cos(F.col("v") / radius * math.pi) + 1) / 2).otherwise(0.0))


def fourier_mask(spark: SparkSession, height: int, width: int, low: float, high: float, order: int) -> DataFrame:
    """Butterworth band-pass over distance from the centre."""
    d = distance_grid(spark, height, width)
    q = lambda cut: 1 / (1 + F.pow(F.col("v") / cut, 2 * order))
    return d.withColumn("v", q(high) * (1 - q(low)))


def cosine_torus(spark: SparkSession, offset: int, width: int) -> DataFrame:
    """A raised cosine over the distance from the centre, from ``offset`` on ``width`` steps long, zero elsewhere; distances count in whole steps, rounded up."""
    d = distance_grid(spark, offset + width, offset + width)
    step = F.ceil("v") - 1 - offset
    return d.withColumn("v", F.when(step.between(0, width - 1), 1 + F.cos(step * (2 * math.pi / max(width - 1, 1)) - math.pi)).otherwise(0.0))


def butterworth_mask(shape: tuple[int, ...], factor: float, order: float, high_pass: bool = False, real: bool = False, squared: bool = True) -> np.ndarray:
    """Butterworth weights of the frequencies of an array, zero frequency first; the cut is at ``factor`` of each axis.

    ``real``: only the half of the last axis that a real transform has. Without ``squared``, the square root of the weights.
    """
    away = np.zeros((1,) * len(shape))
    for axis, n in enumerate(shape):
        at = np.fft.ifftshift(((np.arange(n) - (n - 1) / 2) / (n * factor)) ** 2)
        at = at[: n // 2 + 1] if real and axis == len(shape) - 1 else at
        away = away + at.reshape([-1 if k == axis else 1 for k in range(len(shape))])
    away = away**order
    mask = (away if high_pass else 1) / (1 + away)
    return mask if squared else np.sqrt(mask)


def ring_mask(height: int, width: int, low: float, high: float, order: int = 5) -> np.ndarray:
    """Weights of distances from the centre in pixels: the magnitude of a digital Butterworth band-pass, or low-pass where low is 0."""
    side = max(height, width)
    far = np.hypot(*np.meshgrid(np.arange(height) - height // 2, np.arange(width) - width // 2, indexing="ij"))
    bent = lambda f: np.tan(np.pi * np.minimum(f, side / 2 * (1 - 1e-9)) / side)
    x, top = bent(far), bent(min(side / 2 - 1, high))
    if low <= 0:
        return 1 / np.sqrt(1 + (x / top) ** (2 * order))
    bottom = bent(low)
    with np.errstate(divide="ignore"):
        return 1 / np.sqrt(1 + ((x * x - bottom * top) / ((top - bottom) * x)) ** (2 * order))


def scale_range(df: DataFrame, low: float = 0, high: float = 1, eps: float = 1e-9) -> DataFrame:
    """Each image from its least value, over its largest, times the range."""
    return df.withColumn("v", (F.col("v") - F.min("v").over(whole())) * (high - low) / (F.max("v").over(whole()) + eps))


def scale_sum(df: DataFrame, total: float = 1.0, eps: float = 1e-9, subtract_min: bool = True) -> DataFrame:
    out = df.withColumn("v", total * F.col("v") / (F.sum("v").over(whole()) + eps))
    return out.withColumn("v", F.col("v") - F.min("v").over(whole())) if subtract_min else out


def normalise(df: DataFrame, mean: float = 0, std: float = 1, by: tuple[str, ...] = ("img",)) -> DataFrame:
    w = Window.partitionBy(*by)
    return df.withColumn("v", F.try_divide(F.col("v") - F.avg("v").over(w), F.nullif(F.stddev_samp("v").over(w), F.lit(0.0))) * std + mean)


def clip(v: Column, low: float = 0, high: float = 1) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), v))


def to_uint8(v: Column, top: float = 1.0) -> Column:
    return F.floor(clip(v / top) * 255).cast("short")


def tile_channels(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def mask_border(df: DataFrame, height: int, width: int, outer: int, value: float = 0) -> DataFrame:
    edge = (F.col("y") < outer) | (F.col("x") < outer) | (F.col("y") >= height - outer) | (F.col("x") >= width - outer)
    return df.withColumn("v", F.when(edge, F.lit(float(value))).otherwise(F.col("v")))


def crop_centre(df: DataFrame, height: int, width: int, to: tuple[int, int]) -> DataFrame:
    y0, x0 = (height - to[0]) // 2, (width - to[1]) // 2
    inside = F.col("y").between(y0, y0 + to[0] - 1) & F.col("x").between(x0, x0 + to[1] - 1)
    return df.where(inside).withColumns({"y": F.col("y") - y0, "x": F.col("x") - x0})


def pad_centre(df: DataFrame, height: int, width: int, to: tuple[int, int]) -> DataFrame:
    """Moves an image into a larger frame; cells outside are absent, that is zero."""
    return df.withColumns({"y": F.col("y") + (to[0] - height) // 2, "x": F.col("x") + (to[1] - width) // 2})


def bin_image(df: DataFrame, by: tuple[int, int], reduce=F.avg) -> DataFrame:
    return df.groupBy("img", F.floor(F.col("y") / by[0]).alias("y"), F.floor(F.col("x") / by[1]).alias("x")).agg(reduce("v").alias("v"))


def shift_to_map(df: DataFrame, dy: int, dx: int, height: int, width: int, edge: str = "clip") -> DataFrame:
    """Where each pixel reads from after a shift; edge: clip, wrap or reflect."""
    def at(c: Column, n: int) -> Column:
        if edge == "wrap":
            return F.pmod(c, F.lit(n))
        if edge == "reflect":
            m = F.pmod(c, F.lit(2 * n - 2)) if n > 1 else F.lit(0)
            return F.when(m < n, m).otherwise(2 * n - 2 - m)
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), c))

    return df.withColumns({"from_y": at(F.col("y") - dy, height), "from_x": at(F.col("x") - dx, width)})


def flow_to_map(df: DataFrame) -> DataFrame:
    return df.withColumns({"map_y": F.col("y") + F.col("dy"), "map_x": F.col("x") + F.col("dx")})


def map_to_flow(df: DataFrame) -> DataFrame:
    return df.withColumns({"dy": F.col("map_y") - F.col("y"), "dx": F.col("map_x") - F.col("x")})


def normalised_map(c: Column, n: int) -> Column:
    """Pixel coordinates to [-1, 1]."""
    return c * 2 / (n - 1) - 1


def pixel_map(c: Column, n: int) -> Column:
    return (c + 1) * (n - 1) / 2


def warp_map(df: DataFrame, m: list[list[float]]) -> DataFrame:
    """Affine (2 rows) or projective (3 rows) map of the pixel grid."""
    x, y = F.col("x"), F.col("y")
    u, v = (r[0] * x + r[1] * y + r[2] for r in m[:2])
    z = m[2][0] * x + m[2][1] * y + m[2][2] if len(m) == 3 else F.lit(1.0)
    return df.withColumns({"map_x": F.try_divide(u, z), "map_y": F.try_divide(v, z)})


def remap(df: DataFrame, at: DataFrame) -> DataFrame:
    """Bilinear values of images at fractional (img, id, py, px): four equi-joins in one, by exploding each point's corners."""
    fy, fx = F.floor("py"), F.floor("px")
    corners = F.array(*(F.struct((fy + a).alias("y"), (fx + b).alias("x"),
                                 ((F.col("py") - fy if a else 1 - (F.col("py") - fy)) * (F.col("px") - fx if b else 1 - (F.col("px") - fx))).alias("w")) for a in (0, 1) for b in (0, 1)))
    each = at.select("img", "id", F.explode(corners).alias("c")).select("img", "id", "c.y", "c.x", "c.w").where("w > 0")
    return each.join(df, ["img", "y", "x"]).groupBy("img", "id").agg(F.sum(F.col("w") * F.col("v")).alias("v"), F.sum("w").alias("cover")).where("cover > 1 - 1e-9").drop("cover")


def peak(df: DataFrame) -> DataFrame:
    """(img, y, x, v) of each image's largest value, the first on ties."""
    m = F.max(F.struct("v", (-F.col("y")).alias("y"), (-F.col("x")).alias("x"))).alias("m")
    return df.groupBy("img").agg(m).select("img", (-F.col("m.y")).alias("y"), (-F.col("m.x")).alias("x"), F.col("m.v").alias("v"))


def footprints(rois: DataFrame, size: int) -> DataFrame:
    """Sparse region pixels (roi, y, x, v) moved into size x size crops around each region's rounded weighted centre."""
    c = rois.groupBy("roi").agg(F.round(F.avg("y")).cast("int").alias("cy"), F.round(F.avg("x")).cast("int").alias("cx"))
    moved = rois.join(c, "roi").withColumns({"y": F.col("y") - F.col("cy") + size // 2, "x": F.col("x") - F.col("cx") + size // 2})
    return moved.where(F.col("y").between(0, size - 1) & F.col("x").between(0, size - 1)).drop("cy", "cx")


def stack_slices(df: DataFrame, slices: int, drop_first: int, frames: int) -> DataFrame:
    """Mean image of each slice of frames in (volume, slice, frame) order, the first frames of each slice left out."""
    f = df.withColumns({"slice": F.pmod(F.floor(F.col("img") / frames), F.lit(slices)), "frame": F.pmod("img", F.lit(frames))})
    return f.where(F.col("frame") >= drop_first).groupBy("slice", "y", "x").agg(F.avg("v").alias("v"))


def _by_image(df: DataFrame, height: int, width: int, run, schema: str) -> DataFrame:
    """Applies ``run`` to each image as an array, absent pixels zero; an image is the unit of memory."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((height, width))
        a[pdf["y"].to_numpy(int), pdf["x"].to_numpy(int)] = pdf["v"].to_numpy(float)
        out = run(a)
        return pd.DataFrame({"img": pdf["img"].iloc[0], **out})

    ship(df.sparkSession)
    return df.groupBy("img").applyInPandas(one, f"img {dict(df.dtypes)['img']}, {schema}")


def correlation_image(template: np.ndarray, image: np.ndarray, mask: np.ndarray | None = None, eps: float = 1e-8) -> np.ndarray:
    """Phase correlation with the zero shift in the middle; ``mask`` weighs centred frequencies."""
    a, b = np.fft.fft2(template), np.fft.fft2(image)
    if mask is not None:
        weight = np.fft.fftshift(mask / mask.sum())
        a, b = a * weight, b * weight
    cross = a * b.conj()
    return np.fft.fftshift(np.fft.ifft2(cross / (np.abs(cross) + eps))).real


def translation_shifts(df: DataFrame, template: np.ndarray, mask: np.ndarray | None = None) -> DataFrame:
    """(img, dy, dx, peak): the shift of each image against the template (a small array, sent with the plan) by phase correlation."""
    height, width = template.shape

    def run(image: np.ndarray) -> dict:
        c = correlation_image(template, image, mask)
        y, x = divmod(int(c.argmax()), width)
        return {"dy": [height // 2 - y], "dx": [-(-width // 2) - x], "peak": [c.max()]}

    return _by_image(df, height, width, run, "dy long, dx long, peak double")


def alignment_scores(df: DataFrame, template: np.ndarray, inside: float | tuple[float, float], outside: float | tuple[float, float], order: int = 5) -> DataFrame:
    """(img, mean_out, mean_in, ptile95_out, max_in, std_out, std_in, max_diff, z_in, r_in): how the phase correlation with a
    template (a small array, sent with the plan) near no shift stands out from that further away.

    ``inside`` and ``outside`` are rings of distances; one number means from 0 to it, and from it to half the shorter side.
    """
    height, width = template.shape
    near = ring_mask(height, width, *(inside if isinstance(inside, tuple) else (0.0, inside)), order)
    away = ring_mask(height, width, *(outside if isinstance(outside, tuple) else (outside, min(height, width) / 2)), order)
    names = ("mean_out", "mean_in", "ptile95_out", "max_in", "std_out", "std_in", "max_diff", "z_in", "r_in")

    def run(image: np.ndarray) -> dict:
        c = correlation_image(template, image)
        means = [(c * w).sum() / w.sum() for w in (away, near)]
        p95, top = np.quantile((c * away)[away > 1e-3], 0.95), (c * near).max()
        spread = [math.sqrt(((c - m) ** 2 * w).mean()) for m, w in zip(means, (away, near), strict=True)]
        over = lambda a, b: a / b if b else math.nan
        values = (*means, p95, top, *spread, top - p95, over(top - p95, spread[0]), over(top - p95, p95))
        return {n: [float(v)] for n, v in zip(names, values, strict=True)}

    return _by_image(df, height, width, run, ", ".join(f"{n} double" for n in names))


def depths(df: DataFrame, stack: np.ndarray, at: np.ndarray, mask: np.ndarray | None = None, sigma: float = 4.0) -> DataFrame:
    """(img, depth, peak): where in a stack of slices (slices, height, width; sent with the plan) each image lies.

    The phase correlation's peaks of the slices are smoothed by a Gaussian; the vertex of the parabola through the largest and
    its neighbours is read in the slices' positions ``at``. At the ends the slice's own position stands.
    """
    reach = np.arange(-int(sigma), int(sigma) + 1)
    kernel = np.exp(-0.5 * (reach / sigma) ** 2)
    kernel /= kernel.sum()

    def run(image: np.ndarray) -> dict:
        tops = np.array([correlation_image(s, image, mask).max() for s in stack])
        smooth = np.convolve(tops, kernel)[len(kernel) // 2 : len(kernel) // 2 + len(tops)]
        k = int(smooth.argmax())
        place = float(k)
        if 0 < k < len(smooth) - 1:
            a, b, c = smooth[k - 1 : k + 2]
            place += (a - c) / (2 * (a - 2 * b + c)) if a - 2 * b + c else 0.0
        return {"depth": [float(np.interp(place, np.arange(len(at)), at))], "peak": [float(tops.max())]}

    return _by_image(df, *stack.shape[1:], run, "depth double, peak double")


def resize(df: DataFrame, height: int, width: int, to: tuple[int, int]) -> DataFrame:
    """Bilinear resampling to another size, pixel centres aligned at the corners."""
    images = df.select("img").distinct()
    step = [(n - 1) / max(m - 1, 1) for n, m in zip((height, width), to, strict=True)]
    points = images.crossJoin(F.broadcast(grid(df.sparkSession, *to)))  # every image gets the same pixels
    points = points.select("img", (F.col("y") * to[1] + F.col("x")).alias("id"), (F.col("y") * step[0]).alias("py"), (F.col("x") * step[1]).alias("px"))
    return remap(df, points).select("img", F.floor(F.col("id") / to[1]).alias("y"), F.pmod("id", F.lit(to[1])).alias("x"), "v")


def flatten_channels(df: DataFrame, channels: int) -> DataFrame:
    """(img, c, ...) with the channels of an image following each other as images."""
    return df.withColumn("img", F.col("img") * channels + F.col("c")).drop("c")


def unflatten_channels(df: DataFrame, channels: int) -> DataFrame:
    return df.withColumns({"c": F.pmod("img", F.lit(channels)), "img": F.floor(F.col("img") / channels)})


def to_rgb(df: DataFrame, colours: list[tuple[float, float, float]]) -> DataFrame:
    """(img, y, x, r, g, b): channels (img, c, y, x, v) added in their colours, clipped at 1."""
    part = lambda k: F.least(F.lit(1.0), F.sum(F.col("v") * F.get(F.array(*(F.lit(float(c[k])) for c in colours)), F.col("c").cast("int"))))
    return df.groupBy("img", "y", "x").agg(*(part(k).alias(n) for k, n in enumerate("rgb")))


def occlude(df: DataFrame, height: int, width: int, size: tuple[float, float] = (0.3, 0.5), seed: int = 0) -> DataFrame:
    """A rectangle of each image, placed by the hash of its id, becomes zero."""
    u = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "img"), F.lit(1_000_000)) / 1_000_000
    h, w = (F.floor((size[0] + (size[1] - size[0]) * u(k)) * n) for k, n in ((0, height), (1, width)))
    y0, x0 = F.floor(u(2) * (height - h + 1)), F.floor(u(3) * (width - w + 1))
    return df.withColumn("v", F.when(F.col("y").between(y0, y0 + h - 1) & F.col("x").between(x0, x0 + w - 1), 0.0).otherwise(F.col("v")))


def add_noise(v: Column, scale: float, seed: int = 0) -> Column:
    return v + F.randn(seed) * scale


def multiply_at_random(df: DataFrame, low: float, high: float, seed: int = 0) -> DataFrame:
    """Each image times a factor of its own in [low, high), from the hash of its id."""
    return df.withColumn("v", F.col("v") * (low + (high - low) * F.pmod(F.xxhash64(F.lit(seed), "img"), F.lit(1_000_000)) / 1_000_000))


def without_nan(df: DataFrame) -> DataFrame:
    """Raises when a pixel is NaN."""
    return df.withColumn("v", F.when(F.isnan("v"), F.raise_error(F.lit("image has NaN")).cast("double")).otherwise(F.col("v")))


def _draw(seed: int, salt: int, *by: str) -> Column:
    """A number in [0, 1) by hash."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *by), F.lit(1_000_000)) / 1_000_000


def poisson_noise(df: DataFrame, scale: float, seed: int = 0) -> DataFrame:
    """Each pixel as a Poisson count of its value times the scale, over the scale; drawn by the hash of its place, so the same under any partitioning."""

    @F.pandas_udf("double")
    def counts(mean: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series([float(np.random.default_rng(abs(int(k))).poisson(max(m, 0.0))) for m, k in zip(mean, key, strict=True)])

    ship(df.sparkSession)
    return df.withColumn("v", counts(F.col("v") * scale, F.xxhash64(F.lit(seed), "img", "y", "x")) / scale)


def scale_stripes(df: DataFrame, low: float = 0.5, high: float = 1.0, seed: int = 0) -> DataFrame:
    """The odd and the even lines of each image times a factor each, in [low, high)."""
    return df.withColumn("v", F.col("v") * (low + (high - low) * F.when(F.col("y") % 2 == 1, _draw(seed, 1, "img")).otherwise(_draw(seed, 2, "img"))))


def shift_stripes(df: DataFrame, width: int, least: int = 0, most: int = 5, seed: int = 0) -> DataFrame:
    """Odd lines move one way and even ones the other, together by least..most pixels; what leaves the image is lost."""
    by = (least + F.floor(_draw(seed, 1, "img") * (most - least + 1))) * F.when(_draw(seed, 2, "img") < 0.5, -1).otherwise(1)
    moved = df.withColumn("x", F.col("x") + F.when(F.col("y") % 2 == 1, F.ceil(by / 2)).otherwise(-F.floor(by / 2)))
    return moved.where(F.col("x").between(0, width - 1))


def make_square(df: DataFrame, height: int, width: int) -> DataFrame:
    side = max(height, width)
    return pad_centre(df, height, width, (side, side))


def shift_images(df: DataFrame, shifts: DataFrame, height: int, width: int) -> DataFrame:
    """Images moved by (img, dy, dx), fractions bilinearly: each pixel is shared out to the four it falls on; outside is zero."""
    at = df.join(shifts, "img").withColumns({"_y": F.col("y") + F.col("dy"), "_x": F.col("x") + F.col("dx")})
    fy, fx = F.floor("_y"), F.floor("_x")
    part = lambda c, f, k: F.col(c) - f if k else 1 - (F.col(c) - f)
    corners = F.explode(F.array(*(F.struct((fy + a).alias("y"), (fx + b).alias("x"), (part("_y", fy, a) * part("_x", fx, b)).alias("w")) for a in (0, 1) for b in (0, 1))))
    spread = at.select("img", "v", corners.alias("c")).select("img", "c.y", "c.x", (F.col("v") * F.col("c.w")).alias("v"), "c.w").where("w > 0")
    return spread.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)).groupBy("img", "y", "x").agg(F.sum("v").alias("v"))


def compose_maps(first: DataFrame, second: DataFrame) -> DataFrame:
    """(img, y, x, map_y, map_x): the map that reads through ``second`` what ``first`` reads; places outside are left out. Both: (img, y, x, map_y, map_x)."""
    at = second.select("img", F.struct("y", "x").alias("id"), F.col("map_y").alias("py"), F.col("map_x").alias("px"))
    read = lambda c: remap(first.select("img", "y", "x", F.col(c).alias("v")), at).withColumnRenamed("v", c)
    return read("map_y").join(read("map_x"), ["img", "id"]).select("img", "id.y", "id.x", "map_y", "map_x")


def grey_to_rgb(df: DataFrame) -> DataFrame:
    return df.select("*", *(F.col("v").alias(c) for c in "rgb")).drop("v")
