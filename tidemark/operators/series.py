"""Operators within a series: one shuffle on the series' keys, then window frames or equi-joins on positions."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.functions.scalar import circ_wrap
from tidemark.session import ship
from tidemark.spec import SeriesSpec

def with_totals(df: DataFrame, keys: Sequence[str], **totals: Column) -> DataFrame:
    """Adds aggregates of each group to its rows: they are aggregated partially and joined back, so that no task needs a whole group."""
    held = df.groupBy(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys))).agg(*(c.alias(n) for n, c in totals.items()))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)))
    return df.join(held, same).drop(*(f"_key{i}" for i in range(len(keys))))


# ---- frames


def centred(spec: SeriesSpec, width: int):
    """A frame of ``width`` rows; of an even width the extra row is before the current one."""
    return spec.rows(width // 2, (width - 1) // 2)


#: Wider frames of percentiles are kept sorted as they slide; Spark counts each frame's values anew, so its work grows with the width.
SLIDING = 32


def sorted_quantiles(x: np.ndarray, p: float, before: int, after: int) -> np.ndarray:
    """The quantile of each frame by linear interpolation, NaN left out and where a frame has no value; the frame's values stay sorted as it moves."""
    out, held = np.full(len(x), np.nan), []
    values, missing = x.tolist(), np.isnan(x).tolist()
    for i in range(-after, len(values)):
        if i + after < len(values) and not missing[i + after]:
            insort(held, values[i + after])
        if i > before and not missing[i - before - 1]:
            del held[bisect_left(held, values[i - before - 1])]
        if i >= 0 and held:
            at = p * (len(held) - 1)
            low = int(at)
            a, b = held[low], held[min(low + 1, len(held) - 1)]
            out[i] = a if a == b or at == low else (low + 1 - at) * a + (at - low) * b
    return out


def _rolling(df: DataFrame, spec: SeriesSpec, x: Column, p: float, width: int, out: str) -> DataFrame:
    """Adds the quantile of ``x`` over centred frames. Of wide ones, a series (or its block, see ``blocks.in_blocks``) is the unit of memory."""
    if width <= SLIDING:
        return df.withColumn(out, F.percentile(x, F.lit(p)).over(centred(spec, width)))

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("_t")
        q = sorted_quantiles(part.column("_v").to_numpy().astype(float), p, width // 2, (width - 1) // 2)
        return part.drop_columns(["_t", "_v"]).append_column(out, pa.array(q, from_pandas=True))

    ship(df.sparkSession)
    part = spec.indexed(df.drop(out).withColumn("_v", x), "_t")
    schema = StructType([*(f for f in part.schema if f.name not in ("_t", "_v")), StructField(out, DoubleType())])
    return part.groupBy(*spec.keys).applyInArrow(run, schema)


def rolling_percentile(df: DataFrame, spec: SeriesSpec, p: float, width: int, out: str = "baseline", stride: int = 1) -> DataFrame:
    """Exact rolling quantile with linear interpolation, cut short at the ends; every ``stride``-th row is kept."""
    full = _rolling(df, spec, spec.x, p, width, out)
    return full if stride == 1 else spec.indexed(full, "_t").where(F.col("_t") % stride == 0).drop("_t")


def moving(df: DataFrame, spec: SeriesSpec, width: int) -> DataFrame:
    """Trailing mean, population variance and mean square of up to ``width`` rows."""
    w = spec.rows(width - 1, 0)
    return df.withColumns({"moving_mean": F.avg(spec.x).over(w), "moving_var": F.var_pop(spec.x).over(w), "moving_square": F.avg(spec.x * spec.x).over(w)})


def cumulative_mean(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    return df.withColumn("running_mean", F.avg(spec.x).over(spec.past()))


def rolling_zscore(df: DataFrame, spec: SeriesSpec, width: int, floor: float | None = None) -> DataFrame:
    """(x - moving mean) / moving deviation; ``floor`` bounds the mean below. Null where the deviation is 0."""
    w = spec.rows(width - 1, 0)
    mean = F.avg(spec.x).over(w)
    mean = mean if floor is None else F.greatest(mean, F.lit(floor))
    return df.withColumn("z", F.try_divide(spec.x - mean, F.nullif(F.sqrt(F.var_pop(spec.x).over(w)), F.lit(0.0))))


def zscore(df: DataFrame, spec: SeriesSpec, ddof: int = 0) -> DataFrame:
    dev = (F.stddev_samp if ddof else F.stddev_pop)(spec.x).over(spec.whole)
    return df.withColumn("z", F.try_divide(spec.x - F.avg(spec.x).over(spec.whole), F.nullif(dev, F.lit(0.0))))


def difference(df: DataFrame, spec: SeriesSpec, n: int = 1, circular_period: float | None = None, out: str = "diff") -> DataFrame:
    """n-th difference; with a period, each difference is wrapped to half a period either way."""
    current, part = spec.x, df
    for i in range(n):
        step = current - F.lag(current).over(spec.window)
        part = part.withColumn(f"_{out}{i}", step if circular_period is None else circ_wrap(step, circular_period))
        current = F.col(f"_{out}{i}")
    return part.withColumn(out, current).drop(*(f"_{out}{i}" for i in range(n)))


def shift(df: DataFrame, spec: SeriesSpec, n: int, fill: float | None = 0.0, out: str = "shifted") -> DataFrame:
    return df.withColumn(out, F.lag(spec.x, n, fill).over(spec.window) if n >= 0 else F.lead(spec.x, -n, fill).over(spec.window))


def unwrap_counter(df: DataFrame, spec: SeriesSpec, modulus: float, out: str = "linear") -> DataFrame:
    """Adds the modulus after each fall by more than half of it."""
    step = df.withColumn("_step", F.when(spec.x - F.lag(spec.x).over(spec.window) < -modulus / 2, F.lit(float(modulus))).otherwise(0.0))
    return step.withColumn(out, spec.x + F.sum("_step").over(spec.past())).drop("_step")


def threshold(x: Column, low: float | None, high: float | None, low_value: float | None = None, high_value: float | None = None) -> Column:
    out = x
    if high is not None:
        out = F.when(x > high, F.lit(high if high_value is None else high_value)).otherwise(out)
    return out if low is None else F.when(x < low, F.lit(low if low_value is None else low_value)).otherwise(out)


def scale_between(df: DataFrame, spec: SeriesSpec, low: float = 0, high: float = 1, percentiles: tuple[float, float] | None = None, clip: bool = True, out: str = "scaled") -> DataFrame:
    """Linear scale of each series from its extremes, or two of its quantiles, to [low, high]."""
    if percentiles is None:
        part = with_totals(df, spec.keys, _a=F.min(spec.x), _b=F.max(spec.x))
    else:
        part = with_totals(df, spec.keys, _q=F.percentile(spec.x, F.array(*map(F.lit, percentiles))))
        part = part.withColumns({"_a": F.get("_q", F.lit(0)), "_b": F.get("_q", F.lit(1))}).drop("_q")
    y = F.try_divide(spec.x - F.col("_a"), F.nullif(F.col("_b") - F.col("_a"), F.lit(0.0))) * (high - low) + low
    return part.withColumn(out, F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), y)) if clip else y).drop("_a", "_b")


def convergence(df: DataFrame, spec: SeriesSpec, width: int, tol: float, mode: str = "abs_less", gaps: bool = False) -> DataFrame:
    """First position whose preceding ``width`` values have a fitted line that changes by less/more than tol, by series.

    A frame with a missing value has no line; with ``gaps`` nulls are passed over and a NaN alone leaves its frame without one.
    """
    part = spec.indexed(df)
    w = SeriesSpec(spec.keys, ("t",), spec.value).rows(width, -1)
    whole = (F.count("*").over(w) == width) & (F.count_if(F.isnan(F.col(spec.value).cast("double"))).over(w) == 0) if gaps else F.count(spec.x).over(w) == width
    part = part.withColumn("_delta", F.when(whole, (width - 1) * F.regr_slope(spec.x, F.col("t").cast("double")).over(w)))
    d = F.col("_delta")
    hit = {"less": d < tol, "greater": d > tol, "abs_less": F.abs(d) < tol, "abs_greater": F.abs(d) > tol}[mode]
    return part.groupBy(*spec.keys).agg(F.min(F.when(hit, F.col("t"))).alias("converged_at"))


def stalled(df: DataFrame, spec: SeriesSpec, patience: int, tol_frac: float) -> DataFrame:
    """Marks rows where the best value so far moved by less than tol_frac of itself over the last ``patience`` rows."""
    part = df.withColumn("best", F.min(spec.x).over(spec.past()))
    w = spec.rows(patience - 1, 0)
    spread = F.max("best").over(w) - F.min("best").over(w)
    return part.withColumn("stalled", (F.count("best").over(w) == patience) & (spread <= tol_frac * F.abs(F.col("best"))))


# ---- runs


def widen(df: DataFrame, spec: SeriesSpec, flag: Column, before: int, after: int, out: str = "wide") -> DataFrame:
    """Dilates true rows by ``before`` rows back and ``after`` rows on."""
    return df.withColumn(out, F.coalesce(F.max(flag).over(spec.rows(after, before)), F.lit(False)))


def runs(df: DataFrame, spec: SeriesSpec, flag: Column, circular: bool = False) -> DataFrame:
    """(keys, start, length) of every run of true rows; circular: a run over the end and the start is one, from its start near the end."""
    part = spec.indexed(df.withColumn("_b", F.coalesce(flag, F.lit(False))))
    n = F.count("*").over(spec.whole)
    true = part.withColumn("_n", n).where("_b")
    true = true.withColumn("_g", F.col("t") - F.row_number().over(Window.partitionBy(*spec.keys).orderBy("t")))
    found = true.groupBy(*spec.keys, "_g").agg(F.min("t").alias("start"), F.count("*").alias("length"), F.max("_n").alias("_n"))
    if circular:
        ends = (F.col("start") == 0) | (F.col("start") + F.col("length") == F.col("_n"))
        found = found.withColumn("_seam", F.when(ends, F.lit(-1)).otherwise(F.col("start")))
        found = found.groupBy(*spec.keys, "_seam").agg(
            F.when((F.min("start") == 0) & (F.count("*") == 2) & (F.col("_seam") == -1), F.max("start")).otherwise(F.min("start")).alias("start"), F.sum("length").alias("length"))
    return found.select(*spec.keys, "start", "length")


def longest_run(df: DataFrame, spec: SeriesSpec, flag: Column, circular: bool = False) -> DataFrame:
    """The longest run of each series, the first on ties; series without a true row have none."""
    best = F.max(F.struct("length", (-F.col("start")).alias("back"))).alias("m")
    return runs(df, spec, flag, circular).groupBy(*spec.keys).agg(best).select(*spec.keys, (-F.col("m.back")).alias("start"), F.col("m.length").alias("length"))


def drop_short_runs(df: DataFrame, spec: SeriesSpec, flag: Column, n: int, out: str = "kept") -> DataFrame:
    """False for the true rows of runs shorter than n."""
    part = df.withColumn("_b", F.coalesce(flag, F.lit(False)))
    part = part.withColumn("_e", F.sum(F.when(F.col("_b") != F.coalesce(F.lag("_b").over(spec.window), ~F.col("_b")), 1).otherwise(0)).over(spec.past()))
    size = F.count("*").over(Window.partitionBy(*spec.keys, "_e"))
    return part.withColumn(out, F.col("_b") & (size >= n)).drop("_b", "_e")


# ---- positions


#: Up to this many offsets, windows around events are read by one frame each in one pass; wider ones by an equi-join on positions.
FRAMES = 64


def event_windows(df: DataFrame, spec: SeriesSpec, trigger: Column, low: int, high: int) -> DataFrame:
    """(keys, event, offset, value) for offsets low..high-1 around each trigger row; events whose window leaves the series are dropped."""
    part = spec.indexed(df.withColumn("_x", spec.x)).withColumn("_n", F.count("*").over(spec.whole))
    inside = trigger & (F.col("t") + low >= 0) & (F.col("t") + high <= F.col("_n"))
    if high - low <= FRAMES:
        near = F.array(*(F.lead("_x", o).over(spec.window) if o >= 0 else F.lag("_x", -o).over(spec.window) for o in range(low, high)))
        at = part.withColumn("_near", near).where(inside)
        return at.select(*spec.keys, F.col("t").alias("event"), F.posexplode("_near").alias("offset", "value")).withColumn("offset", F.col("offset") + low)
    asked = part.where(inside).select(*spec.keys, F.col("t").alias("event"), F.explode(F.sequence(F.lit(low), F.lit(high - 1))).alias("offset"))
    held = part.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(spec.keys)), "t", F.col("_x").alias("value"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(spec.keys)), F.col("t") == F.col("event") + F.col("offset"))
    return asked.join(held, same).select(*spec.keys, "event", "offset", "value")


def event_average(df: DataFrame, spec: SeriesSpec, trigger: Column, low: int, high: int) -> DataFrame:
    """(offset, mean, n) over all events of all series."""
    return event_windows(df, spec, trigger, low, high).groupBy("offset").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))


def sorted_event_average(df: DataFrame, spec: SeriesSpec, trigger: Column, low: int, high: int, seed: int = 0, train: Column | None = None) -> DataFrame:
    """Train and test event means by series and offset, with the offset of the series' train peak. ``train`` may look at the
    keys and ``event``; without it, half of the events by hash."""
    half = F.pmod(F.xxhash64(F.lit(seed), *spec.keys, "event"), F.lit(2)) == 0
    win = event_windows(df, spec, trigger, low, high).withColumn("train", half if train is None else train)
    mean = win.groupBy(*spec.keys, "offset").agg(F.avg(F.when(F.col("train"), F.col("value"))).alias("train"), F.avg(F.when(~F.col("train"), F.col("value"))).alias("test"))
    peak = mean.where("train is not null").groupBy(*spec.keys).agg(F.max(F.struct("train", (-F.col("offset")).alias("o"))).alias("p"))
    return mean.join(peak.select(*spec.keys, (-F.col("p.o")).alias("peak")), [*spec.keys])


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, max_diff: float | None = None, payload: Sequence[str] = ()) -> DataFrame:
    """As-of join to the nearest right position, the higher on ties; both sides are merged and read once in each direction."""
    hold = lambda c: F.when(F.col("_r"), c)
    a = left.withColumn("_r", F.lit(False)).withColumn("_v", F.lit(None).cast(right.select(F.struct(at, *payload).alias("s")).schema["s"].dataType))
    b = right.select(*keys, at, F.struct(at, *payload).alias("_v")).withColumn("_r", F.lit(True))
    both = a.unionByName(b, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(at)
    below = F.last(hold(F.col("_v")), True).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    above = F.last(hold(F.col("_v")), True).over(Window.partitionBy(*keys).orderBy(F.desc(at)).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    out = both.withColumns({"_lo": below, "_hi": above}).where(~F.col("_r"))
    up = F.col("_lo").isNull() | (F.col(f"_hi.{at}") - F.col(at) <= F.col(at) - F.col(f"_lo.{at}"))
    out = out.withColumn("match", F.when(F.col("_hi").isNull(), F.col("_lo")).when(up, F.col("_hi")).otherwise(F.col("_lo")))
    out = out.drop("_r", "_v", "_lo", "_hi")
    return out if max_diff is None else out.where(F.abs(F.col(f"match.{at}") - F.col(at)) <= max_diff)


def range_join(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, below: float, above: float) -> DataFrame:
    """Right rows with left - below < right < left + above: an equi-join on cells as wide as the interval, then the exact test."""
    width = float(below + above)
    cell = lambda c: F.floor(c / width)
    a = left.withColumn("_c", F.explode(F.sequence(cell(F.col(at) - below), cell(F.col(at) + above))))
    b = right.withColumnRenamed(at, f"{at}_right").withColumn("_c", cell(F.col(f"{at}_right")))
    got = a.join(b, [*keys, "_c"])
    return got.where((F.col(f"{at}_right") > F.col(at) - below) & (F.col(f"{at}_right") < F.col(at) + above)).drop("_c")


def interpolate(points: DataFrame, knots: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Piecewise-linear value of the knots at each point; outside, the end segments go on. Knots' x are distinct in a series."""
    w = Window.partitionBy(*keys).orderBy(x)
    k = knots.select(*keys, x, y).withColumns({"_x1": F.lead(x).over(w), "_y1": F.lead(y).over(w), "_first": F.row_number().over(w) == 1})
    k = k.where("_x1 is not null")
    seg = F.struct(x, y, F.col("_x1"), F.col("_y1"))
    both = points.select(*keys, x, F.lit(None).cast(k.select(seg.alias("s")).schema["s"].dataType).alias("_s")).withColumn("_p", F.lit(True))
    both = both.unionByName(k.select(*keys, x, seg.alias("_s")).withColumn("_p", F.lit(False)))
    order, back = Window.partitionBy(*keys).orderBy(x, F.col("_p")), Window.partitionBy(*keys).orderBy(F.desc(x), F.desc("_p"))
    so_far = lambda w: F.last("_s", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    got = both.withColumns({"_l": so_far(order), "_f": so_far(back)}).where("_p").withColumn("_g", F.coalesce("_l", "_f"))
    slope = F.try_divide(F.col("_g._y1") - F.col(f"_g.{y}"), F.col("_g._x1") - F.col(f"_g.{x}"))
    return got.select(*keys, x, (F.col(f"_g.{y}") + slope * (F.col(x) - F.col(f"_g.{x}"))).alias(y))


def convolve(df: DataFrame, spec: SeriesSpec, kernel: Sequence[float], mode: str = "same", flip: bool = True, correct_edge: bool = False, out: str = "conv") -> DataFrame:
    """1-D convolution (``flip``) or correlation as one frame expression: a weighted sum of lags, no join and no array.

    same: centred on full index (K-1)//2, missing neighbours count 0, or are left out of the weights with ``correct_edge``.
    same_late: the same, centred on full index K//2, which differs for even kernels.
    valid: only rows whose whole window lies in the series.
    """
    k = len(kernel)
    weights = list(kernel) if flip else list(kernel)[::-1]
    first = k // 2 if mode == "same_late" else (k - 1) // 2
    terms = []
    for j, w in enumerate(weights):
        back = j - first  # full index t + first takes x[t + first - j]
        at = F.lag(spec.x, back).over(spec.window) if back >= 0 else F.lead(spec.x, -back).over(spec.window)
        terms.append((float(w), at))
    total = sum((w * F.coalesce(x, F.lit(0.0)) for w, x in terms[1:]), terms[0][0] * F.coalesce(terms[0][1], F.lit(0.0)))
    if correct_edge:
        share = sum((F.when(x.isNotNull(), w).otherwise(0.0) for w, x in terms[1:]), F.when(terms[0][1].isNotNull(), terms[0][0]).otherwise(0.0))
        total = F.try_divide(total * float(sum(weights)), F.nullif(share, F.lit(0.0)))
    if mode == "valid":
        inside = terms[0][1].isNotNull()
        for _, x in terms[1:]:
            inside = inside & x.isNotNull()
        return df.withColumn(out, F.when(inside, total)).where(F.col(out).isNotNull())
    return df.withColumn(out, total)


def gaussian_kernel(sigma: float) -> list[float]:
    import math

    half = int(math.ceil(3.5 * sigma))
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-half, half + 1)]
    return [x / sum(w) for x in w]


def dampen(df: DataFrame, spec: SeriesSpec, factor: float, out: str = "damped") -> DataFrame:
    """y[t] = factor * y[t-1] + x[t] - x[t-1], y[0] = 0; a recurrence, so each series is folded in its own group."""
    names = [f.name for f in df.schema]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(spec.order))
        x, y, out_values = pdf[spec.value].to_numpy(float), 0.0, []
        for i in range(len(x)):
            y = factor * y + x[i] - x[i - 1] if i else 0.0
            out_values.append(y)
        return pdf.assign(**{out: out_values})[[*names, out]]

    ship(df.sparkSession)
    return df.groupBy(*spec.keys).applyInPandas(fold, StructType([*df.schema.fields, StructField(out, DoubleType())]))


def unfold(df: DataFrame, spec: SeriesSpec, size: int, step: int) -> DataFrame:
    """(keys, window, offset, value): overlapping windows of ``size`` rows at 0, step, ...; only whole ones."""
    if size < 1 or step < 1:
        raise ValueError("size and step must be positive")
    part = spec.indexed(df.withColumn("_x", spec.x)).withColumn("_n", F.count("*").over(spec.whole))
    first = F.greatest(F.ceil((F.col("t") - size + 1) / step), F.lit(0)).cast("long")
    last = F.least(F.floor(F.col("t") / step), F.floor((F.col("_n") - size) / step)).cast("long")
    got = part.where((F.col("_n") >= size) & (first <= last)).withColumn("window", F.explode(F.sequence(first, last)))
    return got.select(*spec.keys, "window", (F.col("t") - F.col("window") * step).alias("offset"), F.col("_x").alias("value"))


def batches(df: DataFrame, spec: SeriesSpec, size: int, min_size: int = 1) -> DataFrame:
    """Adds the batch of ``size`` consecutive rows; batches smaller than min_size are dropped."""
    part = spec.indexed(df).withColumn("batch", F.floor(F.col("t") / size).cast("long"))
    sized = part.withColumn("_m", F.count("*").over(Window.partitionBy(*spec.keys, "batch")))
    return sized.where(F.col("_m") >= min_size).drop("_m")


def bin_by(df: DataFrame, spec: SeriesSpec, width: int, reduce: Callable[[Column], Column] = F.avg, crop: bool = False) -> DataFrame:
    """(keys, bin, value): any reducer over bins of ``width`` rows; crop drops the partial last bin."""
    part = spec.indexed(df).groupBy(*spec.keys, F.floor(F.col("t") / width).cast("long").alias("bin")).agg(reduce(spec.x).alias("value"), F.count("*").alias("_n"))
    return (part.where(F.col("_n") == width) if crop else part).drop("_n")


# ---- traces


def dff(df: DataFrame, spec: SeriesSpec, p: float = 0.3, width: int | None = None, surround: str | None = None, fraction: float = 0.7) -> DataFrame:
    """Baseline-normalised trace: subtracted, baseline, df and dff columns; global or rolling baseline quantile."""
    base = spec.x if surround is None else spec.x - fraction * F.col(surround)
    part = df.withColumn("subtracted", base)
    q = F.percentile("subtracted", F.lit(p))
    part = with_totals(part, spec.keys, baseline=q) if width is None else _rolling(part, spec, F.col("subtracted"), p, width, "baseline")
    return part.withColumn("df", F.col("subtracted") - F.col("baseline")).withColumn("dff", F.try_divide("df", F.nullif(F.col("baseline"), F.lit(0.0))))


def noise_level(df: DataFrame, spec: SeriesSpec, rate: float) -> DataFrame:
    """100 * median |difference| / sqrt(rate) of each series."""
    d = difference(df, spec)
    return d.groupBy(*spec.keys).agg((F.percentile(F.abs("diff"), F.lit(0.5)) / rate**0.5 * 100).alias("noise"))


def derivative_mad(df: DataFrame, spec: SeriesSpec, n: int) -> DataFrame:
    """Lower median of the absolute n-th differences."""
    return difference(df, spec, n).groupBy(*spec.keys).agg(F.expr("percentile_disc(0.5) within group (order by abs(diff))").alias("mad"))


def snr_autoregressive(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Signal s = lag-1 autocovariance of the z-scored series, noise n = 1 - s, and s / n."""
    z = zscore(df, spec, ddof=1).withColumn("_p", F.col("z") * F.lag("z").over(spec.window))
    sums = z.groupBy(*spec.keys).agg(F.sum("_p").alias("_s"), F.count("z").alias("_n"), F.var_samp("z").alias("_v"))
    signal = F.try_divide(F.col("_s"), F.nullif(F.col("_n") - 2, F.lit(0)))
    return sums.select(*spec.keys, signal.alias("signal"), (F.col("_v") - signal).alias("noise"), F.try_divide(signal, F.nullif(F.col("_v") - signal, F.lit(0.0))).alias("snr"))


def quality(df: DataFrame, spec: SeriesSpec, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """Metrics of each series with a pass flag for every limited one and ``good`` for all; null or out of limits fails."""
    traced = dff(df, spec).withColumn("_d", F.col("dff") - F.lag("dff").over(spec.window))
    m = traced.groupBy(*spec.keys).agg(
        F.max("dff").alias("max_dff"), F.percentile(F.abs("_d"), F.lit(0.5)).alias("mad"), F.var_pop("dff").alias("variance"), F.min("baseline").alias("base"))
    flags = {f"ok_{k}": F.coalesce(F.col(k).between(lo, hi), F.lit(False)) for k, (lo, hi) in limits.items()}
    m = m.withColumns(flags)
    good = F.lit(True)
    for k in flags:
        good = good & F.col(k)
    return m.withColumn("good", good)


#: The limits of ``trace_quality``; fixed values.
TRACE_LIMITS = {
    "var_ratio": (0, 0.5), "explained": (0, 0.7), "base_subtracted": (100, 2000), "base": (200, 3500), "nsr": (0, 6), "noise": (0, 0.015), "max_dff": (0.75, 10), "baseline_var": (0, 0.015),
}


def order_statistic(df: DataFrame, spec: SeriesSpec, p: float, out: str) -> DataFrame:
    """(keys, out): the value of each series at rank round(p (n - 1)), halves to even."""
    w = Window.partitionBy(*spec.keys)
    ranked = df.select(*spec.keys, spec.x.alias(out)).where(F.col(out).isNotNull())
    ranked = ranked.withColumns({"_k": F.row_number().over(w.orderBy(out)) - 1, "_n": F.count("*").over(w)})
    return ranked.where(F.col("_k") == F.bround(p * (F.col("_n") - 1)).cast("long")).select(*spec.keys, out)


def trace_quality(df: DataFrame, spec: SeriesSpec, surround: str, fraction: float = 0.7, p: float = 0.3, width: int = 27_000, rate: float = 30.0, limits: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """The eight metrics of traces with a surround signal, a pass flag for each and ``good`` for all; null, NaN and what is out of limits fails.

    var_ratio and explained: variance of the surround to that of the trace, and the share of the trace it explains. base
    and base_subtracted: the p order statistic of the trace and of what is left after subtraction. nsr: autoregressive
    noise to signal of dF/F; noise: median |second difference| / rate; max_dff; baseline_var: variance of the rolling baseline
    over its mean.
    """
    v, keys = spec.value, list(spec.keys)
    traced = dff(df, spec, p, None, surround, fraction)
    traced = _rolling(traced, spec, F.col("subtracted"), p, width, "_roll")
    of = lambda c: SeriesSpec(spec.keys, spec.order, c)
    ratio = F.try_divide(F.var_samp(surround), F.nullif(F.var_samp(v), F.lit(0.0)))
    m = traced.groupBy(*keys).agg(
        F.coalesce(ratio, F.when(F.var_samp(v) == 0, F.lit(0.0))).alias("var_ratio"), F.pow(F.corr(v, surround), 2).alias("explained"), F.max("dff").alias("max_dff"),
        F.try_divide(F.var_samp("_roll"), F.nullif(F.pow(F.avg("_roll"), 2), F.lit(0.0))).alias("baseline_var"))
    snr = snr_autoregressive(traced, of("dff")).select(*keys, F.try_divide(F.lit(1.0), F.nullif(F.col("snr"), F.lit(0.0))).alias("nsr"))
    noise = derivative_mad(traced, of("dff"), 2).select(*keys, (F.col("mad") / rate).alias("noise"))
    for part in (snr, noise, order_statistic(df, spec, p, "base"), order_statistic(traced, of("subtracted"), p, "base_subtracted")):
        m = m.join(part, keys, "left")
    limits = TRACE_LIMITS if limits is None else limits
    flags = {f"ok_{k}": F.coalesce(F.col(k).between(float(lo), float(hi)) & ~F.isnan(k), F.lit(False)) for k, (lo, hi) in limits.items()}
    return m.withColumns(flags).withColumn("good", reduce(lambda a, b: a & b, (F.col(k) for k in flags)))


def magnitude_normalised(df: DataFrame, series: str, at: str, value: str, k: float = 0.05, out: str = "normalised") -> DataFrame:
    """Spectrogram rows (series, frequency, at, value) over k times the mean, by series, of the sum over frequencies at that time, plus 1 - k."""
    total = F.try_divide(F.sum(value), F.count_distinct(series).cast("double"))
    held = df.groupBy(F.col(at).alias("_at")).agg(total.alias("_mean"))
    return df.join(held, F.col(at).eqNullSafe(F.col("_at"))).withColumn(out, F.col(value) / (k * F.col("_mean") + (1 - k))).drop("_at", "_mean")
