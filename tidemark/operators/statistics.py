"""Aggregates by group: moments, circular statistics, losses, contingency. All are partial aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.distributions import p_of_t, p_of_z, t_of_p
from tidemark.functions.scalar import TAU


def clean(x: Column) -> Column:
    """NaN as missing."""
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def moments(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """n, mean, var and std for ddof 0 and 1, min and max of the values that are not missing."""
    v = clean(F.col(x))
    return df.groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("var0"), F.var_samp(v).alias("var1"), F.stddev_pop(v).alias("std0"),
        F.stddev_samp(v).alias("std1"), F.min(v).alias("low"), F.max(v).alias("high"))


def no_missing(df: DataFrame, x: str, missing: str) -> tuple[DataFrame, Column]:
    """The values under a policy for missing ones: omit (left out), propagate (NaN, so results are NaN) or raise (an error when the plan runs)."""
    v = F.col(x).cast("double")
    if missing == "omit":
        return df, clean(v)
    if missing == "propagate":
        return df, F.coalesce(v, F.lit(float("nan")))
    if missing == "raise":
        return df, F.when(v.isNull() | F.isnan(v), F.raise_error(F.lit(f"{x} has missing values")).cast("double")).otherwise(v)
    raise ValueError("missing must be omit, propagate or raise")


def geometric_mean(df: DataFrame, keys: Sequence[str], x: str, zeros: str = "propagate", missing: str = "omit") -> DataFrame:
    """zeros: propagate (the mean is 0), nan (left out like missing ones) or raise. Negative values give null."""
    df, v = no_missing(df, x, missing)
    if zeros == "raise":
        v = F.when(v == 0, F.raise_error(F.lit(f"{x} has zeros")).cast("double")).otherwise(v)
    mean = F.when(F.count_if(v < 0) == 0, F.exp(F.avg(F.when(v > 0, F.ln(v)))))
    mean = F.when(F.count_if(v == 0) > 0, F.lit(0.0)).otherwise(mean) if zeros == "propagate" else mean
    return df.groupBy(*keys).agg(mean.alias("geometric_mean"))


def sparsity(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    v = clean(F.col(x))
    return df.groupBy(*keys).agg((1 - F.try_divide(F.pow(F.avg(v), 2), F.nullif(F.avg(v * v), F.lit(0.0)))).alias("sparsity"))


def error_interval(df: DataFrame, keys: Sequence[str], x: str, error: str = "sem", confidence: float = 0.95, missing: str = "omit") -> DataFrame:
    """Mean with std (ddof 0), sem, n (all rows) and the bounds mean -+ std, sem or, for ci, sem times Student's quantile."""
    if not 0 < confidence < 1 or error not in ("std", "sem", "ci"):
        raise ValueError("confidence must be between 0 and 1, error one of std, sem and ci")
    df, v = no_missing(df, x, missing)
    out = df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count("*").alias("n")).withColumn("sem", F.col("std") / F.sqrt("n"))
    half = F.col("std") if error == "std" else F.col("sem") if error == "sem" else F.col("sem") * t_of_p((1 + confidence) / 2, F.col("n") - 1)
    return out.withColumn("_half", half).withColumns({"lower": F.col("mean") - F.col("_half"), "upper": F.col("mean") + F.col("_half")}).drop("_half")


def quantiles(df: DataFrame, keys: Sequence[str], x: str, ps: Sequence[float]) -> DataFrame:
    return df.groupBy(*keys).agg(*(F.percentile(clean(F.col(x)), F.lit(p)).alias(f"p{round(p * 100)}") for p in ps))


def paired_ratio_t(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """t statistic of the mean log ratio, its degrees of freedom and two-tailed p."""
    d = F.ln(F.col(a) / F.col(b))
    out = df.groupBy(*keys).agg(F.try_divide(F.avg(d), F.nullif(F.stddev_samp(d) / F.sqrt(F.count(d)), F.lit(0.0))).alias("t"), (F.count(d) - 1).alias("dof"))
    return out.withColumn("p", p_of_t(F.col("t"), F.col("dof")))


def two_sample_tests(df: DataFrame, keys: Sequence[str], x: str, second: Column) -> DataFrame:
    """Student's and Welch's t and the Mann-Whitney U of the rows where ``second`` is false against those where it is true, each with p two-tailed, greater and less.

    All from sums by group and by distinct value: no group is gathered. U's p is the normal one, with corrections for
    ties and continuity.
    """
    part = df.select(*keys, clean(F.col(x)).alias("_x"), second.alias("_s")).where("_x is not null and _s is not null")
    side = lambda f, s: f(F.when(F.col("_s") == s, F.col("_x")))
    sums = part.groupBy(*keys).agg(*(side(f, s).alias(f"{n}{i}") for i, s in ((1, False), (2, True)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    pooled = F.try_divide((n1 - 1) * F.col("v1") + (n2 - 1) * F.col("v2"), F.nullif(n1 + n2 - 2, F.lit(0.0)))
    gap, e1, e2 = F.col("m1") - F.col("m2"), F.col("v1") / n1, F.col("v2") / n2
    over = lambda a, b: F.try_divide(a, F.nullif(b, F.lit(0.0)))
    out = sums.withColumns({"t": over(gap, F.sqrt(pooled * (1 / n1 + 1 / n2))), "dof": n1 + n2 - 2, "welch": over(gap, F.sqrt(e1 + e2)),
                            "welch_dof": over(F.pow(e1 + e2, 2), e1 * e1 / (n1 - 1) + e2 * e2 / (n2 - 1))})
    each = part.groupBy(*keys, "_x").agg(F.count_if(~F.col("_s")).alias("_a"), F.count("*").alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.coalesce(F.sum("_c").over(before), F.lit(0)) + (F.col("_c") + 1) / 2
    ranks = each.withColumn("_r", rank).groupBy(*keys).agg(F.sum(F.col("_r") * F.col("_a")).alias("_w"), F.sum(F.pow(F.col("_c").cast("double"), 3) - F.col("_c")).alias("_ties"))
    out = out.join(ranks, list(keys)).withColumn("u", F.col("_w") - n1 * (n1 + 1) / 2)
    n = n1 + n2
    spread = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("_ties") / (n * (n - 1))))
    z = lambda shift: over(F.col("u") - n1 * n2 / 2 + shift, spread)
    out = out.withColumns({"_up": z(-0.5), "_down": z(0.5)})
    tail = lambda c: p_of_z(F.abs(c), two_tailed=False)
    upper = lambda c: F.when(c >= 0, tail(c)).otherwise(1 - tail(c))
    ps = {f"{name}_{tail_}": p_of_t(F.col(t), F.col(d), tail_) for name, t, d in (("t", "t", "dof"), ("welch", "welch", "welch_dof")) for tail_ in ("two", "greater", "less")}
    out = out.withColumns(ps).withColumns({"u_greater": upper(F.col("_up")), "u_less": upper(-F.col("_down"))})
    return out.withColumn("u_two", F.least(F.lit(1.0), 2 * F.least("u_greater", "u_less"))).drop("_w", "_ties", "_up", "_down")


def circular(df: DataFrame, keys: Sequence[str], x: str, high: float = TAU, low: float = 0.0) -> DataFrame:
    """Circular mean in [low, high), variance 1 - R and deviation."""
    span = high - low
    angle = (clean(F.col(x)) - low) * (TAU / span)
    s, c = F.avg(F.sin(angle)), F.avg(F.cos(angle))
    r = F.least(F.hypot(s, c), F.lit(1.0))
    return df.groupBy(*keys).agg(
        (F.pmod(F.atan2(s, c), F.lit(TAU)) * span / TAU + low).alias("circ_mean"), (1 - r).alias("circ_var"), (F.sqrt(-2 * F.ln(r)) * span / TAU).alias("circ_std"))


def phase_consistency(df: DataFrame, keys: Sequence[str], phase: str, weight: str | None = None) -> DataFrame:
    """Pairwise phase consistency, weighted if asked."""
    p = clean(F.col(phase))
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    s, c, n = F.sum(w * F.sin(p)), F.sum(w * F.cos(p)), F.sum(F.when(p.isNotNull(), w * w))
    total = F.sum(F.when(p.isNotNull(), w))
    return df.groupBy(*keys).agg(F.try_divide(s * s + c * c - n, F.nullif(total * total - n, F.lit(0.0))).alias("ppc"))


def phase_consistency_windowed(df: DataFrame, keys: Sequence[str], phase: str, window: str) -> DataFrame:
    """Pairwise phase consistency of phases tapered by a window; the number of pairs is that of all rows."""
    p, w, n = clean(F.col(phase)), F.col(window).cast("double"), F.count("*")
    s, c = F.sum(w * F.sin(p)), F.sum(w * F.cos(p))
    return df.groupBy(*keys).agg(F.try_divide(s * s + c * c - n, F.nullif((n * (n - 1)).cast("double"), F.lit(0.0))).alias("ppc"))


def losses(df: DataFrame, keys: Sequence[str], y: str, pred: str) -> DataFrame:
    """Scaled squared error, explained variance by the prediction and by its best line."""
    e = F.col(y) - F.col(pred)
    var = F.nullif(F.var_pop(y), F.lit(0.0))
    return df.groupBy(*keys).agg(
        F.try_divide(F.avg(e * e), var).alias("mse"), (1 - F.try_divide(F.avg(e * e), var)).alias("explained"), F.pow(F.corr(y, pred), 2).alias("evr"))


def log_loss(df: DataFrame, keys: Sequence[str], y: str, p: str, eps: float = 1e-12) -> DataFrame:
    q = F.greatest(F.least(F.when(F.col(y) == 1, F.col(p)).otherwise(1 - F.col(p)), F.lit(1 - eps)), F.lit(eps))
    return df.groupBy(*keys).agg(F.avg(-F.ln(q)).alias("log_loss"))


def penalised(train: Column, test: Column, power: float = 1.0) -> Column:
    return test * F.pow(test / train, power)


def confusion(df: DataFrame, pred: str, true: str, most: int = 1_000_000) -> DataFrame:
    """(pred, true, share): every pair of labels; the shares of one true label sum to 1.

    The pairs that don't occur are listed too, so the labels are counted first; more than ``most`` pairs are an error.
    """
    n = df.groupBy(F.col(pred).alias("pred"), F.col(true).alias("true")).agg(F.count("*").alias("n"))
    sizes = n.agg(F.count_distinct("pred").alias("a"), F.count_distinct("true").alias("b")).first()
    if (sizes["a"] + 1) * (sizes["b"] + 1) > most:
        raise ValueError("too many labels for a full table of pairs; group by both labels instead")
    grid = n.select("pred").distinct().crossJoin(n.select("true").distinct())  # at most ``most`` rows
    full = grid.join(n, ["pred", "true"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.select("pred", "true", (F.col("n") / F.sum("n").over(Window.partitionBy("true"))).alias("share"))


def one_hot(df: DataFrame, keys: Sequence[str], label: str, classes: int) -> DataFrame:
    return df.select(*keys, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: k == F.col(label))).alias("class", "hot"))


def squeeze(df: DataFrame, x: str, out: str = "squeezed", buckets: int = 64) -> DataFrame:
    """Consecutive integers in the order of the values, from the smallest: ranks of the distinct values, joined back.

    Values are dealt to ranges by approximate quantiles; a rank is that within the range plus the range's start, so no
    task sorts all values.
    """
    values = df.select(x).where(F.col(x).isNotNull()).distinct()
    cuts = values.agg(F.percentile_approx(x, F.lit([i / buckets for i in range(1, buckets)]), F.lit(10_000)).alias("q"), F.min(x).alias("low")).first()
    bucket = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts["q"] or [])))), lambda c: c < F.col(x))) if cuts["q"] else F.lit(0)
    dealt = values.withColumn("_r", bucket)
    starts = dealt.groupBy("_r").agg(F.count("*").alias("_n"))  # at most ``buckets`` rows
    starts = starts.select("_r", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    place = F.row_number().over(Window.partitionBy("_r").orderBy(x)) - 1
    ranked = dealt.withColumn("_place", place).join(F.broadcast(starts), "_r")
    return df.join(ranked.select(x, (F.col("_first") + F.col("_place") + F.lit(cuts["low"])).alias(out)), x)


def frequency(df: DataFrame, x: str) -> DataFrame:
    return df.groupBy(x).agg(F.count("*").alias("n"))
