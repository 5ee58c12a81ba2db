"""Series of events (user_id, in order of ts and event_id) through the series operators."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import TAU
from tidemark.operators import series as S
from tidemark.operators import spectral
from tidemark.operators import statistics as T
from tidemark.queries.common import Registry, r6, table
from tidemark.spec import SeriesSpec

R = Registry()
E = SeriesSpec(("user_id",), ("ts", "event_id"))
W = "over (partition by user_id order by ts, event_id{})"
IX = "(select *, row_number() over (partition by user_id order by ts, event_id) - 1 as t, count(*) over (partition by user_id) as n from events)"


_LAGGED = "(select *, coalesce(lag(value) over (partition by user_id order by ts, event_id), 0) as y, row_number() over (partition by user_id order by ts, event_id) - 1 as t, count(*) over (partition by user_id) as n from events)"


def rows(frame: str = "") -> str:
    return W.format(f" rows between {frame}" if frame else "")


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")


def angle():
    """Hour of day as an angle."""
    return F.hour("ts") * (TAU / 24)


SQL_ANGLE = f"(hour(ts) * {TAU / 24!r})"


@R.add(f"select event_id, round(b, 6) + 0.0 as baseline from (select event_id, quantile_cont(value, 0.3) {rows('10 preceding and 10 following')} as b from events)")
def rolling_percentile(spark, d):
    return S.rolling_percentile(events(spark, d), E, 0.3, 21).select("event_id", r6("baseline").alias("baseline"))


@R.add(f"select event_id, round(b, 6) + 0.0 as baseline from (select event_id, t, quantile_cont(value, 0.5) {rows('5 preceding and 4 following')} as b from {IX}) where t % 4 = 0")
def rolling_percentile_strided(spark, d):
    return S.rolling_percentile(events(spark, d), E, 0.5, 10, stride=4).select("event_id", r6("baseline").alias("baseline"))


@R.add(f"select event_id, round(b, 6) + 0.0 as baseline, round((value - b) / nullif(b, 0), 6) + 0.0 as dff from (select event_id, value, quantile_cont(value, 0.3) {rows('10 preceding and 10 following')} as b from events)")
def dff_rolling(spark, d):
    return S.dff(events(spark, d), E, width=21).select("event_id", r6("baseline").alias("baseline"), r6("dff").alias("dff"))


@R.add("select event_id, round((value - b) / nullif(b, 0), 6) + 0.0 as dff from (select event_id, value, quantile_cont(value, 0.3) over (partition by user_id) as b from events)")
def dff_global(spark, d):
    return S.dff(events(spark, d), E).select("event_id", r6("dff").alias("dff"))


# means of few-decimal values end after a few places: they are rounded beyond those, so that no tie is decided by float noise
_W7 = rows("6 preceding and current row")


@R.add(f"select event_id, round(avg(value) {_W7}, 9) + 0.0 as moving_mean, round(var_pop(value) {_W7}, 9) + 0.0 as moving_var, round(avg(value * value) {_W7}, 9) + 0.0 as moving_square from events")
def moving_moments(spark, d):
    return S.moving(events(spark, d), E, 7).select("event_id", *((F.round(c, 9) + 0.0).alias(c) for c in ("moving_mean", "moving_var", "moving_square")))


@R.add(f"select event_id, round(avg(value) {rows('unbounded preceding and current row')}, 10) + 0.0 as running_mean from events")
def cumulative_mean(spark, d):
    return S.cumulative_mean(events(spark, d), E).select("event_id", (F.round("running_mean", 10) + 0.0).alias("running_mean"))


@R.add(f"select event_id, round((value - greatest(m, 1e-7)) / nullif(s, 0), 5) + 0.0 as z from (select event_id, value, avg(value) {rows('19 preceding and current row')} as m, case when row_number() {rows()} > 1 then stddev_pop(value) {rows('19 preceding and current row')} end as s from events)")
def rolling_zscore(spark, d):
    return S.rolling_zscore(events(spark, d), E, 20, floor=1e-7).select("event_id", (F.round("z", 5) + 0.0).alias("z"))


@R.add("select event_id, round((value - avg(value) over w) / nullif(stddev_pop(value) over w, 0), 6) + 0.0 as z from events window w as (partition by user_id)")
def zscore_partition(spark, d):
    return S.zscore(events(spark, d), E).select("event_id", r6("z").alias("z"))


@R.add(f"select event_id, round(d2, 6) + 0.0 as diff from (select event_id, ts, user_id, d1 - lag(d1) {rows()} as d2 from (select *, value - lag(value) {rows()} as d1 from events))")
def lag_diff(spark, d):
    return S.difference(events(spark, d), E, 2).select("event_id", r6("diff").alias("diff"))


@R.add(f"select event_id, round(((s + {math.pi!r}) - {TAU!r} * floor((s + {math.pi!r}) / {TAU!r})) - {math.pi!r}, 6) + 0.0 as diff from (select event_id, {SQL_ANGLE} - lag({SQL_ANGLE}) {rows()} + 0.01 as s from events)")
def circ_diff(spark, d):
    part = events(spark, d).withColumn("value", angle() + 0.01 * (F.row_number().over(E.window)))
    return S.difference(part, E, 1, TAU).select("event_id", r6("diff").alias("diff"))


@R.add(f"select event_id, round(coalesce(lag(value, 3) {rows()}, 0), 6) + 0.0 as back, round(coalesce(lead(value, 2) {rows()}, -1), 6) + 0.0 as ahead from events")
def shift_pad(spark, d):
    part = S.shift(events(spark, d), E, 3, 0.0, "back")
    return S.shift(part, E, -2, -1.0, "ahead").select("event_id", r6("back").alias("back"), r6("ahead").alias("ahead"))


@R.add(f"select event_id, round(v + sum(step) {rows('unbounded preceding and current row')}, 6) + 0.0 as linear from (select *, case when v - lag(v) {rows()} < -50 then 100.0 else 0.0 end as step from (select *, (t * 37) % 100 as v from {IX}))")
def unwrap_counter(spark, d):
    part = E.indexed(events(spark, d)).withColumn("value", F.pmod(F.col("t") * 37, F.lit(100)))
    return S.unwrap_counter(part, E, 100).select("event_id", r6("linear").alias("linear"))


@R.add("select l_orderkey, l_linenumber, case when l_quantity < 5 then 5.0 when l_quantity > 40 then 99.0 else l_quantity end as clipped from lineitem")
def threshold_clip(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.threshold(F.col("l_quantity"), 5.0, 40.0, None, 99.0).alias("clipped"))


@R.add("select l_orderkey, l_linenumber, round((l_extendedprice - min(l_extendedprice) over w) / nullif(max(l_extendedprice) over w - min(l_extendedprice) over w, 0) * 2 - 1, 6) + 0.0 as scaled from lineitem window w as (partition by l_suppkey)")
def scale_minmax(spark, d):
    s = SeriesSpec(("l_suppkey",), ("l_orderkey", "l_linenumber"), "l_extendedprice")
    return S.scale_between(table(spark, d, "lineitem"), s, -1, 1).select("l_orderkey", "l_linenumber", r6("scaled").alias("scaled"))


@R.add("""select l_orderkey, l_linenumber, round(least(1, greatest(0, (l_extendedprice - a) / nullif(b - a, 0))), 6) + 0.0 as scaled from (
select *, quantile_cont(l_extendedprice, 0.05) over w as a, quantile_cont(l_extendedprice, 0.95) over w as b from lineitem window w as (partition by l_suppkey))""")
def scale_percentile(spark, d):
    s = SeriesSpec(("l_suppkey",), ("l_orderkey", "l_linenumber"), "l_extendedprice")
    return S.scale_between(table(spark, d, "lineitem"), s, percentiles=(0.05, 0.95)).select("l_orderkey", "l_linenumber", r6("scaled").alias("scaled"))


@R.add(f"""select user_id, min(case when abs(delta) < 5 then t end) as converged_at from (
select user_id, t, case when count(*) over w = 20 then 19 * regr_slope(value, t::double) over w end as delta from {IX} window w as (partition by user_id order by t rows between 20 preceding and 1 preceding)) group by user_id""")
def convergence_point(spark, d):
    return S.convergence(events(spark, d), E, 20, 5.0, gaps=True)


@R.add(f"""select event_id, round(best, 6) + 0.0 as best, (count(*) {rows('9 preceding and current row')} = 10) and max(best) {rows('9 preceding and current row')} - min(best) {rows('9 preceding and current row')} <= 0.05 * abs(best) as stalled
from (select *, min(value) {rows('unbounded preceding and current row')} as best from events)""")
def best_so_far(spark, d):
    return S.stalled(events(spark, d), E, 10, 0.05).select("event_id", r6("best").alias("best"), "stalled")


@R.add(f"select event_id, max((event_type = 'error')::int) {rows('3 preceding and 2 following')} = 1 as wide from events")
def widen_events(spark, d):
    return S.widen(events(spark, d), E, F.col("event_type") == "error", 2, 3).select("event_id", "wide")


RUNS = f"""(select user_id, min(t) as start, count(*) as length, max(n) as n from (
select user_id, t, n, t - row_number() over (partition by user_id order by t) as g from {IX} where event_type <> 'error') group by user_id, g)"""


@R.add(f"select user_id, start, length from {RUNS}")
def all_runs(spark, d):
    return S.runs(events(spark, d), E, F.col("event_type") != "error")


@R.add(f"select user_id, start, length from (select *, row_number() over (partition by user_id order by length desc, start) as k from {RUNS}) where k = 1")
def longest_run(spark, d):
    return S.longest_run(events(spark, d), E, F.col("event_type") != "error")


@R.add(f"""with r as {RUNS}, j as (select user_id, case when start = 0 or start + length = n then -1 else start end as seam, start, length from r),
c as (select user_id, case when seam = -1 and count(*) = 2 and min(start) = 0 then max(start) else min(start) end as start, sum(length)::bigint as length from j group by user_id, seam)
select user_id, start, length from (select *, row_number() over (partition by user_id order by length desc, start) as k from c) where k = 1""")
def longest_run_circular(spark, d):
    return S.longest_run(events(spark, d), E, F.col("event_type") != "error", circular=True)


@R.add(f"""with r as {RUNS} select event_id, exists (select 1 from r where r.user_id = e.user_id and e.t >= r.start and e.t < r.start + r.length and r.length >= 4) as kept from {IX} e""")
def short_runs_removed(spark, d):
    return S.drop_short_runs(events(spark, d), E, F.col("event_type") != "error", 4).select("event_id", "kept")


@R.add(f"""select a.user_id, a.t as event, b.t - a.t as "offset", round(b.value, 6) + 0.0 as value from {IX} a join {IX} b on a.user_id = b.user_id and b.t >= a.t - 3 and b.t < a.t + 4
where a.event_type = 'purchase' and a.t - 3 >= 0 and a.t + 4 <= a.n""")
def event_triggered_traces(spark, d):
    got = S.event_windows(events(spark, d), E, F.col("event_type") == "purchase", -3, 4)
    return got.select("user_id", "event", F.col("offset").cast("long").alias("offset"), r6("value").alias("value"))


@R.add(f"""select b.t - a.t as "offset", round(avg(b.value), 6) + 0.0 as mean, count(*) as n from {IX} a join {IX} b on a.user_id = b.user_id and b.t >= a.t - 3 and b.t < a.t + 4
where a.event_type = 'purchase' and a.t - 3 >= 0 and a.t + 4 <= a.n group by 1""")
def event_triggered_average(spark, d):
    got = S.event_average(events(spark, d), E, F.col("event_type") == "purchase", -3, 4)
    return got.select(F.col("offset").cast("long").alias("offset"), r6("mean").alias("mean"), "n")


@R.add()
def event_average_sorted(spark, d):
    return S.sorted_event_average(events(spark, d), E, F.col("event_type") == "purchase", -3, 4)


@R.add(f"""with w as (select a.user_id, a.t as event, b.t - a.t as o, b.value from {IX} a join {IX} b on a.user_id = b.user_id and b.t >= a.t - 3 and b.t < a.t + 4 where a.event_type = 'purchase' and a.t - 3 >= 0 and a.t + 4 <= a.n),
m as (select user_id, o, avg(value) filter (event % 2 = 0) as train, avg(value) filter (event % 2 = 1) as test from w group by 1, 2),
p as (select user_id, o as peak from (select user_id, o, row_number() over (partition by user_id order by train desc, o) as r from m where train is not null) where r = 1)
select user_id, o as "offset", round(train, 6) + 0.0 as train, round(test, 6) + 0.0 as test, peak from m join p using (user_id)""")
def event_average_by_parity(spark, d):
    got = S.sorted_event_average(events(spark, d), E, F.col("event_type") == "purchase", -3, 4, train=F.col("event") % 2 == 0)
    return got.select("user_id", F.col("offset").cast("long").alias("offset"), r6("train").alias("train"), r6("test").alias("test"), F.col("peak").cast("long").alias("peak"))


@R.add("""select event_id, m as match from (select e.event_id, p.x as m, row_number() over (partition by e.event_id order by abs(p.x - e.x), p.x desc) as k from
(select event_id, user_id, floor(epoch(ts))::bigint as x from events where event_type = 'view') e join (select distinct user_id, floor(epoch(ts))::bigint as x from events where event_type = 'purchase') p on e.user_id = p.user_id) where k = 1""")
def nearest_match(spark, d):
    ev = events(spark, d).withColumn("x", F.unix_timestamp(F.col("ts").cast("timestamp")))
    left = ev.where("event_type = 'view'").select("event_id", "user_id", "x")
    right = ev.where("event_type = 'purchase'").select("user_id", "x").distinct()
    return S.nearest(left, right, ["user_id"], "x").where("match is not null").select("event_id", F.col("match.x").alias("match"))


@R.add("""select e.event_id, count(*) as n from (select event_id, user_id, floor(epoch(ts))::double as x from events) e join (select user_id, floor(epoch(ts))::double as x from events) p
on e.user_id = p.user_id and p.x > e.x - 86400 and p.x < e.x + 43200 group by 1""")
def range_match(spark, d):
    ev = events(spark, d).withColumn("x", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double"))
    return S.range_join(ev.select("event_id", "user_id", "x"), ev.select("user_id", "x"), ["user_id"], "x", 86400, 43200).groupBy("event_id").agg(F.count("*").alias("n"))


KNOTS = f"(select user_id, t::double as x, value as y, lead(t::double) over (partition by user_id order by t) as x1, lead(value) over (partition by user_id order by t) as y1 from {IX} where t % 5 = 0)"


@R.add(f"""select p.user_id, p.x, round(k.y + (k.y1 - k.y) / (k.x1 - k.x) * (p.x - k.x), 5) + 0.0 as y from (select user_id, t + 0.5 as x from {IX}) p
join (select *, row_number() over (partition by user_id order by x) as a, row_number() over (partition by user_id order by x desc) as z from {KNOTS} where x1 is not null) k
on p.user_id = k.user_id and (p.x >= k.x or a = 1) and (p.x < k.x1 or z = 1)""")
def interp_linear(spark, d):
    part = E.indexed(events(spark, d))
    points = part.select("user_id", (F.col("t") + 0.5).cast("double").alias("x"))
    knots = part.where("t % 5 = 0").select("user_id", F.col("t").cast("double").alias("x"), F.col("value").alias("y"))
    return S.interpolate(points, knots, ["user_id"], "x", "y").where("y is not null").select("user_id", "x", (F.round("y", 5) + 0.0).alias("y"))


def _at(j: int, shift: int) -> str:
    return f"{'lag' if j >= shift else 'lead'}(value, {abs(j - shift)}) {rows()}"


def _conv(kernel: list[float], shift: int) -> str:
    return " + ".join(f"{w!r} * coalesce({_at(j, shift)}, 0)" for j, w in enumerate(kernel))


def _share(kernel: list[float], shift: int) -> str:
    return " + ".join(f"{w!r} * (case when {_at(j, shift)} is null then 0 else 1 end)" for j, w in enumerate(kernel))


@R.add(f"select event_id, round({_conv([0.1, 0.2, 0.4, 0.2, 0.1], 2)}, 6) + 0.0 as conv from events")
def convolve_same(spark, d):
    return S.convolve(events(spark, d), E, [0.1, 0.2, 0.4, 0.2, 0.1]).select("event_id", r6("conv").alias("conv"))


@R.add(f"select event_id, round(c, 6) + 0.0 as conv from (select event_id, {_conv([1.0, -2.0, 0.5, 3.0], 1)} as c, lag(value, 2) {rows()} as a, lead(value, 1) {rows()} as b from events) where a is not null and b is not null")
def convolve_valid(spark, d):
    return S.convolve(events(spark, d), E, [1.0, -2.0, 0.5, 3.0], "valid").select("event_id", r6("conv").alias("conv"))


_G = S.gaussian_kernel(1.0)


@R.add(f"select event_id, round(({_conv(_G, len(_G) // 2)}) * {sum(_G)!r} / ({_share(_G, len(_G) // 2)}), 6) + 0.0 as conv from events")
def gaussian_smooth(spark, d):
    return S.convolve(events(spark, d), E, _G, correct_edge=True).select("event_id", r6("conv").alias("conv"))


@R.add(f"""with recursive d as (select user_id, t, value, event_id from {IX}), y as (select user_id, t, value, event_id, 0.0::double as damped from d where t = 0
union all select d.user_id, d.t, d.value, d.event_id, 0.9 * y.damped + d.value - y.value from y join d on d.user_id = y.user_id and d.t = y.t + 1) select event_id, round(damped, 6) + 0.0 as damped from y""")
def dampening_filter(spark, d):
    return S.dampen(events(spark, d).select("event_id", "user_id", "ts", "value"), E, 0.9).select("event_id", r6("damped").alias("damped"))


@R.add(f"""select a.user_id, a.t // 4 as "window", b.t - a.t as "offset", round(b.value, 6) + 0.0 as value from {IX} a join {IX} b on a.user_id = b.user_id and b.t >= a.t and b.t < a.t + 10 where a.t % 4 = 0 and a.t + 10 <= a.n""")
def sliding_windows(spark, d):
    return S.unfold(events(spark, d), E, 10, 4).select("user_id", "window", "offset", r6("value").alias("value"))


@R.add(f"select event_id, t // 8 as batch from (select *, count(*) over (partition by user_id, t // 8) as m from {IX}) where m >= 3")
def make_batches(spark, d):
    return S.batches(events(spark, d), E, 8, 3).select("event_id", "batch")


@R.add(f"select user_id, t // 5 as bin, round(avg(value), 6) + 0.0 as value from {IX} group by 1, 2")
def bin_mean(spark, d):
    return S.bin_by(events(spark, d), E, 5).select("user_id", "bin", r6("value").alias("value"))


@R.add(f"select user_id, t // 5 as bin, round(max(value), 6) + 0.0 as value from {IX} group by 1, 2 having count(*) = 5")
def bin_max_cropped(spark, d):
    return S.bin_by(events(spark, d), E, 5, F.max, crop=True).select("user_id", "bin", r6("value").alias("value"))


@R.add(f"select user_id, round(quantile_cont(abs(d), 0.5) / sqrt(30.0) * 100, 6) + 0.0 as noise from (select user_id, value - lag(value) {rows()} as d from events) group by 1")
def noise_level(spark, d):
    return S.noise_level(events(spark, d), E, 30.0).select("user_id", r6("noise").alias("noise"))


@R.add(f"select user_id, round(quantile_disc(abs(d), 0.5), 6) + 0.0 as mad from (select user_id, value - lag(value) {rows()} as d from events) where d is not null group by 1")
def derivative_mad(spark, d):
    return S.derivative_mad(events(spark, d), E, 1).select("user_id", r6("mad").alias("mad"))


@R.add(f"""select user_id, round(s, 6) + 0.0 as signal, round(v - s, 6) + 0.0 as noise, round(s / nullif(v - s, 0), 6) + 0.0 as snr from (
select user_id, sum(p) / nullif(count(*) - 2, 0) as s, var_samp(z) as v from (select *, z * lag(z) {rows()} as p from (
select *, (value - avg(value) over (partition by user_id)) / nullif(stddev_samp(value) over (partition by user_id), 0) as z from events)) group by 1)""")
def snr_autoregressive(spark, d):
    return S.snr_autoregressive(events(spark, d), E).select("user_id", *(r6(c).alias(c) for c in ("signal", "noise", "snr")))


@R.add(f"""with a as (select *, (value - b) / nullif(b, 0) as f from (select *, quantile_cont(value, 0.3) over (partition by user_id) as b from events)),
m as (select user_id, max(f) as max_dff, quantile_cont(abs(d), 0.5) as mad, var_pop(f) as variance, min(b) as base from (select *, f - lag(f) {rows()} as d from a) group by 1)
select user_id, round(max_dff, 6) + 0.0 as max_dff, round(mad, 6) + 0.0 as mad, round(variance, 6) + 0.0 as variance, coalesce(max_dff between 0 and 15, false) and coalesce(mad between 0 and 1.5, false) as good from m""")
def quality_metrics(spark, d):
    return S.quality(events(spark, d), E, {"max_dff": (0, 15), "mad": (0, 1.5)}).select("user_id", *(r6(c).alias(c) for c in ("max_dff", "mad", "variance")), "good")


_C = f"avg(cos({SQL_ANGLE}))"
_S = f"avg(sin({SQL_ANGLE}))"


@R.add(f"select user_id, round(case when atan2(s, c) < 0 then atan2(s, c) + {TAU!r} else atan2(s, c) end, 5) + 0.0 as circ_mean, round(1 - sqrt(s * s + c * c), 6) + 0.0 as circ_var, round(sqrt(-2 * ln(least(1, sqrt(s * s + c * c)))), 5) + 0.0 as circ_std from (select user_id, {_S} as s, {_C} as c from events group by 1)")
def circ_stats(spark, d):
    got = T.circular(events(spark, d).withColumn("a", angle()), ["user_id"], "a")
    return got.select("user_id", (F.round("circ_mean", 5) + 0.0).alias("circ_mean"), r6("circ_var").alias("circ_var"), (F.round("circ_std", 5) + 0.0).alias("circ_std"))


@R.add(f"select user_id, round((s * s + c * c - n) / nullif(n * (n - 1), 0), 6) + 0.0 as ppc from (select user_id, sum(sin({SQL_ANGLE})) as s, sum(cos({SQL_ANGLE})) as c, count(*) as n from events group by 1)")
def phase_consistency(spark, d):
    return T.phase_consistency(events(spark, d).withColumn("a", angle()), ["user_id"], "a").select("user_id", r6("ppc").alias("ppc"))


@R.add(f"select user_id, round((s * s + c * c - q) / nullif(n * n - q, 0), 6) + 0.0 as ppc from (select user_id, sum(w * sin({SQL_ANGLE})) as s, sum(w * cos({SQL_ANGLE})) as c, sum(w) as n, sum(w * w) as q from (select *, 1.0::double + event_id % 3 as w from events) group by 1)")
def phase_consistency_weighted(spark, d):
    part = events(spark, d).withColumn("a", angle()).withColumn("w", (1 + F.col("event_id") % 3).cast("double"))
    return T.phase_consistency(part, ["user_id"], "a", "w").select("user_id", r6("ppc").alias("ppc"))


@R.add("select date_trunc('day', ts) as start, event_type, count(*) as n, round(sum(value), 4) + 0.0 as total from events group by 1, 2")
def tumbling_events(spark, d):
    got = events(spark, d).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), (F.round(F.sum("value"), 4) + 0.0).alias("total"))
    return got.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@R.add("""select s as start, count(*) as n from (select unnest([date_trunc('hour', ts) - interval 1 hour, date_trunc('hour', ts)]) as s from events) group by 1""")
def sliding_events(spark, d):
    return events(spark, d).groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


@R.add(f"""select user_id, min(ts) as start, count(*) as n from (select *, sum(case when gap is null or gap >= interval 1 day then 1 else 0 end) {rows('unbounded preceding and current row')} as s from (select *, ts - lag(ts) {rows()} as gap from events)) group by user_id, s""")
def session_events(spark, d):
    part = events(spark, d).withColumn("at", F.col("ts").cast("timestamp"))
    return part.groupBy("user_id", F.session_window("at", "1 day").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


_SEG = f"(select a.user_id, a.t // 8 as s, b.t - a.t as o, b.value as x, b.y from {_LAGGED} a join {_LAGGED} b on a.user_id = b.user_id and b.t >= a.t and b.t < a.t + 16 where a.t % 8 = 0 and a.t + 16 <= a.n)"
_SPECTRA = f"""(select user_id, s, k, sum(x * cos(w)) as xr, -sum(x * sin(w)) as xi, sum(y * cos(w)) as yr, -sum(y * sin(w)) as yi from (
select user_id, s, k, (x - avg(x) over g) * h as x, (y - avg(y) over g) * h as y, {TAU!r} * k * o / 16 as w from (select *, 0.5 - 0.5 * cos({TAU!r} * o / 16) as h from {_SEG}), range(9) r(k) window g as (partition by user_id, s, k)) group by user_id, s, k)"""


@R.add(f"""select user_id, k / 16.0::double as frequency, round((pow(sum(xr * yr + xi * yi), 2) + pow(sum(xr * yi - xi * yr), 2)) / nullif(sum(xr * xr + xi * xi) * sum(yr * yr + yi * yi), 0), 5) + 0.0 as coherence from {_SPECTRA} group by 1, 2""")
def coherence(spark, d):
    part = events(spark, d).withColumn("other", F.lag("value", 1, 0.0).over(E.window))
    return spectral.coherence(part, E, "other", nperseg=16).withColumn("coherence", F.round("coherence", 5) + 0.0)


@R.add(f"""select user_id, round(k / max(n)::double, 9) as frequency, round(ln(1 + (pow(sum(x * cos(w)), 2) + pow(sum(x * sin(w)), 2)) / max(n)), 8) + 0.0 as log_power from (
select user_id, k, n, value - avg(value) over (partition by user_id, k) as x, {TAU!r} * ((k * t) % n) / n as w from (select *, unnest(range(n // 2 + 1)) as k from {IX})) group by 1, k""")
def power_spectrum(spark, d):
    # powers of few-decimal values end after a few places at some frequencies; their logarithms don't, so no rounding is a tie
    got = spectral.power(events(spark, d), E)
    return got.select("user_id", F.round("frequency", 9).alias("frequency"), (F.round(F.log(1 + F.col("power")), 8) + 0.0).alias("log_power"))


# the transform of each series as sums: frequency k of n, its angle at t as w; half of the frequencies tell the rest
_TURNS = f"(select *, {TAU!r} * ((k * t) % n) / n as w from (select *, unnest(range(n // 2 + 1)) as k from {IX}))"
_FOURIER = f"(select user_id, k, sum(value * cos(w)) as re, sum(value * sin(w)) as im, case when k = 0 or 2 * k = max(n) then 1 else 2 end as twice from {_TURNS} group by 1, 2)"


@R.add(f"""select event_id, round(sqrt(x * x + q * q), 6) + 0.0 as amplitude, round(coalesce(x / nullif(sqrt(x * x + q * q), 0), 1), 6) + 0.0 as cosine, round(coalesce(q / nullif(sqrt(x * x + q * q), 0), 0), 6) + 0.0 as sine from (
select event_id, any_value(value) as x, sum(twice * (re * sin(w) - im * cos(w))) / any_value(n) as q from {_TURNS} join {_FOURIER} using (user_id, k) group by 1)""")
def hilbert_phase(spark, d):
    # cosine and sine of the phase, as noise around half a turn changes its sign
    got = spectral.hilbert(events(spark, d), E)
    return got.select("event_id", r6("amplitude").alias("amplitude"), r6(F.cos("phase")).alias("cosine"), r6(F.sin("phase")).alias("sine"))


@R.add(f"""select event_id, round(sum(twice * (re * cos(w) + im * sin(w)) * case when k = 0 then 0 else 1 / (1 + pow(k / n / 0.3, 8)) / (1 + pow(0.05 * n / k, 8)) end) / any_value(n), 6) + 0.0 as filtered
from {_TURNS} join {_FOURIER} using (user_id, k) group by 1""")
def bandpass(spark, d):
    return spectral.butter_bandpass(events(spark, d), E, 0.05, 0.3, 1.0).select("event_id", r6("filtered").alias("filtered"))


_GAIN = "exp(-0.5 * pow((k / n - frequency) * 6 / frequency, 2)) * (k > 0 and 2 * k < n)::int"


@R.add(f"""select user_id, t, frequency, round((pow(sum({_GAIN} * (re * cos(w) + im * sin(w))), 2) + pow(sum({_GAIN} * (re * sin(w) - im * cos(w))), 2)) / pow(any_value(n), 2), 6) + 0.0 as power
from {_TURNS} join {_FOURIER} using (user_id, k), (values (0.05::double), (0.1::double), (0.2::double)) f(frequency) group by 1, 2, 3""")
def wavelet_power(spark, d):
    return spectral.morlet(events(spark, d), E, [0.05, 0.1, 0.2], 1.0).withColumn("power", r6("power"))


_TAPERS = ", ".join(f"({j}, {o}, {float(v)!r}::double)" for j, taper in enumerate(spectral.slepian(32, 2.5, 4)) for o, v in enumerate(taper))


@R.add(f"""with s as (select user_id, "window", t - 16 * "window" as o, value - avg(value) over (partition by user_id, "window") as x from (select *, unnest(range(greatest(0, (n - 32) // 16 + 1)::bigint)) as "window" from {IX}) where t >= 16 * "window" and t < 16 * "window" + 32),
p as (select user_id, "window", k, j, pow(sum(x * v * cos({TAU!r} * ((k * o) % 32) / 32)), 2) + pow(sum(x * v * sin({TAU!r} * ((k * o) % 32) / 32)), 2) as power from s join (values {_TAPERS}) h(j, o, v) using (o), range(17) f(k) group by 1, 2, 3, 4)
select user_id, "window", k / 32 as frequency, round(avg(power), 6) + 0.0 as power from p group by 1, 2, 3""")
def spectrogram(spark, d):
    # the oracle takes the tapers as numbers; tests hold them against their definition
    return spectral.multitaper(events(spark, d), E, 32, 16).withColumn("power", r6("power"))


QUERIES, ORACLES = R.queries, R.oracles
