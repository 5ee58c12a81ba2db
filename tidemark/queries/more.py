"""Positions, tests of two samples, trace quality, bases, images and values that the other modules' queries don't meet."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import bases
from tidemark.functions import scalar as C
from tidemark.functions.scalar import TAU
from tidemark.operators import images as I
from tidemark.operators import matrix as M
from tidemark.operators import positions as P
from tidemark.operators import series as S
from tidemark.operators import statistics as T
from tidemark.plans import models, tensors
from tidemark.queries.common import Registry, r6, table
from tidemark.queries.matrices import IMAGES, image
from tidemark.queries.series import IX, SQL_ANGLE, E, W, angle, events, rows

R = Registry()


# ---- positions


@R.add(f"select user_id, t from {IX} where event_type = 'error'")
def true_positions(spark, d):
    return P.positions(events(spark, d), E, F.col("event_type") == "error")


@R.add(f"""with p as (select user_id, t from {IX} where event_type = 'error'), m as (select user_id, max(t) as top from p group by 1)
select m.user_id, g.t, p.t is not null as flag from (select user_id, unnest(range(top + 1)) as t, top from m) g join m on m.user_id = g.user_id left join p on p.user_id = g.user_id and p.t = g.t""")
def flags_at_positions(spark, d):
    return P.flags(P.positions(events(spark, d), E, F.col("event_type") == "error"), ["user_id"], "t")


@R.add(f"select user_id, t from (select user_id, t, row_number() over (partition by user_id order by t) as k from {IX} where event_type = 'purchase') where k = 3")
def nth_true(spark, d):
    return P.nth_true(events(spark, d), E, F.col("event_type") == "purchase", 2)


@R.add(f"select user_id, t from (select user_id, t, row_number() over (partition by user_id order by t desc) as k from {IX} where event_type = 'purchase') where k = 2")
def nth_true_from_end(spark, d):
    return P.nth_true(events(spark, d), E, F.col("event_type") == "purchase", -2)


@R.add(f"select user_id, max(t) as t from {IX} where event_type = 'purchase' group by 1")
def last_true(spark, d):
    return P.last_true(events(spark, d), E, F.col("event_type") == "purchase")


@R.add("""select w.l_orderkey, w.l_linenumber, coalesce(p.position, -1)::bigint as position from (select l_orderkey, l_linenumber, l_suppkey, (l_orderkey % 60)::double as q from lineitem) w
left join (select l_suppkey, l_quantity as q, min(k) - 1 as position from (select *, row_number() over (partition by l_suppkey order by l_quantity, l_orderkey, l_linenumber) as k from lineitem) group by 1, 2) p on p.l_suppkey = w.l_suppkey and p.q = w.q""")
def sorted_search(spark, d):
    from tidemark.spec import SeriesSpec

    li = table(spark, d, "lineitem")
    s = SeriesSpec(("l_suppkey",), ("l_orderkey", "l_linenumber"), "l_quantity")
    wanted = li.select("l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_orderkey") % 60).cast("double").alias("q"))
    return P.search(li, s, wanted, "q").select("l_orderkey", "l_linenumber", "position")


@R.add(f"""select a.event_id, round(b.value, 6) + 0.0 as taken from (select event_id, user_id, case when event_id % 5 = 0 then null else t // 2 + 7 end as at from {IX}) a left join {IX} b on a.user_id = b.user_id and a.at = b.t""")
def take_at(spark, d):
    part = E.indexed(events(spark, d)).withColumn("at", F.when(F.col("event_id") % 5 != 0, F.floor(F.col("t") / 2) + 7))
    return P.take(events(spark, d), E, part.select("event_id", "user_id", "at"), "at").select("event_id", r6("taken").alias("taken"))


@R.add("""with recursive w as (select 0 as step, 100::bigint as node union all select step + 1, p.p_partkey // 2 from w join part p on p.p_partkey = w.node where w.node <> 3) select step, node from w""")
def path_between_nodes(spark, d):
    previous = table(spark, d, "part").select(F.lit(3).alias("target"), F.col("p_partkey").alias("node"), F.floor(F.col("p_partkey") / 2).alias("previous"))
    return P.path_between(previous, 100, 3)


# ---- statistics


@R.add("""with x as (select l_suppkey as g, l_extendedprice as x, l_returnflag = 'R' as s from lineitem),
m as (select g, count(*) filter (not s)::double as n1, count(*) filter (s)::double as n2, avg(x) filter (not s) as m1, avg(x) filter (s) as m2, var_samp(x) filter (not s) as v1, var_samp(x) filter (s) as v2 from x group by g),
r as (select g, s, rank() over (partition by g order by x) + (count(*) over (partition by g, x) - 1) / 2.0 as k from x), u as (select g, sum(k) filter (not s) as w from r group by g)
select g as l_suppkey, round((m1 - m2) / nullif(sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / nullif(n1 + n2 - 2, 0) * (1 / n1 + 1 / n2)), 0), 6) + 0.0 as t, round((m1 - m2) / nullif(sqrt(v1 / n1 + v2 / n2), 0), 6) + 0.0 as welch,
round(pow(v1 / n1 + v2 / n2, 2) / nullif(pow(v1 / n1, 2) / nullif(n1 - 1, 0) + pow(v2 / n2, 2) / nullif(n2 - 1, 0), 0), 4) + 0.0 as welch_dof, (w - n1 * (n1 + 1) / 2)::double as u from m join u using (g)""")
def two_sample_tests(spark, d):
    got = T.two_sample_tests(table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", F.col("l_returnflag") == "R")
    return got.select("l_suppkey", r6("t").alias("t"), r6("welch").alias("welch"), (F.round("welch_dof", 4) + 0.0).alias("welch_dof"), F.col("u").cast("double").alias("u"))


@R.add(f"select user_id, round((s * s + c * c - n) / nullif(n * (n - 1), 0), 6) + 0.0 as ppc from (select user_id, sum(w * sin({SQL_ANGLE})) as s, sum(w * cos({SQL_ANGLE})) as c, count(*)::double as n from (select *, 0.5 + (event_id % 4) / 4.0::double as w from events) group by 1)")
def phase_consistency_windowed(spark, d):
    part = events(spark, d).withColumn("a", angle()).withColumn("w", 0.5 + (F.col("event_id") % 4) / 4.0)
    return T.phase_consistency_windowed(part, ["user_id"], "a", "w").select("user_id", r6("ppc").alias("ppc"))


@R.add("""with s as (select user_id as series, event_type as f, date_trunc('day', ts) as d, sum(value) as v from events group by all), m as (select d, sum(v) / count(distinct series) as m from s group by d)
select series, f, s.d, round(v / (0.05 * m + 0.95), 6) + 0.0 as normalised from s join m on s.d = m.d""")
def magnitude_normalised(spark, d):
    part = events(spark, d).groupBy(F.col("user_id").alias("series"), F.col("event_type").alias("f"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("d")).agg(F.sum("value").alias("v"))
    return S.magnitude_normalised(part, "series", "d", "v").select("series", "f", "d", r6("normalised").alias("normalised"))


_TRACE = "(select *, value + 50.0 as f, 0.3 * value + (event_id % 17)::double as fneu from events)"


@R.add(f"""with a as (select *, f - 0.7 * fneu as sub from {_TRACE}), b as (select *, quantile_cont(sub, 0.3) over (partition by user_id) as base, quantile_cont(sub, 0.3) {rows('10 preceding and 10 following')} as roll from a),
c as (select *, (sub - base) / nullif(base, 0) as dff from b),
e as (select *, (dff - avg(dff) over (partition by user_id)) / nullif(stddev_samp(dff) over (partition by user_id), 0) as z, dff - lag(dff) {W.format('')} as d1,
  row_number() over (partition by user_id order by f) - 1 as kf, row_number() over (partition by user_id order by sub) - 1 as ks, count(*) over (partition by user_id) as n from c),
g as (select *, d1 - lag(d1) {W.format('')} as d2, z * lag(z) {W.format('')} as zz from e),
m as (select user_id, var_samp(fneu) / nullif(var_samp(f), 0) as var_ratio, pow(corr(f, fneu), 2) as explained, max(dff) as max_dff, var_samp(roll) / nullif(pow(avg(roll), 2), 0) as baseline_var,
  sum(zz) / nullif(count(*) - 2, 0) as s, var_samp(z) as v, quantile_disc(abs(d2), 0.5) filter (d2 is not null) / 30.0 as noise,
  max(case when kf = round_even(0.3 * (n - 1), 0) then f end) as base, max(case when ks = round_even(0.3 * (n - 1), 0) then sub end) as base_subtracted from g group by 1)
select user_id, round(var_ratio, 6) + 0.0 as var_ratio, round(explained, 6) + 0.0 as explained, round(max_dff, 6) + 0.0 as max_dff, round(baseline_var, 6) + 0.0 as baseline_var, round(base, 6) + 0.0 as base,
round(base_subtracted, 6) + 0.0 as base_subtracted, round(1 / nullif(s / nullif(v - s, 0), 0), 3) + 0.0 as nsr, round(noise, 6) + 0.0 as noise from m""")
def trace_quality(spark, d):
    part = events(spark, d).withColumns({"fneu": 0.3 * F.col("value") + (F.col("event_id") % 17).cast("double"), "f": F.col("value") + 50.0})
    from tidemark.spec import SeriesSpec

    got = S.trace_quality(part, SeriesSpec(E.keys, E.order, "f"), "fneu", width=21)
    return got.select("user_id", *(r6(c).alias(c) for c in ("var_ratio", "explained", "max_dff", "baseline_var", "base", "base_subtracted", "noise")), (F.round("nsr", 3) + 0.0).alias("nsr"))


# ---- bases and tensors


_AXIS, _BASIS = np.linspace(0.0, 100.0, 41), bases.raised_cosines(4, 41).round(9)
_LISTS = "[" + ", ".join(f"[{', '.join(repr(float(v)) for v in r)}]" for r in _BASIS) + "]"


@R.add(f"select event_id, round(b[1], 6) + 0.0 as b0, round(b[2], 6) + 0.0 as b1, round(b[3], 6) + 0.0 as b2, round(b[4], 6) + 0.0 as b3 from (select event_id, list_extract({_LISTS}, (greatest(0, least(40, ceil(value / 2.5 - 0.5))) + 1)::int) as b from events)")
def basis_expansion(spark, d):
    got = bases.expanded(events(spark, d), "value", _AXIS, _BASIS)
    return got.select("event_id", *(r6(F.col("basis")[k]).alias(f"b{k}") for k in range(4)))


@R.add(f"select wave, i, round(cos({TAU!r} * 2.5 * i / 199 - wave * {TAU!r} / 3), 6) + 0.0 as value from range(3) a(wave), range(200) b(i)")
def multiphase(spark, d):
    return bases.multiphase(spark, 200, 2.5, 3).select("wave", "i", r6("value").alias("value"))


@R.add("select c_custkey, c_mktsegment[1] = 'A' as a, c_mktsegment[1] = 'B' as b, c_mktsegment[1] = 'M' as m from customer")
def one_hot_strings(spark, d):
    flags = bases.one_hot_of(F.lower("c_mktsegment"), ["a", "B", "machinery"])
    return table(spark, d, "customer").select("c_custkey", *(flags[k].alias(n) for k, n in enumerate("abm")))


_F = "(select m as mode, i as idx, r, (1 + ((m * 7 + i * 3 + r * r) % 5))::double as v from range(3) a(m), range(4) b(i), range(3) c(r))"
_DENSE = "(select a.i as i0, b.i as i1, c.i as i2, ((a.i * 5 + b.i * 3 + c.i * c.i) % 7)::double as v from range(4) a(i), range(4) b(i), range(4) c(i))"


def _tensor(spark):
    n = spark.range(36).select(F.floor(F.col("id") / 12).alias("mode"), F.floor(F.pmod("id", F.lit(12)) / 3).alias("idx"), F.pmod("id", F.lit(3)).alias("r"))
    factors = n.withColumn("v", (1 + F.pmod(F.col("mode") * 7 + F.col("idx") * 3 + F.col("r") * F.col("r"), F.lit(5))).cast("double"))
    c = spark.range(64).select(F.floor(F.col("id") / 16).alias("i0"), F.pmod(F.floor(F.col("id") / 4), F.lit(4)).alias("i1"), F.pmod("id", F.lit(4)).alias("i2"))
    return factors, c.withColumn("v", F.pmod(F.col("i0") * 5 + F.col("i1") * 3 + F.col("i2") * F.col("i2"), F.lit(7)).cast("double"))


@R.add(f"""with p as (select x.r, d.v as t, x.v * y.v * z.v as p from {_F} x, {_F} y, {_F} z, {_DENSE} d where x.mode = 0 and y.mode = 1 and z.mode = 2 and x.r = y.r and y.r = z.r and d.i0 = x.idx and d.i1 = y.idx and d.i2 = z.idx)
select r, round(pow(corr(t, p), 2), 6) + 0.0 as explained, (row_number() over (order by round(pow(corr(t, p), 2), 9) desc, r) - 1)::int as place from p group by r""")
def cp_order(spark, d):
    factors, dense = _tensor(spark)
    return tensors.order_by_explained(dense, factors, 3).select("r", r6("explained").alias("explained"), F.col("place").cast("int").alias("place"))


@R.add(f"""select round(1 - var_pop(t - p) / var_pop(t), 6) + 0.0 as explained from (select d.i0, d.i1, d.i2, max(d.v) as t, sum(x.v * y.v * z.v) * 0.01 as p from {_F} x, {_F} y, {_F} z, {_DENSE} d
where x.mode = 0 and y.mode = 1 and z.mode = 2 and x.r = y.r and y.r = z.r and d.i0 = x.idx and d.i1 = y.idx and d.i2 = z.idx group by 1, 2, 3)""")
def cp_explained(spark, d):
    factors, dense = _tensor(spark)
    model = M.from_factors(factors).withColumn("v", F.col("v") * 0.01)
    return tensors.explained_variance(dense, model, 3).select(r6("explained").alias("explained"))


# ---- images


@R.add(f"select img, y, x, round(w - min(w) over (partition by img), 8) + 0.0 as v from (select img, y, x, 2 * v / (sum(v) over (partition by img) + 1e-9) as w from {IMAGES})")
def image_scale_sum(spark, d):
    return I.scale_sum(image(spark, d), 2.0).withColumn("v", F.round("v", 8) + 0.0)


@R.add(f"select img, y, x, least(40, greatest(10, v)) + 0.0 as clipped, floor(least(1, greatest(0, v / 50)) * 255)::int as u8 from {IMAGES}")
def image_clip(spark, d):
    return image(spark, d).select("img", "y", "x", (I.clip(F.col("v"), 10, 40) + 0.0).alias("clipped"), I.to_uint8(F.col("v"), 50.0).cast("int").alias("u8"))


@R.add(f"select img, y, x, v + 0.0 as v, c::int as c from {IMAGES}, range(3) r(c)")
def image_tile(spark, d):
    return I.tile_channels(image(spark, d), 3).withColumn("v", F.col("v") + 0.0)


@R.add(f"select img, y, x, case when y < 1 or x < 1 or y >= 7 or x >= 4 then 0.0 else v end + 0.0 as v from {IMAGES}")
def image_border(spark, d):
    return I.mask_border(image(spark, d), 8, 5, 1).withColumn("v", F.col("v") + 0.0)


@R.add(f"select img, y + 2 as y, x + 3 as x, v + 0.0 as v from {IMAGES}")
def image_pad(spark, d):
    return I.pad_centre(image(spark, d), 8, 5, (12, 11)).withColumn("v", F.col("v") + 0.0)


@R.add(f"""select img, y, x, greatest(0, least(7, y - 3)) as cy, greatest(0, least(4, x + 2)) as cx, (y + 5) % 8 as wy, (x + 2) % 5 as wx, abs(y - 3) as ry, case when x + 2 < 5 then x + 2 else 8 - (x + 2) end as rx from {IMAGES}""")
def image_shift_maps(spark, d):
    out = image(spark, d).drop("v")
    for edge in ("clip", "wrap", "reflect"):
        out = I.shift_to_map(out, 3, -2, 8, 5, edge).withColumnsRenamed({"from_y": f"{edge[0]}y", "from_x": f"{edge[0]}x"})
    return out


@R.add(f"""select img, y, x, y + v as my, x - v / 2 as mx, round((x - v / 2) * 2 / 4 - 1, 6) + 0.0 as nx, round((0.5 * x - 2 * y + 1) / (0.01 * x + 0.02 * y + 1), 6) + 0.0 as wx, round((x + y) / (0.01 * x + 0.02 * y + 1), 6) + 0.0 as wy from {IMAGES}""")
def image_maps(spark, d):
    part = I.flow_to_map(image(spark, d).withColumns({"dy": F.col("v"), "dx": -F.col("v") / 2}))
    back = I.map_to_flow(part.withColumnsRenamed({"map_y": "my", "map_x": "mx"}).withColumns({"map_y": F.col("my"), "map_x": F.col("mx")}))
    back = back.withColumns({"my": F.col("y") + F.col("dy"), "mx": I.pixel_map(I.normalised_map(F.col("x") + F.col("dx"), 5), 5), "nx": I.normalised_map(F.col("mx"), 5)})
    warped = I.warp_map(back, [[0.5, -2, 1], [1, 1, 0], [0.01, 0.02, 1]])
    return warped.select("img", "y", "x", "my", (F.col("x") - F.col("v") / 2).alias("mx"), r6("nx").alias("nx"), r6("map_x").alias("wx"), r6("map_y").alias("wy"))


@R.add(f"select img * 5 + x as img, y, v + 0.0 as v from {IMAGES}")
def image_channels(spark, d):
    return I.flatten_channels(image(spark, d).withColumnRenamed("x", "c"), 5).select("img", "y", (F.col("v") + 0.0).alias("v"))


@R.add(f"""select img, y, 0::bigint as x, round(least(1, sum(v * case x when 0 then 0.01 when 1 then 0.005 else 0 end)), 6) + 0.0 as r, round(least(1, sum(v * case x when 2 then 0.02 else 0 end)), 6) + 0.0 as g,
round(least(1, sum(v * case x when 1 then 0.005 when 3 then 0.1 else 0 end)), 6) + 0.0 as b from {IMAGES} where x < 4 group by 1, 2""")
def image_rgb(spark, d):
    part = image(spark, d).where("x < 4").withColumnRenamed("x", "c").withColumn("x", F.lit(0).cast("long"))
    got = I.to_rgb(part, [(0.01, 0, 0), (0.005, 0, 0.005), (0, 0.02, 0), (0, 0, 0.1)])
    return got.select("img", "y", "x", *(r6(c).alias(c) for c in "rgb"))


@R.add(f"""select y, x, round(case when p < 3 then (cos(p / 3 * {math.pi!r}) + 1) / 2 else 0 end, 6) + 0.0 as cosine, round(1 / (1 + pow(p / 3.0, 4)) * (1 - 1 / (1 + pow(p / 1.0, 4))), 6) + 0.0 as mask
from (select y, x, sqrt(pow(y - 4, 2) + pow(x - 4, 2)) as p from range(9) a(y), range(9) b(x))""")
def kernels_2d(spark, d):
    a = I.cosine_2d(spark, 9, 9, 3).withColumnRenamed("v", "cosine")
    return a.join(I.fourier_mask(spark, 9, 9, 1, 3, 2).withColumnRenamed("v", "mask"), ["y", "x"]).select("y", "x", r6("cosine").alias("cosine"), r6("mask").alias("mask"))


# ---- values


@R.add(f"""select p_partkey, round((a + b + {math.pi!r}) - {TAU!r} * floor((a + b + {math.pi!r}) / {TAU!r}) - {math.pi!r}, 6) + 0.0 as added, round((a - b + {math.pi!r}) - {TAU!r} * floor((a - b + {math.pi!r}) / {TAU!r}) - {math.pi!r}, 6) + 0.0 as subtracted,
round(exp(ln(0.1) + p_size * (ln(50) - ln(0.1)) / 49), 6) + 0.0 as spaced, round(p_retailprice / 1000, 6) + 0.0 as kb, round(cos(a), 6) + 0.0 as r00, round(-sin(a), 6) + 0.0 as r01 from (select *, p_size / 7.0 as a, p_retailprice / 500 as b from part)""")
def scalar_circular(spark, d):
    part = table(spark, d, "part").withColumns({"a": F.col("p_size") / 7.0, "b": F.col("p_retailprice") / 500})
    turn = C.rotation(F.col("a"))
    return part.select("p_partkey", r6(C.circ_add(F.col("a"), F.col("b"))).alias("added"), r6(C.circ_subtract(F.col("a"), F.col("b"))).alias("subtracted"), r6(C.log_spaced(F.col("p_size"), 0.1, 50, 50)).alias("spaced"),
                       r6(C.convert_size(F.col("p_retailprice"), "KB")).alias("kb"), r6(turn[0][0]).alias("r00"), r6(turn[0][1]).alias("r01"))


@R.add("""select a.vec_id, round(degrees(acos(list_dot_product(a.embedding::double[], b.embedding::double[]) / sqrt(list_dot_product(a.embedding::double[], a.embedding::double[]) * list_dot_product(b.embedding::double[], b.embedding::double[])))), 4) + 0.0 as angle,
a.vec_id // 12 as u0, a.vec_id // 4 % 3 as u1, a.vec_id % 4 as u2 from embeddings a, (select embedding from embeddings where vec_id = (select min(vec_id) from embeddings)) b where a.vec_id > (select min(vec_id) from embeddings)""")
def vector_angles(spark, d):
    v = table(spark, d, "embeddings")
    first = v.agg(F.min_by("embedding", "vec_id").alias("b"), F.min("vec_id").alias("low"))  # one row
    at = M.unravel(F.col("vec_id"), [1 << 40, 3, 4])
    return v.crossJoin(F.broadcast(first)).where("vec_id > low").select("vec_id", (F.round(M.angle(F.col("embedding"), F.col("b"), True), 4) + 0.0).alias("angle"), *(at[k].cast("long").alias(f"u{k}") for k in range(3)))


_CELLS = "(select l_suppkey % 20 as i, l_linenumber::bigint as j, round(sum(l_tax), 4) as v from lineitem group by 1, 2)"


@R.add(f"select j as i, i as j, v + 0.0 as v, i = j as diagonal from {_CELLS}")
def sparse_permute(spark, d):
    cells = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("i"), F.col("l_linenumber").cast("long").alias("j")).agg(F.round(F.sum("l_tax"), 4).alias("v"))
    turned = M.permute(cells)
    return turned.join(M.diagonal(turned).select("i", "j", F.lit(True).alias("diagonal")), ["i", "j"], "left").select("i", "j", (F.col("v") + 0.0).alias("v"), F.coalesce("diagonal", F.lit(False)).alias("diagonal"))


@R.add("select l_orderkey, l_linenumber, floor(l_orderkey / 100)::bigint as g, c_name is null as odd from lineitem left join (select c_custkey, c_name from customer where c_acctbal > 0) on c_custkey = l_orderkey % 97")
def groups_of_rows(spark, d):
    li, c = table(spark, d, "lineitem"), table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_name")
    part = li.join(c, F.col("c_custkey") == F.col("l_orderkey") % 97, "left")
    return part.select("l_orderkey", "l_linenumber", models.group_of(F.col("l_orderkey"), 100).alias("g"), F.col("c_name").isNull().alias("odd"))


@R.add(f"select user_id, rank, t from (select user_id, t, row_number() over (partition by user_id order by value, t) - 1 as rank from {IX})")
def sorted_positions(spark, d):
    return P.sorted_positions(events(spark, d), E)


@R.add(f"select user_id, arg_min(t, value * 1000000 + t * 1e-3) as argmin, arg_max(t, value * 1000000 - t * 1e-3) as argmax from {IX} group by 1")
def extreme_positions(spark, d):
    return P.extreme_positions(events(spark, d), E)


@R.add("select o_orderkey, concat_ws(',', o_custkey, o_orderkey, 7, o_orderkey % 3) as flat from orders")
def flat_arrays(spark, d):
    from tidemark.functions.nested import flat

    key = F.col("o_orderkey")
    nested = F.array(F.array(F.array(F.col("o_custkey"), key)), F.array(F.array(F.lit(7).cast("long")), F.array(key % 3)))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(flat(nested, 3), ",").alias("flat"))


@R.add(f"select a.i, a.j, round(a.v * b.v, 6) + 0.0 as v from {_CELLS} a join (select i, j, v from {_CELLS} where (i + j) % 2 = 0) b on a.i = b.i and a.j = b.j")
def sparse_times(spark, d):
    cells = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("i"), F.col("l_linenumber").cast("long").alias("j")).agg(F.round(F.sum("l_tax"), 4).alias("v"))
    return M.times(cells, cells.where("(i + j) % 2 = 0")).withColumn("v", r6("v"))


@R.add(f"select r.i, c.j, coalesce(v, -1) + 0.0 as v from range(25) r(i) cross join range(12) c(j) left join {_CELLS} x on x.i = r.i and x.j = c.j")
def sparse_filled(spark, d):
    cells = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("i"), F.col("l_linenumber").cast("long").alias("j")).agg(F.round(F.sum("l_tax"), 4).alias("v"))
    return M.filled(cells, 25, 12, -1).withColumn("v", F.col("v") + 0.0)


@R.add(f"select img, y + 2 as y, x + 1 as x, v + 0.0 as r, v + 0.0 as g, v + 0.0 as b from {IMAGES}")
def image_square(spark, d):
    square = I.make_square(image(spark, d), 8, 10)
    return I.grey_to_rgb(square.withColumns({"y": F.col("y") + 1, "x": F.col("x") + 1})).select("img", "y", "x", *((F.col(c) + 0.0).alias(c) for c in "rgb"))


@R.add("""select l_orderkey, l_linenumber, round(l_extendedprice - (b1 * (l_quantity - mx) + b2 * (l_tax - mz)), 2) + 0.0 as rest from lineitem, (
select (covar_pop(l_extendedprice, l_quantity) * var_pop(l_tax) - covar_pop(l_extendedprice, l_tax) * covar_pop(l_quantity, l_tax)) / (var_pop(l_quantity) * var_pop(l_tax) - pow(covar_pop(l_quantity, l_tax), 2)) as b1,
(covar_pop(l_extendedprice, l_tax) * var_pop(l_quantity) - covar_pop(l_extendedprice, l_quantity) * covar_pop(l_quantity, l_tax)) / (var_pop(l_quantity) * var_pop(l_tax) - pow(covar_pop(l_quantity, l_tax), 2)) as b2,
avg(l_quantity) as mx, avg(l_tax) as mz from lineitem)""")
def orthogonalise_many(spark, d):
    rest, _, _ = models.orthogonalise_from(table(spark, d, "lineitem"), ["l_extendedprice"], ["l_quantity", "l_tax"])
    return rest.select("l_orderkey", "l_linenumber", (F.round("l_extendedprice_rest", 2) + 0.0).alias("rest"))


@R.add("""select y, x, case when s between 0 and 8 then round(1 + cos(s * 2 * pi() / 8 - pi()), 9) + 0.0 else 0.0 end as v from (
select y, x, ceil(sqrt((y - 6) * (y - 6) + (x - 6) * (x - 6)))::bigint - 1 - 4 as s from range(13) a(y), range(13) b(x))""")
def cosine_torus(spark, d):
    return I.cosine_torus(spark, 4, 9).select("y", "x", (F.round("v", 9) + 0.0).alias("v"))


QUERIES, ORACLES = R.queries, R.oracles
