"""Series too long for one task, joins of points and polygons, cubes and reducers of one's own."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import blocks as B
from tidemark.operators import matrix as M
from tidemark.operators import series as S
from tidemark.queries import series as by_series
from tidemark.queries.common import Registry, r6, table
from tidemark.queries.series import _G, IX, E, events

R = Registry()
#: Positions in a block; short, so that series of the test tables are cut as well.
BLOCK = 64


def placed(spark, d):
    """Events with their positions, by way of the counts of their days."""
    return B.long_positions(events(spark, d), E, F.to_date("ts"))


@R.add(f"select event_id, t::bigint as t from {IX}")
def long_positions(spark, d):
    return placed(spark, d).select("event_id", "t")


@R.add(by_series.ORACLES["dff_rolling"])
def dff_rolling_blocks(spark, d):
    got = B.in_blocks(placed(spark, d), E, BLOCK, 10, 10, lambda part, spec: S.dff(part, spec, width=21))
    return got.select("event_id", r6("baseline").alias("baseline"), r6("dff").alias("dff"))


@R.add(by_series.ORACLES["moving_moments"])
def moving_moments_blocks(spark, d):
    got = B.in_blocks(placed(spark, d), E, BLOCK, 6, 0, lambda part, spec: S.moving(part, spec, 7))
    return got.select("event_id", *((F.round(c, 9) + 0.0).alias(c) for c in ("moving_mean", "moving_var", "moving_square")))


@R.add(by_series.ORACLES["gaussian_smooth"])
def gaussian_smooth_blocks(spark, d):
    half = len(_G) // 2
    got = B.in_blocks(placed(spark, d), E, BLOCK, half, half, lambda part, spec: S.convolve(part, spec, _G, correct_edge=True))
    return got.select("event_id", r6("conv").alias("conv"))


_CORNERS = "(select n_nationkey as poly, k, n_nationkey * 2.0 + 0.3 + [0, 4.1, 0, -2.2][k + 1] as px, n_nationkey % 5 * 2.0 + 0.2 + [-1.6, 0, 3.3, 0][k + 1] as py from nation, range(4) r(k))"


@R.add(f"""with e as (select poly, px as x1, py as y1, coalesce(lead(px) over w, first_value(px) over w) as x2, coalesce(lead(py) over w, first_value(py) over w) as y2 from {_CORNERS} window w as (partition by poly order by k)),
p as (select l_quantity as x, l_discount * 100 as y, count(*) as m from lineitem group by 1, 2),
h as (select poly, x, y, any_value(m) as m from p, e where (y < y1) <> (y < y2) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 group by 1, 2, 3 having count(*) % 2 = 1) select poly, sum(m)::bigint as n from h group by 1""")
def points_in_polygons(spark, d):
    k = F.posexplode(F.array(*(F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in ((0.0, -1.6), (4.1, 0.0), (0.0, 3.3), (-2.2, 0.0)))))
    corners = table(spark, d, "nation").select("n_nationkey", k.alias("k", "at"))
    corners = corners.select(F.col("n_nationkey").alias("poly"), "k", (F.col("n_nationkey") * 2.0 + 0.3 + F.col("at.dx")).alias("px"), (F.col("n_nationkey") % 5 * 2.0 + 0.2 + F.col("at.dy")).alias("py"))
    points = table(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("x"), (F.col("l_discount") * 100).cast("double").alias("y"))
    return M.within_polygons(points, corners, "x", "y", 2.0, boundary=False).groupBy("poly").agg(F.count("*").alias("n"))


@R.add("select l_returnflag, l_linestatus, count(*) as n, round(avg(l_quantity), 6) + 0.0 as mean, grouping(l_returnflag, l_linestatus)::bigint as level from lineitem group by cube (l_returnflag, l_linestatus)")
def cube_totals(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), r6(F.avg("l_quantity")).alias("mean"), F.grouping_id().alias("level"))


@R.add(f"select user_id, t // 8 as bin, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) + 0.0 as value from {IX} group by 1, 2")
def bin_by_own_reducer(spark, d):
    @F.pandas_udf("double")
    def spread(v: pd.Series) -> float:
        return float(v.quantile(0.75) - v.quantile(0.25))

    return S.bin_by(events(spark, d), E, 8, spread).select("user_id", "bin", r6("value").alias("value"))


QUERIES, ORACLES = R.queries, R.oracles
