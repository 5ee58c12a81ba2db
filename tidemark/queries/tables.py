"""Group statistics, scalar functions, nested values, text and paths, table operations."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.functions import nested as N
from tidemark.functions import scalar as C
from tidemark.operators import statistics as T
from tidemark.plans import models
from tidemark.queries.common import Registry, r6, table
from tidemark.sources import tables as S

R = Registry()


def shared(spark: SparkSession) -> None:
    """checkpoint() needs a folder: the one the cluster names, or a temporary one where it names none."""
    at, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not at and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at or tempfile.mkdtemp(prefix="tidemark-"))


def lineitem(spark, d):
    return table(spark, d, "lineitem")


@R.add("""select l_suppkey, count(*) as n, round(avg(l_quantity), 6) + 0.0 as mean, round(var_pop(l_quantity), 5) + 0.0 as var0, round(var_samp(l_quantity), 5) + 0.0 as var1, round(stddev_pop(l_quantity), 6) + 0.0 as std0, round(stddev_samp(l_quantity), 6) + 0.0 as std1, min(l_quantity) as low, max(l_quantity) as high from lineitem group by 1""")
def nan_moments(spark, d):
    m = T.moments(lineitem(spark, d), ["l_suppkey"], "l_quantity")
    return m.select("l_suppkey", "n", r6("mean").alias("mean"), *((F.round(c, 5) + 0.0).alias(c) for c in ("var0", "var1")), r6("std0").alias("std0"), r6("std1").alias("std1"), "low", "high")


@R.add("select l_suppkey, round(exp(avg(ln(l_extendedprice))), 4) + 0.0 as geometric_mean from lineitem group by 1")
def geometric_mean(spark, d):
    return T.geometric_mean(lineitem(spark, d), ["l_suppkey"], "l_extendedprice").select("l_suppkey", (F.round("geometric_mean", 4) + 0.0).alias("geometric_mean"))


@R.add("select l_suppkey, round(1 - pow(avg(l_discount), 2) / nullif(avg(l_discount * l_discount), 0), 6) + 0.0 as sparsity from lineitem group by 1")
def sparsity(spark, d):
    return T.sparsity(lineitem(spark, d), ["l_suppkey"], "l_discount").withColumn("sparsity", r6("sparsity"))


@R.add("select l_suppkey, round(avg(l_tax), 6) + 0.0 as mean, round(stddev_pop(l_tax), 6) + 0.0 as std, round(stddev_pop(l_tax) / sqrt(count(*)), 6) + 0.0 as sem, count(*) as n, round(avg(l_tax) - stddev_pop(l_tax) / sqrt(count(*)), 6) + 0.0 as lower, round(avg(l_tax) + stddev_pop(l_tax) / sqrt(count(*)), 6) + 0.0 as upper from lineitem group by 1")
def error_interval(spark, d):
    return T.error_interval(lineitem(spark, d), ["l_suppkey"], "l_tax").select("l_suppkey", *(r6(c).alias(c) for c in ("mean", "std", "sem", "lower", "upper")), "n")


@R.add("select l_suppkey, round(quantile_cont(l_extendedprice, 0.1), 4) + 0.0 as p10, round(quantile_cont(l_extendedprice, 0.9), 4) + 0.0 as p90 from lineitem group by 1")
def row_percentile(spark, d):
    return T.quantiles(lineitem(spark, d), ["l_suppkey"], "l_extendedprice", [0.1, 0.9]).select("l_suppkey", *((F.round(c, 4) + 0.0).alias(c) for c in ("p10", "p90")))


@R.add("select l_suppkey, round(avg(x) / (stddev_samp(x) / sqrt(count(x))), 5) + 0.0 as t, count(x) - 1 as dof from (select l_suppkey, ln((1 + l_discount) / (1 + l_tax)) as x from lineitem) group by 1")
def ttest_ratio(spark, d):
    part = lineitem(spark, d).withColumns({"a": 1 + F.col("l_discount"), "b": 1 + F.col("l_tax")})
    return T.paired_ratio_t(part, ["l_suppkey"], "a", "b").select("l_suppkey", (F.round("t", 5) + 0.0).alias("t"), "dof")


@R.add("""select l_suppkey, round(avg(e * e) / var_pop(l_extendedprice), 6) + 0.0 as mse, round(1 - avg(e * e) / var_pop(l_extendedprice), 6) + 0.0 as explained, round(pow(corr(l_extendedprice, p), 2), 6) + 0.0 as evr
from (select *, l_extendedprice - p as e from (select *, 1000 * l_quantity + 100.0 as p from lineitem)) group by 1""")
def regression_losses(spark, d):
    part = lineitem(spark, d).withColumn("p", 1000 * F.col("l_quantity") + 100.0)
    return T.losses(part, ["l_suppkey"], "l_extendedprice", "p").select("l_suppkey", *(r6(c).alias(c) for c in ("mse", "explained", "evr")))


@R.add("select quality, round(avg(-ln(case when toxic = 1 then p else 1 - p end)), 6) + 0.0 as log_loss from (select *, (1 + doc_id % 8) / 10.0::double as p from labels) group by 1")
def log_loss(spark, d):
    return T.log_loss(table(spark, d, "labels").withColumn("p", (1 + F.col("doc_id") % 8) / 10.0), ["quality"], "toxic", "p").withColumn("log_loss", r6("log_loss"))


@R.add("""select vec_id, k::int as class, label = k as hot from embeddings, range(10) r(k)""")
def one_hot(spark, d):
    return T.one_hot(table(spark, d, "embeddings"), ["vec_id"], "label", 10)


@R.add("select p_partkey, (dense_rank() over (order by p_size) - 1 + (select min(p_size) from part))::int as squeezed from part")
def relabel_dense(spark, d):
    return T.squeeze(table(spark, d, "part"), "p_size").select("p_partkey", F.col("squeezed").cast("int").alias("squeezed"))


@R.add("select p_brand, count(*) as n from part group by 1")
def value_frequency(spark, d):
    return T.frequency(table(spark, d, "part"), "p_brand")


@R.add("select l_orderkey, l_partkey from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as k from lineitem) where k = 1")
def first_distinct(spark, d):
    return lineitem(spark, d).groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey")).alias("m")).select("l_orderkey", F.col("m.l_partkey").alias("l_partkey"))


@R.add("""select p_partkey, (case when p_partkey >= p_size then p_partkey * p_partkey + p_partkey + p_size else p_partkey + p_size::bigint * p_size end)::bigint as code, p_partkey as a, p_size::bigint as b from part""")
def szudzik_pairs(spark, d):
    part = table(spark, d, "part").withColumn("code", C.szudzik(F.col("p_partkey"), F.col("p_size").cast("long")))
    pair = C.szudzik_pair(F.col("code"))
    return part.withColumn("p", pair).select("p_partkey", "code", F.col("p.a").alias("a"), F.col("p.b").alias("b"))


@R.add("select p_partkey, round(1 / (1 + exp(-(p_retailprice - 1000) / 100)), 6) + 0.0 as logistic, round(exp(-pow((p_size - 25) / 10.0, 2) / 2) / (10 * sqrt(2 * pi())), 8) + 0.0 as gaussian, round(2 * (1.5 * exp(0.1 * 1.2 * (p_size - 25)) - 0.3 * pow(p_size - 25, 2) - 1), 4) + 0.0 as linex, p_size + (case when p_size % 2 = 0 then 1 else 0 end) as odd, p_size - (case when p_size % 2 <> 0 then 1 else 0 end) as even from part")
def scalar_maths(spark, d):
    s = F.col("p_size")
    return table(spark, d, "part").select(
        "p_partkey", r6(C.logistic(F.col("p_retailprice"), b=0.01, mu=1000)).alias("logistic"), (F.round(C.gaussian(s, 25, 10), 8) + 0.0).alias("gaussian"),
        (F.round(C.linex(s, 25, 2, 1.5, 0.1, 1.2, 0.3, 2), 4) + 0.0).alias("linex"), C.make_odd(s).alias("odd"), C.make_even(s, up=False).alias("even"))


@R.add("select s_suppkey, round(s_acctbal, 6) + 0.0 as re, round(sqrt(s_acctbal * s_acctbal + 1), 5) + 0.0 as r from supplier")
def polar_roundtrip(spark, d):
    p = table(spark, d, "supplier").withColumn("p", C.cartesian_to_polar(F.col("s_acctbal"), F.lit(1.0))).withColumn("c", C.polar_to_cartesian(F.col("p.r"), F.col("p.angle")))
    return p.select("s_suppkey", r6("c.re").alias("re"), (F.round("p.r", 5) + 0.0).alias("r"))


@R.add("""select vec_id, round(2 / pow(s, 1.5) - 1 + 0.25, 6) + 0.0 as d1, round(exp(pow(2 - s, 1.5)) + 0.25, 6) + 0.0 as d2, round(atan(1.5 * (1 - s)) + 0.25, 6) + 0.0 as d3,
round(1 - pow(s, 1.5) + 0.25, 6) + 0.0 as d4, round(pow(sqrt(1 - (s - 1)), 1.5) + 0.25, 6) + 0.0 as d5, round(-ln(s * 1.5 + 1) + 0.25, 6) + 0.0 as d6 from (select vec_id, abs(embedding[1]::double) + 0.1 as s from embeddings)""")
def similarity_to_distance(spark, d):
    s = F.abs(F.col("embedding")[0].cast("double")) + 0.1
    shift = {1: 1, 2: 2, 3: 1, 4: 1, 5: -1, 6: 1}
    return table(spark, d, "embeddings").select("vec_id", *(r6(C.similarity_to_distance(s, k, 1.5, b, 0.25)).alias(f"d{k}") for k, b in shift.items()))


@R.add(r"""select page_id, array_to_string(regexp_extract_all(url, '(-?\d+\.?\d*)', 1), ',') as numbers, try_cast(nullif(regexp_replace(url, '[^0-9]', '', 'g'), '') as bigint) as digits from pages""")
def numbers_in_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(F.regexp_extract_all("url", F.lit(r"(-?\d+\.?\d*)"), F.lit(1)), ",").alias("numbers"), C.digits_of(F.col("url")).alias("digits"))


DATE_FORMS = (r"\d{4}\d{2}\d{2}", r"\d{4}\D\d{2}\D\d{2}", r"\d{2}\D\d{2}\D\d{4}", r"\d{1}\D\d{1}\D\d{4}", r"\d{1}\D\d{2}\D\d{4}")
_PARTS = "['data' || o_custkey % 1000, 'run_' || case o_orderkey % 3 when 0 then strftime(o_orderdate, '%Y%m%d') when 1 then strftime(o_orderdate, '%Y.%m-%d') else strftime(o_orderdate, '%-m x%d %Y') end, 'x' || o_orderkey % 7 || '.bin']"
_FOUND = ", ".join(f"list_extract(regexp_extract_all(parts[{k}], '{f}'), -1)" for k in (3, 2, 1) for f in DATE_FORMS)


@R.add(f"select o_orderkey, coalesce({_FOUND}) as found from (select o_orderkey, {_PARTS} as parts from orders)")
def date_in_path(spark, d):
    day = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyyMMdd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy.MM-dd")).otherwise(
        F.concat(F.month("o_orderdate").cast("string"), F.lit(" x"), F.date_format("o_orderdate", "dd yyyy")))
    p = F.concat(F.lit("data"), (F.col("o_custkey") % 1000).cast("string"), F.lit("/run_"), day, F.lit("/x"), (F.col("o_orderkey") % 7).cast("string"), F.lit(".bin"))
    return table(spark, d, "orders").select("o_orderkey", C.date_in_path(p).alias("found"))


@R.add("select doc_id, md5(text) as md5, sha256(text) as sha256 from documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


@R.add("select c_custkey, base64(encode(c_name)) as code, c_name as back from customer")
def base64_roundtrip(spark, d):
    return table(spark, d, "customer").withColumn("code", F.base64(F.col("c_name").cast("binary"))).select("c_custkey", "code", F.unbase64("code").cast("string").alias("back"))


@R.add("select p_partkey, printf('#%02x%02x%02x', p_size % 256, (p_partkey % 256)::int, ((p_partkey * 7) % 256)::int) as colour from part")
def hex_colour(spark, d):
    return table(spark, d, "part").select("p_partkey", C.hex_colour((F.col("p_size") % 256).cast("int"), (F.col("p_partkey") % 256).cast("int"), ((F.col("p_partkey") * 7) % 256).cast("int")).alias("colour"))


@R.add("select a.x as rate, b.y as depth from (select unnest([0.1, 0.2, 0.5]::double[]) as x) a, (select unnest([1, 2, 3, 4]::bigint[]) as y) b")
def param_grid(spark, d):
    return N.grid(spark, {"rate": [0.1, 0.2, 0.5], "depth": [1, 2, 3, 4]})


@R.add("select event_id, json_extract_string(props, '$.' || k) as first_value, k as first_key from (select *, list_sort(json_keys(props))[1] as k from events)")
def json_flatten(spark, d):
    m = F.from_json("props", "map<string,string>")
    return table(spark, d, "events").withColumn("m", m).withColumn("first_key", F.get(F.array_sort(F.map_keys("m")), F.lit(0))).select("event_id", F.try_element_at("m", F.col("first_key")).alias("first_value"), "first_key")


@R.add("select key, count(distinct value) as n_values, count(distinct value) > 1 as changes from (select unnest(json_keys(props)) as key, json_extract_string(props, '$.' || unnest(json_keys(props))) as value from events) group by 1")
def changed_params(spark, d):
    return N.changing(table(spark, d, "events"), F.from_json("props", "map<string,string>"))


MAPS = (lambda: F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority")), lambda: F.create_map(F.lit("status"), F.lit("O"), F.lit("origin"), F.lit("web")))


@R.add("select o_orderkey, (o_orderstatus = 'O')::int as shared, (o_orderstatus <> 'O')::int as differing, 'origin,priority' as missing, 3 as merged from orders")
def map_operations(spark, d):
    a, b = (m() for m in MAPS)
    return table(spark, d, "orders").select(
        "o_orderkey", F.size(N.shared_items(a, b)).alias("shared"), F.size(N.differing_items(a, b)).alias("differing"), F.array_join(N.missing_keys(a, b), ",").alias("missing"), F.size(N.merged(a, b)).alias("merged"))


@R.add("select o_orderkey, case when o_orderkey % 3 = 0 then 'X' else o_orderstatus end as o_orderstatus from orders union all select -n_nationkey - 1, 'X' from nation")
def upsert_merge(spark, d):
    old = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    new = old.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("X")).unionByName(table(spark, d, "nation").select((-F.col("n_nationkey") - 1).alias("o_orderkey"), F.lit("X").alias("o_orderstatus")))
    return S.upsert(old, new, ["o_orderkey"])


@R.add("""select coalesce(a.name, b.name) as name, a.hash as expected, b.hash as found, coalesce(a.hash = b.hash, false) as same from (select c_name as name, md5(c_mktsegment) as hash from customer where c_custkey % 3 <> 0) a
full outer join (select c_name as name, md5(case when c_custkey % 5 = 0 then 'other' else c_mktsegment end) as hash from customer where c_custkey % 4 <> 0) b on a.name = b.name""")
def full_outer_diff(spark, d):
    c = table(spark, d, "customer")
    a = c.where("c_custkey % 3 <> 0").select(F.col("c_name").alias("name"), F.md5("c_mktsegment").alias("hash"))
    b = c.where("c_custkey % 4 <> 0").select(F.col("c_name").alias("name"), F.md5(F.when(F.col("c_custkey") % 5 == 0, F.lit("other")).otherwise(F.col("c_mktsegment"))).alias("hash"))
    return S.compare_hashes(a, b)


@R.add("select o_custkey as k from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0) group by 1 union all select c_custkey from customer where c_acctbal > 0 and c_custkey not in (select o_custkey from orders)")
def key_symmetric_difference(spark, d):
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct()
    b = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return a.join(b, "k", "left_anti").unionAll(b.join(a, "k", "left_anti"))


@R.add("select r_name, n_name, round(sum(s_acctbal), 4) + 0.0 as total from region join nation on n_regionkey = r_regionkey join supplier on s_nationkey = n_nationkey group by rollup (r_name, n_name)")
def rollup_sizes(spark, d):
    n, r, s = (table(spark, d, t) for t in ("nation", "region", "supplier"))
    j = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.rollup("r_name", "n_name").agg((F.round(F.sum("s_acctbal"), 4) + 0.0).alias("total"))


@R.add("select o_orderkey from orders where o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '1996-01-01'")
def date_range(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderdate").cast("date").between(F.to_date(F.lit("19950101"), "yyyyMMdd"), F.to_date(F.lit("19951231"), "yyyyMMdd"))).select("o_orderkey")


@R.add()
def group_split(spark, d):
    return lineitem(spark, d).select("l_orderkey", "l_linenumber", models.fold_of(5, "l_orderkey").alias("fold"))


QUERIES, ORACLES = R.queries, R.oracles
