"""Representative SQL over replicas: what Spark itself gives once a snapshot's tables are DataFrames."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chunkvault.plans.catalog import query, table

MONEY = "decimal(18,2)"


def _revenue():
    return (F.col("l_extendedprice").cast(MONEY) * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(18,4)")


REVENUE = "(l_extendedprice::decimal(18,2) * (1 - l_discount::decimal(4,2)))::decimal(18,4)"


@query(f"select n_name, sum({REVENUE})::decimal(28,4) as revenue, count(*)::bigint as n from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join nation on c_nationkey = n_nationkey group by n_name")
def sql_join_inner(spark, sf):
    t = lambda n: table(spark, sf, n)
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.sum(_revenue()).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("select c_custkey, count(o_orderkey)::bigint as orders from customer left join orders on c_custkey = o_custkey group by c_custkey")
def sql_join_left(spark, sf):
    counted = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"))
    return table(spark, sf, "customer").join(counted, "c_custkey", "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"))


@query("select p_partkey from part where p_partkey in (select l_partkey from lineitem where l_quantity > 45)")
def sql_join_semi(spark, sf):
    large = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf, "part").join(large, "p_partkey", "left_semi").select("p_partkey")


@query("select s_suppkey from supplier where s_suppkey not in (select l_suppkey from lineitem where l_returnflag = 'R' and l_quantity > 49)")
def sql_join_anti(spark, sf):
    returned = table(spark, sf, "lineitem").where("l_returnflag = 'R' and l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, sf, "supplier").join(returned, "s_suppkey", "left_anti").select("s_suppkey")


@query("select coalesce(c_nationkey, s_nationkey) as nation, customers, suppliers from (select c_nationkey, count(*)::bigint as customers from customer where c_acctbal > 0 group by all) full join (select s_nationkey, count(*)::bigint as suppliers from supplier where s_acctbal > 5000 group by all) on c_nationkey = s_nationkey")
def sql_join_full(spark, sf):
    left = table(spark, sf, "customer").where("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("customers"))
    right = table(spark, sf, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"))
    return left.join(right, "nation", "full_outer").select("nation", "customers", "suppliers")


@query("select e.event_id, count(*)::bigint as earlier from events e join events p on p.user_id = e.user_id and p.ts < e.ts and p.ts >= e.ts - interval 6 hour group by e.event_id")
def sql_join_range(spark, sf):
    """Events of the same user in the six hours before: a window frame in place of a join of all pairs."""
    events = table(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    before = W.partitionBy("user_id").orderBy("us").rangeBetween(-21_600_000_000, -1)
    return events.select("event_id", F.count(F.lit(1)).over(before).alias("earlier")).where("earlier > 0")


@query("select l_returnflag, l_linestatus, sum(l_quantity)::bigint as qty, min(l_shipdate) as first, max(l_shipdate) as last, count(*)::bigint as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all")
def sql_agg(spark, sf):
    rows = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("long").alias("qty"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"), F.count(F.lit(1)).alias("n"))


@query("select l_returnflag, count(distinct l_suppkey)::bigint as suppliers, count(distinct l_partkey)::bigint as parts from lineitem group by all having suppliers > 1")
def sql_distinct(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_partkey").alias("parts")).where("suppliers > 1")


def _grouped(kind: str) -> str:
    return f"select l_returnflag, l_linestatus, count(*)::bigint as n from lineitem group by {kind}"


@query(_grouped("rollup (l_returnflag, l_linestatus)"))
def sql_rollup(spark, sf):
    return table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query(_grouped("cube (l_returnflag, l_linestatus)"))
def sql_cube(spark, sf):
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query(_grouped("grouping sets ((l_returnflag), (l_linestatus), ())"))
def sql_grouping_sets(spark, sf):
    sets = [[F.col("l_returnflag")], [F.col("l_linestatus")], []]
    return table(spark, sf, "lineitem").groupingSets(sets, "l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderkey, rank() over w::int as r, dense_rank() over w::int as d from orders window w as (partition by o_orderpriority order by o_orderdate desc)")
def sql_window_rank(spark, sf):
    w = W.partitionBy("o_orderpriority").orderBy(F.col("o_orderdate").desc())
    return table(spark, sf, "orders").select("o_orderkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"))


@query("select o_orderkey, lag(o_orderkey) over w as before, lead(o_orderkey) over w as after from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)")
def sql_window_lag(spark, sf):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey").over(w).alias("after"))


@query("select event_id, sum(event_id) over (partition by user_id order by ts, event_id rows between 3 preceding and current row)::bigint as s from events")
def sql_window_frame(spark, sf):
    return table(spark, sf, "events").select("event_id", F.sum("event_id").over(W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-3, 0)).alias("s"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def sql_topk(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25)


@query("(select c_nationkey as k from customer intersect select s_nationkey from supplier) union (select n_regionkey from nation except select r_regionkey from region where r_regionkey > 2)")
def sql_setops(spark, sf):
    t = lambda n, c: table(spark, sf, n).select(F.col(c).alias("k"))
    both = t("customer", "c_nationkey").intersect(t("supplier", "s_nationkey"))
    rest = t("nation", "n_regionkey").exceptAll(t("region", "r_regionkey").where("k > 2")).where("k <= 2").distinct()
    return both.union(rest).distinct()


@query("select event_id, (props::json ->> 'k') as k, event_type like '%u%' as has_u, upper(event_type) as up, strlen(event_type)::int as n from events")
def sql_json_string(spark, sf):
    kind = F.col("event_type")
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), kind.like("%u%").alias("has_u"), F.upper(kind).alias("up"), F.octet_length(kind).alias("n"))


@query("select event_id, floor(sqrt(event_id))::bigint as root, (event_id % 7)::bigint as rest, event_id & 255 as low, extract(dow from ts)::int as dow, date_trunc('month', ts)::timestamp as month from events")
def sql_math_date(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").select("event_id", F.floor(F.sqrt(e)).alias("root"), (e % 7).alias("rest"), e.bitwiseAND(F.lit(255)).alias("low"), (F.dayofweek("ts") - 1).alias("dow"), F.date_trunc("month", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("month"))


@query("select r_name, o_orderpriority, count(*)::bigint as nations from region cross join (select distinct o_orderpriority from orders) p left join nation on n_regionkey = r_regionkey group by all")
def sql_join_cross(spark, sf):
    """A cross product of two small dimensions, as a grid to count on."""
    grid = table(spark, sf, "region").crossJoin(table(spark, sf, "orders").select("o_orderpriority").distinct())
    counts = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count(F.lit(1)).alias("nations"))
    return grid.join(counts, "r_regionkey", "left").select("r_name", "o_orderpriority", F.coalesce("nations", F.lit(0)).alias("nations"))


@query("select a.s_suppkey, count(*)::bigint as richer from supplier a join supplier b on b.s_nationkey = a.s_nationkey and b.s_acctbal > a.s_acctbal group by a.s_suppkey")
def sql_join_theta(spark, sf):
    """An inequality within equal keys."""
    a = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    b = a.select("s_nationkey", F.col("s_acctbal").alias("other"))
    return a.join(b, "s_nationkey").where("other > s_acctbal").groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("richer"))


@query("select k, count(*)::bigint as n from (select c_nationkey as k from customer union all select s_nationkey from supplier) group by k")
def sql_union_all(spark, sf):
    both = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).unionAll(table(spark, sf, "supplier").select("s_nationkey"))
    return both.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderkey from orders order by o_totalprice, o_orderkey limit 20 offset 15")
def sql_offset(spark, sf):
    return table(spark, sf, "orders").orderBy("o_totalprice", "o_orderkey").offset(15).limit(20).select("o_orderkey")


@query("select event_type, round(var_samp(event_id), 2) as var, round(stddev_pop(event_id), 2) as sd, round(corr(event_id, user_id), 6) as r, median(event_id)::double as mid, approx_count_distinct(user_id) > 0 as some from events group by event_type")
def sql_statistics(spark, sf):
    found = table(spark, sf, "events").groupBy("event_type").agg(F.round(F.var_samp("event_id"), 2).alias("var"), F.round(F.stddev_pop("event_id"), 2).alias("sd"), F.round(F.corr("event_id", "user_id"), 6).alias("r"), F.median("event_id").alias("mid"), (F.approx_count_distinct("user_id") > 0).alias("some"))
    return found
