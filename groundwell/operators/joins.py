"""Joins of every kind that a guarded statement may use.

Join strategies are left to the optimiser: no side is broadcast by hint, so a
side that outgrows the session's threshold is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import Tables, query


def _returned() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


@query("join_revenue_by_segment", "SELECT c_mktsegment AS segment, round(sum(o_totalprice), 2) AS order_value FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment")
def join_revenue_by_segment(t: Tables) -> DataFrame:
    joined = t.orders.select("o_custkey", "o_totalprice").join(t.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.round(F.sum("o_totalprice"), 2).alias("order_value"))


@query(
    "join3_returns_by_nation",
    "SELECT n_name AS nation, CAST(round(sum(l_extendedprice * (1 - l_discount)), 2) AS DOUBLE) AS returned FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '2001-06-01' AND l_shipdate < TIMESTAMP '2001-07-01' GROUP BY n_name",
)
def join3_returns_by_nation(t: Tables) -> DataFrame:
    month = (F.col("l_shipdate") >= F.lit("2001-06-01").cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit("2001-07-01").cast("timestamp_ntz"))
    lines = t.lineitem.where((F.col("l_returnflag") == "R") & month).select("l_orderkey", _returned().alias("value"))
    joined = lines.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    joined = joined.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(t.nation.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy(F.col("n_name").alias("nation")).agg(F.round(F.sum("value"), 2).alias("returned"))


@query("join_filter_only", "SELECT count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'")
def join_filter_only(t: Tables) -> DataFrame:
    building = t.customer.where(F.col("c_mktsegment") == "BUILDING").select("c_custkey")
    return t.orders.select("o_custkey").join(building, F.col("o_custkey") == F.col("c_custkey"), "left_semi").agg(F.count("*").alias("n"))


@query("join_comma", "SELECT count(*) AS n FROM customer, nation WHERE c_nationkey = n_nationkey AND n_regionkey = 1")
def join_comma(t: Tables) -> DataFrame:
    return t.customer.join(t.nation).where("c_nationkey = n_nationkey AND n_regionkey = 1").agg(F.count("*").alias("n"))


@query("anti_left_join", "SELECT d.doc_id AS doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL")
def anti_left_join(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels.select("doc_id"), "doc_id", "left_anti")


@query("join_left_outer", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 450000 GROUP BY c_custkey")
def join_left_outer(t: Tables) -> DataFrame:
    large = t.orders.where("o_totalprice > 450000").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    joined = t.customer.select("c_custkey").join(large, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("join_right_outer", "SELECT r_name, count(n_nationkey) AS n FROM nation RIGHT JOIN region ON n_regionkey = r_regionkey AND n_name < 'NATION_2' GROUP BY r_name")
def join_right_outer(t: Tables) -> DataFrame:
    some = t.nation.where("n_name < 'NATION_2'")
    return some.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "right").groupBy("r_name").agg(F.count("n_nationkey").alias("n"))


@query("join_full_outer", "SELECT s.s_nationkey AS sk, r.r_regionkey AS rk, count(*) AS n FROM supplier s FULL OUTER JOIN region r ON s.s_nationkey = r.r_regionkey + 20 GROUP BY s.s_nationkey, r.r_regionkey")
def join_full_outer(t: Tables) -> DataFrame:
    joined = t.supplier.join(t.region, F.col("s_nationkey") == F.col("r_regionkey") + 20, "full")
    return joined.groupBy(F.col("s_nationkey").alias("sk"), F.col("r_regionkey").alias("rk")).agg(F.count("*").alias("n"))


@query("join_cross_small", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross_small(t: Tables) -> DataFrame:
    return t.region.select("r_name").crossJoin(t.nation.select("n_name"))


@query("join_theta_dates", "SELECT count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND l_shipdate < o_orderdate")
def join_theta_dates(t: Tables) -> DataFrame:
    both = (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") < F.col("o_orderdate"))
    return t.lineitem.select("l_orderkey", "l_shipdate").join(t.orders.select("o_orderkey", "o_orderdate"), both).agg(F.count("*").alias("n"))


_LARGE = 490000


@query("semi_in_subquery", "SELECT count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 490000)")
def semi_in_subquery(t: Tables) -> DataFrame:
    large = t.orders.where(F.col("o_totalprice") > _LARGE).select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey").join(large, "c_custkey", "left_semi").agg(F.count("*").alias("n"))


@query("anti_not_in", "SELECT count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_not_in(t: Tables) -> DataFrame:
    """Null-aware, as NOT IN is: any null on the right leaves nothing."""
    right = t.labels.select("doc_id")
    nulls = right.where("doc_id is null").limit(1).agg(F.count("*").alias("nulls"))
    left = t.documents.select("doc_id").where("doc_id is not null").join(right, "doc_id", "left_anti").agg(F.count("*").alias("n"))
    return left.crossJoin(nulls).select(F.when(F.col("nulls") > 0, F.lit(0)).otherwise(F.col("n")).cast("long").alias("n"))


@query("semi_exists", "SELECT count(*) AS n FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 490000)")
def semi_exists(t: Tables) -> DataFrame:
    c, o = t.customer.alias("c"), t.orders.where(F.col("o_totalprice") > _LARGE).alias("o")
    return c.join(o, F.col("o.o_custkey") == F.col("c.c_custkey"), "left_semi").agg(F.count("*").alias("n"))


@query("anti_not_exists", "SELECT count(*) AS n FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)")
def anti_not_exists(t: Tables) -> DataFrame:
    c, o = t.customer.alias("c"), t.orders.where(F.col("o_totalprice") > 400000).alias("o")
    return c.join(o, F.col("o.o_custkey") == F.col("c.c_custkey"), "left_anti").agg(F.count("*").alias("n"))


@query("scalar_subquery_corr", "SELECT c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n FROM customer c")
def scalar_subquery_corr(t: Tables) -> DataFrame:
    counts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t.customer.select("c_custkey").join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("scalar_subquery", "SELECT count(*) AS n FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def scalar_subquery(t: Tables) -> DataFrame:
    mean = t.orders.agg(F.avg("o_totalprice").alias("mean"))
    return t.orders.select("o_totalprice").crossJoin(F.broadcast(mean)).where("o_totalprice > mean").agg(F.count("*").alias("n"))  # one row


@query("join_self", "SELECT count(*) AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self(t: Tables) -> DataFrame:
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).agg(F.count("*").alias("n"))
