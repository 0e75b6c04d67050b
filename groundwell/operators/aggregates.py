"""Aggregation, grouping, having, and top-k over groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import compat
from .registry import Tables, query


@query("orders_total_count", "SELECT count(*) AS order_count FROM orders")
def orders_total_count(t: Tables) -> DataFrame:
    return t.orders.agg(F.count("*").alias("order_count"))


@query("count_column", "SELECT count(l.quality) AS labelled, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def count_column(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return joined.agg(F.count("quality").alias("labelled"), F.count("*").alias("n"))


@query("count_distinct_customers", "SELECT count(DISTINCT o_custkey) AS n FROM orders")
def count_distinct_customers(t: Tables) -> DataFrame:
    return t.orders.agg(F.countDistinct("o_custkey").alias("n"))


@query("sum_total", "SELECT round(sum(o_totalprice), 2) AS total FROM orders")
def sum_total(t: Tables) -> DataFrame:
    return t.orders.agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("avg_order_value", "SELECT round(avg(o_totalprice), 2) AS avg_order FROM orders")
def avg_order_value(t: Tables) -> DataFrame:
    return t.orders.agg(F.round(F.avg("o_totalprice"), 2).alias("avg_order"))


@query("max_single", "SELECT max(l_extendedprice) AS biggest FROM lineitem WHERE l_returnflag = 'R'")
def max_single(t: Tables) -> DataFrame:
    return t.lineitem.where(F.col("l_returnflag") == "R").agg(F.max("l_extendedprice").alias("biggest"))


@query("min_max_dates", "SELECT min(o_orderdate) AS first_order, max(o_orderdate) AS last_order FROM orders")
def min_max_dates(t: Tables) -> DataFrame:
    return t.orders.agg(F.min("o_orderdate").alias("first_order"), F.max("o_orderdate").alias("last_order"))


@query("total_empty_zero", "SELECT coalesce(sum(o_totalprice), CAST(0 AS DOUBLE)) AS total, sum(o_totalprice) AS raw_sum FROM orders WHERE o_orderstatus = 'Z'")
def total_empty_zero(t: Tables) -> DataFrame:
    none = t.orders.where(F.col("o_orderstatus") == "Z")
    return none.agg(compat.total(F.col("o_totalprice")).alias("total"), F.sum("o_totalprice").alias("raw_sum"))


@query("group_concat_sorted", "SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def group_concat_sorted(t: Tables) -> DataFrame:
    joined = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(compat.group_concat(F.col("n_name")).alias("nations"))


@query("agg_filter_clause", "SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o FROM orders")
def agg_filter_clause(t: Tables) -> DataFrame:
    return t.orders.agg(F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") == "O").alias("o"))


@query("group_by_status", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus")
def group_by_status(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("group_by_priority", "SELECT o_orderpriority AS priority, count(*) AS n, round(avg(o_totalprice), 2) AS mean_value FROM orders GROUP BY o_orderpriority")
def group_by_priority(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean_value"))


@query("group_by_month", "SELECT strftime(o_orderdate, '%Y-%m') AS ym, count(*) AS n FROM orders GROUP BY 1")
def group_by_month(t: Tables) -> DataFrame:
    return t.orders.groupBy(compat.strftime("%Y-%m", F.col("o_orderdate")).alias("ym")).agg(F.count("*").alias("n"))


@query("group_by_two", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_returnflag, l_linestatus")
def group_by_two(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("group_without_aggregate", "SELECT o_custkey, o_orderstatus FROM orders GROUP BY o_custkey, o_orderstatus")
def group_without_aggregate(t: Tables) -> DataFrame:
    return t.orders.select("o_custkey", "o_orderstatus").distinct()


@query("alias_in_group_order", "SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY p ORDER BY p")
def alias_in_group_order(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_orderpriority").alias("p")).agg(F.count("*").alias("n")).orderBy("p")


@query("having_count", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
def having_count(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 15")


@query("top_cities_by_orders", "SELECT n_name AS nation, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name ORDER BY n DESC, nation LIMIT 5")
def top_cities_by_orders(t: Tables) -> DataFrame:
    by_customer = t.orders.groupBy("o_custkey").agg(F.count("*").alias("m"))  # before the joins: one row a customer
    joined = by_customer.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(t.nation.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy(F.col("n_name").alias("nation")).agg(F.sum("m").alias("n")).orderBy(F.desc("n"), "nation").limit(5)


@query("top_products_by_revenue", "SELECT p_partkey, round(sum(l_extendedprice), 2) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_partkey ORDER BY revenue DESC, p_partkey LIMIT 3")
def top_products_by_revenue(t: Tables) -> DataFrame:
    by_part = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"))
    known = by_part.join(t.part.select("p_partkey"), "p_partkey", "left_semi")
    return known.orderBy(F.desc("revenue"), "p_partkey").limit(3)


@query(
    "top_nations_by_returns",
    "SELECT n_name AS nation, round(sum(l_extendedprice * (1 - l_discount)), 2) AS returned FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE l_returnflag = 'R' GROUP BY n_name ORDER BY returned DESC, nation LIMIT 5",
)
def top_nations_by_returns(t: Tables) -> DataFrame:
    value = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value")
    by_supplier = t.lineitem.where(F.col("l_returnflag") == "R").groupBy("l_suppkey").agg(value)
    joined = by_supplier.join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    joined = joined.join(t.nation.select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.groupBy(F.col("n_name").alias("nation")).agg(F.round(F.sum("value"), 2).alias("returned")).orderBy(F.desc("returned"), "nation").limit(5)


@query(
    "top_regions_by_customers",
    "SELECT r_name AS region, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name ORDER BY n DESC, region LIMIT 3",
)
def top_regions_by_customers(t: Tables) -> DataFrame:
    by_nation = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("m"))
    joined = by_nation.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy(F.col("r_name").alias("region")).agg(F.sum("m").alias("n")).orderBy(F.desc("n"), "region").limit(3)


@query("top1_priority", "SELECT o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY o_orderpriority ORDER BY n DESC, priority LIMIT 1")
def top1_priority(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "priority").limit(1)


@query("line_total_per_order", "SELECT l_orderkey, count(*) AS lines, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_orderkey")
def line_total_per_order(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("total"))
