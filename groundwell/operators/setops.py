"""Set operations, common table expressions and derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import Tables, query


@query("setop_union_nested", "SELECT count(*) AS n FROM (SELECT c_nationkey k FROM customer UNION SELECT s_nationkey FROM supplier) u")
def setop_union_nested(t: Tables) -> DataFrame:
    keys = t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey"))
    return keys.distinct().agg(F.count("*").alias("n"))


@query("setop_union_all", "SELECT k, count(*) AS n FROM (SELECT c_nationkey k FROM customer UNION ALL SELECT s_nationkey FROM supplier) u GROUP BY k")
def setop_union_all(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).groupBy("k").agg(F.count("*").alias("n"))


@query("setop_intersect_nested", "SELECT count(*) AS n FROM (SELECT o_custkey k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') u")
def setop_intersect_nested(t: Tables) -> DataFrame:
    building = t.customer.where(F.col("c_mktsegment") == "BUILDING").select("c_custkey")
    return t.orders.select(F.col("o_custkey").alias("k")).intersect(building).agg(F.count("*").alias("n"))


@query("setop_except_nested", "SELECT count(*) AS n FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) u")
def setop_except_nested(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").subtract(t.labels.select("doc_id")).agg(F.count("*").alias("n"))


@query("recursive_cte_series", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n FROM t")
def recursive_cte_series(t: Tables) -> DataFrame:
    return t.spark.sql("WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n FROM t")


@query("cte_basic", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 400000) SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey")
def cte_basic(t: Tables) -> DataFrame:
    return t.orders.where("o_totalprice > 400000").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("cte_two_level", "WITH a AS (SELECT o_custkey k, count(*) n FROM orders GROUP BY o_custkey), b AS (SELECT n, count(*) m FROM a GROUP BY n) SELECT n AS orders_per_customer, m AS customers FROM b")
def cte_two_level(t: Tables) -> DataFrame:
    per_customer = t.orders.groupBy("o_custkey").agg(F.count("*").alias("orders_per_customer"))
    return per_customer.groupBy("orders_per_customer").agg(F.count("*").alias("customers"))


@query("derived_table", "SELECT max(n) AS busiest FROM (SELECT o_custkey, count(*) n FROM orders GROUP BY o_custkey) x")
def derived_table(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).agg(F.max("n").alias("busiest"))


_LEFT = ("o_custkey", "o_orderstatus")


@query("multiset_diff", "SELECT count(*) AS only_left FROM (SELECT o_custkey, o_orderstatus FROM orders EXCEPT ALL SELECT o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 100000) d")
def multiset_diff(t: Tables) -> DataFrame:
    return t.orders.select(*_LEFT).exceptAll(t.orders.where("o_totalprice > 100000").select(*_LEFT)).agg(F.count("*").alias("only_left"))


@query(
    "ordered_sequence_match",
    "WITH a AS (SELECT n_name AS v, row_number() OVER (ORDER BY n_nationkey) AS k FROM nation), b AS (SELECT n_name AS v, row_number() OVER (ORDER BY n_name) AS k FROM nation) SELECT count(*) AS positions, count(*) FILTER (WHERE a.v IS NOT DISTINCT FROM b.v) AS same FROM a FULL JOIN b USING (k)",
)
def ordered_sequence_match(t: Tables) -> DataFrame:
    """Two capped results as sequences: equal when every position agrees."""
    from ..plans.compare import with_positions

    a = with_positions(t.nation.select(F.col("n_name").alias("a"), "n_nationkey"), ["n_nationkey"]).select("position", "a")
    b = with_positions(t.nation.select(F.col("n_name").alias("b")), ["b"]).select("position", "b")
    return a.join(b, "position", "full").agg(F.count("*").alias("positions"), F.count_if(F.col("a").eqNullSafe(F.col("b"))).alias("same"))
