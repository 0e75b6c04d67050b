"""Scans, projections, predicates, scalar functions, sorting and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import compat
from .registry import Tables, query


@query("literal_select", "SELECT 1 AS one, 'x' AS tag")
def literal_select(t: Tables) -> DataFrame:
    return t.spark.range(1).select(F.lit(1).alias("one"), F.lit("x").alias("tag"))


@query("scan_project_orders", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def scan_project_orders(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")


@query("scan_filter_pushdown", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 450000")
def scan_filter_pushdown(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_totalprice") > 450000).select("o_orderkey", "o_totalprice")


@query("star_small_table", "SELECT * FROM region")
def star_small_table(t: Tables) -> DataFrame:
    return t.region.select("*")


@query("distinct_values", "SELECT DISTINCT p_type AS p_type FROM part")
def distinct_values(t: Tables) -> DataFrame:
    return t.part.select("p_type").distinct()


@query("revenue_expr", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem")
def revenue_expr(t: Tables) -> DataFrame:
    charge = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return t.lineitem.select("l_orderkey", "l_linenumber", charge.alias("charge"))


@query("int_division", "SELECT p_partkey, CAST(p_size // 7 AS BIGINT) AS sevens FROM part")
def int_division(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", compat.int_div(F.col("p_size"), F.lit(7)).alias("sevens"))


@query("count_status_open", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'")
def count_status_open(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderstatus") == "O").agg(F.count("*").alias("n"))


@query("count_over_threshold", "SELECT count(*) AS n FROM orders WHERE o_totalprice > 200000")
def count_over_threshold(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_totalprice") > 200000).agg(F.count("*").alias("n"))


@query("filter_between", "SELECT count(*) AS n FROM part WHERE p_size BETWEEN 10 AND 20")
def filter_between(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_size").between(10, 20)).agg(F.count("*").alias("n"))


@query("filter_in_list", "SELECT count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def filter_in_list(t: Tables) -> DataFrame:
    return t.customer.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).agg(F.count("*").alias("n"))


@query("filter_not_in_list", "SELECT count(*) AS n FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def filter_not_in_list(t: Tables) -> DataFrame:
    return t.customer.where(~F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).agg(F.count("*").alias("n"))


@query("filter_like_ci", "SELECT count(*) AS n FROM part WHERE p_name ILIKE '%ANVIL%'")
def filter_like_ci(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_name").ilike("%ANVIL%")).agg(F.count("*").alias("n"))


@query("filter_glob", "SELECT count(*) AS n FROM part WHERE p_brand GLOB 'Brand#[12]*'")
def filter_glob(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_brand").rlike("^Brand#[12].*$")).agg(F.count("*").alias("n"))


@query("filter_boolean_logic", "SELECT count(*) AS n FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice < 50000) AND NOT o_orderpriority = '1-URGENT'")
def filter_boolean_logic(t: Tables) -> DataFrame:
    either = (F.col("o_orderstatus") == "F") | (F.col("o_totalprice") < 50000)
    return t.orders.where(either & ~(F.col("o_orderpriority") == "1-URGENT")).agg(F.count("*").alias("n"))


@query("concat_text", "SELECT n_nationkey, n_name || '/' || r_name AS place FROM nation JOIN region ON r_regionkey = n_regionkey")
def concat_text(t: Tables) -> DataFrame:
    joined = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("n_nationkey", F.concat("n_name", F.lit("/"), "r_name").alias("place"))


@query("case_bucket", "SELECT CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 300000 THEN 'mid' ELSE 'high' END AS bucket, count(*) AS n FROM orders GROUP BY 1")
def case_bucket(t: Tables) -> DataFrame:
    price = F.col("o_totalprice")
    bucket = F.when(price < 100000, "low").when(price < 300000, "mid").otherwise("high")
    return t.orders.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("count_unlinked_docs", "SELECT count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL")
def count_unlinked_docs(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels.select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("n"))


@query("count_linked_docs", "SELECT count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL")
def count_linked_docs(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return joined.where(F.col("quality").isNotNull()).agg(F.count("*").alias("n"))


@query("limit_offset", "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 5 OFFSET 3")
def limit_offset(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", "n_name").orderBy("n_nationkey").offset(3).limit(5)


@query("order_by_hidden", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def order_by_hidden(t: Tables) -> DataFrame:
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey")


@query("truncation_probe", "SELECT least(count(*), 200) AS returned, count(*) > 200 AS truncated FROM (SELECT 1 AS x FROM orders LIMIT 201) t")
def truncation_probe(t: Tables) -> DataFrame:
    seen = t.orders.select("o_orderkey").limit(201).agg(F.count("*").alias("n"))
    return seen.select(F.least("n", F.lit(200)).cast("long").alias("returned"), (F.col("n") > 200).alias("truncated"))


@query("fn_round", "SELECT s_suppkey, round(s_acctbal, 1) AS r1 FROM supplier")
def fn_round(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", F.round("s_acctbal", 1).alias("r1"))


@query("fn_abs", "SELECT s_suppkey, abs(s_acctbal - 5000) AS a FROM supplier")
def fn_abs(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", F.abs(F.col("s_acctbal") - 5000).alias("a"))


@query("fn_round_abs", "SELECT s_suppkey, round(s_acctbal, 1) AS r1, abs(s_acctbal) AS a FROM supplier")
def fn_round_abs(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", F.round("s_acctbal", 1).alias("r1"), F.abs("s_acctbal").alias("a"))


@query("fn_lower_upper", "SELECT n_nationkey, lower(n_name) AS lo, upper(n_name) AS up FROM nation")
def fn_lower_upper(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", F.lower("n_name").alias("lo"), F.upper("n_name").alias("up"))


@query("fn_length", "SELECT doc_id, length(text) AS len FROM documents")
def fn_length(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.length("text").cast("long").alias("len"))


@query("fn_text", "SELECT n_nationkey, lower(n_name) AS lo, upper(n_name) AS up, length(n_name) AS len FROM nation")
def fn_text(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", F.lower("n_name").alias("lo"), F.upper("n_name").alias("up"), F.length("n_name").cast("long").alias("len"))


@query("fn_coalesce", "SELECT d.doc_id AS doc_id, coalesce(l.quality, -1) AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def fn_coalesce(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return joined.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("q"))


@query("fn_date", "SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1")
def fn_date(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("n"))


@query("fn_strftime_month", "SELECT strftime(o_orderdate, '%Y-%m') AS ym, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def fn_strftime_month(t: Tables) -> DataFrame:
    month = compat.strftime("%Y-%m", F.col("o_orderdate"))
    return t.orders.groupBy(month.alias("ym")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("fn_julianday", "SELECT o_orderkey, CAST(round(julian(o_orderdate) * 1000) AS BIGINT) AS milli_days FROM orders")
def fn_julianday(t: Tables) -> DataFrame:
    days = compat.julianday(F.col("o_orderdate")) + 0.5  # the oracle counts from midnight
    return t.orders.select("o_orderkey", F.round(days * 1000).cast("long").alias("milli_days"))


@query("fn_julianday_diff", "SELECT round(avg(date_diff('day', o_orderdate, l_shipdate)), 2) AS avg_days FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def fn_julianday_diff(t: Tables) -> DataFrame:
    joined = t.lineitem.select("l_orderkey", "l_shipdate").join(t.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.agg(F.round(F.avg(F.datediff("l_shipdate", "o_orderdate")), 2).alias("avg_days"))


@query("greatest_least", "SELECT p_partkey, greatest(p_size, 25) AS hi, least(p_size, 25) AS lo FROM part")
def greatest_least(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.greatest("p_size", F.lit(25)).alias("hi"), F.least("p_size", F.lit(25)).alias("lo"))
