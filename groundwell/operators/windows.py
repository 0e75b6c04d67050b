"""Window aggregates and relative time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.timewindow import resolve
from .registry import QUERIES, Tables, query

#: The last day with data; relative periods count back from it.
AS_OF = "2001-07-31"


def running_sum(df: DataFrame, key: str, order: list[str], value: str, span: Column) -> DataFrame:
    """Adds ``run``: the sum of ``value`` so far in each key, in that order.

    ``span`` must not fall as the order goes on.  Sums run within each (key, span)
    and start at the total of the key's spans before, so the rows of a hot key
    never meet in one task; only its totals do.
    """
    df = df.withColumn("_span", span)
    totals = df.groupBy(key, "_span").agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(key, "_span", F.coalesce(F.sum("_total").over(earlier), F.lit(0.0)).alias("_before"))
    within = Window.partitionBy(key, "_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.join(before, [key, "_span"]).withColumn("run", F.col("_before") + F.sum(value).over(within)).drop("_span", "_before")


@query("window_running_sum", "SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS run FROM orders")
def window_running_sum(t: Tables) -> DataFrame:
    orders = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    summed = running_sum(orders, "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice", F.date_format("o_orderdate", "yyyy-MM"))
    return summed.select("o_custkey", "o_orderkey", F.round("run", 2).alias("run"))


@query("window_partition_share", "SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share FROM orders")
def window_partition_share(t: Tables) -> DataFrame:
    """The sum is aggregated before the join, so no task needs a whole customer."""
    orders = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    whole = orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("whole"))
    return orders.join(whole, "o_custkey").select("o_orderkey", F.round(F.col("o_totalprice") / F.col("whole"), 6).alias("share"))


@query(
    "window_count_min_max",
    "SELECT l_orderkey, l_linenumber, count(*) OVER w AS n, min(l_quantity) OVER w AS lo, max(l_shipdate) OVER w AS last_ship FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)",
)
def window_count_min_max(t: Tables) -> DataFrame:
    whole = Window.partitionBy("l_orderkey")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.count("*").over(whole).alias("n"), F.min("l_quantity").over(whole).alias("lo"), F.max("l_shipdate").over(whole).alias("last_ship"))


@query("window_moving_average", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS mean3 FROM orders")
def window_moving_average(t: Tables) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, Window.currentRow)
    return t.orders.select("o_orderkey", F.round(F.avg("o_totalprice").over(order), 4).alias("mean3"))


#: Query name, the period in words, and its bounds for the oracle.
_PERIODS = (
    ("window_last_month_count", "last month", "2001-06-01", "2001-07-01"),
    ("tw_last_n_days", "in the last 7 days", "2001-07-25", "2001-08-01"),
    ("tw_yesterday", "yesterday", "2001-07-30", "2001-07-31"),
    ("tw_last_week", "last week", "2001-07-23", "2001-07-30"),
    ("tw_this_month", "this month", "2001-07-01", "2001-08-01"),
    ("tw_last_quarter", "last quarter", "2001-04-01", "2001-07-01"),
    ("tw_last_year", "last year", "2000-01-01", "2001-01-01"),
    ("tw_named_quarter", "in Q2 2000", "2000-04-01", "2000-07-01"),
    ("tw_since_month", "since November", "2000-11-01", "2001-08-01"),
    ("tw_named_month", "in June 1998", "1998-06-01", "1998-07-01"),
    ("tw_bare_year", "in 1998", "1998-01-01", "1999-01-01"),
)


def _orders_in(words: str):
    def build(t: Tables) -> DataFrame:
        window = resolve(f"how many orders {words}", AS_OF)
        return t.orders.where(window.contains("o_orderdate")).agg(F.count("*").alias("n"))

    return build


for _name, _words, _start, _end in _PERIODS:
    query(_name, f"SELECT count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '{_start}' AND o_orderdate < TIMESTAMP '{_end}'")(_orders_in(_words))

assert all(name in QUERIES for name, *_ in _PERIODS)
