"""Aggregates and windows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.operators import aggregates, windows
from larkspur.queries.book import Book
from larkspur.session import table

BOOK = Book()
both, query = BOOK.both, BOOK.query

both("agg_global", "SELECT count(*) AS n, count(nullif(l_returnflag, 'N')) AS known, round(sum(l_quantity), 2) AS quantity, round(avg(l_extendedprice), 4) AS price, min(l_discount) AS low, max(l_returnflag) AS last FROM {lineitem}")
both("agg_group", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_quantity), 4) AS quantity, min(l_tax) AS low, max(l_tax) AS high FROM {lineitem} GROUP BY l_returnflag, l_linestatus")
both("agg_group_expr", "SELECT upper(o_orderstatus) AS s, o_custkey % 10 AS k, count(*) AS n FROM {orders} GROUP BY upper(o_orderstatus), o_custkey % 10")
both("agg_having", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 12 AND sum(o_totalprice) > 1000")
both("agg_count_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities FROM {orders} GROUP BY o_orderstatus")
both("agg_empty_input", "SELECT count(*) AS n, count(o_custkey) AS m, sum(o_totalprice) AS s, avg(o_totalprice) AS a, min(o_orderkey) AS low, max(o_orderkey) AS high FROM {orders} WHERE o_totalprice < 0")
both("agg_null_groups", "SELECT nullif(o_orderstatus, 'O') AS s, count(*) AS n, count(nullif(o_orderpriority, '1-URGENT')) AS m FROM {orders} GROUP BY nullif(o_orderstatus, 'O')")
both("agg_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)")
both("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)")
both("agg_filter", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS many FROM {lineitem} GROUP BY l_returnflag")
both("agg_distinct_skewed", "SELECT l_linestatus, count(DISTINCT l_orderkey) AS n FROM {lineitem} GROUP BY l_linestatus")


@query("agg_int_avg", "SELECT p_brand, CAST(sum(p_size) // count(p_size) AS BIGINT) AS a FROM part GROUP BY p_brand")
def _(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(aggregates.int_avg("p_size").alias("a"))


@query("agg_custom_fold", "SELECT o_custkey, CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders GROUP BY o_custkey")
def _(spark, d):
    fold = aggregates.Fold("bigint", lambda a, x: a + x, merge=lambda a, b: a + b)
    return fold.apply(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", "s")


@query("agg_custom_finalfunc", "SELECT o_orderstatus, CAST(10 + 2 * sum(o_orderkey % 5) AS BIGINT) AS s FROM orders GROUP BY o_orderstatus")
def _(spark, d):
    fold = aggregates.Fold("bigint", lambda a, x: a + x, finish=lambda s: s * 2 + 10, merge=lambda a, b: a + b)
    return fold.apply(table(spark, d, "orders").select("o_orderstatus", (F.col("o_orderkey") % 5).alias("v"), "o_orderkey"), ["o_orderstatus"], "v", "s")


@query("agg_custom_ordered", "SELECT o_custkey, string_agg(o_orderstatus, '' ORDER BY o_orderstatus) AS s FROM orders GROUP BY o_custkey")
def _(spark, d):
    fold = aggregates.Fold("string", lambda a, x: F.concat(a, x))
    return fold.apply(table(spark, d, "orders"), ["o_custkey"], "o_orderstatus", "s")


# Windows ---------------------------------------------------------------------------------------------------------------------

_ORDERED = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
for _name, _f in (
    ("win_row_number", "row_number()"),
    ("win_lag", "lag(o_orderkey)"),
    ("win_lag_2", "lag(o_orderkey, 2)"),
    ("win_lead", "lead(o_orderkey, 1)"),
    ("win_ntile", "ntile(3)"),
    ("win_first_value", "first_value(o_orderkey)"),
    ("win_last_value_default", "last_value(o_orderkey)"),
):
    both(_name, f"SELECT o_orderkey, CAST({_f} OVER ({_ORDERED}) AS BIGINT) AS v FROM {{orders}}")
for _name, _f in (("win_rank", "CAST(rank()"), ("win_dense_rank", "CAST(dense_rank()")):
    both(_name, f"SELECT o_orderkey, {_f} OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS v FROM {{orders}}")
for _name, _f in (("win_percent_rank", "percent_rank()"), ("win_cume_dist", "cume_dist()")):
    both(_name, f"SELECT o_orderkey, round({_f} OVER (PARTITION BY o_custkey ORDER BY o_orderpriority), 6) AS v FROM {{orders}}")
both("win_last_value", f"SELECT o_orderkey, last_value(o_orderkey) OVER ({_ORDERED} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v FROM {{orders}}")
both("win_nth_value", f"SELECT o_orderkey, nth_value(o_orderkey, 2) OVER ({_ORDERED} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v FROM {{orders}}")
both("win_rows_frame", f"SELECT o_orderkey, round(sum(o_totalprice) OVER ({_ORDERED} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS v FROM {{orders}}")
both("win_range_frame", "SELECT l_orderkey, l_linenumber, l_suppkey, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_quantity RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS v FROM {lineitem}")
both("win_agg_over", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, max(o_totalprice) OVER (PARTITION BY o_custkey) AS top FROM {orders}")
both("win_multi", f"SELECT o_orderkey, CAST(row_number() OVER ({_ORDERED}) AS BIGINT) AS a, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS BIGINT) AS b FROM {{orders}}")
both("win_null_order", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY nullif(o_orderstatus, 'O') ASC NULLS LAST, o_orderkey) AS BIGINT) AS v FROM {orders}")


@query("win_groups_frame", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_type GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW), 4) AS v FROM events")
def _(spark, d):
    df = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return windows.groups_frame(df, F.sum("value"), ["user_id"], ["event_type"], -1, 0, "v").select("event_id", F.round("v", 4).alias("v"))


@query("win_groups_desc", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_type DESC GROUPS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM events")
def _(spark, d):
    df = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return windows.groups_frame(df, F.count("*"), ["user_id"], ["-event_type"], 0, Window.unboundedFollowing, "v").select("event_id", "v")
