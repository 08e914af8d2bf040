"""Scans, projection, filters, sorting, joins, subqueries and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import joins, ordering, recursive, sets
from larkspur.queries.book import Book
from larkspur.session import table

BOOK = Book()
both, query = BOOK.both, BOOK.query

# Scans, projection, filters: one text serves Spark and DuckDB ---------------------------------------------------------------

both("scan_project", "SELECT o_orderkey, o_custkey AS customer, o_orderstatus FROM (SELECT * FROM {orders}) t")
both("constant_select", "SELECT CAST(1 AS BIGINT) AS one, 'two' AS two, CAST(NULL AS BIGINT) AS nothing")
both("star_qualified", "SELECT n.*, r.r_name FROM {nation} n JOIN {region} r ON n.n_regionkey = r.r_regionkey")
both("filter_comparison", "SELECT p_partkey, p_size FROM {part} WHERE p_size >= 10 AND p_size < 40 AND p_size != 20 AND p_retailprice > 900")
both("filter_logic_null", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE NOT (l_quantity > 10 OR nullif(l_returnflag, 'N') IS NULL) AND (nullif(l_linestatus, 'F') IS NOT NULL OR l_discount > 0.05)")
both("filter_between_in", "SELECT o_orderkey FROM {orders} WHERE o_totalprice BETWEEN 10000 AND 200000 AND o_orderstatus IN ('F', 'O') AND o_orderpriority NOT IN ('1-URGENT', '5-LOW')")
both("filter_like", "SELECT p_partkey, p_type FROM {part} WHERE p_type LIKE '%E%' AND p_brand LIKE 'Brand#_%' AND p_name NOT LIKE 'zz%'")
both("filter_ilike", "SELECT p_partkey, p_type FROM {part} WHERE p_type ILIKE '%e%'")
both("case_when", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'small' END AS size FROM {orders}")
both("coalesce_nullif", "SELECT l_orderkey, l_linenumber, coalesce(nullif(l_returnflag, 'N'), nullif(l_linestatus, 'O'), 'none') AS flag FROM {lineitem}")
both("arith_int_div_mod", "SELECT p_partkey, p_size + 3 AS plus, p_size - 100 AS minus, p_size * 2 AS times, -p_size AS negative, p_partkey % 7 AS rest, (p_size - 25) % 7 AS signed_rest, CAST((p_size - 25) DIV 7 AS BIGINT) AS quotient FROM {part}", duck="SELECT p_partkey, p_size + 3 AS plus, p_size - 100 AS minus, p_size * 2 AS times, -p_size AS negative, p_partkey % 7 AS rest, (p_size - 25) % 7 AS signed_rest, CAST((p_size - 25) // 7 AS BIGINT) AS quotient FROM part")
both("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM {lineitem}")
both("view_query", "SELECT c_mktsegment, count(*) AS n FROM (SELECT * FROM {customer} WHERE c_acctbal > 0) rich GROUP BY c_mktsegment")
both("derived_table", "SELECT d.k, d.n FROM (SELECT o_custkey AS k, count(*) AS n FROM {orders} GROUP BY o_custkey) d WHERE d.n > 5")


@query("sort_nulls_limit_offset", "SELECT o_orderkey, nullif(o_orderstatus, 'O') AS s FROM orders ORDER BY s ASC NULLS LAST, o_orderkey DESC LIMIT 50 OFFSET 20")
def _(spark, d):
    return ordering.top_k(table(spark, d, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("O")).alias("s")), 50, "s", "-o_orderkey", offset=20)


@query("sort_desc_nulls_first", "SELECT o_orderkey, nullif(o_orderstatus, 'O') AS s FROM orders ORDER BY s DESC NULLS FIRST, o_orderkey LIMIT 100")
def _(spark, d):
    return ordering.top_k(table(spark, d, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("O")).alias("s")), 100, "-s", "o_orderkey")


@query("topk_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(spark, d):
    return ordering.top_k(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 10, "-o_totalprice", "o_orderkey")


@query("topk_per_group", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def _(spark, d):
    return ordering.top_k_per_group(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), 2, ["o_custkey"], "-o_totalprice", "o_orderkey").drop("o_totalprice")


@query("cursor_fetch", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 9")
def _(spark, d):
    c = ordering.Cursor(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    c.absolute(9)
    return c.fetch(20)


# Joins -----------------------------------------------------------------------------------------------------------------------

both("join_inner", "SELECT o_orderkey, c_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey")
both("join_left", "SELECT c_custkey, o_orderkey FROM {customer} LEFT JOIN (SELECT * FROM {orders} WHERE o_totalprice > 400000) o ON c_custkey = o_custkey")
both("join_right", "SELECT c_custkey, o_orderkey FROM (SELECT * FROM {orders} WHERE o_totalprice > 400000) o RIGHT JOIN {customer} ON c_custkey = o_custkey")
both("join_full", "SELECT c_custkey, s_suppkey FROM (SELECT * FROM {customer} WHERE c_acctbal > 0) c FULL JOIN (SELECT * FROM {supplier} WHERE s_acctbal > 0) s ON c_custkey = s_suppkey")
both("join_cross", "SELECT a.r_name AS a, b.r_name AS b FROM {region} a CROSS JOIN (SELECT * FROM {region}) b")
both("join_theta", "SELECT a.n_nationkey AS low, b.n_nationkey AS high FROM {nation} a JOIN (SELECT * FROM {nation}) b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
both("join_composite_key", "SELECT a.l_orderkey, a.l_linenumber, b.total FROM {lineitem} a JOIN (SELECT l_orderkey, l_linenumber, round(sum(l_quantity), 2) AS total FROM {lineitem} GROUP BY l_orderkey, l_linenumber) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber")


@query("join_self", "SELECT a.c_mktsegment AS segment, a.c_nationkey AS nation, count(*) AS n, sum(b.c_custkey - a.c_custkey) AS apart FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey GROUP BY a.c_mktsegment, a.c_nationkey")
def _(spark, d):
    pairs = joins.pairs_below(table(spark, d, "customer").select("c_mktsegment", "c_nationkey", "c_custkey"), ["c_mktsegment", "c_nationkey"], "c_custkey")
    return pairs.select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), F.col("_n").alias("n"), F.col("_apart").alias("apart"))


both("join_three_way", "SELECT n_name, c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS revenue FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name, c_mktsegment")
both("join_null_safe", "SELECT a.k AS a, b.k AS b FROM (SELECT nullif(n_regionkey, 1) AS k FROM {nation}) a JOIN (SELECT nullif(r_regionkey, 1) AS k FROM {region}) b ON a.k <=> b.k", duck="SELECT a.k AS a, b.k AS b FROM (SELECT nullif(n_regionkey, 1) AS k FROM nation) a JOIN (SELECT nullif(r_regionkey, 1) AS k FROM region) b ON a.k IS NOT DISTINCT FROM b.k")
both("join_null_keys", "SELECT a.k AS a, b.k AS b FROM (SELECT nullif(n_regionkey, 1) AS k FROM {nation}) a LEFT JOIN (SELECT nullif(r_regionkey, 1) AS k FROM {region}) b ON a.k = b.k")
both("join_group_by", "SELECT c_name, count(*) AS n FROM {customer} JOIN {orders} ON c_custkey = o_custkey GROUP BY c_name")

_PAIR = "SELECT s_name, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name"


def _hinted(hint):
    def run(spark, d):
        lines, suppliers = table(spark, d, "lineitem").select("l_suppkey"), table(spark, d, "supplier").select("s_suppkey", "s_name")
        return joins.join(lines, suppliers, F.col("l_suppkey") == F.col("s_suppkey"), hint=hint).groupBy("s_name").agg(F.count("*").alias("n"))

    return run


for _hint in ("shuffle_hash", "merge", "broadcast"):
    BOOK.add(f"join_{_hint}_hint", _hinted(_hint), _PAIR)


@query("range_join", "SELECT o_orderkey, s_suppkey FROM orders JOIN supplier ON o_custkey >= s_suppkey * 10 AND o_custkey < s_suppkey * 10 + 5")
def _(spark, d):
    ranges = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") * 10).alias("low"), (F.col("s_suppkey") * 10 + 5).alias("high"))
    return joins.range_join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ranges, "o_custkey", "low", "high", 64).select("o_orderkey", "s_suppkey")


# Subqueries ------------------------------------------------------------------------------------------------------------------


@query("semi_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def _(spark, d):
    return joins.exists(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").where("o_totalprice > 300000"), F.col("o_custkey") == F.col("c_custkey"))


@query("anti_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def _(spark, d):
    return joins.not_exists(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").where("o_totalprice > 300000"), F.col("o_custkey") == F.col("c_custkey"))


@query("in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(spark, d):
    return joins.in_subquery(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")).select("o_orderkey")


@query("not_in_subquery", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber NOT IN (SELECT n_regionkey FROM nation)")
def _(spark, d):
    return joins.not_in_subquery(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_linenumber", table(spark, d, "nation").select("n_regionkey"))


@query("not_in_with_null", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT nullif(r_regionkey, 1) FROM region)")
def _(spark, d):
    return joins.not_in_subquery(table(spark, d, "nation").select("n_nationkey"), "n_nationkey", table(spark, d, "region").select(F.nullif("r_regionkey", F.lit(1)).alias("k")))


@query("not_in_null_outer", "SELECT n_nationkey, k FROM (SELECT n_nationkey, nullif(n_regionkey, 1) AS k FROM nation) WHERE k NOT IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')")
def _(spark, d):
    outer = table(spark, d, "nation").select("n_nationkey", F.nullif("n_regionkey", F.lit(1)).alias("k"))
    return joins.not_in_subquery(outer, "k", table(spark, d, "region").where("r_name LIKE 'A%'").select("r_regionkey"))


for _name, _how, _op in (("any_equal", "any", "="), ("any_less", "any", "<"), ("all_greater", "all", ">"), ("all_not_equal", "all", "<>")):

    def _run(spark, d, how=_how, op=_op):
        inner = table(spark, d, "part").where("p_size BETWEEN 30 AND 45").select(F.col("p_size").cast("double"))
        f = joins.any_of if how == "any" else joins.all_of
        return f(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", op, inner)

    BOOK.add(_name, _run, f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity {_op} {_how.upper()} (SELECT CAST(p_size AS DOUBLE) FROM part WHERE p_size BETWEEN 30 AND 45)")


@query("all_empty", "SELECT o_orderkey FROM orders WHERE o_totalprice > ALL (SELECT c_acctbal FROM customer WHERE c_acctbal < -100000)")
def _(spark, d):
    return joins.all_of(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", ">", table(spark, d, "customer").where("c_acctbal < -100000").select("c_acctbal")).select("o_orderkey")


both("scalar_subquery", "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT max(o_totalprice) * 0.9 FROM {orders})")
both("correlated_scalar", "SELECT c_custkey, (SELECT max(o_totalprice) FROM {orders} WHERE o_custkey = c_custkey) AS top FROM {customer}")
both("correlated_in", "SELECT c_custkey FROM {customer} WHERE c_nationkey IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = c_custkey % 5)")


@query("lateral_sql", "SELECT c.c_custkey, t.o_orderkey FROM customer c, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t")
def _(spark, d):
    """Not by Spark's own LATERAL: it numbers the rows of a LIMIT in the order in which they come out of a shuffle, after a sort of all."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    order = [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey").asc_nulls_last()]
    return joins.lateral_top_n(table(spark, d, "customer").select("c_custkey"), orders, ("c_custkey", "o_custkey"), 2, order).select("c_custkey", "o_orderkey")


@query("lateral_topn", "SELECT c_custkey, o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 3) t")
def _(spark, d):
    return joins.lateral_top_n(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ("c_custkey", "o_custkey"), 3, [F.col("o_totalprice").desc(), F.col("o_orderkey")]).select("c_custkey", "o_orderkey")


# Set operations and CTEs -----------------------------------------------------------------------------------------------------

for _name, _f, _sql in (("union_all", sets.union_all, "UNION ALL"), ("union_distinct", sets.union, "UNION"), ("intersect_distinct", sets.intersect, "INTERSECT"), ("except_distinct", sets.except_, "EXCEPT")):

    def _run(spark, d, f=_f):
        return f(table(spark, d, "lineitem").select(F.col("l_linenumber").cast("long").alias("k")), table(spark, d, "nation").select(F.col("n_regionkey").cast("long")))

    BOOK.add(_name, _run, f"SELECT CAST(l_linenumber AS BIGINT) AS k FROM lineitem {_sql} SELECT CAST(n_regionkey AS BIGINT) FROM nation")

both("set_chain", "SELECT n_nationkey AS k FROM {nation} EXCEPT SELECT r_regionkey FROM {region} UNION SELECT c_nationkey FROM {customer} WHERE c_acctbal < 0")
both("cte_single", "WITH big AS (SELECT * FROM {orders} WHERE o_totalprice > 200000) SELECT o_orderstatus, count(*) AS n FROM big GROUP BY o_orderstatus")
both("cte_chain", "WITH a AS (SELECT o_custkey, sum(o_totalprice) AS s FROM {orders} GROUP BY o_custkey), b AS (SELECT max(s) AS m FROM a) SELECT o_custkey FROM a, b WHERE s = m")
both("cte_nested", "WITH a AS (WITH b AS (SELECT n_regionkey AS r, count(*) AS n FROM {nation} GROUP BY n_regionkey) SELECT * FROM b WHERE n > 1) SELECT r_name, n FROM a JOIN {region} ON r = r_regionkey")
both("recursive_counter", "WITH RECURSIVE t(n) AS (SELECT CAST(1 AS BIGINT) UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n FROM t")


@query("recursive_cycle_distinct", "WITH RECURSIVE t(n) AS (SELECT CAST(1 AS BIGINT) UNION SELECT n % 3 + 1 FROM t) SELECT n FROM t")
def _(spark, d):
    return recursive.recursive_union(spark.range(1, 2).toDF("n"), lambda t: t.select(F.col("n") % 3 + 1))


@query("recursive_tree", "WITH RECURSIVE t(id, depth) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS BIGINT) UNION SELECT id * 2 + b, depth + 1 FROM t, (VALUES (0), (1)) v(b) WHERE depth < 3) SELECT id, depth FROM t")
def _(spark, d):
    seed = spark.range(1, 2).select(F.col("id"), F.lit(0).cast("long").alias("depth"))
    return recursive.recursive_union(seed, lambda t: t.where("depth < 3").select(F.explode(F.array(F.col("id") * 2, F.col("id") * 2 + 1)), F.col("depth") + 1))


@query("recursive_graph", "WITH RECURSIVE t(n) AS (SELECT CAST(0 AS BIGINT) UNION SELECT CAST(n_nationkey AS BIGINT) FROM t JOIN nation ON n_regionkey = t.n % 5) SELECT n FROM t")
def _(spark, d):
    edges = table(spark, d, "nation").select(F.col("n_regionkey"), F.col("n_nationkey"))
    return recursive.recursive_union(spark.range(1).toDF("n"), lambda t: t.join(edges, F.col("n") % 5 == F.col("n_regionkey")).select("n_nationkey"))
