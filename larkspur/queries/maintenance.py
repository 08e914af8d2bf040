"""Statements on tables, constraints, partitions, views, statistics; each oracle computes the expected state."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from larkspur.plans import statistics
from larkspur.queries.book import Book
from larkspur.session import shared_folder, table
from larkspur.sources import partitions, tables

BOOK = Book()
query = BOOK.query


def _nation(spark, d):
    return table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")


@query("insert_rows", "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 100, 'ATLANTIS', 1 UNION ALL SELECT 101, NULL, 9")
def _(spark, d):
    db = tables.Database(spark)
    db.create_table("nation", _nation(spark, d), tables.Schema(primary_key=["n_nationkey"], defaults={"n_regionkey": "9"}))
    db.insert("nation", spark.sql("SELECT 100 AS n_nationkey, 'ATLANTIS' AS n_name, 1 AS n_regionkey"))
    return db.insert("nation", spark.sql("SELECT 101 AS n_nationkey"))


@query("serial_default", "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name FROM region UNION ALL SELECT 5, 'a' UNION ALL SELECT 6, 'b'")
def _(spark, d):
    db = tables.Database(spark)
    db.create_table("t", table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name")), tables.Schema(serial="id", primary_key=["id"]))
    return db.insert("t", spark.sql("SELECT * FROM VALUES ('b'), ('a') AS t(name)"))


@query("update_where", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def _(spark, d):
    return tables.update(table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), {"c_acctbal": "0.0", "c_mktsegment": "'DEBT'"}, "c_acctbal < 0")


@query("update_swap", "SELECT n_nationkey, n_regionkey AS a, n_nationkey AS b FROM nation")
def _(spark, d):
    return tables.update(table(spark, d, "nation").select("n_nationkey", F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("b")), {"a": "b", "b": "a"})


@query("update_case_subquery", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN (SELECT max(o_totalprice) FROM orders) WHEN o_orderstatus = 'O' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders")
def _(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    top = orders.agg(F.max("o_totalprice")).scalar()
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    return tables.update(orders, {"o_totalprice": F.when(status == "F", top).when(status == "O", price * 2).otherwise(price)}).select("o_orderkey", "o_totalprice")


@query("delete_where", "SELECT o_orderkey FROM orders WHERE NOT coalesce(nullif(o_orderstatus, 'P') = 'F', false)")
def _(spark, d):
    return tables.delete(table(spark, d, "orders"), "nullif(o_orderstatus, 'P') = 'F'").select("o_orderkey")


@query("delete_cascade", "SELECT n_nationkey FROM nation WHERE n_regionkey <> 2")
def _(spark, d):
    db = tables.Database(spark)
    db.create_table("region", table(spark, d, "region"), tables.Schema(primary_key=["r_regionkey"]))
    db.create_table("nation", _nation(spark, d), tables.Schema(foreign_keys=[tables.ForeignKey(["n_regionkey"], "region", ["r_regionkey"], "cascade")]))
    db.delete("region", "r_regionkey = 2")
    return db.table("nation").select("n_nationkey")


def _family(spark, d, on_delete="cascade", on_update="restrict"):
    """region <- nation (some without a region) <- customer."""
    db = tables.Database(spark)
    db.create_table("region", table(spark, d, "region").select("r_regionkey", "r_name"), tables.Schema(primary_key=["r_regionkey"]))
    nation = _nation(spark, d).withColumn("n_regionkey", F.when(~F.col("n_name").like("I%"), F.col("n_regionkey")))
    db.create_table("nation", nation, tables.Schema(primary_key=["n_nationkey"], foreign_keys=[tables.ForeignKey(["n_regionkey"], "region", ["r_regionkey"], on_delete, on_update)]))
    db.create_table("customer", table(spark, d, "customer").select("c_custkey", "c_nationkey"), tables.Schema(foreign_keys=[tables.ForeignKey(["c_nationkey"], "nation", ["n_nationkey"], on_delete, on_update)]))
    return db


_NULLED = "(SELECT n_nationkey, n_name, CASE WHEN n_name NOT LIKE 'I%' THEN n_regionkey END AS n_regionkey FROM nation)"


@query("delete_cascade_nulls", f"SELECT n_nationkey, n_regionkey FROM {_NULLED} WHERE n_regionkey IS DISTINCT FROM 2")
def _(spark, d):
    db = _family(spark, d)
    db.delete("region", "r_regionkey = 2")
    return db.table("nation").select("n_nationkey", "n_regionkey")


@query("delete_cascade_chain", f"SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM {_NULLED} WHERE n_regionkey IS DISTINCT FROM 2)")
def _(spark, d):
    db = _family(spark, d)
    db.delete("region", "r_regionkey = 2")
    return db.table("customer").select("c_custkey")


@query("delete_set_null", f"SELECT n_nationkey, nullif(n_regionkey, 3) AS n_regionkey FROM {_NULLED}")
def _(spark, d):
    db = _family(spark, d, on_delete="set null")
    db.delete("region", "r_regionkey = 3")
    return db.table("nation").select("n_nationkey", "n_regionkey")


@query("delete_fk_restrict", "SELECT r_regionkey, true AS refused FROM region")
def _(spark, d):
    db = _family(spark, d, on_delete="restrict")
    refused = False
    try:
        db.delete("region", "r_regionkey = 1")
    except tables.ConstraintError:
        refused = True
    return db.table("region").select("r_regionkey", F.lit(refused).alias("refused"))


@query("update_fk_restrict", "SELECT r_regionkey, true AS refused FROM region")
def _(spark, d):
    db = _family(spark, d)
    refused = False
    try:
        db.update("region", {"r_regionkey": "r_regionkey + 100"}, "r_name = 'ASIA'")
    except tables.ConstraintError:
        refused = True
    return db.table("region").select("r_regionkey", F.lit(refused).alias("refused"))


@query("update_fk_cascade", f"SELECT n_nationkey, n_regionkey + 100 AS n_regionkey FROM {_NULLED}")
def _(spark, d):
    db = _family(spark, d, on_update="cascade")
    db.update("region", {"r_regionkey": "r_regionkey + 100"})
    return db.table("nation").select("n_nationkey", "n_regionkey")


@query("alter_table", "SELECT n_nationkey AS id, CAST(n_regionkey AS VARCHAR) AS region, 'new' AS mark FROM nation")
def _(spark, d):
    db = tables.Database(spark)
    db.create_table("nation", _nation(spark, d), tables.Schema(primary_key=["n_nationkey"]))
    db.alter_table("nation", add={"mark": ("string", "'new'")}, drop=["n_name"], rename={"n_nationkey": "id", "n_regionkey": "region"}, types={"region": "string"}, constraints=tables.Schema(not_null=["id"]), to="land")
    return db.table("land")


@query("create_drop_table", "SELECT 'kept' AS name, CAST(5 AS BIGINT) AS n UNION ALL SELECT 'made', 25")
def _(spark, d):
    db = tables.Database(spark)
    db.create_table("kept", table(spark, d, "region"))
    db.create_table("gone", table(spark, d, "region"))
    db.create_table("made", _nation(spark, d), tables.Schema(primary_key=["n_nationkey"]))
    db.create_table("kept", _nation(spark, d), if_not_exists=True)
    db.drop_table("gone")
    db.drop_table("gone", if_exists=True)
    return spark.createDataFrame([(n, db.table(n).count()) for n in db.versions], "name string, n long")


@query("describe_table", "SELECT CAST(1 AS INTEGER) AS place, 'r_regionkey' AS column_name, 'bigint' AS data_type UNION ALL SELECT 2, 'r_name', 'string'")
def _(spark, d):
    db = tables.Database(spark)
    db.create_table("region", table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name"))
    return db.described("region")


@query("catalog_persistence", "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def _(spark, d):
    db = _family(spark, d)
    db.update("nation", {"n_regionkey": "coalesce(n_regionkey, n_nationkey % 5)"})
    db.delete("nation")
    db.insert("nation", _nation(spark, d))
    db.create_view("named", "SELECT r_name, n_nationkey FROM {nation} JOIN {region} ON n_regionkey = r_regionkey")
    db.prepare("counted", "SELECT r_name, count(*) AS n FROM {named} GROUP BY r_name")
    db.save_all(path := f"{shared_folder(spark)}/catalog-{uuid.uuid4().hex}")
    return tables.Database.load_all(spark, path).execute("counted")


@query("transaction_isolation", "SELECT 'read committed' AS level, count(*) AS seen FROM nation WHERE n_regionkey <> 0 UNION ALL SELECT 'repeatable read', count(*) FROM nation UNION ALL SELECT 'serializable', -1")
def _(spark, d):
    db = tables.Database(spark)
    db.create_table("nation", _nation(spark, d))
    open_ = {level: db.begin(level) for level in tables.Transaction.LEVELS}
    open_["serializable"].table("nation")
    other = db.begin()
    other.delete("nation", "n_regionkey = 0")
    other.commit()
    seen = [(level, t.table("nation").count()) for level, t in open_.items() if level != "serializable"]
    try:
        open_["serializable"].commit()
    except tables.SerializationError:
        seen.append(("serializable", -1))
    return spark.createDataFrame(seen, "level string, seen long")


@query("rollback_ddl", "SELECT n_nationkey, n_name FROM nation")
def _(spark, d):
    db = tables.Database(spark)
    db.create_table("nation", _nation(spark, d).select("n_nationkey", "n_name"))
    db.savepoint("a")
    db.alter_table("nation", drop=["n_name"])
    db.drop_table("nation")
    db.create_view("nation", lambda: spark.range(1))
    db.rollback("a")
    return db.table("nation")


@query("index_scan", "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 300000 AND o_orderpriority = '1-URGENT'")
def _(spark, d):
    db = tables.Database(spark)
    db.create_table("orders", table(spark, d, "orders"))
    db.create_index("orders", "by_price", ["o_totalprice"])
    db.create_index("orders", "by_priority", ["o_orderpriority"], method="hash")
    db.save_indexed("orders", path := f"{shared_folder(spark)}/orders-{uuid.uuid4().hex}", 8)
    return spark.read.parquet(path).where("o_totalprice > 300000 AND o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey")


@query("pk_violations", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM (SELECT l_orderkey, nullif(l_linenumber, 7) AS l_linenumber FROM lineitem) GROUP BY ALL HAVING count(*) > 1 OR l_linenumber IS NULL")
def _(spark, d):
    return tables.key_violations(table(spark, d, "lineitem").select("l_orderkey", F.nullif("l_linenumber", F.lit(7)).alias("l_linenumber")), ["l_orderkey", "l_linenumber"])


@query("unique_violations", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    return tables.duplicate_keys(table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"])


@query("fk_violations", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _(spark, d):
    return tables.orphans(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], table(spark, d, "customer").where("c_acctbal > 0"), ["c_custkey"])


@query("check_violations", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT coalesce(nullif(l_quantity, 50) < 40 AND l_discount <= 0.1, true)")
def _(spark, d):
    return tables.check_violations(table(spark, d, "lineitem"), "nullif(l_quantity, 50) < 40 AND l_discount <= 0.1").select("l_orderkey", "l_linenumber")


@query("not_null_violations", "SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'P') IS NULL")
def _(spark, d):
    return tables.null_violations(table(spark, d, "orders").withColumn("s", F.nullif("o_orderstatus", F.lit("P"))), ["s"]).select("o_orderkey")


@query("savepoint_rollback", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey <> 3")
def _(spark, d):
    db = tables.Database(spark)
    db.create_table("nation", _nation(spark, d))
    db.savepoint("begin")
    db.delete("nation", "n_nationkey = 3")
    db.savepoint("a")
    db.update("nation", {"n_name": "'X'"})
    db.rollback("a")
    return db.table("nation").select("n_nationkey", "n_name")


@query("matview_refresh", "SELECT r_name, n FROM (SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey < 20 GROUP BY n_regionkey) JOIN region ON n_regionkey = r_regionkey WHERE n > 1")
def _(spark, d):
    db = tables.Database(spark)
    db.create_table("nation", _nation(spark, d))
    db.create_materialized_view("by_region", "SELECT n_regionkey, count(*) AS n FROM {nation} GROUP BY n_regionkey", f"{shared_folder(spark)}/mv-{uuid.uuid4().hex}")
    db.delete("nation", "n_nationkey >= 20")
    db.refresh("by_region")
    return db.table("by_region").where("n > 1").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n")


@query("scd2_current", "SELECT p_partkey AS id, p_size AS size, CAST(1 AS BIGINT) AS since, CAST(CASE WHEN p_partkey % 3 = 0 THEN 2 END AS BIGINT) AS until, p_partkey % 3 <> 0 AS current FROM part UNION ALL SELECT p_partkey, p_size + 1, 2, NULL, true FROM part WHERE p_partkey % 3 = 0")
def _(spark, d):
    items = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"), F.lit(1).cast("long").alias("since"), F.lit(None).cast("long").alias("until"), F.lit(True).alias("current"))
    changed = "id % 3 = 0"
    closed = tables.update(items, {"until": "2", "current": "false"}, changed)
    return closed.unionByName(items.where(changed).select("id", (F.col("size") + 1).alias("size"), F.lit(2).cast("long").alias("since"), "until", "current"))


# Partitions ------------------------------------------------------------------------------------------------------------------


@query("partition_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 50000 AND o_totalprice <= 180000")
def _(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    p = partitions.Partitioned("o_totalprice")
    for name, low, high in (("p0", None, 100000.0), ("p1", 100000.0, 200000.0), ("p2", 200000.0, None)):
        p.attach(name, orders.limit(0), (low, high))
    p.route(orders)
    return p.scan(50000.0, 180000.0)


@query("partition_list", "SELECT CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'heavy' WHEN c_mktsegment = 'FURNITURE' THEN 'light' ELSE 'rest' END AS child, count(*) AS n FROM customer GROUP BY 1")
def _(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    p = partitions.Partitioned("c_mktsegment")
    for name, bound in (("heavy", ["BUILDING", "MACHINERY"]), ("light", ["FURNITURE"]), ("rest", None)):
        p.attach(name, rows.limit(0), bound)
    p.route(rows)
    return p.scan(names=True).groupBy(F.col("_child").alias("child")).agg(F.count("*").alias("n"))


@query("partition_hash", "SELECT 'h' || c_custkey % 4 AS child, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS total FROM customer GROUP BY 1")
def _(spark, d):
    rows = table(spark, d, "customer").select("c_custkey")
    p = partitions.Partitioned("c_custkey")
    for k in range(4):
        p.attach(f"h{k}", rows.limit(0), {"modulus": 4, "remainder": k})
    p.route(rows)
    p.write(path := f"{shared_folder(spark)}/hash-{uuid.uuid4().hex}")
    stored = spark.read.parquet(path)
    return stored.groupBy(F.col("_child").alias("child")).agg(F.count("*").alias("n"), F.sum("c_custkey").cast("long").alias("total"))


@query("partition_detach", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'")
def _(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    p = partitions.Partitioned("c_mktsegment")
    p.attach("building", rows.limit(0), ["BUILDING"])
    p.attach("others", rows.limit(0), None)
    p.route(rows)
    p.detach("building")
    return p.scan()


# Statistics ------------------------------------------------------------------------------------------------------------------


@query("stats_analyze", "SELECT 'o_custkey' AS column_name, count(*) AS n_rows, count(*) - count(o_custkey) AS n_null, count(DISTINCT o_custkey) AS n_distinct, CAST(min(o_custkey) AS VARCHAR) AS low, CAST(max(o_custkey) AS VARCHAR) AS high FROM orders UNION ALL SELECT 'o_orderstatus', count(*), count(*) - count(o_orderstatus), count(DISTINCT o_orderstatus), min(o_orderstatus), max(o_orderstatus) FROM orders")
def _(spark, d):
    return statistics.analyze(table(spark, d, "orders"), ["o_custkey", "o_orderstatus"])


@query("stats_common_values", "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, value LIMIT 3")
def _(spark, d):
    return statistics.common_values(table(spark, d, "orders"), "o_orderpriority", 3)


@query("histogram_equidepth", "SELECT CAST(b AS BIGINT) AS bucket, min(o_orderkey) AS low, max(o_orderkey) AS high, count(*) AS n FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) * 10 // (SELECT count(*) FROM orders) AS b FROM orders) GROUP BY b")
def _(spark, d):
    return statistics.equi_depth(table(spark, d, "orders"), "o_orderkey", 10)


# Batch form of the streaming operator ----------------------------------------------------------------------------------------


@query("events_hourly", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    from larkspur.streaming import events

    return events.hourly(table(spark, d, "events")).select(F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n")
