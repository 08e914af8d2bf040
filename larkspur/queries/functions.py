"""Scalar, array, JSON, range, enum and composite functions; table functions and user-defined ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import ranges, scalar, series, user
from larkspur.queries.book import Book
from larkspur.session import sql, table
from larkspur.sources import tables

BOOK = Book()
both, query = BOOK.both, BOOK.query


@query("fn_string", "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, CAST(strlen(c_name || 'é') AS BIGINT) AS n_bytes, CAST(length(c_name || 'é') AS BIGINT) AS n_chars, concat(c_name, nullif(c_mktsegment, 'BUILDING'), CAST(c_nationkey AS VARCHAR)) AS joined, substring(c_name, 1, 4) AS head, substring(c_name, 3) AS tail, trim(c_mktsegment) AS t, c_name || '-' || c_mktsegment AS piped FROM customer")
def _(spark, d):
    name, seg = F.col("c_name"), F.col("c_mktsegment")
    spaced = F.concat(F.lit("\t "), seg, F.lit(" \n"))
    return table(spark, d, "customer").select(
        "c_custkey", F.upper(name).alias("u"), F.lower(seg).alias("l"), scalar.byte_length(F.concat(name, F.lit("é"))).cast("long").alias("n_bytes"), F.length(F.concat(name, F.lit("é"))).cast("long").alias("n_chars"),
        scalar.concat(name, F.nullif(seg, F.lit("BUILDING")), F.col("c_nationkey")).alias("joined"), scalar.substring(name, 0, 4).alias("head"), scalar.substring(name, 3).alias("tail"), scalar.trim(spaced).alias("t"), F.concat(name, F.lit("-"), seg).alias("piped"),
    )


@query("fn_split_replace", "SELECT p_partkey, split_part(p_brand, '#', 1) AS a, split_part(p_brand, '#', 2) AS b, split_part(p_brand, '#', 9) AS c, replace(p_type, 'E', 'e') AS r FROM part")
def _(spark, d):
    b = F.col("p_brand")
    return table(spark, d, "part").select("p_partkey", *[scalar.split_part(b, "#", n).alias(x) for n, x in ((1, "a"), (2, "b"), (9, "c"))], F.replace("p_type", F.lit("E"), F.lit("e")).alias("r"))


@query("fn_math", "SELECT p_partkey, abs(p_size - 25) AS a, CAST(pow(p_size, 2) AS BIGINT) AS p, CAST(floor(sqrt(p_size)) AS BIGINT) AS s, mod(p_size, 7) AS m, round(p_retailprice, 1) AS r, CAST(ceil(p_retailprice) AS BIGINT) AS c, CAST(floor(p_retailprice) AS BIGINT) AS f FROM part")
def _(spark, d):
    size, price = F.col("p_size"), F.col("p_retailprice")
    return table(spark, d, "part").select("p_partkey", F.abs(size - 25).alias("a"), scalar.int_power(size, 2).alias("p"), scalar.int_sqrt(size).alias("s"), (size % 7).alias("m"), F.round(price, 1).alias("r"), F.ceil(price).alias("c"), F.floor(price).alias("f"))


@query("fn_extract", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS epoch, " + ", ".join(f"CAST(extract({f} FROM ts) AS BIGINT) AS {f}" for f in ("year", "month", "day", "hour", "minute", "second")) + " FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", *[scalar.extract(f, "ts").alias(f) for f in ("epoch", "year", "month", "day", "hour", "minute", "second")])


@query("fn_date_trunc", "SELECT event_id, " + ", ".join(f"strftime(date_trunc('{f}', ts), '%Y-%m-%d %H:%M:%S') AS t_{f}" for f in ("year", "month", "day", "hour", "minute", "second")) + " FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", *[F.date_format(scalar.date_trunc(f, "ts"), "yyyy-MM-dd HH:mm:ss").alias(f"t_{f}") for f in ("year", "month", "day", "hour", "minute", "second")])


# Arrays ----------------------------------------------------------------------------------------------------------------------

def _arrays(spark, d):
    k, r = F.col("n_nationkey").cast("long"), F.col("n_regionkey").cast("long")
    return table(spark, d, "nation").select("n_nationkey", F.array(k, r, F.lit(3).cast("long")).alias("a"), F.array(r, F.lit(3).cast("long")).alias("b"))


_DUCK_A = "SELECT n_nationkey, [CAST(n_nationkey AS BIGINT), CAST(n_regionkey AS BIGINT), CAST(3 AS BIGINT)] AS a, [CAST(n_regionkey AS BIGINT), CAST(3 AS BIGINT)] AS b FROM nation"
for _name, _make, _duck in (
    ("fn_array_contains", lambda: {"v": scalar.array_contains_all(F.col("a"), F.col("b")), "e": F.array_contains("a", F.lit(4).cast("long"))}, "list_has_all(a, b) AS v, list_contains(a, 4) AS e"),
    ("fn_array_contained_by", lambda: {"v": scalar.array_contained_by(F.col("a"), F.col("b"))}, "list_has_all(b, a) AS v"),
    ("fn_array_overlaps", lambda: {"v": scalar.array_overlaps(F.col("a"), F.array(F.lit(1).cast("long"), F.lit(7).cast("long")))}, "list_has_any(a, [1, 7]) AS v"),
    ("fn_array_concat", lambda: {"v": F.array_join(F.concat("a", "b"), ","), "w": F.array_join(F.array_append("a", F.lit(9).cast("long")), ","), "x": F.array_join(F.array_prepend("a", F.lit(9).cast("long")), ",")}, "array_to_string(a || b, ',') AS v, array_to_string(list_append(a, 9), ',') AS w, array_to_string(list_prepend(9, a), ',') AS x"),
    ("fn_array_element", lambda: {"v": scalar.array_element(F.col("a"), 1), "w": scalar.array_element(F.col("a"), 3), "x": scalar.array_element(F.col("a"), 9)}, "a[1] AS v, a[3] AS w, a[9] AS x"),
    ("fn_array_length", lambda: {"v": F.size("a").cast("long"), "w": F.size(F.array_append("b", F.lit(1).cast("long"))).cast("long")}, "CAST(len(a) AS BIGINT) AS v, CAST(len(list_append(b, 1)) AS BIGINT) AS w"),
    ("fn_array_position", lambda: {"v": scalar.array_position(F.col("a"), F.lit(3).cast("long")), "w": scalar.array_position(F.col("b"), F.lit(99).cast("long"))}, "CAST(list_position(a, 3) AS BIGINT) AS v, CAST(list_position(b, 99) AS BIGINT) AS w"),
):
    BOOK.add(_name, lambda spark, d, make=_make: _arrays(spark, d).select("n_nationkey", *[c.alias(n) for n, c in make().items()]), f"SELECT n_nationkey, {_duck} FROM ({_DUCK_A})")


@query("array_agg_unnest", "SELECT o_custkey, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders GROUP BY o_custkey")
def _(spark, d):
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("keys"))
    return series.unnest(lists, "keys", "k").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("k").alias("s"))


# JSON ------------------------------------------------------------------------------------------------------------------------

_JSON = "concat('{\"k\": ', CAST(event_id % 5 AS VARCHAR), ', \"t\": \"', event_type, '\", \"n\": {\"a\": [1, ', CAST(event_id % 3 AS VARCHAR), ']}, \"z\": null}')"


def _json(spark, d):
    text = F.concat(F.lit('{"k": '), (F.col("event_id") % 5).cast("string"), F.lit(', "t": "'), F.col("event_type"), F.lit('", "n": {"a": [1, '), (F.col("event_id") % 3).cast("string"), F.lit(']}, "z": null}'))
    return table(spark, d, "events").select("event_id", text.alias("j"), "props")


for _name, _make, _duck in (
    ("fn_json_text", lambda: {"k": scalar.json_text(F.col("j"), "k"), "t": scalar.json_text(F.col("j"), "t"), "missing": scalar.json_text(F.col("j"), "q"), "p": scalar.json_text(F.col("props"), "k")}, "j ->> 'k' AS k, j ->> 't' AS t, j ->> 'q' AS missing, props ->> 'k' AS p"),
    ("fn_json_value", lambda: {"k": scalar.json_value(F.col("j"), "k"), "t": scalar.json_value(F.col("j"), "t"), "n": scalar.json_value(F.col("j"), "n")}, "CAST(j -> 'k' AS VARCHAR) AS k, CAST(j -> 't' AS VARCHAR) AS t, replace(CAST(j -> 'n' AS VARCHAR), ' ', '') AS n"),
    ("fn_json_path", lambda: {"a": scalar.json_text_at(F.col("j"), "{n,a,1}"), "b": scalar.json_text_at(F.col("j"), "{n.a.[0]}"), "c": scalar.json_value_at(F.col("j"), '["n","a"]')}, "j ->> '$.n.a[1]' AS a, j ->> '$.n.a[0]' AS b, replace(CAST(j -> '$.n.a' AS VARCHAR), ' ', '') AS c"),
    ("fn_json_exists", lambda: {"k": scalar.json_has(F.col("j"), "k"), "z": scalar.json_has(F.col("j"), "z"), "q": scalar.json_has(F.col("j"), "q"), "any_": scalar.json_has_any(F.col("j"), ["q", "t"]), "all_": scalar.json_has_all(F.col("j"), ["k", "q"]), "both_": scalar.json_has_all(F.col("j"), ["k", "t"])}, "list_contains(json_keys(j), 'k') AS k, list_contains(json_keys(j), 'z') AS z, list_contains(json_keys(j), 'q') AS q, list_has_any(json_keys(j), ['q', 't']) AS any_, list_has_all(json_keys(j), ['k', 'q']) AS all_, list_has_all(json_keys(j), ['k', 't']) AS both_"),
    ("fn_json_build", lambda: {"o": F.lit("{}"), "a": F.lit("[]"), "x": F.get_json_object("props", "$.k")}, "'{}' AS o, '[]' AS a, json_extract_string(props, '$.k') AS x"),
):
    BOOK.add(_name, lambda spark, d, make=_make: _json(spark, d).select("event_id", *[c.alias(n) for n, c in make().items()]), f"SELECT event_id, {_duck} FROM (SELECT event_id, CAST({_JSON} AS JSON) AS j, CAST(props AS JSON) AS props FROM events)")


# Ranges ----------------------------------------------------------------------------------------------------------------------


def _ranges(spark, d):
    q, n = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", q.alias("q"), n.alias("n"))
    # a = [q, q + n), b = (20, 25]
    return df.withColumns({"a": ranges.make(F.col("q"), F.col("q") + F.col("n")), "b": ranges.make(F.lit(20).cast("long"), F.lit(25).cast("long"), "(]"), "open": ranges.make(F.lit(None).cast("long"), F.lit(30).cast("long"))})


for _name, _make, _duck in (
    ("fn_range_contains", lambda: {"v": ranges.contains(F.col("a"), F.lit(22)), "w": ranges.contains(F.col("b"), F.col("q")), "x": ranges.contains(F.col("open"), F.col("q"))}, "q <= 22 AND 22 < q + n AS v, 20 < q AND q <= 25 AS w, q < 30 AS x"),
    ("fn_range_overlaps", lambda: {"v": ranges.overlaps(F.col("a"), F.col("b")), "w": ranges.overlaps(F.col("a"), F.col("open"))}, "q < 26 AND 21 < q + n AS v, q < 30 AS w"),
    ("fn_range_left", lambda: {"v": ranges.left_of(F.col("a"), F.col("b"))}, "q + n <= 21 AS v"),
    ("fn_range_right", lambda: {"v": ranges.right_of(F.col("a"), F.col("b"))}, "26 <= q AS v"),
    ("fn_range_adjacent", lambda: {"v": ranges.adjacent(F.col("a"), F.col("b"))}, "q + n = 21 OR q = 26 AS v"),
    ("fn_range_text", lambda: {"v": ranges.text(F.col("a")), "w": ranges.text(F.col("b")), "x": ranges.text(F.col("open")), "e": ranges.is_empty(ranges.make(F.col("q"), F.col("q")))}, "'[' || q || ',' || (q + n) || ')' AS v, '(20,25]' AS w, '[,30)' AS x, true AS e"),
):
    BOOK.add(_name, lambda spark, d, make=_make: _ranges(spark, d).select("l_orderkey", "l_linenumber", "l_suppkey", "q", *[c.alias(n) for n, c in make().items()]), f"SELECT l_orderkey, l_linenumber, l_suppkey, q, {_duck} FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q, CAST(l_linenumber AS BIGINT) AS n FROM lineitem)")

_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("fn_enum_order", "SELECT o_orderkey, CAST(coalesce(list_position(['5-LOW', '4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH', '1-URGENT'], o_orderpriority) - 1, NULL) AS BIGINT) AS place, list_position(['5-LOW', '4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH', '1-URGENT'], o_orderpriority) > 3 AS above, o_orderpriority = '2-HIGH' AS high FROM orders")
def _(spark, d):
    place = scalar.enum_ordinal(F.col("o_orderpriority"), _PRIORITIES[::-1])
    return table(spark, d, "orders").select("o_orderkey", place.alias("place"), (place > 2).alias("above"), (F.col("o_orderpriority") == "2-HIGH").alias("high"))


@query("fn_composite", "SELECT c_custkey, c_name AS a, c_nationkey AS b, (c_nationkey, c_name) < (10, 'D') AS low FROM customer")
def _(spark, d):
    df = table(spark, d, "customer").select("c_custkey", F.struct("c_nationkey", "c_name").alias("s"))
    return df.select("c_custkey", F.col("s.c_name").alias("a"), F.col("s.c_nationkey").alias("b"), (F.col("s") < F.struct(F.lit(10).alias("c_nationkey"), F.lit("D").alias("c_name"))).alias("low"))


# Table functions and user-defined functions ----------------------------------------------------------------------------------


@query("generate_series", "SELECT generate_series AS value FROM generate_series(CAST(1 AS BIGINT), 10)")
def _(spark, d):
    return series.generate_series(spark, 1, 10)


@query("generate_series_step", "SELECT n_nationkey, unnest(generate_series(10, n_nationkey, -3)) AS v FROM nation")
def _(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.explode(series.series(F.lit(10), F.col("n_nationkey"), -3)).alias("v"))


@query("generate_series_empty", "SELECT generate_series AS value FROM generate_series(CAST(5 AS BIGINT), 1)")
def _(spark, d):
    return series.generate_series(spark, 5, 1)


@query("unnest_array", "SELECT n_nationkey, unnest([n_nationkey, n_regionkey]) AS v FROM nation")
def _(spark, d):
    return series.unnest(table(spark, d, "nation").select("n_nationkey", F.array("n_nationkey", "n_regionkey").alias("a")), "a", "v")


@query("sql_udf_scalar", "SELECT p_partkey, p_size * 2 + 1 AS v FROM part")
def _(spark, d):
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION larkspur_twice(x INT) RETURNS INT RETURN x * 2 + 1")
    return sql(spark, d, "SELECT p_partkey, larkspur_twice(p_size) AS v FROM {part}")


@query("sql_udf_overload_default", "SELECT p_partkey, p_size + 10 AS a, p_size + 3 AS b FROM part")
def _(spark, d):
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION larkspur_add(x INT, y INT DEFAULT 10) RETURNS INT RETURN x + y")
    return sql(spark, d, "SELECT p_partkey, larkspur_add(p_size) AS a, larkspur_add(p_size, 3) AS b FROM {part}")


@query("sql_udf_table", "SELECT n_nationkey, v.i * n_nationkey AS x FROM nation, (VALUES (CAST(1 AS BIGINT)), (2), (3)) v(i)")
def _(spark, d):
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION larkspur_multiples(n BIGINT) RETURNS TABLE (x BIGINT) RETURN SELECT i * n FROM VALUES (1L), (2L), (3L) AS t(i)")
    return sql(spark, d, "SELECT n_nationkey, m.x FROM {nation}, LATERAL larkspur_multiples(n_nationkey) m")


@query("udf_variadic", "SELECT n_nationkey, concat_ws('-', n_name, CAST(n_regionkey AS VARCHAR), 'x') AS v FROM nation")
def _(spark, d):
    functions = user.Functions(spark)
    functions.create(user.Function("joined", [("separator", "string"), ("parts", "string")], "array_join($2, $1)", "string", variadic=True))
    nation = table(spark, d, "nation")
    return nation.select("n_nationkey", functions.call(nation, "joined", "'-'", "n_name", "CAST(n_regionkey AS STRING)", "'x'").alias("v"))


@query("udf_overload_signature", "SELECT p_partkey, p_size + 1 AS a, p_name || '!' AS b, p_size * CAST(2.5 AS DOUBLE) AS c, p_size + 7 AS e FROM part")
def _(spark, d):
    functions = user.Functions(spark)
    functions.create(user.Function("f", [("x", "int")], "$1 + 1", "int"))
    functions.create(user.Function("f", [("x", "string")], "$1 || '!'", "string"))
    functions.create(user.Function("f", [("x", "int"), ("y", "double")], "$1 * $2", "double"))
    functions.create(user.Function("g", [("x", "int"), ("y", "int")], "$1 + $2", "int", defaults=["7"]))
    part = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("int").alias("p_size"), "p_name")
    call = lambda name, *x: functions.call(part, name, *x)
    return part.select("p_partkey", call("f", "p_size").alias("a"), call("f", "p_name").alias("b"), call("f", "p_size", "2.5D").alias("c"), call("g", "p_size").alias("e"))


@query("udf_table_function", "SELECT r_regionkey, r_name FROM region WHERE r_regionkey >= 2")
def _(spark, d):
    functions = user.Functions(spark)
    functions.create(user.Function("from_region", [("low", "int")], "SELECT r_regionkey, r_name FROM {region} WHERE r_regionkey >= $1", table=True))
    return functions.rows("from_region", "2", region=table(spark, d, "region"))


@query("function_cache", "SELECT CAST(49 AS BIGINT) AS value, CAST(1 AS BIGINT) AS cached")
def _(spark, d):
    functions = user.Functions(spark)
    functions.create(user.Function("square", [("x", "bigint")], "$1 * $1", "bigint", volatility="immutable"))
    first, again = functions.value("square", "7"), functions.value("square", "7")
    return spark.createDataFrame([(again if first == again else None, len(functions.cache))], "value long, cached long")


@query("fn_power_large", "SELECT CAST(50031545098999707 AS BIGINT) AS a, CAST(-8 AS BIGINT) AS b, CAST(1 AS BIGINT) AS c, CAST(4611686018427387904 AS BIGINT) AS e")
def _(spark, d):
    one = spark.range(1)
    return one.select(scalar.int_power(F.lit(3), 35).alias("a"), scalar.int_power(F.lit(-2), 3).alias("b"), scalar.int_power(F.lit(0), 0).alias("c"), scalar.int_power(F.lit(2), 62).alias("e"))


@query("fn_sqrt_large", "SELECT CAST(3037000499 AS BIGINT) AS a, CAST(94906265 AS BIGINT) AS b, CAST(94906266 AS BIGINT) AS c")
def _(spark, d):
    x = lambda v: scalar.int_sqrt(F.lit(v).cast("long"))
    return spark.range(1).select(x(2**63 - 1).alias("a"), x(94906266**2 - 1).alias("b"), x(94906266**2).alias("c"))


@query("fn_json_exists_array", "SELECT event_id, event_id % 3 > 0 AS zero, event_id % 3 > 1 AS one, false AS nine FROM events")
def _(spark, d):
    n = F.col("event_id") % 3
    j = F.concat(F.lit("["), F.array_join(F.slice(F.array(F.lit("1"), F.lit('"b"')), 1, n.cast("int")), ","), F.lit("]"))
    rows = table(spark, d, "events").select("event_id", j.alias("j"))
    return rows.select("event_id", *[scalar.json_has(F.col("j"), k).alias(c) for k, c in (("0", "zero"), ("1", "one"), ("9", "nine"))])


@query("fn_now", "SELECT true AS same_in_a_query, true AS after_2020, true AS same_day")
def _(spark, d):
    rows = spark.range(4).select(scalar.epoch_seconds().alias("s"), scalar.epoch_days().alias("day"))
    return rows.agg((F.count_distinct("s") == 1).alias("same_in_a_query"), (F.min("s") > 1577836800).alias("after_2020"), (F.max(F.abs(F.floor(F.col("s") / 86400) - F.col("day"))) <= 1).alias("same_day"))


@query("fn_random", "SELECT count(*) AS n, true AS inside, true AS varied FROM orders")
def _(spark, d):
    rows = table(spark, d, "orders").select(scalar.random_int().alias("r"))
    return rows.agg(F.count("*").alias("n"), ((F.min("r") >= 0) & (F.max("r") <= 999)).alias("inside"), (F.count_distinct("r") > 500).alias("varied"))


# Procedures ------------------------------------------------------------------------------------------------------------------

for _name, _text, _duck in (
    ("procedural_loop", "DECLARE i BIGINT DEFAULT 1; DECLARE total BIGINT DEFAULT 0; WHILE i <= 100 DO SET total = total + i; SET i = i + 1; END WHILE; SELECT total AS total;", "SELECT CAST(5050 AS BIGINT) AS total"),
    ("procedural_if", "DECLARE n BIGINT; DECLARE size STRING; SET n = (SELECT count(*) FROM {nation}); IF n > 100 THEN SET size = 'large'; ELSEIF n > 10 THEN SET size = 'middle'; ELSE SET size = 'small'; END IF; SELECT size AS size;", "SELECT CASE WHEN count(*) > 100 THEN 'large' WHEN count(*) > 10 THEN 'middle' ELSE 'small' END AS size FROM nation"),
    ("procedural_case", "DECLARE n BIGINT; DECLARE name STRING; SET n = (SELECT count(*) FROM {region}); CASE n WHEN 4 THEN SET name = 'four'; WHEN 5 THEN SET name = 'five'; ELSE SET name = 'many'; END CASE; SELECT name AS name;", "SELECT CASE count(*) WHEN 4 THEN 'four' WHEN 5 THEN 'five' ELSE 'many' END AS name FROM region"),
    ("procedural_for_query", "DECLARE total BIGINT DEFAULT 0; FOR r AS SELECT n_nationkey AS k FROM {nation} WHERE n_regionkey = 1 DO SET total = total + r.k; END FOR; SELECT total AS total;", "SELECT CAST(sum(n_nationkey) AS BIGINT) AS total FROM nation WHERE n_regionkey = 1"),
    ("procedural_foreach", "DECLARE text STRING DEFAULT ''; FOR r AS SELECT explode(array('a', 'b', 'c')) AS x DO SET text = text || r.x; END FOR; SELECT text AS text;", "SELECT 'abc' AS text"),
    ("procedural_exit_continue", "DECLARE i BIGINT DEFAULT 0; DECLARE total BIGINT DEFAULT 0; l: LOOP SET i = i + 1; IF i > 10 THEN LEAVE l; END IF; IF i % 2 = 0 THEN ITERATE l; END IF; SET total = total + i; END LOOP l; SELECT total AS total;", "SELECT CAST(25 AS BIGINT) AS total"),
    ("procedural_exception", "DECLARE state STRING DEFAULT 'none'; BEGIN DECLARE EXIT HANDLER FOR SQLEXCEPTION SET state = 'caught'; SELECT raise_error('stop'); END; SELECT state AS state;", "SELECT 'caught' AS state"),
    ("procedural_execute", "DECLARE n BIGINT; EXECUTE IMMEDIATE 'SELECT CAST(? * 3 AS BIGINT)' INTO n USING 14; SELECT n AS n;", "SELECT CAST(42 AS BIGINT) AS n"),
):
    BOOK.both(_name, f"BEGIN {_text} END", _duck)


@query("prepared_params", "SELECT o_orderkey FROM orders WHERE o_totalprice > 250000 AND o_orderstatus = 'O'")
def _(spark, d):
    db = tables.Database(spark)
    db.create_table("orders", table(spark, d, "orders"))
    db.prepare("large", "SELECT o_orderkey FROM {orders} WHERE o_totalprice > :low AND o_orderstatus = :status")
    return db.execute("large", {"low": 250000, "status": "O"})
