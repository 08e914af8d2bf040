"""Semantics on small literal inputs: nulls, empty inputs, ties, frames, constraints, plans."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur import registry
from larkspur.functions import ranges, scalar, series, user
from larkspur.operators import aggregates, joins, ordering, recursive, sets, windows
from larkspur.plans import statistics
from larkspur.sources import partitions, skipping, tables

DATA = "/root/testdata/sf0.001"


def values(df, *names):
    return [tuple(r) for r in (df.select(*names) if names else df).collect()]


# windows


def test_rank_of_salaries(spark):
    df = spark.createDataFrame([(1, 5000), (1, 6000), (1, 6000), (1, 7000)], "dept int, salary int")
    assert sorted(r[0] for r in values(df.select(F.rank().over(windows.over(["dept"], "salary"))))) == [1, 2, 2, 4]


def test_row_number_by_department(spark):
    df = spark.createDataFrame([(1, 100), (1, 200), (2, 50), (2, 150), (1, 300)], "dept int, value int")
    got = values(df.withColumn("n", F.row_number().over(windows.over(["dept"], "value"))).orderBy("dept", "value"), "n")
    assert [x[0] for x in got] == [1, 2, 3, 1, 2]


def test_first_value_in_a_rows_frame(spark):
    df = spark.createDataFrame([(i, 100 * i) for i in range(1, 6)], "id int, value int")
    w = Window.orderBy("id").rowsBetween(-2, 2)
    assert [x[0] for x in values(df.select("id", F.first("value").over(w).alias("v")).orderBy("id"), "v")] == [100, 100, 100, 200, 300]


def test_lag_two_and_ntile(spark):
    df = spark.createDataFrame([(i, 100 * i) for i in range(1, 5)], "id int, value int")
    w = Window.orderBy("id")
    got = values(df.select("id", F.lag("value", 2).over(w).alias("a"), F.ntile(2).over(w).alias("b")).orderBy("id"), "a", "b")
    assert got == [(None, 1), (None, 1), (100, 2), (200, 2)]


def test_groups_frame_counts_peers(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("a", 2, 4), ("a", 4, 8), ("b", None, 16)], "p string, o int, v int")
    got = windows.groups_frame(df, F.sum("v"), ["p"], ["o"], -1, 0, "s").orderBy("p", "v")
    assert [x[0] for x in values(got, "s")] == [3, 3, 7, 12, 16]
    down = windows.groups_frame(df, F.sum("v"), ["p"], ["-o"], 0, Window.unboundedFollowing, "s").orderBy("p", "v")
    assert [x[0] for x in values(down, "s")] == [3, 3, 7, 15, 16]


# ordering


def test_nulls_last_up_and_first_down(spark):
    df = spark.createDataFrame([(2,), (None,), (1,)], "x int")
    assert [x[0] for x in values(ordering.sort(df, "x"))] == [1, 2, None]
    assert [x[0] for x in values(ordering.sort(df, "-x"))] == [None, 2, 1]


def test_cursor_moves(spark):
    c = ordering.Cursor(spark.range(1, 6).toDF("x"), "x")
    assert c.next()[0] == 1 and c.next()[0] == 2 and c.prior()[0] == 1 and c.prior() is None
    assert c.last()[0] == 5 and c.next() is None and c.absolute(-2)[0] == 4 and c.relative(-1)[0] == 3
    assert [r[0] for r in c.fetch(2).collect()] == [4, 5]
    assert [r[0] for r in c.fetch(-2).collect()] == [4, 3]
    c.close()
    with pytest.raises(ValueError):
        c.next()


# joins and quantified comparisons


@pytest.mark.parametrize("op", ["<", "<=", ">", ">=", "=", "<>"])
@pytest.mark.parametrize("how", ["any", "all"])
@pytest.mark.parametrize("inner", [[], [1], [1, 3], [2, None], [None]])
def test_quantified(spark, op, how, inner):
    test = {"<": int.__lt__, "<=": int.__le__, ">": int.__gt__, ">=": int.__ge__, "=": int.__eq__, "<>": int.__ne__}[op]
    outer = [0, 1, 2, 3, 4]

    def truth(x):
        each = [None if y is None else test(x, y) for y in inner]
        return any(e is True for e in each) if how == "any" else all(e is True for e in each)

    df = spark.createDataFrame([(x,) for x in outer], "x int")
    f = joins.any_of if how == "any" else joins.all_of
    got = f(df, "x", op, spark.createDataFrame([(y,) for y in inner], "y int"))
    assert sorted(r[0] for r in got.collect()) == [x for x in outer if truth(x)]


def test_equal_joins_skip_nulls(spark):
    a = spark.createDataFrame([(1,), (None,)], "x int")
    b = spark.createDataFrame([(1,), (None,)], "y int")
    assert values(joins.join(a, b, F.col("x") == F.col("y"))) == [(1, 1)]
    assert len(values(joins.join(a, b, F.col("x").eqNullSafe(F.col("y"))))) == 2


def test_full_join(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "i int, x string")
    b = spark.createDataFrame([(1, "p"), (3, "q"), (4, "r")], "j int, y string")
    assert len(values(joins.join(a, b, F.col("i") == F.col("j"), "full"))) == 4


def test_broadcast_hint_needs_a_small_side(spark):
    big = spark.range(10**9).toDF("y")
    assert joins.estimated_bytes(big) > joins.BROADCAST_BYTES
    plan = joins.join(spark.range(10).toDF("x"), big, F.col("x") == F.col("y"), hint="broadcast")._jdf.queryExecution().analyzed().toString()
    assert "broadcast" not in plan


def test_range_join(spark):
    got = joins.range_join(spark.range(20).toDF("v"), spark.createDataFrame([(1, 3, 9), (2, 8, 8), (3, 5, 30)], "id int, low int, high int"), "v", "low", "high", 4)
    assert sorted(values(got, "v", "id")) == sorted((v, i) for v in range(20) for i, a, b in ((1, 3, 9), (3, 5, 30)) if a <= v < b)


def test_pairs_below_without_pairs(spark):
    far = 2**61
    many = [("a", 1, x) for x in (5, 5, 5, -9000, 4095, 4096, 4096, 70000, -1, 0)]
    few = [("a", 2, 7), ("b", 1, 7), ("b", 1, 7), ("c", 1, -far), ("c", 1, far - 1), ("c", 1, far - 1)]
    rows = many + few + [(None, 1, 8), (None, 1, 9), ("b", None, 8), ("b", None, 9), ("b", 1, None)]
    want = {}
    for g, h, x in rows:
        for _, _, y in (r for r in rows if r[:2] == (g, h) and None not in (g, h, x, r[2]) and x < r[2]):
            n, apart = want.get((g, h), (0, 0))
            want[g, h] = n + 1, apart + y - x
    got = joins.pairs_below(spark.createDataFrame(rows, "g string, h int, x long"), ["g", "h"], "x")
    assert sorted(values(got)) == sorted((*k, *v) for k, v in want.items())
    assert values(joins.pairs_below(spark.range(0).select(F.lit(1).alias("g"), "id"), ["g"], "id")) == []


def test_self_join_by_group_grows_with_its_rows(spark, tmp_path):
    """One group of 100,000 customers, each there twice: 19,999,800,000 pairs."""
    n = 100_000
    spark.range(2 * n).select((F.col("id") % n).alias("c_custkey"), F.lit("A").alias("c_mktsegment"), F.lit(3).alias("c_nationkey")).write.parquet(str(tmp_path / "customer.parquet"))
    df = registry.queries()["join_self"](spark, str(tmp_path))
    assert "Join" not in plan_of(df)
    assert values(df, "segment", "nation", "n", "apart") == [("A", 3, 4 * (n * (n - 1) // 2), 4 * ((n - 1) * n * (n + 1) // 6))]


def test_lateral_order_outlives_the_shuffle(spark, tmp_path):
    """Orders of a key reach the limit in many spilled runs, whose rows of like keys come out in any order."""
    n, folder = 20_000, str(tmp_path)
    spark.range(7).select(F.nullif("id", F.lit(6)).alias("c_custkey")).unionByName(spark.range(1, 2).toDF("c_custkey")).write.parquet(f"{folder}/customer.parquet")
    prices = F.when(F.col("id") % 5 == 4, None).otherwise((F.col("id") * 7919 % 1009).cast("double"))
    spark.range(n).select(F.col("id").alias("o_orderkey"), (F.col("id") % 5).alias("o_custkey"), prices.alias("o_totalprice")).write.parquet(f"{folder}/orders.parquet")
    price = {k: -1 if k % 5 == 4 else k * 7919 % 1009 for k in range(n)}
    first = {c: sorted(range(c, n, 5), key=lambda k: (-price[k], k))[:2] for c in range(5)}
    conf = spark._jvm.org.apache.spark.SparkEnv.get().conf()
    conf.set("spark.shuffle.spill.numElementsForceSpillThreshold", "100")
    try:
        got = values(registry.queries()["lateral_sql"](spark, folder))
    finally:
        conf.remove("spark.shuffle.spill.numElementsForceSpillThreshold")
    assert sorted(got) == sorted((c, k) for c in (0, 1, 1, 2, 3, 4) for k in first[c])


# aggregates


def test_folds(spark):
    df = spark.createDataFrame([(1, 10), (1, 20), (1, 30), (2, None)], "k int, v int")
    plain = aggregates.Fold("bigint", lambda a, x: a + x, finish=lambda s: s * 10)
    assert sorted(values(plain.apply(df, ["k"], "v", "s"))) == [(1, 600), (2, 0)]
    salted = aggregates.Fold("bigint", lambda a, x: a + x, merge=lambda a, b: a + b)
    assert sorted(values(salted.apply(df, ["k"], "v", "s"))) == [(1, 60), (2, 0)]
    counting = aggregates.Fold("bigint", lambda a, x: a + F.when(x.isNull(), 1).otherwise(0), keep_nulls=True)
    assert sorted(values(counting.apply(df, ["k"], "v", "s"))) == [(1, 0), (2, 1)]


def test_int_avg_cuts(spark):
    df = spark.createDataFrame([(1, -7), (1, 0), (2, None)], "k int, v int")
    assert sorted(values(df.groupBy("k").agg(aggregates.int_avg("v")))) == [(1, -3), (2, None)]


# sets and recursion


def test_set_operations(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,)], "x int")
    assert values(sets.except_(a, b)) == [(2,)] and values(sets.intersect(a, b)) == [(1,)]
    assert len(values(sets.union_all(a, b))) == 4 and sorted(values(sets.union(a, b))) == [(1,), (2,)]


def test_recursion(spark):
    one = spark.range(1, 2).toDF("n")
    assert sorted(values(recursive.recursive_union(one, lambda t: t.select(F.col("n") % 3 + 1)))) == [(1,), (2,), (3,)]
    assert len(values(recursive.recursive_union(one, lambda t: t.where("n < 5").select(F.col("n") + 1)))) == 5
    assert values(recursive.recursive_union(one.limit(0), lambda t: t)) == []
    with pytest.raises(RuntimeError):
        recursive.recursive_union(one, lambda t: t.select(F.col("n") + 1), limit=3)


# functions


def test_arrays(spark):
    df = spark.range(1).select(F.array(F.lit(1), F.lit(2)).alias("a"))
    a = F.col("a")
    got = df.select(scalar.array_element(a, 2), scalar.array_element(a, 5), scalar.array_position(a, F.lit(9)), scalar.array_overlaps(a, F.array(F.lit(2))), scalar.array_contains_all(a, F.array(F.lit(3)))).first()
    assert tuple(got) == (2, None, None, True, False)
    with pytest.raises(Exception, match="at least 1"):
        df.select(scalar.array_element(a, 0)).collect()


def test_json(spark):
    df = spark.createDataFrame([('{"a": {"b": [1, "x"]}, "k": null}',), (None,)], "j string")
    j = F.col("j")
    got = values(df.select(scalar.json_text_at(j, "{a,b,1}"), scalar.json_value_at(j, "{a.b.[1]}"), scalar.json_has(j, "k"), scalar.json_has_any(j, []), scalar.json_has_all(j, ["a", "k"])))
    assert got[0] == ("x", '"x"', True, False, True) and got[1][2] is False


def test_strings(spark):
    got = spark.range(1).select(scalar.concat(F.lit("a"), F.lit(None), F.lit(1)), scalar.substring(F.lit("hello"), 0, 2), scalar.byte_length(F.lit("é")), scalar.trim(F.lit("\t x \n")), scalar.split_part(F.lit("a,b"), ",", 5)).first()
    assert tuple(got) == ("a1", "he", 2, "x", "")


@pytest.mark.parametrize("a, b, overlap, left, adjacent", [((1, 5, "[)"), (5, 9, "[)"), False, True, True), ((1, 5, "[]"), (5, 9, "[)"), True, False, False), ((1, 5, "[]"), (6, 9, "[]"), False, True, True), ((None, 3, "[)"), (2, None, "[)"), True, False, False), ((3, 3, "[)"), (1, 9, "[]"), False, False, False)])
def test_ranges(spark, a, b, overlap, left, adjacent):
    x, y = (ranges.make(F.lit(low).cast("long"), F.lit(high).cast("long"), s) for low, high, s in (a, b))
    assert tuple(spark.range(1).select(ranges.overlaps(x, y), ranges.left_of(x, y), ranges.adjacent(x, y)).first()) == (overlap, left, adjacent)


def test_series(spark):
    assert [r[0] for r in series.generate_series(spark, 5, 1, -2).collect()] == [5, 3, 1]
    assert series.generate_series(spark, 5, 1).count() == 0
    with pytest.raises(ValueError):
        series.generate_series(spark, 1, 5, 0)


# tables


def test_constraints(spark):
    db = tables.Database(spark)
    db.create_table("c", spark.createDataFrame([(1, "a")], "id long, name string"), tables.Schema(primary_key=["id"], not_null=["name"], unique=[["name"]], checks=["id > 0"]))
    db.create_table("o", spark.createDataFrame([(7, 1)], "id long, c long"), tables.Schema(foreign_keys=[tables.ForeignKey(["c"], "c", ["id"])]))
    for bad in ["SELECT 1L AS id, 'b' AS name", "SELECT NULL AS id, 'b' AS name", "SELECT 2L AS id, NULL AS name", "SELECT 2L AS id, 'a' AS name", "SELECT 0L AS id, 'z' AS name"]:
        with pytest.raises(tables.ConstraintError):
            db.insert("c", spark.sql(bad))
    with pytest.raises(tables.ConstraintError):
        db.insert("o", spark.sql("SELECT 8L AS id, 99L AS c"))
    with pytest.raises(tables.ConstraintError):
        db.delete("c", "id = 1")
    db.insert("o", spark.sql("SELECT 8L AS id, CAST(NULL AS BIGINT) AS c"))
    assert db.table("c").count() == 1 and db.table("o").count() == 2


def test_update_reads_old_values_and_unknown_keeps_rows(spark):
    df = spark.createDataFrame([(1, 2), (None, 4)], "a int, b int")
    assert sorted(values(tables.update(df, {"a": "b", "b": "a"}, "a = 1")), key=str) == [(2, 1), (None, 4)]
    assert values(tables.delete(df, "a = 1")) == [(None, 4)]


def test_catalog_objects(spark, tmp_path):
    db = tables.Database(spark)
    db.create_table("t", spark.range(3).toDF("x"))
    db.create_view("v", lambda: db.table("t").where("x > 0"))
    db.create_materialized_view("m", lambda: db.table("t"), str(tmp_path / "m"))
    db.delete("t", "x = 2")
    assert db.table("v").count() == 1 and db.table("m").count() == 3
    db.refresh("m")
    assert db.table("m").count() == 2 and db.describe("t") == [("x", "bigint")]
    db.prepare("q", "SELECT * FROM {t} WHERE x = :x")
    assert [r[0] for r in db.execute("q", {"x": 1}).collect()] == [1]
    db.create_enum("e", ["low", "high"])
    db.add_enum_value("e", "middle", before="high")
    assert db.types["e"] == ["low", "middle", "high"]
    db.schemas["t"].options["compression"] = "zstd"
    db.save("t", str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    db.create_index("t", "i", ["x"], unique=True)
    db.create_trigger("t", "g", when="BEFORE")
    with pytest.raises(tables.ConstraintError):
        db.insert("t", spark.range(1).toDF("x"))
    db.drop_table("t")
    db.drop_table("t", if_exists=True)


def test_partitions(spark):
    rows = spark.range(10).toDF("k")
    p = partitions.Partitioned("k")
    p.attach("a", rows.limit(0), (None, 4))
    with pytest.raises(ValueError):
        p.attach("b", rows.limit(0), (3, 9))
    p.attach("b", rows.limit(0), (4, 8))
    with pytest.raises(ValueError):
        p.route(rows)
    p.attach("rest", rows.limit(0), None)
    p.route(rows)
    assert p.pruned(5, 6) == ["b", "rest"] and sorted(r[0] for r in p.scan(5, 6).collect()) == [5, 6]
    assert sorted(r[0] for r in p.detach("a").collect()) == [0, 1, 2, 3]


# plans


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark.read.parquet(f"{DATA}/orders.parquet").where("o_custkey = 5").select("o_orderkey"))
    assert "PushedFilters: [IsNotNull(o_custkey), EqualTo(o_custkey,5)]" in text and "o_comment" not in text and "o_totalprice" not in text


def test_top_k_is_a_heap(spark):
    assert "TakeOrderedAndProject" in plan(ordering.top_k(spark.range(100).toDF("x"), 3, "x"))


def test_aggregates_are_partial_first(spark):
    assert "partial_sum" in plan(spark.range(100).groupBy((F.col("id") % 3).alias("k")).agg(F.sum("id")))


def test_partition_directories_are_pruned(spark, tmp_path):
    spark.range(20).withColumn("k", F.col("id") % 4).write.partitionBy("k").parquet(str(tmp_path / "p"))
    assert "PartitionFilters: [isnotnull(k" in plan(spark.read.parquet(str(tmp_path / "p")).where("k = 2"))


def test_statistics(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (4,)], "x int")
    assert values(statistics.analyze(df, ["x"])) == [("x", 4, 1, 2, "1", "4")]
    got = values(statistics.equi_depth(spark.range(100).toDF("v"), "v", 4).orderBy("bucket"))
    assert got == [(0, 0, 24, 25), (1, 25, 49, 25), (2, 50, 74, 25), (3, 75, 99, 25)]


def test_stream_equals_batch(spark):
    from larkspur.streaming import events

    batch = spark.read.parquet(f"{DATA}/events.parquet")
    q = events.hourly(events.read(spark, DATA, "events.parquet", batch.schema)).writeStream.outputMode("complete").format("memory").queryName("hourly").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(values(spark.table("hourly")), key=str) == sorted(values(events.hourly(batch)), key=str)


# Tables, keys, transactions ---------------------------------------------------------------------------------------------------


def family(spark, on_delete="cascade", on_update="cascade", leaf="restrict"):
    db = tables.Database(spark)
    db.create_table("a", spark.createDataFrame([(1,), (2,), (3,)], "id int"), tables.Schema(primary_key=["id"]))
    db.create_table("b", spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id int, a int"), tables.Schema(primary_key=["id"], foreign_keys=[tables.ForeignKey(["a"], "a", ["id"], on_delete, on_update)], defaults={"a": "3"}))
    db.create_table("c", spark.createDataFrame([(100, 10), (101, None)], "id int, b int"), tables.Schema(foreign_keys=[tables.ForeignKey(["b"], "b", ["id"], leaf)]))
    return db


def content(db, name):
    return sorted(map(tuple, db.table(name).collect()), key=str)


def test_cascade_goes_through_all_levels_or_nothing_changes(spark):
    db = family(spark)
    with pytest.raises(tables.ConstraintError):
        db.delete("a", "id = 1")  # c refuses two levels below
    assert [len(v) for v in db.versions.values()] == [1, 1, 1]
    db.delete("a", "id = 2")
    assert content(db, "b") == [(10, 1), (12, None)] and content(db, "c") == [(100, 10), (101, None)]
    db = family(spark, leaf="cascade")
    db.delete("a", "id = 1")
    assert content(db, "b") == [(11, 2), (12, None)] and content(db, "c") == [(101, None)]
    db = family(spark, on_delete="set default")
    db.delete("a", "id = 1")
    assert content(db, "b") == [(10, 3), (11, 2), (12, None)]
    with pytest.raises(tables.ConstraintError):
        db.delete("a", "id = 3")  # the default itself would be an orphan


def test_cascade_on_itself(spark):
    db = tables.Database(spark)
    db.create_table("t", spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, None), (5, 4)], "id int, up int"), tables.Schema(primary_key=["id"], foreign_keys=[]))
    db.schemas["t"].foreign_keys.append(tables.ForeignKey(["up"], "t", ["id"], "cascade"))
    db.delete("t", "id = 1")
    assert content(db, "t") == [(4, None), (5, 4)]


def test_changed_keys(spark):
    db = family(spark)
    db.update("a", {"id": "id + 50"}, "id <= 2")
    assert content(db, "b") == [(10, 51), (11, 52), (12, None)]
    db = family(spark, on_update="set null")
    db.update("a", {"id": "id + 50"}, "id = 1")
    assert content(db, "b") == [(10, None), (11, 2), (12, None)]
    db = family(spark, on_update="restrict")
    with pytest.raises(tables.ConstraintError):
        db.update("a", {"id": "id + 50"}, "id = 1")
    db.update("a", {"id": "id + 50"}, "id = 3")  # nobody refers to it
    assert (53,) in content(db, "a")


def test_alter_and_drop(spark, tmp_path):
    db = family(spark)
    db.alter_table("a", rename={"id": "key"}, add={"mark": ("string", "'x'")})
    assert db.schemas["b"].foreign_keys[0].references == ["key"] and content(db, "a") == [(1, "x"), (2, "x"), (3, "x")]
    with pytest.raises(tables.ConstraintError):
        db.alter_table("a", constraints=tables.Schema(checks=["key > 1"]))
    with pytest.raises(ValueError):
        db.alter_table("a", add={"mark": ("int", None)})
    db.create_index("a", "u", ["mark", "key"], unique=True)
    db.drop_index("a", "u")
    assert not db.schemas["a"].unique and not db.schemas["a"].indexes
    db.create_view("v", "SELECT key FROM {a}")
    db.create_materialized_view("m", "SELECT count(*) AS n FROM {a}", str(tmp_path / "m"))
    assert content(db, "v") == [(1,), (2,), (3,)] and content(db, "m") == [(3,)]
    db.drop_view("v")
    db.drop_materialized_view("m")
    assert not (tmp_path / "m").exists()
    for gone in ("v", "m"):
        with pytest.raises(KeyError):
            db.table(gone)
    db.drop_view("v", if_exists=True)
    with pytest.raises(KeyError):
        db.drop_index("a", "u")


def test_transactions(spark):
    db = family(spark)
    one, two = db.begin("repeatable read"), db.begin("repeatable read")
    one.insert("a", spark.createDataFrame([(9,)], "id int"))
    two.insert("a", spark.createDataFrame([(8,)], "id int"))
    assert one.table("a").count() == two.table("a").count() == 4 and db.table("a").count() == 3
    one.commit()
    with pytest.raises(tables.SerializationError):
        two.commit()
    assert (9,) in content(db, "a") and (8,) not in content(db, "a")
    three = db.begin()
    three.delete("a", "id = 9")
    three.rollback()
    with pytest.raises(ValueError):
        three.commit()
    assert (9,) in content(db, "a")
    with pytest.raises(ValueError):
        db.begin("chaos")


def test_catalog_comes_back(spark, tmp_path):
    db = family(spark)
    db.create_enum("mood", ["sad", "happy"])
    db.create_composite("point", [("x", "int"), ("y", "int")])
    db.create_view("v", "SELECT id FROM {b} WHERE a IS NULL")
    db.prepare("p", "SELECT id FROM {a} WHERE id > :low")
    db.save_all(str(tmp_path / "all"))
    back = tables.Database.load_all(spark, str(tmp_path / "all"))
    assert content(back, "b") == content(db, "b") and back.schemas == db.schemas and back.types == db.types
    assert content(back, "v") == [(12,)] and [r.id for r in back.execute("p", {"low": 2}).collect()] == [3]
    with pytest.raises(tables.ConstraintError):
        back.insert("b", spark.createDataFrame([(99, 77)], "id int, a int"))
    db.create_view("f", lambda: spark.range(1))
    with pytest.raises(ValueError):
        db.save_all(str(tmp_path / "no"))


# Plans that scale -------------------------------------------------------------------------------------------------------------


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_places_without_one_task_or_python(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    got = ordering.numbered(df, [F.col("x").asc()], "place")
    assert all(r.place == r.x + 1 for r in got.collect()) and "Python" not in plan_of(got)
    cursor = ordering.Cursor(df, "x")
    assert cursor.absolute(500).x == 499 and [r.x for r in cursor.fetch(-3).collect()] == [498, 497, 496] and cursor.last().x == 999
    assert ordering.numbered(df.limit(0), [F.col("x").asc()], "place").count() == 0


def test_serial_has_no_single_partition_window(spark):
    new = tables.completed(spark.range(100).select(F.col("id").cast("string").alias("name")), spark.createDataFrame([], "id long, name string"), tables.Schema(serial="id"), 5)
    assert sorted(r.id for r in new.collect()) == list(range(6, 106)) and "Window" not in plan_of(new)


def test_a_scan_of_children_reads_the_source_once(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "t"))
    source = spark.read.parquet(str(tmp_path / "t"))
    p = partitions.Partitioned("id")
    for k in range(5):
        p.attach(f"p{k}", source.limit(0), (20 * k, 20 * k + 20))
    p.route(source)
    plan = plan_of(p.scan(30, 70))
    assert plan.count("FileScan parquet") == 1 and "GreaterThanOrEqual(id,30)" in plan and p.scan(30, 70).count() == 41
    assert p.child("p1").count() == 20 and p.detach("p1").count() == 20 and p.scan().count() == 80
    with pytest.raises(ValueError):
        p.route(source)
    h = partitions.Partitioned("id")
    h.attach("even", source.limit(0), {"modulus": 2, "remainder": 0})
    with pytest.raises(ValueError):
        h.attach("four", source.limit(0), {"modulus": 4, "remainder": 2})
    h.attach("odd", source.limit(0), {"modulus": 2, "remainder": 1})
    h.route(source)
    assert h.child("odd").count() == 50 and h.pruned(3, 3) == ["odd"]


def test_a_fold_with_merge_gathers_pieces_only(spark, monkeypatch):
    monkeypatch.setattr(aggregates, "PIECE", 10)
    df = spark.range(1000).select(F.lit(1).alias("g"), F.col("id").alias("v")).unionByName(spark.createDataFrame([(2, None), (3, 5)], "g int, v long"))
    fold = aggregates.Fold("bigint", lambda a, x: a + x * x, merge=lambda a, b: a + b)
    want = {1: sum(i * i for i in range(1000)), 2: 0, 3: 25}
    assert {r.g: r.s for r in fold.apply(df, ["g"], "v", "s").collect()} == want
    summed = aggregates.Fold("bigint", lambda a, x: a + x, built_in=F.sum)
    out = summed.apply(df, ["g"], "v", "s")
    assert {r.g: r.s for r in out.collect()} == {1: 499500, 2: 0, 3: 5} and "collect_list" not in plan_of(out)


def test_indexes_skip_rows(spark, tmp_path):
    db = tables.Database(spark)
    db.create_table("t", spark.range(200_000).select("id", (F.col("id") * 7919 % 200_000).alias("x")))
    db.create_index("t", "by_x", ["x"], method="brin")
    db.save_indexed("t", str(tmp_path / "t"), 8)
    df = spark.read.parquet(str(tmp_path / "t")).where("x BETWEEN 1000 AND 1100")
    assert len(df.collect()) == 101
    run = df.select("id", "x")
    run.collect()
    assert skipping.rows_read(run) <= 200_000 // 4


def test_errors_of_whole_number_functions(spark):
    one = spark.range(1)
    for bad in (scalar.int_power(F.lit(2), -1), scalar.int_power(F.lit(10), 19), scalar.int_sqrt(F.lit(-1))):
        with pytest.raises(Exception):
            one.select(bad).collect()
    assert one.select(scalar.int_power(F.lit(-1), 2**40 + 1).alias("x"), scalar.int_power(F.lit(None).cast("long"), 2).alias("y")).first() == (-1, None)


def test_overloads_and_cache(spark):
    f = user.Functions(spark)
    f.create(user.Function("f", [("x", "bigint")], "$1 + 1", "bigint", volatility="immutable"))
    f.create(user.Function("f", [("x", "string")], "upper($1)", "string"))
    assert f.value("f", "CAST(1 AS INT)") == 2 and f.value("f", "'a'") == "A" and len(f.cache) == 1
    with pytest.raises(ValueError):
        f.create(user.Function("f", [("x", "string")], "$1", "string"))
    with pytest.raises(ValueError):
        f.value("f", "true")
    f.drop("f", ["bigint"])
    assert not f.cache and len(f.known["f"]) == 1
    many = user.Function("g", [("n", "int"), ("m", "int")], "$1 * $2", "int", defaults=["10"])
    f.create(many)
    assert f.value("g", "4") == 40 and f.value("g", "4", "5") == 20
