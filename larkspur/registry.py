"""Named queries and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.queries import analytic, core, functions, maintenance
from larkspur.session import table

BOOKS = [core.BOOK, analytic.BOOK, functions.BOOK, maintenance.BOOK]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by market segment over larger orders."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 1000").select("o_custkey", "o_totalprice")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_mktsegment")
        .agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.round(F.avg("o_totalprice"), 4).alias("average"))
        .where("n_orders > 0")
        .orderBy(F.col("c_mktsegment").asc_nulls_last())
    )


FLAGSHIP_SQL = "SELECT c_mktsegment, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue, round(avg(o_totalprice), 4) AS average FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY c_mktsegment"


def queries() -> dict:
    return {"flagship": flagship, **{name: run for b in BOOKS for name, run in b.queries.items()}}


def oracles() -> dict:
    return {"flagship": FLAGSHIP_SQL, **{name: text for b in BOOKS for name, text in b.oracles.items()}}
