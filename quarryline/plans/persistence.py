"""Queries on stores that change as a whole, on exports, and on work that is done unit by unit, each with its SQL."""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from quarryline.plans.registry import query
from quarryline.session import shared_dir, stored
from quarryline.session import table as T
from quarryline.sources.stores import read_sqlite, write_sqlite
from quarryline.sources.versions import Level, Link, OrphanError, Versions, persist
from quarryline.streaming.work import outcome, work_through


@query("""
SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS num_orders, (SELECT count(DISTINCT (l_orderkey, l_linenumber)) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey) AS num_lines, 2 AS version FROM customer
""")
def atomic_persist(spark: SparkSession, d: str) -> DataFrame:
    """Customers, orders and lines as one store: a first load, an update of all with their children, and a load with orphans
    that makes no version."""
    links = (Link("orders", "o_custkey", "customer", "c_custkey"), Link("lineitem", "l_orderkey", "orders", "o_orderkey"))
    store = Versions(spark, f"{shared_dir(spark)}/versions-{uuid.uuid4().hex}", links)
    customers = T(spark, d, "customer").select("c_custkey", "c_name")
    orders = T(spark, d, "orders").select("o_orderkey", "o_custkey")
    lines = T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    level = lambda rows: Level("orders", rows, ("o_orderkey",), "o_custkey", "customer", "c_custkey", "num_orders")
    persist(store, [Level("customer", customers, ("c_custkey",)), level(orders)])
    persist(store, [level(orders), Level("lineitem", lines, ("l_orderkey", "l_linenumber"), "l_orderkey", "orders", "o_orderkey", "num_lines")])
    try:
        persist(store, [level(orders.select((-F.col("o_orderkey") - 1).alias("o_orderkey"), (-F.col("o_custkey") - 1).alias("o_custkey")))])
    except OrphanError:
        pass
    tables = store.tables()
    made = tables["orders"].groupBy("o_custkey").agg(F.sum("num_lines").alias("num_lines"))
    out = tables["customer"].join(made, F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.select("c_custkey", "num_orders", F.coalesce("num_lines", F.lit(0)).alias("num_lines"), F.lit(store.newest()).alias("version"))


@query("SELECT c_custkey, o_orderkey, o_totalprice::DOUBLE AS o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def sqlite_export(spark: SparkSession, d: str) -> DataFrame:
    """The customers of a segment with their orders as a SQLite file of its own, read back from it."""
    place = urlparse(shared_dir(spark))
    if place.scheme not in ("", "file"):
        raise ValueError("a SQLite file needs a folder that all machines see as files")
    path = f"{place.path}/export-{uuid.uuid4().hex}.db"
    customers = T(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    orders = T(spark, d, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    write_sqlite({"customer": customers, "orders": orders.select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("o_totalprice"))}, path)
    back = read_sqlite(spark, path, "orders").join(read_sqlite(spark, path, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return back.select("c_custkey", "o_orderkey", "o_totalprice")


@query("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'poison' ELSE 'done' END AS status, CASE o_orderstatus WHEN 'P' THEN 2 ELSE 1 END AS tries,
       CASE o_orderstatus WHEN 'P' THEN 'ValueError: not settled' END AS error, CASE o_orderstatus WHEN 'P' THEN 0 ELSE len(string_split(o_orderpriority, '-')) END AS rows FROM orders
""")
def unit_work(spark: SparkSession, d: str) -> DataFrame:
    """Orders as units of work that come as a stream: each gives the parts of its priority, and unsettled ones fail twice."""

    def parts(row: dict) -> list[dict]:
        if row["o_orderstatus"] == "P":
            raise ValueError("not settled")
        return [{"part": p} for p in row["o_orderpriority"].split("-")]

    units = T(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    root = f"{shared_dir(spark)}/work-{uuid.uuid4().hex}"
    units.write.parquet(f"{root}/units")
    stream = spark.readStream.schema(units.schema).option("maxFilesPerTrigger", 256).parquet(f"{root}/units")
    shape = StructType().add("part", StringType())
    work_through(stream, "o_orderkey", parts, shape, f"{root}/out", f"{root}/checkpoint", tries=2)
    results, marks = outcome(spark, f"{root}/out", units.schema["o_orderkey"], shape)
    counts = results.groupBy(F.col("o_orderkey").alias("unit")).agg(F.count("*").alias("rows"))
    out = stored(marks.join(counts, F.col("o_orderkey") == F.col("unit"), "left"), "outcome")
    return out.select("o_orderkey", "status", "tries", "error", F.coalesce("rows", F.lit(0)).alias("rows"))
