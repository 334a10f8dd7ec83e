"""The domain tables as views of the given tables, with the same views as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.operators.lineage import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GPS points: a user's events are a trip, in event order."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("trip_id"), F.col("event_id").alias("source_row"),
        (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / 1e6).alias("t"),
        (21 + (F.col("event_id") % 1000) / 1e5).alias("lat"), (105.8 + (F.col("event_id") % 777) / 1e5).alias("lon"),
        F.col("value").alias("speed"), F.when(F.col("event_type") == "click", "m/s").when(F.col("event_type") == "view", "mph").otherwise("km/h").alias("speed_unit"),
        F.col("event_type").alias("time_block"), F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("user_id") % 3 + 1).cast("int")).alias("sampling_zone"),
    )


POINTS = """points AS (SELECT user_id AS trip_id, event_id AS source_row, epoch_us(ts) / 1e6 AS t,
  21 + (event_id % 1000) / 1e5 AS lat, 105.8 + (event_id % 777) / 1e5 AS lon, value AS speed,
  CASE event_type WHEN 'click' THEN 'm/s' WHEN 'view' THEN 'mph' ELSE 'km/h' END AS speed_unit,
  event_type AS time_block, CASE user_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS sampling_zone FROM events)"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Road parts with length, class, zone, lanes (null where unknown)."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("part_id"), F.col("p_retailprice").alias("length_m"), F.concat(F.lit("RC"), (F.col("p_size") % 4 + 1).cast("string")).alias("rc"),
        F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int") % 3 + 1)).alias("zone"),
        F.nullif(F.col("p_size") % 5, F.lit(0)).cast("double").alias("lanes"), (F.col("p_size") % 7 == 0).alias("connector"),
    )


PARTS = """parts AS (SELECT p_partkey AS part_id, p_retailprice AS length_m, 'RC' || CAST(p_size % 4 + 1 AS VARCHAR) AS rc,
  CASE CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS zone,
  CAST(nullif(p_size % 5, 0) AS DOUBLE) AS lanes, p_size % 7 = 0 AS connector FROM part)"""


def walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passes of routes over parts: a supplier's line items, in a total order."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("route_id"), F.col("l_partkey").alias("part_id"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("double").alias("length_m"))


WALKS = "walks AS (SELECT l_suppkey AS route_id, l_partkey AS part_id, l_orderkey AS o, l_linenumber AS n, CAST(l_quantity AS DOUBLE) AS length_m FROM lineitem)"


def passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arcs of the graph, each as often as it is passed."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("from_node"), F.col("l_partkey").alias("to_node"))


def arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directed graph: an order's line items lead from supplier to part number."""
    return dealt(passes(spark, sf_dir), "from_node", "to_node").distinct()


ARCS = "arcs AS (SELECT DISTINCT l_suppkey AS from_node, l_partkey AS to_node FROM lineitem)"


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips with a resource and a time range: orders, of a customer, over some days."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("trip_id"), F.col("o_custkey").alias("device_id"), F.col("o_orderdate").cast("date").alias("started"),
        F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 10 + 1).cast("int")).alias("ended"),
        (F.col("o_custkey") % 30).alias("route_id"), F.col("o_orderpriority").alias("time_block"), F.col("o_orderstatus").alias("status"),
        F.when(F.weekday(F.col("o_orderdate").cast("date")) >= 5, "weekend").otherwise("weekday").alias("day_type"),
    )


TRIPS = """trips AS (SELECT o_orderkey AS trip_id, o_custkey AS device_id, CAST(o_orderdate AS DATE) AS started,
  CAST(o_orderdate AS DATE) + CAST(o_orderkey % 10 + 1 AS INT) AS ended, o_custkey % 30 AS route_id, o_orderpriority AS time_block,
  o_orderstatus AS status, CASE WHEN isodow(CAST(o_orderdate AS DATE)) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type FROM orders)"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field observations of routes: events, with a day, a field, a value and whether it passes."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("observation_id"), (F.col("user_id") % 60).alias("route_id"), F.col("event_type").alias("field"), F.col("ts").cast("date").alias("day"),
        F.floor("value").cast("long").alias("value"), (F.col("event_id") % 11 != 0).alias("passed"), (F.col("event_id") % 40).alias("part_id"),
    )


EVIDENCE = """evidence AS (SELECT event_id AS observation_id, user_id % 60 AS route_id, event_type AS field, CAST(ts AS DATE) AS day,
  CAST(floor(value) AS BIGINT) AS value, event_id % 11 <> 0 AS passed, event_id % 40 AS part_id FROM events)"""
