"""Graphs derived from the business tables, with integer layouts that any engine computes alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geom
from ..model import CityGraph, GraphMeta
from ..operators.order import dense_positions, grown

#: Metres per minute of a grid street by market segment; all others 83.
SPEEDS = {"AUTOMOBILE": 1000.0, "BUILDING": 667.0, "FURNITURE": 500.0, "MACHINERY": 333.0}
WIDTH = 40
EPSG = 32636


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nodes(customer: DataFrame) -> DataFrame:
    return customer.select(F.col("c_custkey").cast("long").alias("node_id"), F.col("c_custkey").cast("long").alias("pos"), (F.col("c_custkey") % WIDTH * 100.0).alias("x"), (F.floor(F.col("c_custkey") / WIDTH) * 100.0).alias("y"))


def _grid(spark: SparkSession, sf_dir: str, right, down) -> CityGraph:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    nodes = _nodes(customer)
    speed = F.lit(83.0)
    for name, value in SPEEDS.items():
        speed = F.when(F.col("c_mktsegment") == name, F.lit(value)).otherwise(speed)
    i = F.col("c_custkey").cast("long")
    arms = F.array(F.when((i % WIDTH != WIDTH - 1) & right(i), F.struct((2 * i).alias("edge_id"), (i + 1).alias("v"), (i % 5 == 0).alias("oneway"))), F.when(down(i), F.struct((2 * i + 1).alias("edge_id"), (i + WIDTH).alias("v"), F.lit(False).alias("oneway"))))
    rows = customer.select(i.alias("u"), speed.alias("speed"), F.explode(F.filter(arms, lambda a: a.isNotNull())).alias("a")).select("a.edge_id", "u", "a.v", "speed", "a.oneway")
    # ends exist where ids are dense, and the join holds where they are not
    rows = rows.join(grown(nodes.select(F.col("node_id").alias("v"))), "v", "left_semi")
    at = lambda c: geom.point(F.col(c) % WIDTH * 100.0, F.floor(F.col(c) / WIDTH) * 100.0)
    edges = rows.select("edge_id", "u", "v", F.array(at("u"), at("v")).alias("geometry"), F.lit(100.0).alias("length_meter"), geom.rounded(100.0 / F.col("speed"), 3).alias("time_min"), "oneway")
    return CityGraph(nodes, edges, GraphMeta(EPSG, "walk", False, True, "oneway"))


def street_grid(spark: SparkSession, sf_dir: str) -> CityGraph:
    return _grid(spark, sf_dir, lambda i: (i * 7 + 3) % 11 != 0, lambda i: (i * 5 + 1) % 7 != 0)


def broken_grid(spark: SparkSession, sf_dir: str) -> CityGraph:
    return _grid(spark, sf_dir, lambda i: (i * 7 + 3) % 11 > 5, lambda i: (i * 5 + 1) % 7 > 3)


def supply_multigraph(spark: SparkSession, sf_dir: str) -> CityGraph:
    """Directed multigraph of suppliers; each line item is an edge weighted by its quantity."""
    items, supplier = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    n = supplier.count()
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    numbered = dense_positions(items.select(*order, "l_quantity"), [F.col(c) for c in order], "edge_id")
    u, v = F.col("l_suppkey").cast("long"), ((F.col("l_suppkey") + 1 + F.col("l_partkey") % 7) % F.lit(n)).cast("long")
    here = lambda c: geom.point(c * 1.0, c * 0.0)
    edges = numbered.select("edge_id", u.alias("u"), v.alias("v"), F.array(here(u), here(v)).alias("geometry"), F.abs(u - v).cast("double").alias("length_meter"), F.col("l_quantity").alias("time_min"))
    edges = edges.withColumn("k", (F.row_number().over(Window.partitionBy("u", "v").orderBy("edge_id")) - 1).cast("int"))
    nodes = supplier.select(F.col("s_suppkey").cast("long").alias("node_id"), F.col("s_suppkey").cast("long").alias("pos"), F.col("s_suppkey").cast("double").alias("x"), F.lit(0.0).alias("y"))
    return CityGraph(nodes, edges, GraphMeta(None, None, True, True))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(object_id, x, y, node_id) of suppliers beside the streets."""
    k = F.col("s_suppkey").cast("long")
    nodes = table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "supplier").crossJoin(F.broadcast(nodes)).select(k.alias("object_id"), (100.0 * (k * 37 % 40) + 13).alias("x"), (100.0 * (k * 11 % 37) + 29).alias("y"), (k * 7 % F.col("n")).alias("node_id"))  # one row of counts


#: Transport mode of an event type.
MODES = {"view": "bus", "click": "trolleybus", "signup": "tram", "purchase": "subway"}


def transit_rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, route, mode, u, v, x1, y1, x2, y2): consecutive stops of 20 routes in the order of events."""
    mode = F.lit("bus")
    for name, value in MODES.items():
        mode = F.when(F.col("event_type") == name, F.lit(value)).otherwise(mode)
    events = table(spark, sf_dir, "events").select("event_id", "ts", (F.col("user_id") % 20).alias("route"), (F.col("event_id") % 500).alias("v"), mode.alias("mode"))
    rides = events.withColumn("u", F.lag("v").over(Window.partitionBy("route").orderBy("ts", "event_id"))).filter("u is not null and u <> v")
    x, y = lambda c: F.col(c) % 25 * 400.0, lambda c: F.floor(F.col(c) / 25) * 400.0
    return rides.select("event_id", "route", "mode", "u", "v", x("u").alias("x1"), y("u").alias("y1"), x("v").alias("x2"), y("v").alias("y2"))
