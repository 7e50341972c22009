"""Nearest nodes and nearest edges by a grid whose rings widen until the answer is certain."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geom
from ..model import CityGraph
from .order import checkpoint, grown


def _cell(x: Column, size: float) -> Column:
    return F.floor(x / F.lit(size)).cast("long")


def _ring(df: DataFrame, size: float, reach: int) -> DataFrame:
    """A row for each cell within `reach` of a row's own."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    wide = df.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps))
    return wide.withColumns({"cx": _cell(F.col("x"), size) + F.col("_dx"), "cy": _cell(F.col("y"), size) + F.col("_dy")}).drop("_dx", "_dy")


def nearest_nodes(graph: CityGraph, objects: DataFrame) -> DataFrame:
    """(object_id, node_id, distance): the nearest node of each object, of equally near ones the first.

    Each round joins the objects left with the nodes of the cells around them and accepts
    what is nearer than the ring is wide; the rest goes on with rings twice as wide. Cells
    of the first round hold about one node.
    """
    nodes = graph.nodes.select("node_id", F.col("pos") if "pos" in graph.nodes.columns else F.col("node_id").alias("pos"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    n, low_x, high_x, low_y, high_y = nodes.agg(F.count(F.lit(1)), F.min("nx"), F.max("nx"), F.min("ny"), F.max("ny")).first()
    if not n:
        raise ValueError("the graph has no nodes")
    ox = objects.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if ox[0] is None:
        return objects.sparkSession.createDataFrame([], "object_id long, node_id long, distance double")
    span = math.hypot(max(high_x, ox[1]) - min(low_x, ox[0]), max(high_y, ox[3]) - min(low_y, ox[2])) + 1
    size = max(math.sqrt(max((high_x - low_x) * (high_y - low_y), 1e-9) / n), span / 1e6, 1e-9)
    left, done = objects.select("object_id", "x", "y"), None
    while True:
        placed = nodes.withColumns({"cx": _cell(F.col("nx"), size), "cy": _cell(F.col("ny"), size)})
        square = (F.col("x") - F.col("nx")) * (F.col("x") - F.col("nx")) + (F.col("y") - F.col("ny")) * (F.col("y") - F.col("ny"))
        best = _ring(left, size, 1).join(grown(placed), ["cx", "cy"]).groupBy("object_id").agg(F.min(F.struct(square.alias("d2"), "pos", "node_id")).alias("b"))
        last = size >= span
        found = checkpoint(left.join(grown(best), "object_id", "left").withColumn("sure", F.col("b").isNotNull() & (F.lit(last) | (F.sqrt("b.d2") <= F.lit(size)))))
        hit = found.filter("sure").select("object_id", F.col("b.node_id").alias("node_id"), F.sqrt("b.d2").alias("distance"))
        done = hit if done is None else done.unionByName(hit)
        left = found.filter("not sure").select("object_id", "x", "y")
        if last or left.isEmpty():
            return done
        size = min(size * 2, span)


def edge_segments(graph: CityGraph) -> DataFrame:
    """(edge_id, nth, before, a, b): the straight pieces of every edge and how far along they begin."""
    line = F.col("geometry")
    pieces = graph.edges.select("edge_id", F.posexplode(F.arrays_zip(geom.segments(line).alias("s"), geom.cumulative(line).alias("c"))).alias("nth", "z")).filter("z.s is not null")
    return pieces.select("edge_id", "nth", F.col("z.c").alias("before"), F.col("z.s.a").alias("a"), F.col("z.s.b").alias("b"))


def nearest_edges(graph: CityGraph, objects: DataFrame, max_dist: float | None = None) -> DataFrame:
    """(object_id, edge_id, distance, along): every nearest edge of each object within max_dist, ties included."""
    if max_dist is not None and max_dist <= 0:
        raise ValueError(f"max_dist must be above 0: {max_dist}")
    pieces = checkpoint(edge_segments(graph))
    points = checkpoint(objects.select("object_id", "x", "y"))
    bounds = pieces.agg(F.min(F.least("a.x", "b.x")), F.max(F.greatest("a.x", "b.x")), F.min(F.least("a.y", "b.y")), F.max(F.greatest("a.y", "b.y")), F.avg(geom.distance(F.col("a"), F.col("b")))).first()
    seen = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if bounds[0] is None or seen[0] is None:
        return objects.sparkSession.createDataFrame([], "object_id long, edge_id long, distance double, along double")
    span = math.hypot(max(bounds[1], seen[1]) - min(bounds[0], seen[0]), max(bounds[3], seen[3]) - min(bounds[2], seen[2])) + 1
    size = max(min(max_dist or bounds[4], span), span / 1e6, 1e-9)
    left, done = points, None
    while True:
        cells = {k: F.sequence(_cell(F.least(f"a.{c}", f"b.{c}"), size), _cell(F.greatest(f"a.{c}", f"b.{c}"), size)) for k, c in (("cx", "x"), ("cy", "y"))}
        placed = pieces.withColumn("cx", F.explode(cells["cx"])).withColumn("cy", F.explode(cells["cy"]))
        near = _ring(left, size, 1).join(grown(placed), ["cx", "cy"]).select("object_id", "x", "y", "edge_id", "nth", "before", "a", "b").distinct()
        share = geom.segment_share(F.col("x"), F.col("y"), F.col("a"), F.col("b"))
        measured = near.select("object_id", "edge_id", "nth", geom.segment_distance(F.col("x"), F.col("y"), F.col("a"), F.col("b")).alias("distance"), (F.col("before") + share * geom.distance(F.col("a"), F.col("b"))).alias("along"))
        each = measured.groupBy("object_id", "edge_id").agg(F.min(F.struct("distance", "nth", "along")).alias("m"))
        ranked = each.select("object_id", "edge_id", "m.distance", "m.along").withColumn("_r", F.rank().over(Window.partitionBy("object_id").orderBy("distance"))).filter("_r = 1").drop("_r")
        last = size >= span or max_dist is not None and size >= max_dist
        limit = size if not last else math.inf if max_dist is None else max_dist
        hit = checkpoint(ranked.filter(F.col("distance") <= F.lit(float(limit))))
        done = hit if done is None else done.unionByName(hit)
        left = checkpoint(left.join(grown(hit.select("object_id").distinct()), "object_id", "left_anti"))
        if last or left.isEmpty():
            return done
        size = min(size * 2, span)
