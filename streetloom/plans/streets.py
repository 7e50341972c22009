"""Drive and walk networks from street elements."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geom, tags
from ..functions.crs import line_to_utm
from ..model import CityGraph, GraphMeta, empty
from ..operators.components import keep_largest, star_components
from ..operators.edit import edge_keys
from ..operators.order import checkpoint, dense_positions

WALK_SPEED = 83.33
#: Tags kept on edges unless others are asked for.
EDGE_TAGS = ("highway", "maxspeed", "name")


def way_segments(ways: DataFrame, epsg: int) -> DataFrame:
    """(edge_id, way_id, geometry): consecutive vertex pairs of ways of two or more points, in metres."""
    lines = ways.filter(F.size("geometry") >= 2).select(F.col("id").alias("way_id"), line_to_utm(F.col("geometry"), epsg).alias("line"))
    pieces = lines.select("way_id", F.posexplode(geom.segments(F.col("line"))).alias("nth", "s"))
    line = F.array("s.a", "s.b")
    return dense_positions(pieces.select("way_id", "nth", line.alias("geometry")), [F.col("way_id"), F.col("nth")], "edge_id")


def merge_chains(segments: DataFrame) -> DataFrame:
    """(edge_id, way_id, geometry): lines merged along their direction through vertices with one segment in and one out.

    Links between neighbouring segments make chains; components find the closed ones, which
    are opened at their smallest segment, and pointer doubling gives each segment its place,
    in as many rounds as the logarithm of the longest chain. A line takes the way of the
    segment that holds its midpoint.
    """
    at = lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))
    rows = checkpoint(segments.select("edge_id", "way_id", at(geom.start(F.col("geometry"))).alias("a"), at(geom.end(F.col("geometry"))).alias("b")))
    ends = rows.select(F.col("a").alias("p"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(rows.select("b", F.lit(0), F.lit(1)))
    through = ends.groupBy("p").agg(F.sum("out").alias("o"), F.sum("into").alias("i")).filter("o = 1 and i = 1").select("p")
    links = rows.select("edge_id", F.col("a").alias("p")).join(through, "p").join(rows.select(F.col("edge_id").alias("prev"), F.col("b").alias("p")), "p").select("edge_id", "prev")
    links = checkpoint(links.filter("edge_id <> prev"))
    roots = star_components(links.select(F.col("edge_id").alias("a"), F.col("prev").alias("b"))).withColumnRenamed("node", "edge_id")
    chained = checkpoint(rows.select("edge_id").join(links, "edge_id", "left").join(roots, "edge_id", "left").withColumn("root", F.coalesce("root", "edge_id")))
    closed = chained.groupBy("root").agg(F.count_if(F.col("prev").isNull()).alias("heads")).filter("heads = 0").select(F.col("root").alias("edge_id"), F.lit(True).alias("cut"))
    jump = chained.join(closed, "edge_id", "left").select("edge_id", F.when(F.col("cut").isNull(), F.col("prev")).alias("ptr"))
    jump = checkpoint(jump.withColumns({"head": F.coalesce("ptr", "edge_id"), "place": F.when(F.col("ptr").isNull(), 0).otherwise(1).cast("long")}))
    while not jump.filter("ptr is not null").isEmpty():
        other = jump.select(F.col("edge_id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("head").alias("head2"), F.col("place").alias("place2"))
        jump = checkpoint(jump.join(other, "ptr", "left").select("edge_id", F.col("ptr2").alias("ptr"), F.coalesce("head2", "head").alias("head"), (F.col("place") + F.coalesce("place2", F.lit(0))).alias("place")))
    full = rows.join(jump.select("edge_id", "head", "place"), "edge_id").withColumn("len", geom.distance(F.col("a"), F.col("b")))
    chain = Window.partitionBy("head")
    full = full.withColumns({"upto": F.sum("len").over(chain.orderBy("place")), "total": F.sum("len").over(chain)})
    holds = F.when(F.col("upto") >= F.col("total") / 2, F.struct("place", "way_id"))
    merged = full.groupBy("head").agg(F.array_sort(F.collect_list(F.struct("place", "a", "b"))).alias("s"), F.min(holds).alias("mid"))
    line = F.concat(F.array(F.col("s")[0]["a"]), F.transform("s", lambda x: x["b"]))
    return merged.select(F.col("head").alias("edge_id"), F.col("mid.way_id").alias("way_id"), line.alias("geometry"))


def _inside(x: float, y: float, rings: list[list[tuple[float, float]]]) -> bool:
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def clip_line(points: list[tuple[float, float]], rings: list[list[tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """The parts of a line inside a polygon."""
    parts: list[list[tuple[float, float]]] = []
    for (ax, ay), (bx, by) in zip(points, points[1:], strict=False):
        cuts = {0.0, 1.0}
        for ring in rings:
            for (cx, cy), (dx, dy) in zip(ring, [*ring[1:], ring[0]], strict=True):
                det = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
                if det:
                    t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / det
                    s = ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / det
                    if 0 < t < 1 and 0 <= s <= 1:
                        cuts.add(t)
        along = sorted(cuts)
        for t0, t1 in zip(along, along[1:], strict=False):
            mid = (t0 + t1) / 2
            if _inside(ax + (bx - ax) * mid, ay + (by - ay) * mid, rings):
                p, q = ((ax + (bx - ax) * t, ay + (by - ay) * t) for t in (t0, t1))
                if parts and parts[-1][-1] == p:
                    parts[-1].append(q)
                else:
                    parts.append([p, q])
    return parts


def clip_lines(edges: DataFrame, polygon: list[list[tuple[float, float]]]) -> DataFrame:
    """Edges cut at a polygon; each part inside is an edge of its own, numbered anew."""
    rings = [r[:-1] if r[0] == r[-1] else r for r in polygon]
    low_x, high_x = min(p[0] for p in rings[0]), max(p[0] for p in rings[0])
    low_y, high_y = min(p[1] for p in rings[0]), max(p[1] for p in rings[0])
    bounds = geom.box(F.col("geometry"))
    near = edges.filter((bounds[2] >= low_x) & (bounds[0] <= high_x) & (bounds[3] >= low_y) & (bounds[1] <= high_y))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lines in batches:
            yield pd.Series([[[{"x": x, "y": y} for x, y in part] for part in clip_line([(p["x"], p["y"]) for p in line], rings)] for line in lines])

    cut = F.pandas_udf(run, "array<array<struct<x:double,y:double>>>")(F.col("geometry"))
    parts = near.withColumn("_parts", cut).select("*", F.posexplode("_parts").alias("_n", "_g")).drop("geometry", "_parts").withColumnRenamed("_g", "geometry")
    return dense_positions(parts.withColumnRenamed("edge_id", "_e"), [F.col("_e"), F.col("_n")], "edge_id").select(*edges.columns)


def factorize(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the end points, numbered as they first appear (all starts before all ends), and edges with u and v."""
    n = edges.agg(F.coalesce(F.max("edge_id") + 1, F.lit(0))).first()[0]
    a, b = geom.start(F.col("geometry")), geom.end(F.col("geometry"))
    ends = edges.select(a["x"].alias("x"), a["y"].alias("y"), F.col("edge_id").alias("first")).union(edges.select(b["x"], b["y"], F.col("edge_id") + F.lit(n)))
    nodes = dense_positions(ends.groupBy("x", "y").agg(F.min("first").alias("first")), [F.col("first")]).select(F.col("pos").alias("node_id"), "pos", "x", "y")
    nodes = checkpoint(nodes)
    named = edges.withColumns({"_ax": a["x"], "_ay": a["y"], "_bx": b["x"], "_by": b["y"]})
    for end, p in (("u", "_a"), ("v", "_b")):
        side = nodes.select(F.col("node_id").alias(end), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"))
        named = named.join(side, [f"{p}x", f"{p}y"])
    return nodes, named.drop("_ax", "_ay", "_bx", "_by")


def street_edges(ways: DataFrame, epsg: int, wanted: tuple[str, ...], simplify: bool, clip_polygon: list | None) -> DataFrame:
    """(edge_id, geometry, tags…) of street ways."""
    lines = way_segments(ways, epsg)
    lines = merge_chains(lines) if simplify else lines.select("edge_id", "way_id", "geometry")
    named = ways.select(F.col("id").alias("way_id"), *[F.col("tags")[k].alias(k) for k in wanted])
    edges = lines.join(named, "way_id", "left").drop("way_id")
    return clip_lines(edges, clip_polygon) if clip_polygon else edges


def drive_graph(elements: DataFrame, epsg: int, simplify: bool = True, add_category: bool = False, clip_polygon: list | None = None, keep_largest_part: bool = True, network: str = "drive", custom_filter: str | None = None, edge_tags: tuple[str, ...] = EDGE_TAGS) -> CityGraph:
    """Directed multigraph of streets for cars; `oneway` is the direction column."""
    if network != "custom" and network not in ("drive", "drive_service"):
        raise ValueError(f"network must be drive, drive_service or custom, not {network}")
    if (network == "custom") != (custom_filter is not None):
        raise ValueError("a custom network needs a filter, and only that one takes it")
    said = custom_filter or tags.NETWORKS[network]
    meta = GraphMeta(epsg, network, True, True, "oneway")
    ways = elements.filter((F.col("type") == "way") & tags.tag_filter(said, F.col("tags")))
    wanted = tuple(dict.fromkeys([*edge_tags, "oneway", "maxspeed", "highway"]))
    edges = checkpoint(street_edges(ways, epsg, wanted, simplify, clip_polygon))
    if edges.isEmpty():
        return empty(elements.sparkSession, meta)
    edges = edges.withColumn("geometry", F.when(tags.reversed_oneway(F.col("oneway")), F.reverse("geometry")).otherwise(F.col("geometry"))).withColumn("oneway", tags.oneway(F.col("oneway")))
    nodes, edges = factorize(checkpoint(edges))
    size = geom.rounded(geom.length(F.col("geometry")), 3)
    edges = edges.withColumn("length_meter", size).withColumn("time_min", geom.rounded(F.col("length_meter") / tags.drive_speed(F.col("maxspeed"), F.col("highway")), 3)).withColumn("type", F.lit("drive"))
    if add_category:
        edges = edges.withColumn("category", tags.highway_category(F.col("highway")))
    kept = ["edge_id", "u", "v", "k", "geometry", "length_meter", "time_min", "type", "oneway", *[t for t in edge_tags if t != "oneway"], *(["category"] if add_category else [])]
    graph = CityGraph(nodes, checkpoint(edge_keys(edges).select(*kept)), meta)
    return keep_largest(graph) if keep_largest_part else graph


def walk_graph(elements: DataFrame, epsg: int, simplify: bool = True, clip_polygon: list | None = None, keep_largest_part: bool = True, network: str = "walk", custom_filter: str | None = None, edge_tags: tuple[str, ...] = EDGE_TAGS, walk_speed: float = WALK_SPEED) -> CityGraph:
    """Undirected multigraph of streets for walking."""
    if network not in ("walk", "custom") or (network == "custom") != (custom_filter is not None):
        raise ValueError(f"network must be walk, or custom with a filter, not {network}")
    if walk_speed <= 0:
        raise ValueError(f"walk_speed must be above 0: {walk_speed}")
    meta = GraphMeta(epsg, network, True, False)
    ways = elements.filter((F.col("type") == "way") & tags.tag_filter(custom_filter or tags.NETWORKS["walk"], F.col("tags")))
    edges = checkpoint(street_edges(ways, epsg, tuple(edge_tags), simplify, clip_polygon))
    if edges.isEmpty():
        return empty(elements.sparkSession, meta)
    nodes, edges = factorize(edges)
    edges = edges.withColumn("length_meter", geom.rounded(geom.length(F.col("geometry")), 3)).withColumn("time_min", geom.rounded(F.col("length_meter") / float(walk_speed), 3)).withColumn("type", F.lit("walk"))
    graph = CityGraph(nodes, checkpoint(edge_keys(edges).select("edge_id", "u", "v", "k", "geometry", "length_meter", "time_min", "type", *edge_tags)), meta)
    return keep_largest(graph) if keep_largest_part else graph
