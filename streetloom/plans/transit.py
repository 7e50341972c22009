"""Public transport and intermodal networks.

Routes become node and edge tables first (`ground_tables`, `subway_links`), one route at a
time because stitching and pairing are sequential along a route; a route is bounded by its
relation. `assemble` then makes the graph with joins and aggregations over all routes.

pt_nodes: pos LONG, node_id STRING, type STRING, route STRING, x DOUBLE, y DOUBLE
pt_edges: pos LONG, u STRING, v STRING, type STRING, route STRING, oneway BOOLEAN, geometry, speed_m_min DOUBLE
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geom
from ..functions.crs import line_to_utm, to_utm
from ..functions.registry import TransportRegistry, travel_time
from ..functions.tags import infer_role, maxspeed_m_per_min
from ..model import CityGraph, GraphMeta, empty
from ..operators.components import keep_largest
from ..operators.edit import apply_changes, edge_keys, to_directed
from ..operators.order import checkpoint, dense_positions, grown
from ..operators.projection import project_objects
from ..operators.validation import preview
from ..sources.elements import member_tags
from .streets import WALK_SPEED, walk_graph

# Roles of members, distances in metres, speeds in metres per minute.
PLATFORM_ROLES = ("platform", "platform_entry_only", "platform_exit_only")
STOP_ROLES = ("stop", "stop_entry_only", "stop_exit_only")
PLATFORM_TYPES = ("platform", "subway_entry_exit", "subway_entry", "subway_exit")
PAIRING, OFFSET = 100.0, 7.0
ESCALATOR, TRANSFER_FACTOR = 45.0, 1.5
META = GraphMeta(None, "public_transport", True, True, "oneway")
LINE_DDL = "array<struct<x:double,y:double>>"


def merge_platforms(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, mapping): platforms within a rounded metre are one node of several routes; other nodes
    are one for each rounded metre, route and type. The mapping is (source position, node_id)."""
    first = lambda c: F.min_by(c, "pos")
    cell = {"gx": F.rint("x"), "gy": F.rint("y")}
    placed = nodes.withColumns(cell)
    group = {True: placed.filter(F.col("type") == "platform").withColumn("r", F.lit(None).cast("string")), False: placed.filter(F.col("type").isNull() | (F.col("type") != "platform")).withColumn("r", F.col("route"))}
    keyed = group[True].withColumn("kind", F.lit(0)).unionByName(group[False].withColumn("kind", F.lit(1)))
    routes = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("route").isNotNull(), F.struct("pos", "route")))), lambda s: s["route"]))
    merged = keyed.groupBy("kind", "gx", "gy", "r", "type").agg(first("x").alias("x"), first("y").alias("y"), F.min("pos").alias("first"), F.collect_list("pos").alias("members"), routes.alias("routes"))
    numbered = checkpoint(dense_positions(merged, [F.col("kind"), F.col("gx"), F.col("gy"), F.col("r").asc_nulls_last(), F.col("type").asc_nulls_last()]).withColumn("node_id", F.col("pos")))
    mapping = numbered.select("node_id", F.explode("members").alias("source_pos"))
    single = F.when(F.size("routes") == 1, F.col("routes")[0])
    return numbered.select("node_id", "pos", "x", "y", "type", "routes", single.alias("route")), mapping


def resolve_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are source positions: of the same route, else of a source id that occurs once."""
    by_route = nodes.groupBy("node_id", "route").agg(F.min("pos").alias("at"))
    alone = nodes.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("at")).filter("n = 1")
    for end in ("u", "v"):
        same = by_route.select(F.col("node_id").alias("_i"), F.col("route").alias("_r"), F.col("at").alias("_a"))
        edges = edges.join(grown(same), (F.col(end) == F.col("_i")) & F.col("route").eqNullSafe(F.col("_r")), "left").drop("_i", "_r")
        edges = edges.join(grown(alone.select(F.col("node_id").alias("_i"), F.col("at").alias("_b"))), F.col(end) == F.col("_i"), "left").drop("_i")
        edges = edges.withColumn(f"_{end}", F.coalesce("_a", "_b")).drop("_a", "_b")
    return edges


def split_boarding(edges: DataFrame, boarding_min: float) -> DataFrame:
    """Each boarding row (stop to platform) as an alighting row that takes no time, and a boarding row back."""
    ways = F.when(F.col("type") == "boarding", F.array(F.lit("alighting"), F.lit("boarding"))).otherwise(F.array(F.col("type")))
    many = edges.select("*", F.posexplode(ways).alias("_n", "_t"))
    back = (F.col("type") == "boarding") & (F.col("_t") == "boarding")
    free = F.col("type") == "boarding"
    return many.select(
        *[c for c in edges.columns if c not in ("u", "v", "type", "geometry", "oneway", "length_meter", "time_min")],
        F.when(back, F.col("v")).otherwise(F.col("u")).alias("u"),
        F.when(back, F.col("u")).otherwise(F.col("v")).alias("v"),
        F.col("_t").alias("type"),
        F.when(back, F.reverse("geometry")).otherwise(F.col("geometry")).alias("geometry"),
        F.when(free, True).otherwise(F.coalesce("oneway", F.lit(True))).alias("oneway"),
        F.when(free, 0.0).otherwise(F.col("length_meter")).alias("length_meter"),
        F.when(back, F.lit(float(boarding_min))).when(free, 0.0).otherwise(F.col("time_min")).alias("time_min"),
        "_n",
    )


def assemble(pt_nodes: DataFrame, pt_edges: DataFrame, registry: TransportRegistry | None = None, boarding_min: float = 1.0, epsg: int | None = None) -> CityGraph:
    """Directed multigraph from the tables of all routes."""
    registry = registry or TransportRegistry()
    if boarding_min < 0:
        raise ValueError(f"boarding time must not be negative: {boarding_min}")
    spark, meta = pt_nodes.sparkSession, GraphMeta(epsg, *(META.graph_type, True, True, "oneway"))
    nodes = pt_nodes.filter("x is not null and y is not null")
    keep = Window.partitionBy("node_id", "x", "y", "route", "type").orderBy("pos")
    nodes = checkpoint(nodes.withColumn("_n", F.row_number().over(keep)).filter("_n = 1").drop("_n"))
    if nodes.isEmpty():
        return empty(spark, meta)
    graph_nodes, mapping = merge_platforms(nodes)
    edges = resolve_ends(pt_edges, nodes).drop("u", "v")
    for end in ("u", "v"):
        edges = edges.join(grown(mapping.select(F.col("source_pos").alias(f"_{end}"), F.col("node_id").alias(end))), f"_{end}").drop(f"_{end}")
    for name, kind in (("length_meter", "double"), ("time_min", "double"), ("speed_m_min", "double"), ("oneway", "boolean")):
        edges = edges if name in edges.columns else edges.withColumn(name, F.lit(None).cast(kind))
    edges = checkpoint(split_boarding(edges, boarding_min))
    modes = registry.to_df(spark)  # one row a mode
    open_ = F.col("length_meter").isNull() | F.col("time_min").isNull()
    unknown = edges.filter(open_).join(modes, F.lower(F.trim("type")) == modes["mode"], "left_anti").select("type").distinct()
    if not unknown.isEmpty():
        raise KeyError(f"unknown transport types: {preview(unknown)}")
    size = geom.rounded(geom.length(F.col("geometry")), 3)
    timed = edges.join(modes, F.lower(F.trim("type")) == modes["mode"], "left")
    minutes = geom.rounded(travel_time(F.col("vmax"), F.col("accel"), F.col("brake"), F.col("coef"), F.col("_l"), F.col("speed_m_min")), 3)
    timed = timed.withColumn("_l", size).withColumns({"time_min": F.when(open_, minutes).otherwise(F.col("time_min")), "length_meter": F.when(open_, F.col("_l")).otherwise(F.col("length_meter"))})
    # rows that are no boarding come first, then alighting, then boarding
    rank = F.when(F.col("type") == "alighting", 1).when(F.col("type") == "boarding", 2).otherwise(0)
    numbered = dense_positions(timed.withColumn("_k", rank), [F.col("_k"), F.col("pos"), F.col("_n")], "edge_id")
    out = edge_keys(numbered).select("edge_id", "u", "v", "k", "geometry", "length_meter", "time_min", "oneway", "type", "route")
    return CityGraph(graph_nodes, checkpoint(out), meta)


# --- one ground route --------------------------------------------------------------------------

Point = tuple[float, float]


def _dist(a: Point, b: Point) -> float:
    return math.hypot(a[0] - b[0], a[1] - b[1])


def stitch(ways: list[tuple[list[Point], float | None]]) -> list[tuple[list[Point], float | None]]:
    """Ways put in order and direction: each time the nearest free end goes on from either end of the path."""
    left = [w for w in ways if len(w[0]) > 1]
    if not left:
        return []
    path = [left.pop(0)]
    while left:
        head, tail = path[0][0][0], path[-1][0][-1]
        options = []
        for k, (points, _) in enumerate(left):
            options += [(_dist(tail, points[0]), k, 0), (_dist(tail, points[-1]), k, 1), (_dist(head, points[-1]), k, 2), (_dist(head, points[0]), k, 3)]
        _, k, how = min(options)
        points, speed = left.pop(k)
        way = (points[::-1] if how in (1, 3) else points, speed)
        path = [*path, way] if how < 2 else [way, *path]
    return path


def _along(points: list[Point]) -> list[float]:
    total = [0.0]
    for a, b in zip(points, points[1:], strict=False):
        total.append(total[-1] + _dist(a, b))
    return total


def locate(points: list[Point], along: list[float], p: Point, least: float = 0.0) -> float:
    """Distance along the path of the point nearest to p, not before `least`."""
    best = (math.inf, least)
    for (a, b), start in zip(zip(points, points[1:], strict=False), along, strict=False):
        size = _dist(a, b)
        if not size or start + size < least:
            continue
        t = max(0.0, min(1.0, ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / size**2))
        at = max(start + t * size, least)
        t = (at - start) / size
        best = min(best, (round(_dist(p, (a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t)), 9), at))
    return best[1]


def at(points: list[Point], along: list[float], where: float) -> Point:
    for (a, b), start in zip(zip(points, points[1:], strict=False), along, strict=False):
        size = _dist(a, b)
        if where <= start + size and size:
            t = max(0.0, (where - start) / size)
            return (a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t)
    return points[-1]


def between(points: list[Point], along: list[float], low: float, high: float) -> list[Point]:
    inner = [p for p, d in zip(points, along, strict=True) if low < d < high]
    return [at(points, along, low), *inner, at(points, along, high)]


def mean_speed(pieces: list[tuple[float, float, float | None]], low: float, high: float) -> float | None:
    """Mean of the known speeds on [low, high], weighted by length."""
    total = weight = 0.0
    for start, stop, speed in pieces:
        overlap = min(high, stop) - max(low, start)
        if speed is not None and overlap > 0:
            total, weight = total + overlap * speed, weight + overlap
    return total / weight if weight else None


def side_of(a: Point, b: Point, p: Point) -> int:
    """1 left, 0 right of the line from a to b."""
    return int((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) > 0)


def offset_point(a: Point, b: Point, p: Point, side: int, distance: float = OFFSET) -> Point:
    """The point `distance` beside p, at right angles to the line from a to b."""
    size = _dist(a, b) or 1.0
    sign = 1 if side else -1
    return (p[0] - sign * distance * (b[1] - a[1]) / size, p[1] + sign * distance * (b[0] - a[0]) / size)


def pair(stops: list[Point], platforms: list[Point], limit: float = PAIRING) -> dict[int, int]:
    """Stops and platforms matched one to one, the nearest first; each stop considers its two nearest."""
    options = []
    for i, s in enumerate(stops):
        near = sorted((_dist(s, p), j) for j, p in enumerate(platforms))[:2]
        options += [(d, i, j) for d, j in near if d <= limit]
    out: dict[int, int] = {}
    for _, i, j in sorted(options):
        if i not in out and j not in out.values():
            out[i] = j
    return out


def parse_route(route: str, mode: str, members: list[dict]) -> tuple[list[tuple], list[tuple]]:
    """Node rows (node_id, type, x, y) and edge rows (u, v, type, geometry, speed) of one route."""
    ways = [([(p["x"], p["y"]) for p in m["line"]], m.get("speed")) for m in members if m["type"] == "way" and m.get("line") is not None and len(m["line"]) > 1 and m["role"] not in PLATFORM_ROLES + STOP_ROLES]
    path = stitch(ways)
    if not path:
        return [], []
    points = [path[0][0][0]]
    pieces, done = [], 0.0
    for way, speed in path:
        begin = done
        for p in way:
            if p != points[-1]:
                done += _dist(points[-1], p)
                points.append(p)
        pieces.append((begin, done, speed))
    if len(points) < 2:
        return [], []
    along = _along(points)
    middle = lambda m: (m["x"], m["y"]) if m.get("x") is not None else (sum(p["x"] for p in m["line"]) / len(m["line"]), sum(p["y"] for p in m["line"]) / len(m["line"])) if m.get("line") is not None and len(m["line"]) else None
    found = {kind: [(str(m["ref"]), middle(m)) for m in members if m["role"] in roles and middle(m)] for kind, roles in (("stop", STOP_ROLES), ("platform", PLATFORM_ROLES))}
    stops, platforms = found["stop"], found["platform"]
    matched = pair([p for _, p in stops], [p for _, p in platforms])
    # a platform without stop gets one on the path; a stop without platform gets one beside it
    calls = [(sid, locate(points, along, p), platforms[matched[i]] if i in matched else None) for i, (sid, p) in enumerate(stops)]
    for j, (pid, p) in enumerate(platforms):
        if j not in matched.values():
            where = locate(points, along, p)
            if _dist(at(points, along, where), p) <= PAIRING:
                calls.append((f"{pid}_stop", where, (pid, p)))
    calls.sort(key=lambda c: c[1])
    nodes, edges, last = [], [], None
    for sid, where, platform in calls:
        here = at(points, along, where)
        if platform is None:
            ahead = at(points, along, min(along[-1], where + 1.0))
            behind = at(points, along, max(0.0, where - 1.0))
            platform = (f"{sid}_platform", offset_point(behind, ahead, here, 0))
        if _dist(here, platform[1]) > PAIRING:
            continue
        nodes += [(sid, mode, *here), (platform[0], "platform", *platform[1])]
        edges.append((sid, platform[0], "boarding", [here, platform[1]], None))
        if last is not None and where > last[1]:
            edges.append((last[0], sid, mode, between(points, along, last[1], where), mean_speed(pieces, last[1], where)))
        last = (sid, where)
    return nodes, edges


def members_of(relations: DataFrame, elements: DataFrame, epsg: int) -> DataFrame:
    """(id, route, mode, nth, type, ref, role, x, y, line, speed): members with missing facts filled from their elements."""
    label = F.coalesce(F.col("tags")["ref"], F.col("tags")["name"], F.concat(F.lit("Unnamed_"), F.col("id").cast("string")))
    many = relations.select("id", label.alias("route"), F.col("tags")["route"].alias("mode"), F.posexplode("members").alias("nth", "m")).select("id", "route", "mode", "nth", "m.*")
    full = member_tags(many, elements)
    role = F.when(F.coalesce(F.trim("role"), F.lit("")) != "", F.col("role")).otherwise(infer_role(F.coalesce("member_tags", F.create_map().cast("map<string,string>"))))
    x, y = to_utm(F.coalesce("lon", "member_lon"), F.coalesce("lat", "member_lat"), epsg)
    line = F.when(F.size(F.coalesce("geometry", F.array())) > 0, F.col("geometry")).otherwise(F.col("member_geometry"))
    return full.select("id", "route", "mode", "nth", "type", "ref", role.alias("role"), x.alias("x"), y.alias("y"), line_to_utm(line, epsg).alias("line"), maxspeed_m_per_min(F.col("member_tags")["maxspeed"]).alias("speed"))


def ground_tables(relations: DataFrame, elements: DataFrame, epsg: int) -> tuple[DataFrame, DataFrame]:
    """pt_nodes and pt_edges of bus, tram and trolleybus routes."""
    members = members_of(relations, elements, epsg)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("nth")
        rows = group.astype(object).where(group.notna(), None).to_dict("records")
        nodes, edges = parse_route(rows[0]["route"], rows[0]["mode"], rows)
        out = [("n", k, rows[0]["id"], rows[0]["route"], i, None, kind, x, y, None, None) for k, (i, kind, x, y) in enumerate(nodes)]
        out += [("e", k, rows[0]["id"], rows[0]["route"], u, v, kind, None, None, [{"x": a, "y": b} for a, b in line], speed) for k, (u, v, kind, line, speed) in enumerate(edges)]
        return pd.DataFrame(out, columns=["what", "nth", "id", "route", "u", "v", "type", "x", "y", "geometry", "speed_m_min"])

    parsed = checkpoint(members.groupBy("id").applyInPandas(run, f"what string, nth long, id long, route string, u string, v string, type string, x double, y double, geometry {LINE_DDL}, speed_m_min double"))
    order = [F.col("id"), F.col("nth")]
    nodes = dense_positions(parsed.filter("what = 'n'").select("id", "nth", F.col("u").alias("node_id"), "type", "route", "x", "y"), order).drop("id", "nth")
    edges = dense_positions(parsed.filter("what = 'e'").select("id", "nth", "u", "v", "type", "route", F.lit(True).alias("oneway"), "geometry", "speed_m_min"), order).drop("id", "nth")
    return nodes, edges


# --- subway stations ---------------------------------------------------------------------------


def subway_links(areas: DataFrame, area_groups: DataFrame, elements: DataFrame, epsg: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of stop areas, and links inside stations and between the stations of a group.

    Links: stops to platforms (boarding), entrances to platforms by their direction, at
    escalator speed over the slant of distance and depth, and transfers between the
    platforms of a group at walking speed with a factor for detours.
    """
    depth = F.coalesce(F.abs(F.regexp_extract(F.coalesce(F.col("member_tags")["depth"], F.lit("")), r"-?\d+(?:\.\d+)?", 0).try_cast("double")), F.lit(0.0))
    many = areas.select(F.col("id").alias("area"), F.posexplode("members").alias("nth", "m")).select("area", "nth", "m.*")
    full = member_tags(many, elements)
    given = F.coalesce(F.trim("role"), F.lit(""))
    role = F.when(given != "", given).otherwise(infer_role(F.coalesce("member_tags", F.create_map().cast("map<string,string>"))))
    x, y = to_utm(F.coalesce("lon", "member_lon"), F.coalesce("lat", "member_lat"), epsg)
    facts = checkpoint(full.select("area", "nth", F.col("ref").cast("string").alias("node_id"), role.alias("role"), x.alias("x"), y.alias("y"), depth.alias("depth")).filter("x is not null"))
    kind = F.when(F.col("role").isin(*STOP_ROLES), "subway").when(F.col("role").isin(*PLATFORM_ROLES), "subway_platform").when(F.col("role") == "station", "subway_station").when(F.col("role") == "entry_only", "subway_entry").when(F.col("role") == "exit_only", "subway_exit").when(F.col("role") == "entrance", "subway_entry_exit")
    nodes = facts.withColumn("type", kind).filter("type is not null")
    side = lambda name, keep: nodes.filter(F.col("type").isin(*keep)).select("area", *[F.col(c).alias(f"{name}_{c}") for c in ("node_id", "type", "x", "y", "depth")])
    flat = F.hypot(F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y"))
    line = F.array(geom.point(F.col("a_x"), F.col("a_y")), geom.point(F.col("b_x"), F.col("b_y")))

    def linked(a: DataFrame, kind_: str, size: Column, minutes: Column | None, oneway: Column) -> DataFrame:
        return a.select(F.col("a_node_id").alias("u"), F.col("b_node_id").alias("v"), F.lit(kind_).alias("type"), oneway.alias("oneway"), line.alias("geometry"), (geom.rounded(size, 3) if minutes is not None else F.lit(None).cast("double")).alias("length_meter"), (geom.rounded(minutes, 1) if minutes is not None else F.lit(None).cast("double")).alias("time_min"))

    platforms = side("b", ("subway_platform",))
    boarding = linked(side("a", ("subway",)).join(platforms, "area"), "boarding", flat, None, F.lit(True))
    slant = F.hypot(flat, F.col("a_depth") - F.col("b_depth"))
    doors = side("a", ("subway_entry_exit", "subway_entry", "subway_exit")).join(platforms, "area")
    into = linked(doors.filter("a_type = 'subway_entry_exit'"), "subway_entry_exit", slant, slant / ESCALATOR, F.lit(False))
    entry = linked(doors.filter("a_type = 'subway_entry'"), "subway_entry", slant, slant / ESCALATOR, F.lit(True))
    swapped = doors.filter("a_type = 'subway_exit'").select("area", *[F.col(f"{o}_{c}").alias(f"{n}_{c}") for n, o in (("a", "b"), ("b", "a")) for c in ("node_id", "type", "x", "y", "depth")])
    leave = linked(swapped, "subway_exit", slant, slant / ESCALATOR, F.lit(True))
    groups = area_groups.select(F.col("id").alias("grp"), F.explode("members").alias("m")).select("grp", F.col("m.ref").alias("area"))
    grouped = platforms.join(groups, "area")
    left = grouped.select("grp", F.col("area").alias("area_a"), *[F.col(f"b_{c}").alias(f"a_{c}") for c in ("node_id", "type", "x", "y", "depth")])
    pairs = left.join(grouped.withColumnRenamed("area", "area_b"), "grp").filter("area_a < area_b")
    walk = slant * TRANSFER_FACTOR
    transfer = linked(pairs, "transfer", walk, walk / WALK_SPEED, F.lit(False))
    links = boarding.unionByName(into).unionByName(entry).unionByName(leave).unionByName(transfer)
    # a mapped platform is where people board, so it merges like other platforms unless it is a subway one
    return nodes.select("node_id", "type", "x", "y", "depth").distinct(), links


def public_transport_graph(elements: DataFrame, epsg: int, types: list[str] | None = None, registry: TransportRegistry | None = None, boarding_min: float = 1.0) -> CityGraph:
    """All routes of some types, with the stations of the subway."""
    registry = registry or TransportRegistry()
    types = types or registry.list_types()
    registry.check(types)
    relations = elements.filter((F.col("type") == "relation") & F.col("tags")["route"].isin(*types))
    nodes, edges = ground_tables(relations, elements, epsg)
    if "subway" in types:
        tag = F.coalesce(F.col("tags")["public_transport"], F.lit(""))
        more_nodes, links = subway_links(elements.filter((F.col("type") == "relation") & (tag == "stop_area")), elements.filter((F.col("type") == "relation") & (tag == "stop_area_group")), elements, epsg)
        big = F.lit(1 << 40)
        extra = more_nodes.join(nodes.select("node_id").distinct(), "node_id", "left_anti")
        nodes = nodes.unionByName(dense_positions(extra, [F.col("node_id")]).withColumns({"pos": F.col("pos") + big, "route": F.lit(None).cast("string")}).drop("depth"))
        links = dense_positions(links, [F.col("u"), F.col("v"), F.col("type")]).withColumns({"pos": F.col("pos") + big, "route": F.lit(None).cast("string"), "speed_m_min": F.lit(None).cast("double")})
        edges = edges.unionByName(links, allowMissingColumns=True)
    return assemble(checkpoint(nodes), checkpoint(edges), registry, boarding_min, epsg)


# --- intermodal ------------------------------------------------------------------------------


def collapse(rows: DataFrame, column: str) -> DataFrame:
    """(target, column): the different values of each target in order of position, as an array."""
    values = F.col(column) if dict(rows.dtypes)[column].startswith("array") else F.array(column)
    long = rows.select("target", "pos", F.posexplode(values).alias("_n", "_v")).filter("_v is not null")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "_n", "_v"))), lambda s: s["_v"])
    return long.groupBy("target").agg(F.array_distinct(ordered).alias(column))


def join_transit_walk(transit: CityGraph, walk: CityGraph, max_dist: float = 20, keep_largest_part: bool = True, add_link_edge: bool = True, walk_speed: float = WALK_SPEED) -> CityGraph:
    """Hang the platforms of a transit graph on the streets and unite both."""
    if transit.meta.epsg != walk.meta.epsg:
        raise ValueError(f"reference systems differ: {transit.meta.epsg}, {walk.meta.epsg}")
    if transit.nodes.isEmpty():
        return walk
    if walk.nodes.isEmpty():
        return transit
    streets = to_directed(walk)
    streets = streets.with_(nodes=checkpoint(streets.nodes), edges=checkpoint(streets.edges))  # read many times
    platforms = transit.nodes.filter(F.col("type").isin(*PLATFORM_TYPES)) if "type" in transit.nodes.columns else transit.nodes.limit(0)
    mapping = platforms.sparkSession.createDataFrame([], "object_id long, node_id long")
    if not platforms.isEmpty():
        changes, mapping = project_objects(streets, platforms.select(F.col("node_id").alias("object_id"), "x", "y"), walk_speed, max_dist, add_link_edge)
        streets = apply_changes(streets, changes)
        kind = F.coalesce("type", F.lit("walk")) if "type" in streets.edges.columns else F.lit("walk")
        streets = streets.with_(edges=streets.edges.withColumns({"type": kind, "oneway": F.coalesce(F.col("oneway").cast("boolean"), F.lit(False))}))
        attributes = [c for c in transit.nodes.columns if c not in ("node_id", "pos", "x", "y")]
        named = transit.nodes.join(grown(mapping.select(F.col("object_id").alias("node_id"), F.col("node_id").alias("target"))), "node_id")
        nodes = streets.nodes
        for c in attributes:
            lists = collapse(named, c).withColumnsRenamed({"target": "node_id", c: "_c"})
            value = F.col("_c") if dict(transit.nodes.dtypes)[c].startswith("array") else F.array_join(F.col("_c").cast("array<string>"), "|")
            nodes = nodes.join(grown(lists), "node_id", "left").withColumn(c, F.coalesce(value, F.col(c)) if c in nodes.columns else value).drop("_c")
        streets = streets.with_(nodes=checkpoint(nodes))
    start_id, start_pos = streets.nodes.agg(F.max("node_id") + 1, F.max("pos") + 1).first()
    rest = transit.nodes.join(grown(mapping.select(F.col("object_id").alias("node_id"))), "node_id", "left_anti").withColumnRenamed("node_id", "_old").withColumnRenamed("pos", "_order")
    rest = dense_positions(rest, [F.col("_order"), F.col("_old")], "_n").withColumns({"node_id": F.col("_n") + start_id, "pos": F.col("_n") + start_pos})
    ids = checkpoint(mapping.select(F.col("object_id").alias("_old"), "node_id").unionByName(rest.select("_old", "node_id")))
    rides = transit.edges
    for end in ("u", "v"):
        rides = rides.join(grown(ids.select(F.col("_old").alias(end), F.col("node_id").alias(f"_{end}"))), end)
    rides = rides.drop("u", "v").withColumnsRenamed({"_u": "u", "_v": "v"})
    first_edge = streets.edges.agg(F.coalesce(F.max("edge_id") + 1, F.lit(0))).first()[0]
    edges = streets.edges.unionByName(rides.withColumn("edge_id", F.col("edge_id") + F.lit(first_edge)), allowMissingColumns=True)
    edges = edge_keys(edges.withColumn("oneway", F.coalesce(F.col("oneway").cast("boolean"), F.lit(False))))
    graph = CityGraph(checkpoint(streets.nodes.unionByName(rest.drop("_old", "_order", "_n"), allowMissingColumns=True)), checkpoint(edges), GraphMeta(walk.meta.epsg, "intermodal", True, True, "oneway"))
    return keep_largest(graph) if keep_largest_part else graph


def intermodal_graph(elements: DataFrame, epsg: int, max_dist: float = 30, walk_options: dict | None = None, transit_options: dict | None = None, keep_largest_part: bool = True) -> CityGraph:
    """Streets and routes of one territory in one graph."""
    walk = walk_graph(elements, epsg, **{"keep_largest_part": False, **(walk_options or {})})
    transit = public_transport_graph(elements, epsg, **(transit_options or {}))
    return join_transit_walk(transit, walk, max_dist, keep_largest_part)

