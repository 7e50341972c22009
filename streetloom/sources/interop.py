"""Graphs from and to edge lists, NetworkX objects and GML files, and graphs from bare lines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geom
from ..functions.crs import from_utm, to_utm
from ..model import CityGraph, GraphMeta, edge_fields, straight
from ..operators.order import dense_positions
from ..plans.streets import factorize


def from_edge_list(nodes: DataFrame, edges: DataFrame, meta: GraphMeta, restore: bool = True) -> CityGraph:
    """A graph of node and edge tables. Missing lines become straight ones or drop their edge; lines that
    begin at v turn the edge round; others must join their nodes."""
    if nodes.isEmpty() or edges.isEmpty():
        raise ValueError("a graph needs nodes and edges")
    numbered = nodes if "pos" in nodes.columns else dense_positions(nodes, [F.col("node_id")])
    listed = edges if "edge_id" in edges.columns else dense_positions(edges, [F.col(c) for c in meta.key], "edge_id")
    if "geometry" not in listed.columns:
        listed = listed.withColumn("geometry", F.lit(None).cast("array<struct<x:double,y:double>>"))
    listed = straight(numbered, listed) if restore else listed.filter("geometry is not null and size(geometry) > 1")
    ends = numbered.select("node_id", geom.point(F.col("x"), F.col("y")).alias("p"))
    placed = listed.join(ends.withColumnsRenamed({"node_id": "u", "p": "_pu"}), "u").join(ends.withColumnsRenamed({"node_id": "v", "p": "_pv"}), "v")
    line, near = F.col("geometry"), F.greatest(F.lit(1e-6), F.lit(1e-9) * F.greatest(geom.length(F.col("geometry")), F.lit(1.0)))
    fits = lambda p, q: (geom.distance(p, geom.start(line)) <= near) & (geom.distance(q, geom.end(line)) <= near)
    turned = ~fits(F.col("_pu"), F.col("_pv")) & fits(F.col("_pv"), F.col("_pu"))
    wrong = placed.filter(~fits(F.col("_pu"), F.col("_pv")) & ~fits(F.col("_pv"), F.col("_pu")))
    if not wrong.isEmpty():
        raise ValueError(f"lines that do not join their nodes: {[tuple(r) for r in wrong.select('u', 'v').limit(10).collect()]}")
    placed = placed.withColumns({"_t": turned, "_nu": F.when(turned, F.col("v")).otherwise(F.col("u")), "_nv": F.when(turned, F.col("u")).otherwise(F.col("v"))})
    out = placed.drop("u", "v", "_pu", "_pv", "_t").withColumnsRenamed({"_nu": "u", "_nv": "v"})
    return CityGraph(numbered, out.select(*listed.columns), meta)


def from_networkx(spark: SparkSession, graph, epsg: int | None = None, oneway: str = "oneway", restore: bool = True) -> CityGraph:
    """A graph of an object with NetworkX's interface."""
    epsg = epsg if epsg is not None else graph.graph.get("crs")
    if epsg is None:
        raise ValueError("the graph names no reference system")
    nodes = [(int(n), float(d["x"]), float(d["y"])) for n, d in graph.nodes(data=True)]
    multi = graph.is_multigraph()
    rows = []
    for edge in graph.edges(data=True, keys=True) if multi else graph.edges(data=True):
        u, v, data = edge[0], edge[1], edge[-1]
        line = data.get("geometry")
        points = None if line is None or not len(line) else [(float(x), float(y)) for x, y in line]
        rows.append((int(u), int(v), int(edge[2]) if multi else 0, points, float(data["length_meter"]), float(data["time_min"]), bool(data[oneway]) if oneway in data else None))
    directed = any(r[-1] is not None for r in rows)
    meta = GraphMeta(int(epsg), None, multi, graph.is_directed(), oneway if directed else None)
    edges = spark.createDataFrame(rows, f"u long, v long, k int, geometry array<struct<x:double,y:double>>, length_meter double, time_min double, {oneway} boolean")
    edges = edges if directed else edges.drop(oneway)
    return from_edge_list(spark.createDataFrame(nodes, "node_id long, x double, y double"), edges if multi else edges.drop("k"), meta, restore)


def to_networkx(graph: CityGraph):
    """A NetworkX graph on the driver, if the package is there."""
    try:
        import networkx as nx
    except ImportError as error:
        raise ImportError("networkx is not installed") from error
    kind = {(False, False): nx.Graph, (False, True): nx.DiGraph, (True, False): nx.MultiGraph, (True, True): nx.MultiDiGraph}[graph.meta.is_multigraph, graph.meta.is_directed]
    out = kind(crs=graph.meta.epsg)
    for row in graph.nodes.collect():
        out.add_node(row["node_id"], **{k: v for k, v in row.asDict().items() if k != "node_id"})
    for row in graph.edges.orderBy("edge_id").collect():
        data = {k: v for k, v in row.asDict(True).items() if k not in ("u", "v", "k", "edge_id")}
        data["geometry"] = [(p["x"], p["y"]) for p in data["geometry"]]
        out.add_edge(row["u"], row["v"], *([row["k"]] if graph.meta.is_multigraph else []), **data)
    return out


def reproject(graph: CityGraph, epsg: int) -> CityGraph:
    """The graph in another system, longitude and latitude (4326) or a UTM zone."""
    if graph.meta.epsg is None:
        raise ValueError("the graph names no reference system")
    if epsg == graph.meta.epsg:
        return graph

    def moved(x, y):
        lon, lat = (x, y) if graph.meta.epsg == 4326 else from_utm(x, y, graph.meta.epsg)
        return (lon, lat) if epsg == 4326 else to_utm(lon, lat, epsg)

    x, y = moved(F.col("x"), F.col("y"))

    def point(p):
        a, b = moved(p["x"], p["y"])
        return F.struct(a.alias("x"), b.alias("y"))

    return graph.with_(nodes=graph.nodes.withColumns({"x": x, "y": y}), edges=graph.edges.withColumn("geometry", F.transform("geometry", point)), epsg=epsg)


def from_lines(lines: DataFrame, epsg: int, speed_kmh: float = 5.0, split_crossings: bool = True) -> CityGraph:
    """Directed graph of lines (line_id, geometry, attributes…), split where segments cross."""
    pieces = lines.select("line_id", F.posexplode(geom.segments(F.col("geometry"))).alias("nth", "s")).select("line_id", "nth", "s.a", "s.b")
    if split_crossings:
        pieces = _split(pieces)
    numbered = dense_positions(pieces.filter(geom.distance(F.col("a"), F.col("b")) > 0), [F.col("line_id"), F.col("nth"), *([F.col("part")] if split_crossings else [])], "edge_id")
    attributes = lines.drop("geometry")
    edges = numbered.select("edge_id", "line_id", F.array("a", "b").alias("geometry")).join(attributes, "line_id")
    nodes, edges = factorize(edges)
    size = geom.rounded(geom.length(F.col("geometry")), 3)
    edges = edges.withColumn("length_meter", size).withColumn("time_min", geom.rounded(F.col("length_meter") / (speed_kmh * 1000 / 60), 3))
    from ..operators.edit import edge_keys

    return CityGraph(nodes, edge_keys(edges), GraphMeta(epsg, None, True, True))


def _split(pieces: DataFrame, cell: float = 100.0) -> DataFrame:
    """Segments cut at their crossings with others; candidates share a cell of a grid."""
    grid = lambda low, high: F.sequence(F.floor(low / cell).cast("long"), F.floor(high / cell).cast("long"))
    spread = pieces.withColumn("cx", F.explode(grid(F.least("a.x", "b.x"), F.greatest("a.x", "b.x")))).withColumn("cy", F.explode(grid(F.least("a.y", "b.y"), F.greatest("a.y", "b.y"))))
    other = spread.select("cx", "cy", F.col("line_id").alias("l2"), F.col("nth").alias("n2"), F.col("a").alias("c"), F.col("b").alias("d"))
    met = spread.join(other, ["cx", "cy"]).filter("not (line_id = l2 and nth = n2)")
    rx, ry, sx, sy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y"), F.col("d.x") - F.col("c.x"), F.col("d.y") - F.col("c.y")
    det = rx * sy - ry * sx
    t = ((F.col("c.x") - F.col("a.x")) * sy - (F.col("c.y") - F.col("a.y")) * sx) / det
    s = ((F.col("c.x") - F.col("a.x")) * ry - (F.col("c.y") - F.col("a.y")) * rx) / det
    cuts = met.filter(det != 0).select("line_id", "nth", F.round(t, 9).alias("t"), s.alias("s")).filter("t > 0 and t < 1 and s >= 0 and s <= 1").groupBy("line_id", "nth").agg(F.array_sort(F.collect_set("t")).alias("ts"))
    full = pieces.join(cuts, ["line_id", "nth"], "left").withColumn("ts", F.concat(F.array(F.lit(0.0)), F.coalesce("ts", F.array().cast("array<double>")), F.array(F.lit(1.0))))
    at = lambda k: geom.point(F.round(F.col("a.x") + (F.col("b.x") - F.col("a.x")) * k, 6), F.round(F.col("a.y") + (F.col("b.y") - F.col("a.y")) * k, 6))
    return full.select("line_id", "nth", F.posexplode(F.zip_with(F.slice("ts", 1, F.size("ts") - 1), F.slice("ts", 2, F.size("ts") - 1), lambda p, q: F.struct(at(p).alias("a"), at(q).alias("b")))).alias("part", "z")).select("line_id", "nth", "part", "z.a", "z.b")


def write_gml(graph: CityGraph, path: str) -> None:
    """A GML text file on the driver; lines as WKT."""
    meta = graph.meta
    quote = lambda v: f'"{v}"' if isinstance(v, str) else int(v) if isinstance(v, bool) else v
    with open(path, "w", encoding="utf-8") as file:
        file.write(f"graph [\n  directed {int(meta.is_directed)}\n  multigraph {int(meta.is_multigraph)}\n  crs {meta.epsg if meta.epsg is not None else -1}\n")
        for r in graph.nodes.orderBy("pos").toLocalIterator():
            file.write(f"  node [\n    id {r['node_id']}\n    x {r['x']!r}\n    y {r['y']!r}\n  ]\n")
        for r in graph.edges.orderBy("edge_id").toLocalIterator():
            wkt = "LINESTRING (" + ", ".join(f"{p['x']!r} {p['y']!r}" for p in r["geometry"]) + ")"
            parts = {"source": r["u"], "target": r["v"], **({"key": r["k"]} if meta.is_multigraph else {}), "geometry": wkt, "length_meter": r["length_meter"], "time_min": r["time_min"], **({meta.direction_col: r[meta.direction_col]} if meta.direction_col else {})}
            file.write("  edge [\n" + "".join(f"    {k} {quote(v)}\n" for k, v in parts.items()) + "  ]\n")
        file.write("]\n")


def read_gml(spark: SparkSession, path: str, oneway: str = "oneway") -> CityGraph:
    """A graph of a GML file with x, y on nodes and WKT lines on edges."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    fields = lambda body: {k: v.strip('"') for k, v in re.findall(r'^\s*(\w+) ("[^"]*"|\S+)$', body, re.M)}
    head = fields(text[: text.index("node [")] if "node [" in text else text)
    nodes = [fields(m) for m in re.findall(r"node \[(.*?)\n\s*\]", text, re.S)]
    edges = [fields(m) for m in re.findall(r"edge \[(.*?)\n\s*\]", text, re.S)]
    multi, direction = head.get("multigraph") == "1", oneway if any(oneway in e for e in edges) else None
    meta = GraphMeta(None if head.get("crs", "-1") == "-1" else int(head["crs"]), None, multi, head.get("directed") == "1", direction)
    rows = []
    for k, e in enumerate(edges):
        line = [tuple(map(float, p.split())) for p in re.search(r"\((.*)\)", e["geometry"])[1].split(",")]
        rows.append((k, int(e["source"]), int(e["target"]), *([int(e.get("key", 0))] if multi else []), line, float(e["length_meter"]), float(e["time_min"]), *([e.get(oneway) == "1"] if direction else [])))
    from pyspark.sql.types import StructType

    made = spark.createDataFrame([(int(n["id"]), k, float(n["x"]), float(n["y"])) for k, n in enumerate(nodes)], "node_id long, pos long, x double, y double")
    return CityGraph(made, spark.createDataFrame(rows, StructType(edge_fields(meta))), meta)
