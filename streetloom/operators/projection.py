"""Attach objects to a graph: split the nearest edges and link the objects to the new nodes.

Coordinates are metres already (a projected system). An object whose nearest point is an
end of its edge goes to the node there. All others are grouped by edge and by the cell of a
10 m grid that their nearest point falls in; a group shares one new node, at the point of
its first object. Edges are replaced by their pieces, which keep attributes and key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geom
from ..model import CityGraph, GraphChanges
from .order import checkpoint, dense_positions, grown
from .spatial import nearest_edges
from .validation import preview

GRID = 10.0


def _pieces(line, cuts: list[float]) -> list[list[tuple[float, float]]]:
    """A line cut at ascending distances."""
    points = [(p["x"], p["y"]) for p in line]
    out, current, done, at = [], [points[0]], 0.0, 0
    for (ax, ay), (bx, by) in zip(points, points[1:], strict=False):
        part = ((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5
        while at < len(cuts) and cuts[at] < done + part:
            t = (cuts[at] - done) / part
            p = (ax + (bx - ax) * t, ay + (by - ay) * t)
            out.append([*current, p] if current[-1] != p else current)
            current, at = [p], at + 1
        if current[-1] != (bx, by):
            current.append((bx, by))
        done += part
    return [*out, current]


def _length(points: list[tuple[float, float]]) -> float:
    return sum(((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5 for (ax, ay), (bx, by) in zip(points, points[1:], strict=False))


def split_line(u: int, v: int, line, cuts: list[tuple[float, int]], speed: float) -> list[tuple]:
    """(u, v, geometry, length, time) of the pieces of an edge that is cut at (distance, node); near cuts are one."""
    total = _length([(p["x"], p["y"]) for p in line])
    eps = 1e-6 * total
    groups: list[tuple[float, int]] = []
    for dist, node in sorted(cuts, key=lambda c: c[0]):
        if not groups or abs(dist - groups[-1][0]) > eps:
            groups.append((dist, node))
    inner = [g for g in groups if eps < g[0] < total - eps]
    names = [u, *(n for _, n in inner), v]
    out = []
    for a, b, points in zip(names, names[1:], _pieces(line, [d for d, _ in inner]), strict=False):
        if _length(points) > 0 and a != b:
            size = round(_length(points), 3)
            out.append((a, b, points, size, round(size / speed, 2)))
    return out


def project_objects(graph: CityGraph, objects: DataFrame, speed_m_per_min: float, max_dist: float | None = None, add_link_edge: bool = True) -> tuple[GraphChanges, DataFrame]:
    """Changes for `apply_changes`, and (object_id, node_id). Objects: object_id, x, y, ordered by object_id."""
    meta, spark = graph.meta, graph.spark
    if speed_m_per_min <= 0:
        raise ValueError(f"speed must be above 0: {speed_m_per_min}")
    if objects.isEmpty():
        raise ValueError("no objects")
    twice = objects.groupBy("object_id").count().filter("count > 1")
    if not twice.isEmpty():
        raise ValueError(f"object ids are repeated: {preview(twice)}")
    edges = graph.edges.withColumn("_len", geom.length(F.col("geometry")))
    hits = nearest_edges(graph, objects, max_dist).join(grown(objects.select("object_id", "x", "y")), "object_id")
    hits = hits.join(grown(edges.select("edge_id", "u", "v", "geometry", "_len")), "edge_id")
    tolerance = F.greatest(F.lit(1e-6), F.lit(1e-5) * F.col("_len"))
    hits = checkpoint(hits.withColumn("snap", F.when(F.abs(F.col("along") - F.col("_len")) <= tolerance, F.col("v")).when(F.abs("along") <= tolerance, F.col("u"))))
    each = hits.groupBy("object_id").agg(F.count("snap").alias("at_end"), F.count(F.lit(1)).alias("all"), F.countDistinct("snap").alias("ends"), F.min("snap").alias("node"))
    mixed = each.filter("at_end > 0 and at_end < all")
    if not mixed.isEmpty():
        raise ValueError(f"objects with an end and an inner point as nearest: {preview(mixed.select('object_id'))}")
    several = each.filter("ends > 1")
    if not several.isEmpty():
        raise ValueError(f"objects at several nodes: {preview(several.select('object_id'))}")
    snapped = checkpoint(each.filter("at_end > 0").select("object_id", F.col("node").alias("target")))
    base = graph.nodes.agg(F.coalesce(F.max("node_id") + 1, F.lit(0)), F.coalesce(F.max("pos") + 1, F.lit(0)) if "pos" in graph.nodes.columns else F.lit(0)).first()
    next_id, next_pos = int(base[0]), int(base[1])
    next_edge = int(graph.edges.agg(F.coalesce(F.max("edge_id") + 1, F.lit(0))).first()[0])

    inner = hits.filter("snap is null").withColumn("p", geom.interpolate(F.col("geometry"), F.col("along")))
    grid = lambda c: F.rint(F.col(f"p.{c}") / GRID)
    inner = inner.withColumns({"gx": grid("x"), "gy": grid("y")})
    first = F.min(F.struct("object_id", "along", "p"))
    groups = inner.groupBy("edge_id", "gx", "gy").agg(first.alias("f"))
    groups = dense_positions(groups, [F.col("f.object_id"), F.col("edge_id"), F.col("gx"), F.col("gy")], "nth")
    n_snapped = snapped.count() if add_link_edge else 0
    groups = checkpoint(groups.select("edge_id", "gx", "gy", "nth", (F.col("nth") + next_id + n_snapped).alias("node"), F.col("f.along").alias("along"), F.col("f.p").alias("p")))
    n_groups = groups.count()
    # the first group of each object holds it
    member = inner.select("object_id", "edge_id", "gx", "gy", "x", "y").join(grown(groups), ["edge_id", "gx", "gy"])
    held = member.groupBy("object_id").agg(F.min(F.struct("nth", "node")).alias("m"), F.first("x").alias("x"), F.first("y").alias("y")).select("object_id", F.col("m.nth").alias("nth"), F.col("m.node").alias("target"), "x", "y")

    project_nodes = groups.select(F.col("node").alias("node_id"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    if add_link_edge:
        ends = snapped.join(grown(objects.select("object_id", "x", "y")), "object_id").join(grown(graph.nodes.select(F.col("node_id").alias("target"), F.col("x").alias("tx"), F.col("y").alias("ty"))), "target")
        first_block = dense_positions(ends, [F.col("object_id")], "n").withColumn("node_id", F.col("n") + next_id)
        others = held.join(grown(project_nodes.select(F.col("node_id").alias("target"), F.col("x").alias("tx"), F.col("y").alias("ty"))), "target")
        second_block = dense_positions(others, [F.col("nth"), F.col("object_id")], "n").withColumn("node_id", F.col("n") + next_id + n_snapped + n_groups)
        linked = checkpoint(first_block.select("object_id", "node_id", "target", "x", "y", "tx", "ty").unionByName(second_block.select("object_id", "node_id", "target", "x", "y", "tx", "ty")))
        mapping = linked.select("object_id", "node_id")
        new_nodes = project_nodes.unionByName(linked.select("node_id", "x", "y"))
        line = F.array(geom.point(F.col("x"), F.col("y")), geom.point(F.col("tx"), F.col("ty")))
        size = geom.distance(F.element_at(line, 1), F.element_at(line, 2))
        connect = linked.withColumns({"geometry": line, "_size": size}).filter("_size > 0")
        # one row serves both ways where edges have a direction or none, a second one where all are one-way
        rows = F.array(F.struct(F.col("node_id").alias("u"), F.col("target").alias("v"), F.col("geometry").alias("g")), *([F.struct(F.col("target").alias("u"), F.col("node_id").alias("v"), F.reverse("geometry").alias("g"))] if meta.is_directed and meta.direction_col is None else []))
        links = connect.select(F.explode(rows).alias("r"), F.round("_size", 3).alias("length_meter")).select("r.u", "r.v", F.col("r.g").alias("geometry"), "length_meter", F.round(F.col("length_meter") / F.lit(float(speed_m_per_min)), 2).alias("time_min"))
    else:
        mapping = snapped.select("object_id", F.col("target").alias("node_id")).unionByName(held.select("object_id", F.col("target").alias("node_id")))
        new_nodes, links = project_nodes, None

    cuts = groups.groupBy("edge_id").agg(F.collect_list(F.struct("along", "node")).alias("cuts"))
    touched = edges.join(grown(cuts), "edge_id").select("edge_id", "u", "v", "geometry", "cuts")

    def split(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                for nth, (a, b, points, size, time) in enumerate(split_line(row.u, row.v, row.geometry, [(c["along"], c["node"]) for c in row.cuts], float(speed_m_per_min))):
                    out.append((row.edge_id, nth, a, b, [{"x": x, "y": y} for x, y in points], size, time))
            yield pd.DataFrame(out, columns=["source_edge", "nth", "u", "v", "geometry", "length_meter", "time_min"])

    pieces = touched.mapInPandas(split, "source_edge long, nth int, u long, v long, geometry array<struct<x:double,y:double>>, length_meter double, time_min double")
    rest = [c for c in graph.edges.columns if c not in ("edge_id", "u", "v", "geometry", "length_meter", "time_min")]
    attrs = graph.edges.select(F.col("edge_id").alias("source_edge"), *rest)
    new_edges = pieces.join(grown(attrs), "source_edge")
    if links is not None:
        extra = {"source_edge": F.lit(1 << 62), "nth": F.lit(0)} | ({"k": F.lit(0)} if meta.is_multigraph else {}) | ({meta.direction_col: F.lit(False)} if meta.direction_col else {})
        new_edges = new_edges.unionByName(links.withColumns(extra), allowMissingColumns=True)
    new_edges = dense_positions(new_edges, [F.col("source_edge"), F.col("nth"), F.col("u"), F.col("v")], "edge_id").withColumn("edge_id", F.col("edge_id") + next_edge)
    delete = edges.join(grown(cuts.select("edge_id")), "edge_id", "left_semi").select(*meta.key)
    added = new_nodes.withColumn("pos", F.col("node_id") - next_id + next_pos)
    return GraphChanges(checkpoint(added.select("node_id", "pos", "x", "y")), checkpoint(new_edges.select(*graph.edges.columns)), delete, meta), checkpoint(mapping)
