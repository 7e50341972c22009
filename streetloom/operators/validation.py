"""Contracts of graphs and change sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geom
from ..model import CORE, PREVIEW, CityGraph, GraphChanges, GraphMeta


def preview(df: DataFrame) -> list:
    return [r.asDict() if len(r) > 1 else r[0] for r in df.limit(PREVIEW).collect()]


def node_report(nodes: DataFrame) -> DataFrame:
    """One row: rows, repeated ids, null ids, null points."""
    ids = nodes.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("no_point"))
    return ids.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"), F.count_if((F.col("n") > 1) & F.col("node_id").isNotNull()).alias("repeated_ids"), F.coalesce(F.sum(F.when(F.col("node_id").isNull(), F.col("n"))), F.lit(0)).alias("null_ids"), F.coalesce(F.sum("no_point"), F.lit(0)).alias("null_points"))


def edge_report(edges: DataFrame, meta: GraphMeta) -> DataFrame:
    """One row: rows, repeated keys, null ends, null lines, null directions."""
    undirected = F.lit(None).cast("boolean").isNull() if meta.direction_col is None else F.col(meta.direction_col).isNotNull()
    keys = edges.groupBy(*meta.key).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("u").isNull() | F.col("v").isNull()).alias("no_end"),
        F.count_if(F.col("geometry").isNull()).alias("no_line"),
        F.count_if(~undirected).alias("no_direction"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return keys.agg(total("n").alias("edges"), F.count_if(F.col("n") > 1).alias("repeated_keys"), total("no_end").alias("null_ends"), total("no_line").alias("null_lines"), total("no_direction").alias("null_directions"))


def dangling(graph: CityGraph) -> DataFrame:
    """Ends of edges that are no nodes."""
    ends = graph.edges.select(F.col("u").alias("node_id")).union(graph.edges.select("v"))
    return ends.filter("node_id is not null").join(graph.nodes.select("node_id"), "node_id", "left_anti").distinct()


def report(graph: CityGraph) -> DataFrame:
    """One row with all counts that must be zero, and the sizes."""
    return node_report(graph.nodes).crossJoin(edge_report(graph.edges, graph.meta)).crossJoin(dangling(graph).agg(F.count(F.lit(1)).alias("dangling")))


def validate_graph(graph: CityGraph) -> None:
    missing = [c for c in ("node_id", "x", "y") if c not in graph.nodes.columns]
    missing += [c for c in (*CORE, *(["k"] if graph.meta.is_multigraph else []), *([graph.meta.direction_col] if graph.meta.direction_col else [])) if c not in graph.edges.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    found = report(graph).first().asDict()
    wrong = {k: v for k, v in found.items() if k not in ("nodes", "edges") and v}
    if wrong:
        more = f"; no nodes: {preview(dangling(graph))}" if wrong.get("dangling") else ""
        raise ValueError(f"invalid graph: {wrong}{more}")


def validate_changes(changes: GraphChanges) -> None:
    keys = changes.delete.groupBy(*changes.meta.key).count().filter("count > 1")
    if not keys.isEmpty():
        raise ValueError(f"keys to delete are repeated: {preview(keys)}")
    nodes = node_report(changes.nodes).first().asDict()
    edges = edge_report(changes.edges, changes.meta).first().asDict()
    wrong = {k: v for k, v in {**nodes, **edges}.items() if k not in ("nodes", "edges") and v}
    if wrong:
        raise ValueError(f"invalid changes: {wrong}")


def located(objects: DataFrame) -> DataFrame:
    """Objects with x and y: those of points as they are, lines by their middle, polygons by a point inside."""
    kind = dict(objects.dtypes).get("geometry")
    if kind is None or {"x", "y"} <= set(objects.columns):
        return objects
    at = geom.inner_point(F.col("geometry")) if kind.startswith("array<array<") else geom.midpoint(F.col("geometry")) if kind.startswith("array<") else F.col("geometry")
    return objects.withColumns({"x": at["x"], "y": at["y"]})


def resolve_nodes(graph: CityGraph, nodes: DataFrame | None = None, objects: DataFrame | None = None, node_column: str | None = None) -> DataFrame:
    """(object_id, node_id) of node ids, or of objects that carry their node or snap to the nearest one.

    Objects are points (x, y), lines or polygons (geometry).
    """
    if (nodes is None) == (objects is None):
        raise ValueError("give either nodes or objects")
    repeated = graph.nodes.groupBy("node_id").count().filter("count > 1")
    if graph.nodes.isEmpty():
        raise ValueError("the graph is empty")
    if not repeated.isEmpty():
        raise ValueError(f"node ids are repeated: {preview(repeated.select('node_id'))}")
    given, said = (nodes, "nodes") if nodes is not None else (objects, "objects")
    if given.isEmpty():
        raise ValueError(f"there are no {said}")
    if nodes is not None:
        found = nodes.select(F.col("node_id").alias("object_id"), "node_id")
    else:
        twice = objects.groupBy("object_id").count().filter("count > 1")
        if not twice.isEmpty():
            raise ValueError(f"object ids are repeated: {preview(twice.select('object_id'))}")
        if node_column is None or node_column not in objects.columns:
            from .spatial import nearest_nodes

            return nearest_nodes(graph, located(objects)).select("object_id", "node_id")
        found = objects.select("object_id", F.col(node_column).cast("long").alias("node_id"))
    empty = found.filter("node_id is null")
    if not empty.isEmpty():
        raise ValueError(f"{said} without a node: {preview(empty.select('object_id'))}")
    missing = found.join(graph.nodes.select("node_id"), "node_id", "left_anti")
    if not missing.isEmpty():
        raise ValueError(f"not nodes of the graph: {preview(missing.select('node_id'))}")
    return found
