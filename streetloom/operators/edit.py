"""Editing graphs: subgraph, clip, join, relabel, simplify, direction, changes."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geom import in_polygon
from ..model import CityGraph, GraphChanges
from .order import dense_positions, grown
from .validation import preview, validate_changes


def edge_keys(edges: DataFrame) -> DataFrame:
    """`k`: the number of earlier rows with the same ends."""
    return edges.withColumn("k", (F.row_number().over(Window.partitionBy("u", "v").orderBy("edge_id")) - 1).cast("int"))


def _inside(edges: DataFrame, ids: DataFrame) -> DataFrame:
    columns = edges.columns
    return edges.join(grown(ids.withColumnRenamed("node_id", "u")), "u", "left_semi").join(grown(ids.withColumnRenamed("node_id", "v")), "v", "left_semi").select(*columns)


def subgraph(graph: CityGraph, node_ids: DataFrame, check: bool = True) -> CityGraph:
    """The given nodes and the edges between them; ids stay."""
    ids = node_ids.select("node_id").distinct()
    if check:
        unknown = ids.join(grown(graph.nodes), "node_id", "left_anti")
        if not unknown.isEmpty():
            raise ValueError(f"not nodes of the graph: {preview(unknown)}")
    columns = graph.nodes.columns
    return graph.with_(nodes=graph.nodes.join(grown(ids), "node_id", "left_semi").select(*columns), edges=_inside(graph.edges, ids))


def clip(graph: CityGraph, polygon: list[list[tuple[float, float]]]) -> CityGraph:
    """The nodes inside a polygon or on its border, and the edges between them."""
    if not isinstance(polygon, list) or not polygon or not isinstance(polygon[0], list):
        raise TypeError("a polygon is a list of rings of (x, y)")
    nodes = graph.nodes.filter(in_polygon(F.col("x"), F.col("y"), polygon))
    return graph.with_(nodes=nodes, edges=_inside(graph.edges, nodes.select("node_id")))


def relabel(graph: CityGraph) -> CityGraph:
    """Ids 0, 1, 2, … in node order; edges without nodes go, keys are made anew."""
    renamed = graph.nodes.withColumnsRenamed({"node_id": "_old", "pos": "_order"})
    numbered = dense_positions(renamed, [F.col(c) for c in ("_order", "_old") if c in renamed.columns])
    nodes = numbered.withColumn("node_id", F.col("pos")).drop("_order")
    mapping = nodes.select("_old", "node_id")
    columns = graph.edges.columns
    edges = graph.edges
    for end in ("u", "v"):
        edges = edges.join(mapping.select(F.col("_old").alias(end), F.col("node_id").alias(f"_{end}")), end)
    edges = edges.drop("u", "v").withColumnsRenamed({"_u": "u", "_v": "v"}).select(*columns)
    edges = edge_keys(edges).select(*columns) if graph.meta.is_multigraph else edges
    return graph.with_(nodes=nodes.select(*graph.nodes.columns, *([] if "pos" in graph.nodes.columns else ["pos"])), edges=edges)


def simplify_multiedges(graph: CityGraph, weight: str | None = None, rule: str = "min") -> CityGraph:
    """One edge for each pair of ends, that of the least or greatest weight, the first of equal ones."""
    weight = weight or graph.meta.weight
    if weight not in graph.edges.columns:
        raise KeyError(f"no weight column: {weight}")
    if rule not in ("min", "max"):
        raise ValueError(f"rule must be min or max, not {rule}")
    ends = ["u", "v"] if graph.meta.is_directed else [F.least("u", "v"), F.greatest("u", "v")]
    order = F.col(weight).asc() if rule == "min" else F.col(weight).desc()
    # row_number keeps whole rows; a group limit before the exchange keeps one row a task and pair
    best = graph.edges.withColumn("_n", F.row_number().over(Window.partitionBy(*ends).orderBy(order, "edge_id"))).filter("_n = 1").drop("_n", "k")
    return graph.with_(edges=best, is_multigraph=False)


def to_directed(graph: CityGraph, column: str = "oneway", default: bool = False) -> CityGraph:
    """Add a direction column, or fill the gaps of an existing one."""
    value = F.coalesce(F.col(column).cast("boolean"), F.lit(default)) if column in graph.edges.columns else F.lit(default)
    return graph.with_(edges=graph.edges.withColumn(column, value), is_directed=True, direction_col=column)


def to_undirected(graph: CityGraph) -> CityGraph:
    """Edges lose their direction; the column stays as data."""
    return CityGraph(graph.nodes, graph.edges, replace(graph.meta, is_directed=False, direction_col=None))


def join_graphs(left: CityGraph, right: CityGraph, graph_type: str | None = None, node_conflict: str = "left", check: bool = True) -> CityGraph:
    """Union of two graphs of one kind; of a node in both, one side wins; edge keys must differ."""
    if node_conflict not in ("left", "right"):
        raise ValueError(f"node_conflict must be left or right, not {node_conflict}")
    a, b = left.meta, right.meta
    if (a.epsg, a.is_multigraph, a.is_directed, a.direction_col) != (b.epsg, b.is_multigraph, b.is_directed, b.direction_col):
        raise ValueError("graphs differ in reference system or kind")
    if check:
        double = left.edges.select(*a.key).join(right.edges.select(*a.key), a.key, "left_semi")
        if not double.isEmpty():
            raise ValueError(f"edge keys in both graphs: {preview(double)}")
    side = lambda df, n: df.withColumn("_side", F.lit(n))
    first = F.col("_side").asc() if node_conflict == "left" else F.col("_side").desc()
    nodes = side(left.nodes, 0).unionByName(side(right.nodes, 1), allowMissingColumns=True)
    nodes = nodes.withColumn("_n", F.row_number().over(Window.partitionBy("node_id").orderBy(first, "pos"))).filter("_n = 1").drop("_n", "_side")
    edges = left.edges.unionByName(right.edges, allowMissingColumns=True)
    return CityGraph(nodes, edges, replace(a, graph_type=graph_type or a.graph_type))


def apply_changes(graph: CityGraph, changes: GraphChanges, check: bool = True) -> CityGraph:
    """Delete the named edges, then add the new nodes and edges."""
    if (graph.meta.is_multigraph, graph.meta.is_directed) != (changes.meta.is_multigraph, changes.meta.is_directed):
        raise ValueError("changes are for another kind of graph")
    key = graph.meta.key
    if check:
        validate_changes(changes)
        absent = changes.delete.select(*key).join(grown(graph.edges.select(*key)), key, "left_anti")
        if not absent.isEmpty():
            raise ValueError(f"no such edges to delete: {preview(absent)}")
        taken = changes.nodes.select("node_id").join(grown(graph.nodes.select("node_id")), "node_id", "left_semi")
        if not taken.isEmpty():
            raise ValueError(f"node ids exist: {preview(taken)}")
    columns = graph.edges.columns
    kept = graph.edges.join(grown(changes.delete.select(*key)), key, "left_anti").select(*columns)
    return graph.with_(nodes=graph.nodes.unionByName(changes.nodes, allowMissingColumns=True), edges=kept.unionByName(changes.edges, allowMissingColumns=True))
