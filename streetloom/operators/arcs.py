"""Traversable arcs of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import CityGraph


def _both(edges: DataFrame, graph: CityGraph, weak: bool = False) -> DataFrame:
    """Rows (src, dst, …) by the direction rules, each edge row read once."""
    back = F.lit(True) if weak or not graph.meta.is_directed else ~F.col(graph.meta.direction_col).cast("boolean") if graph.meta.direction_col else F.lit(False)
    there, again = F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst"))
    pairs = F.when(F.coalesce(back, F.lit(False)), F.array(there, again)).otherwise(F.array(there))
    return edges.withColumn("_arc", F.explode(pairs)).withColumns({"src": F.col("_arc.src"), "dst": F.col("_arc.dst")}).drop("_arc")


def _among(edges: DataFrame, node_ids: DataFrame | None) -> DataFrame:
    if node_ids is None:
        return edges
    ids = node_ids.select("node_id").distinct()
    return edges.join(ids.withColumnRenamed("node_id", "u"), "u", "left_semi").join(ids.withColumnRenamed("node_id", "v"), "v", "left_semi")


def arcs(graph: CityGraph, weight: str | None = None, rule: str = "min", node_ids: DataFrame | None = None, check: bool = True) -> DataFrame:
    """(src, dst, w float): one arc for each ordered pair; parallel edges keep their least or greatest weight.

    Undirected rows are traversable both ways and are made so before grouping.
    """
    weight = weight or graph.meta.weight
    if weight not in graph.edges.columns:
        raise KeyError(f"no weight column: {weight}")
    if rule not in ("min", "max"):
        raise ValueError(f"rule must be min or max, not {rule}")
    value = F.col(weight).cast("float")
    if check:
        bad = graph.edges.filter(value.isNull() | F.isnan(value))
        if not bad.isEmpty():
            raise ValueError(f"missing weights in {weight}")
    rows = _both(_among(graph.edges, node_ids), graph).select("src", "dst", value.alias("w"))
    return rows.groupBy("src", "dst").agg((F.min if rule == "min" else F.max)("w").alias("w"))


def boolean_arcs(graph: CityGraph, weak: bool = False, node_ids: DataFrame | None = None) -> DataFrame:
    """(src, dst) without weights; `weak` ignores direction."""
    return _both(_among(graph.edges, node_ids), graph, weak).select("src", "dst").distinct()
