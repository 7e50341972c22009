"""Hand-built graphs of a few nodes."""

from __future__ import annotations

from streetloom.model import CityGraph, GraphMeta, edge_fields
from pyspark.sql.types import StructType


def build(spark, nodes, edges, multi=False, directed=False, direction=None, graph_type=None, tags=None):
    """nodes {id: (x, y)}; edges (u, v, [k], length, time, [direction])."""
    meta = GraphMeta(3857, graph_type, multi, directed, direction)
    rows = []
    for n, e in enumerate(edges):
        line = [nodes[e[0]], nodes[e[1]]]
        at = 3 if multi else 2
        rows.append((n, e[0], e[1], *([e[2]] if multi else []), line, float(e[at]), float(e[at + 1]), *([e[at + 2]] if direction else [])))
    made = spark.createDataFrame([(i, k, float(x), float(y)) for k, (i, (x, y)) in enumerate(nodes.items())], "node_id long, pos long, x double, y double")
    lines = [tuple([(float(x), float(y)) for x, y in c] if isinstance(c, list) else c for c in r) for r in rows]
    return CityGraph(made, spark.createDataFrame(lines, StructType(edge_fields(meta))), meta)


LINE = {0: (0, 0), 1: (10, 0), 2: (20, 0), 3: (30, 0)}


def line(spark):
    return build(spark, LINE, [(0, 1, 10, 1), (1, 2, 10, 2), (2, 3, 10, 4)])


def oneway(spark):
    return build(spark, LINE, [(0, 1, 10, 1, True), (1, 2, 10, 2, False), (2, 3, 10, 4, True)], direction="oneway")


def parallel(spark):
    return build(spark, {k: LINE[k] for k in (0, 1, 2)}, [(0, 1, 0, 10, 5), (0, 1, 1, 10, 1), (1, 2, 0, 10, 2)], multi=True)


def disconnected(spark):
    return build(spark, {0: (0, 0), 1: (10, 0), 2: (20, 0), 10: (100, 0), 11: (110, 0)}, [(0, 1, 10, 1), (1, 2, 10, 1), (10, 11, 10, 1)])


def as_set(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}
