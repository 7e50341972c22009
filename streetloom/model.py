"""The graph: a node table, an edge table and a small record about both.

nodes: node_id LONG, pos LONG, x DOUBLE, y DOUBLE, and any attributes
edges: edge_id LONG, u LONG, v LONG, [k INT], geometry ARRAY<STRUCT<x,y>>, length_meter DOUBLE,
       time_min DOUBLE, [direction column BOOLEAN], and any attributes

DataFrames have no order, so `pos` and `edge_id` carry it: whatever is "first" is first by them.
Graphs are immutable; every operation returns a new one.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINE = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
CORE = ("u", "v", "geometry", "length_meter", "time_min")
PREVIEW = 10


@dataclass(frozen=True)
class GraphMeta:
    epsg: int | None = None
    graph_type: str | None = None
    is_multigraph: bool = False
    is_directed: bool = False
    direction_col: str | None = None
    weight: str = "time_min"

    def __post_init__(self):
        if self.direction_col is not None:  # a direction column makes a graph directed
            object.__setattr__(self, "is_directed", True)

    @property
    def key(self) -> list[str]:
        return ["u", "v", "k"] if self.is_multigraph else ["u", "v"]


@dataclass(frozen=True)
class CityGraph:
    nodes: DataFrame
    edges: DataFrame
    meta: GraphMeta = GraphMeta()

    def with_(self, **changes) -> CityGraph:
        meta = {k: v for k, v in changes.items() if k not in ("nodes", "edges")}
        return CityGraph(changes.get("nodes", self.nodes), changes.get("edges", self.edges), replace(self.meta, **meta))

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def validate(self) -> CityGraph:
        from .operators.validation import validate_graph

        validate_graph(self)
        return self

    def subgraph(self, node_ids: DataFrame) -> CityGraph:
        from .operators.edit import subgraph

        return subgraph(self, node_ids)

    def clip(self, polygon) -> CityGraph:
        from .operators.edit import clip

        return clip(self, polygon)

    def join(self, other: CityGraph, **options) -> CityGraph:
        from .operators.edit import join_graphs

        return join_graphs(self, other, **options)

    def relabel(self) -> CityGraph:
        from .operators.edit import relabel

        return relabel(self)

    def simplify_multiedges(self, **options) -> CityGraph:
        from .operators.edit import simplify_multiedges

        return simplify_multiedges(self, **options)

    def to_directed(self, **options) -> CityGraph:
        from .operators.edit import to_directed

        return to_directed(self, **options)

    def to_undirected(self) -> CityGraph:
        from .operators.edit import to_undirected

        return to_undirected(self)

    def arcs(self, **options) -> DataFrame:
        from .operators.arcs import arcs

        return arcs(self, **options)

    def keep_largest(self, mode: str = "auto") -> CityGraph:
        from .operators.components import keep_largest

        return keep_largest(self, mode)

    def sssp(self, source: int, **options) -> DataFrame:
        from .operators.paths import single_source

        return single_source(self, source, **options)

    def od_matrix(self, origins: DataFrame, destinations: DataFrame, **options) -> DataFrame:
        from .operators.paths import od_matrix

        return od_matrix(self, origins, destinations, **options)

    def nearest_nodes(self, objects: DataFrame, **options) -> DataFrame:
        from .operators.spatial import nearest_nodes

        return nearest_nodes(self, objects, **options)

    def project_objects(self, objects: DataFrame, speed_m_per_min: float, **options):
        from .operators.edit import apply_changes
        from .operators.projection import project_objects

        changes, mapping = project_objects(self, objects, speed_m_per_min, **options)
        return apply_changes(self, changes), mapping

    def write(self, path: str, **options) -> None:
        from .sources.archive import write_graph

        write_graph(self, path, **options)


@dataclass(frozen=True)
class GraphChanges:
    """A delta: nodes and edges to add, and keys of edges to delete."""

    nodes: DataFrame
    edges: DataFrame
    delete: DataFrame
    meta: GraphMeta = GraphMeta()


def edge_fields(meta: GraphMeta) -> list[T.StructField]:
    fields = [T.StructField("edge_id", T.LongType()), T.StructField("u", T.LongType()), T.StructField("v", T.LongType())]
    fields += [T.StructField("k", T.IntegerType())] if meta.is_multigraph else []
    fields += [T.StructField("geometry", LINE), T.StructField("length_meter", T.DoubleType()), T.StructField("time_min", T.DoubleType())]
    return fields + ([T.StructField(meta.direction_col, T.BooleanType())] if meta.direction_col else [])


NODE_FIELDS = [T.StructField("node_id", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]


def empty(spark: SparkSession, meta: GraphMeta | None = None) -> CityGraph:
    """A graph without nodes, with the columns that its kind requires."""
    meta = meta or GraphMeta()
    return CityGraph(spark.createDataFrame([], T.StructType(NODE_FIELDS)), spark.createDataFrame([], T.StructType(edge_fields(meta))), meta)


def straight(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with a missing geometry get the straight line between their ends."""
    ends = lambda side: nodes.select(F.col("node_id").alias(side), F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).alias(f"_{side}"))
    joined = edges.join(ends("u"), "u", "left").join(ends("v"), "v", "left")
    line = F.array("_u", "_v")
    geometry = F.coalesce(F.col("geometry"), line) if "geometry" in edges.columns else line
    return joined.withColumn("geometry", geometry).select(*edges.columns, *([] if "geometry" in edges.columns else ["geometry"]))
