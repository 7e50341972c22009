"""Graphs on disk: a folder of Parquet tables for work at any size, and a single archive for exchange."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import zipfile
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.cells import from_cell, nested, to_cell
from ..model import CityGraph, GraphMeta

FORMAT, VERSION = "streetloom-graph", 1
SUFFIX = ".citygraph"


def write_graph(graph: CityGraph, path: str, include_arcs: bool = False) -> None:
    """nodes/, edges/, meta/ and perhaps arcs/ below a folder that any Spark file system holds."""
    graph.validate()
    graph.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    graph.edges.write.mode("overwrite").parquet(f"{path}/edges")
    if include_arcs:
        graph.arcs().write.mode("overwrite").parquet(f"{path}/arcs")
    record = json.dumps({"format": FORMAT, "version": VERSION, **asdict(graph.meta)})
    graph.spark.createDataFrame([(record,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def read_graph(spark: SparkSession, path: str, validate: bool = True) -> CityGraph:
    record = json.loads("".join(r[0] for r in spark.read.text(f"{path}/meta").collect()))
    if record.pop("format", None) != FORMAT:
        raise ValueError(f"not a graph: {path}")
    if (version := record.pop("version", None)) != VERSION:
        raise ValueError(f"unknown version: {version}")
    graph = CityGraph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), GraphMeta(**record))
    return graph.validate() if validate else graph


def _cells(fields) -> list[T.StructField]:
    """The fields that are JSON text in an archive."""
    return [f for f in fields if nested(f.dataType) and f.name != "geometry"]


def export_archive(graph: CityGraph, path: str, include_arcs: bool = False) -> str:
    """One zip file on the driver, for graphs of a city's size; nested columns but the geometry are JSON text in it."""
    import pyarrow.parquet as pq

    path = path if path.endswith(SUFFIX) else path + SUFFIX
    folder = tempfile.mkdtemp(prefix="graph-")
    try:
        graph.validate()
        tables = {"nodes": graph.nodes, "edges": graph.edges, **({"arcs": graph.arcs()} if include_arcs else {})}
        for name, table in tables.items():
            plain = table.withColumns({f.name: to_cell(table[f.name], f.dataType) for f in _cells(table.schema)})
            pq.write_table(plain.toArrow(), os.path.join(folder, f"{name}.parquet"))
        with open(os.path.join(folder, "metadata.json"), "w") as file:
            json.dump({"format": FORMAT, "version": VERSION, "schemas": {n: t.schema.jsonValue() for n, t in tables.items()}, **asdict(graph.meta)}, file)
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
            for name in ("metadata.json", *(f"{t}.parquet" for t in tables)):
                archive.write(os.path.join(folder, name), name)
    finally:
        shutil.rmtree(folder)
    return path


def import_archive(spark: SparkSession, path: str, validate: bool = True) -> CityGraph:
    import io

    import pyarrow.parquet as pq

    from ..model import NODE_FIELDS, edge_fields

    with zipfile.ZipFile(path) as archive:
        missing = {"metadata.json", "nodes.parquet", "edges.parquet"} - set(archive.namelist())
        if missing:
            raise ValueError(f"archive lacks {sorted(missing)}")
        record = json.loads(archive.read("metadata.json"))
        tables = {n: pq.read_table(io.BytesIO(archive.read(f"{n}.parquet"))) for n in ("nodes", "edges")}
    if record.pop("format", None) != FORMAT or record.pop("version", None) != VERSION:
        raise ValueError(f"not a graph of version {VERSION}: {path}")
    schemas = {n: T.StructType.fromJson(s) for n, s in record.pop("schemas", {}).items()}
    meta = GraphMeta(**record)
    frames = {n: spark.createDataFrame(t) for n, t in tables.items()}
    frames = {n: df.withColumns({f.name: from_cell(df[f.name].cast("string"), f.dataType) for f in _cells(schemas.get(n, []))}) for n, df in frames.items()}
    cast = lambda df, fields: df.withColumns({f.name: df[f.name].cast(f.dataType) for f in fields if f.name in df.columns})
    graph = CityGraph(cast(frames["nodes"], NODE_FIELDS), cast(frames["edges"], edge_fields(meta)), meta)
    return graph.validate() if validate else graph


def archived_arcs(spark: SparkSession, path: str) -> DataFrame | None:
    """The weighted arcs that an archive holds beside its graph, if it does."""
    import io

    import pyarrow.parquet as pq

    with zipfile.ZipFile(path) as archive:
        if "arcs.parquet" not in archive.namelist():
            return None
        return spark.createDataFrame(pq.read_table(io.BytesIO(archive.read("arcs.parquet"))))
