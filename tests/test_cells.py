"""Nested cells, completed tables, points inside shapes, and the checks of inputs."""

import random

import pytest
from pyspark.sql import functions as F

from streetloom.functions import cells, geom
from streetloom.operators.merge import combine_first
from streetloom.operators.validation import located, resolve_nodes

from . import micro


def test_paths_into_cells(spark):
    df = spark.createDataFrame([("way", {"name": "A", "type": "road"}, ((1.5, [1, 2]),))], "type string, tags map<string,string>, center struct<at: struct<lat: double, ids: array<int>>>")
    paths = ["name", "type", "center.at.lat", "center.at.ids", "tags.name", "tags.none", "none", "center.none", "none.at"]
    got = df.select(*(cells.extract(df.schema, p).alias(f"c{k}") for k, p in enumerate(paths))).first()
    assert tuple(got) == ("A", "road", "1.5", "[1,2]", "A", None, None, None, None)


def test_cells_as_json_and_back(spark):
    df = spark.createDataFrame([([1, None, 3], {"a": 1.5}, ("x", [True])), (None, None, None)], "a array<int>, m map<string,double>, s struct<t: string, b: array<boolean>>")
    written = df.select(*(cells.to_cell(F.col(f.name), f.dataType).alias(f.name) for f in df.schema))
    assert {t for _, t in written.dtypes} == {"string"}
    back = written.select(*(cells.from_cell(F.col(f.name), f.dataType).alias(f.name) for f in df.schema))
    assert back.collect() == df.collect()


def test_distinct_values_and_maps(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (1, None), (2, "c"), (3, None)], "k int, v string")
    got = {r["k"]: (r["u"], r["s"]) for r in df.groupBy("k").agg(cells.unique_values(F.col("v")).alias("u")).withColumn("s", cells.scalar_or_list(F.col("u"))).collect()}
    assert got == {1: (["a", "b"], '["a","b"]'), 2: (["c"], "c"), 3: ([], None)}
    maps = spark.createDataFrame([([{"a": 1, "b": 2}, {"b": 3}, {}, {"c": 4}],), ([],)], "m array<map<string,int>>")
    assert [r[0] for r in maps.select(cells.merged(F.col("m"))).collect()] == [{"a": 1, "b": 3, "c": 4}, {}]


def test_combine_first(spark):
    left = spark.createDataFrame([(1, "x", None), (2, None, 5), (3, "z", 6)], "k int, v string, n int")
    right = spark.createDataFrame([(2, "r", 7, True), (4, "s", None, False)], "k int, v string, n int, more boolean")
    got = combine_first(left, right, ["k"])
    assert got.columns == ["k", "v", "n", "more"]
    assert micro.as_set(got, *got.columns) == {(1, "x", None, None), (2, "r", 5, True), (3, "z", 6, None), (4, "s", None, False)}


def test_inner_points_are_inside(spark):
    shapes = [
        [[(0, 0), (4, 0), (4, 4), (0, 4)]],
        [[(0, 0), (10, 0), (10, 1), (1, 1), (1, 9), (10, 9), (10, 10), (0, 10)]],  # open to the right
        [[(0, 0), (9, 0), (9, 9), (0, 9)], [(1, 1), (8, 1), (8, 8), (1, 8)]],  # with a hole in its middle
        [[(0, 0), (5, 5), (10, 0), (5, 10)]],
    ]
    rng = random.Random(3)
    for _ in range(20):
        xs, ys = sorted(rng.sample(range(50), 6)), [rng.randint(0, 20) for _ in range(6)]
        shapes.append([[*zip(xs, ys, strict=True), *((x, y + rng.randint(1, 9)) for x, y in reversed(list(zip(xs, ys, strict=True))))]])
    rows = [(k, [[(float(x), float(y)) for x, y in ring] for ring in shape]) for k, shape in enumerate(shapes)]
    df = spark.createDataFrame(rows, "k int, geometry array<array<struct<x: double, y: double>>>")
    for r in df.select("k", geom.inner_point(F.col("geometry")).alias("p")).collect():
        assert spark.range(1).select(geom.in_polygon(F.lit(r["p"]["x"]), F.lit(r["p"]["y"]), rows[r["k"]][1])).first()[0], r
    assert located(df).filter("x is null").isEmpty()


def test_centroid(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (2.0, 0.0), (2.0, 4.0)],), ([(1.0, 1.0), (1.0, 1.0)],)], "g array<struct<x: double, y: double>>")
    got = [tuple(r[0]) for r in df.select(geom.centroid(F.col("g"))).collect()]
    assert got == [pytest.approx((5 / 3, 4 / 3)), (1.0, 1.0)]


def test_inputs_are_checked(spark):
    graph = micro.line(spark)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "node_id long")
    objects = lambda *x: spark.createDataFrame(list(x), "object_id long, x double, y double, node long")
    assert resolve_nodes(graph, nodes=ids(0, 2)).count() == 2
    for wrong in ({"nodes": ids()}, {"nodes": ids(None)}, {"nodes": ids(99)}, {"objects": objects()}, {"objects": objects((1, 0.0, 0.0, 0), (1, 1.0, 0.0, 1))}, {"objects": objects((1, 0.0, 0.0, None)), "node_column": "node"}, {}):
        with pytest.raises(ValueError):
            resolve_nodes(graph, **wrong)
    lines = spark.createDataFrame([(7, [(18.0, 0.0), (24.0, 0.0)])], "object_id long, geometry array<struct<x: double, y: double>>")
    assert [tuple(r) for r in resolve_nodes(graph, objects=lines).select("object_id", "node_id").collect()] == [(7, 2)]
