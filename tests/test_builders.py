"""Builders, sources, files and interchange."""

import json

import pytest
from pyspark.sql import functions as F

from streetloom.functions.geom import length
from streetloom.functions.registry import TransportRegistry
from streetloom.model import GraphMeta
from streetloom.plans import samples, streets, transit
from streetloom.sources import archive, elements, interop
from streetloom.streaming.edge_weights import windowed_weights

from . import micro
from .micro import as_set


def way(number, points, **tags):
    return {"type": "way", "id": number, "tags": tags, "geometry": [{"lat": a, "lon": b} for a, b in points]}


WAYS = [
    way(10, [(59.900, 30.300), (59.901, 30.301)], highway="residential", oneway="yes", maxspeed="30", name="A"),
    way(11, [(59.905, 30.305), (59.906, 30.306)], highway="primary", oneway="-1"),
    way(12, [(59.910, 30.310), (59.911, 30.311)], highway="unclassified"),
    way(13, [(59.920, 30.310), (59.921, 30.311)], highway="footway"),
]


def test_drive_graph(spark):
    g = streets.drive_graph(elements.elements_of(spark, WAYS), 32636, keep_largest_part=False, add_category=True).validate()
    rows = {r["highway"]: r for r in g.edges.collect()}
    assert g.nodes.count() == 6 and len(rows) == 3
    assert rows["residential"]["oneway"] and rows["primary"]["oneway"] and not rows["unclassified"]["oneway"]
    assert rows["primary"]["category"] == "regional" and rows["residential"]["time_min"] == round(rows["residential"]["length_meter"] / 500, 3)
    assert rows["primary"]["geometry"][0]["y"] > rows["primary"]["geometry"][1]["y"]  # turned round
    assert streets.drive_graph(elements.elements_of(spark, WAYS[3:]), 32636).nodes.count() == 0
    with pytest.raises(ValueError):
        streets.drive_graph(elements.elements_of(spark, WAYS), 32636, network="custom")


def test_walk_graph_takes_footways(spark):
    g = streets.walk_graph(elements.elements_of(spark, WAYS), 32636, keep_largest_part=False).validate()
    assert g.edges.count() == 4 and not g.meta.is_directed
    row = g.edges.first()
    assert row["time_min"] == round(row["length_meter"] / 83.33, 3)
    with pytest.raises(ValueError):
        streets.walk_graph(elements.elements_of(spark, WAYS), 32636, walk_speed=0)


def test_chains_merge(spark):
    seg = lambda *rows: spark.createDataFrame([(k, w, [a, b]) for k, w, a, b in rows], "edge_id long, way_id long, geometry array<struct<x:double,y:double>>")
    p = [(float(k), 0.0) for k in range(6)]
    chain = seg((0, 1, p[0], p[1]), (1, 1, p[1], p[2]), (2, 2, p[2], p[5]), (3, 3, p[5], (5.0, 1.0)), (4, 3, p[5], (5.0, -1.0)))
    got = streets.merge_chains(chain).collect()
    assert sorted(len(r["geometry"]) for r in got) == [2, 2, 4]
    assert next(r["way_id"] for r in got if len(r["geometry"]) == 4) == 2  # the way of the midpoint
    ring = seg((0, 1, p[0], p[1]), (1, 1, p[1], (1.0, 1.0)), (2, 1, (1.0, 1.0), p[0]))
    closed = streets.merge_chains(ring).collect()
    assert len(closed) == 1 and closed[0]["geometry"][0] == closed[0]["geometry"][-1]


def test_clip_line():
    square = [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]]
    assert streets.clip_line([(-5.0, 5.0), (15.0, 5.0)], square) == [[(0.0, 5.0), (10.0, 5.0)]]
    assert len(streets.clip_line([(5.0, 5.0), (5.0, 15.0), (8.0, 15.0), (8.0, 5.0)], square)) == 2
    assert streets.clip_line([(20.0, 5.0), (30.0, 5.0)], square) == []


PT_DDL = "pos long, node_id string, type string, route string, x double, y double"
EDGE_DDL = "pos long, u string, v string, type string, route string, oneway boolean, geometry array<struct<x:double,y:double>>"


def test_boarding_and_shared_stops(spark):
    nodes = spark.createDataFrame([(0, "a", "bus", "1", 0.0, 0.0), (1, "b", "bus", "1", 0.0, 300.0), (2, "p", "platform", "1", 0.0, 7.0), (3, "z", "bus", "1", None, 0.0)], PT_DDL)
    edges = spark.createDataFrame([(0, "a", "b", "bus", "1", None, [(0.0, 0.0), (0.0, 300.0)]), (1, "a", "p", "boarding", "1", None, [(0.0, 0.0), (0.0, 7.0)]), (2, "a", "nowhere", "bus", "1", True, [(0.0, 0.0), (1.0, 1.0)])], EDGE_DDL)
    g = transit.assemble(nodes, edges, boarding_min=2.5, epsg=32636).validate()
    by = {r["type"]: r for r in g.edges.collect()}
    assert len(by) == 3 and by["boarding"]["time_min"] == 2.5 and by["alighting"]["time_min"] == 0
    assert (by["boarding"]["u"], by["boarding"]["v"]) == (by["alighting"]["v"], by["alighting"]["u"])
    assert by["bus"]["length_meter"] == 300 and all(r["oneway"] for r in by.values())
    shared = spark.createDataFrame([(0, "s", "bus", "A", 0.0, 0.0), (1, "s", "bus", "B", 0.0, 0.0), (2, "p", "platform", "A", 5.0, 0.0), (3, "q", "platform", "B", 5.2, 0.0)], PT_DDL)
    g = transit.assemble(shared, edges.limit(0), epsg=32636)
    assert g.nodes.filter("type = 'bus'").count() == 2
    platform = g.nodes.filter("type = 'platform'").first()
    assert platform["routes"] == ["A", "B"] and platform["route"] is None
    with pytest.raises(KeyError):
        transit.assemble(nodes, spark.createDataFrame([(0, "a", "b", "rocket", "1", None, [(0.0, 0.0), (0.0, 300.0)])], EDGE_DDL))
    with pytest.raises(ValueError):
        transit.assemble(nodes, edges, boarding_min=-1)


def test_ground_routes(spark):
    g = transit.public_transport_graph(elements.elements_of(spark, samples.ROUTES), samples.EPSG, ["bus", "tram"]).validate()
    bus = g.edges.filter("type = 'bus'").orderBy("edge_id").collect()
    assert len(bus) == 2 and 420 < bus[0]["length_meter"] < 440
    assert g.edges.filter("type = 'tram'").count() == 1 and g.edges.filter("type = 'boarding'").count() == 5
    with pytest.raises(ValueError):
        transit.public_transport_graph(elements.elements_of(spark, samples.ROUTES), samples.EPSG, ["rocket"])


def test_route_helpers():
    way = lambda *p: ([tuple(map(float, x)) for x in p], None)
    path = transit.stitch([way((0, 0), (1, 0)), way((3, 0), (2, 0)), way((1, 0), (2, 0))])
    assert [p for w, _ in path for p in w] == [(0, 0), (1, 0), (1, 0), (2, 0), (2, 0), (3, 0)]
    assert transit.pair([(0, 0), (10, 0)], [(1, 0), (9, 0), (500, 0)]) == {0: 0, 1: 1}
    assert transit.mean_speed([(0, 10, 100.0), (10, 20, 200.0), (20, 30, None)], 5, 30) == pytest.approx((500 + 2000) / 15)
    assert transit.offset_point((0, 0), (1, 0), (0, 0), 1) == (0, 7) and transit.side_of((0, 0), (1, 0), (0, 5)) == 1
    assert transit.parse_route("r", "bus", []) == ([], [])


def test_subway(spark):
    g = transit.public_transport_graph(elements.elements_of(spark, samples.SUBWAY), samples.EPSG, ["subway"]).validate()
    kinds = {r["type"]: r["n"] for r in g.edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kinds["subway"] == 1 and kinds["transfer"] == 1 and kinds["subway_exit"] == 1
    deep = g.edges.filter("type = 'subway_entry_exit'").first()
    assert deep["length_meter"] > 50  # 33 m along and 40 m down


def test_intermodal(spark):
    walk = micro.build(spark, {100: (0, 0), 101: (20, 0)}, [(100, 101, 0, 20, 4)], multi=True, graph_type="walk")
    pt = micro.build(spark, {200: (8, 2), 201: (40, 0)}, [(200, 201, 0, 32, 3, True)], multi=True, direction="oneway")
    pt = pt.with_(nodes=pt.nodes.withColumn("type", F.when(F.col("node_id") == 200, "platform").otherwise("subway")).withColumn("routes", F.array(F.lit("A"), F.lit("B"))))
    g = transit.join_transit_walk(pt, walk, keep_largest_part=False).validate()
    assert g.meta.graph_type == "intermodal" and g.nodes.filter("type = 'platform'").first()["routes"] == ["A", "B"]
    assert g.edges.count() == 4 and g.nodes.count() == 5
    assert transit.join_transit_walk(pt, walk.with_(nodes=walk.nodes.limit(0), edges=walk.edges.limit(0))) is pt
    with pytest.raises(ValueError):
        transit.join_transit_walk(pt.with_(epsg=1), walk)


def test_archives(spark, tmp_path):
    g = micro.oneway(spark)
    archive.write_graph(g, str(tmp_path / "g"), include_arcs=True)
    back = archive.read_graph(spark, str(tmp_path / "g"))
    assert back.meta == g.meta and as_set(back.edges, "u", "v", "oneway") == as_set(g.edges, "u", "v", "oneway")
    assert spark.read.parquet(str(tmp_path / "g/arcs")).count() == 4
    path = archive.export_archive(g, str(tmp_path / "one"))
    assert path.endswith(".citygraph")
    again = archive.import_archive(spark, path)
    assert again.meta == g.meta and again.edges.select(length(F.col("geometry"))).first()[0] == 10
    with pytest.raises(ValueError):
        spark.createDataFrame([("{}",)], "v string").write.text(str(tmp_path / "bad/meta"))
        archive.read_graph(spark, str(tmp_path / "bad"))


def test_interchange(spark, tmp_path):
    g = micro.oneway(spark)
    interop.write_gml(g, str(tmp_path / "g.gml"))
    back = interop.read_gml(spark, str(tmp_path / "g.gml"))
    assert as_set(back.edges, "u", "v", "oneway", "time_min") == as_set(g.edges, "u", "v", "oneway", "time_min") and back.meta.direction_col == "oneway"
    nodes = spark.createDataFrame([(0, 0.0, 0.0), (1, 10.0, 0.0), (2, 20.0, 0.0)], "node_id long, x double, y double")
    rows = [(0, 1, [(10.0, 0.0), (0.0, 0.0)], 10.0, 1.0), (1, 2, None, 10.0, 1.0)]
    edges = spark.createDataFrame(rows, "u long, v long, geometry array<struct<x:double,y:double>>, length_meter double, time_min double")
    made = interop.from_edge_list(nodes, edges, GraphMeta(3857)).validate()
    assert as_set(made.edges, "u", "v") == {(1, 0), (1, 2)}
    assert interop.from_edge_list(nodes, edges, GraphMeta(3857), restore=False).edges.count() == 1
    wrong = spark.createDataFrame([(0, 1, [(5.0, 5.0), (6.0, 6.0)], 1.0, 1.0)], edges.schema)
    with pytest.raises(ValueError, match="join"):
        interop.from_edge_list(nodes, wrong, GraphMeta(3857))
    cross = spark.createDataFrame([(0, [(0.0, 0.0), (10.0, 0.0)]), (1, [(5.0, -5.0), (5.0, 5.0)])], "line_id long, geometry array<struct<x:double,y:double>>")
    assert interop.from_lines(cross, 32636).validate().edges.count() == 4


def test_sources(spark, tmp_path):
    key = elements.cache_key("u", "POST", "q")
    assert elements.cache_load(str(tmp_path), "network", key) is None
    elements.cache_save(str(tmp_path), "network", key, {"elements": WAYS})
    assert elements.cache_load(str(tmp_path), "network", key)["elements"][0]["id"] == 10
    config = elements.Config(cache_dir=str(tmp_path), timeout=5)
    config.set_snapshot("2024-02-03")
    assert config.header() == '[out:json][timeout:5][date:"2024-02-03T00:00:00Z"];'
    with pytest.raises(ValueError):
        config.set_snapshot("2024-13-01")
    query = elements.network_query([[(30.0, 59.0), (31.0, 59.0), (31.0, 60.0)]], '["highway"]', config)
    elements.cache_save(str(tmp_path), "network", elements.cache_key(config.url, "POST", query), {"elements": []})
    assert elements.download(query, config) == {"elements": []}
    (tmp_path / "rows.json").write_text("\n".join(map(json.dumps, WAYS)))
    read = elements.read_elements(spark, str(tmp_path / "rows.json"))
    assert elements.network_elements(read, '["highway"="primary"]').count() == 1
    told = elements.classified(elements.elements_of(spark, samples.ROUTES + samples.SUBWAY), True)
    assert told.filter("is_stop_area").count() == 3 and told.filter("is_way_data").first()["way_speed"] == 1000
    assert elements.route_elements(elements.elements_of(spark, samples.SUBWAY), ["subway"], snapshot=True).count() == 0
    half = [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0)]]
    ring = elements.boundary({"members": [{"role": "outer", "geometry": [{"lon": x, "lat": y} for x, y in part]} for part in half]})
    assert len(ring) == 1 and ring[0][0] == ring[0][-1] and len(ring[0]) == 5
    two = elements.normalise_territory([[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]], [[(5.0, 5.0), (6.0, 5.0), (6.0, 6.0)]]])
    assert len(two) == 1
    with pytest.raises(TypeError):
        elements.normalise_territory("box")


def test_stream_of_weights(spark, tmp_path):
    rows = spark.range(100).select(F.timestamp_seconds(F.col("id") * 30).alias("ts"), (F.col("id") % 3).alias("edge_id"), F.col("id").cast("double").alias("minutes"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = windowed_weights(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    job = stream.writeStream.outputMode("complete").format("memory").queryName("weights").start()
    job.processAllAvailable()
    job.stop()
    assert as_set(spark.table("weights"), "start", "edge_id", "n") == as_set(windowed_weights(rows), "start", "edge_id", "n")
    assert TransportRegistry().to_df(spark).count() == 4
