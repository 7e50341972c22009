"""Registered queries do the whole job: no row of the tables is left out."""

import heapq
import os
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from streetloom.plans import registry
from streetloom.plans.derived import objects, street_grid, transit_rides

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
FAR = 10_000_000


def counted(frame, *columns):
    return {tuple(r[:-1]): r[-1] for r in frame.groupBy(*columns).count().collect()}


@needs_data
def test_intermodal_join_has_all_rides(spark):
    got = registry.QUERIES["intermodal_join"](spark, DATA)
    want = counted(transit_rides(spark, DATA).select(F.col("mode").alias("type"), F.col("route").cast("string").alias("route")), "type", "route")
    rides = got.filter(~F.col("type").isin("walk", "boarding", "alighting"))
    assert counted(rides, "type", "route") == want
    # both stops of every ride are left for their platforms and reached from them
    assert counted(got.filter("type like '%ing'"), "type") == {(t,): 2 * sum(want.values()) for t in ("boarding", "alighting")}


@needs_data
def test_intermodal_join_with_far_event_ids(spark, tmp_path):
    # the stop of an event does not change by multiples of 500, nor the order where times differ
    events = spark.read.parquet(f"{DATA}/events.parquet").dropDuplicates(["ts"])
    ids = F.col("event_id")
    moved = F.when(ids < 500, ids).otherwise(ids - 500 + FAR).cast(events.schema["event_id"].dataType)
    near, far = tmp_path / "near", tmp_path / "far"
    for place, frame in ((near, events), (far, events.withColumn("event_id", moved))):
        place.mkdir()
        os.symlink(f"{DATA}/customer.parquet", place / "customer.parquet")
        frame.write.parquet(str(place / "events.parquet"))
    said = [counted(registry.QUERIES["intermodal_join"](spark, str(p)), "u", "v", "type", "route", "length_meter", "time_min") for p in (near, far)]
    assert said[0] == said[1]


def nearest(out, start):
    """Least distances from one node, summed as float32."""
    best, heap = {}, [(np.float32(0), start)]
    while heap:
        d, at = heapq.heappop(heap)
        if at not in best:
            best[at] = d
            for to, w in out[at]:
                if to not in best:
                    heapq.heappush(heap, (np.float32(d + w), to))
    return best


@needs_data
def test_od_of_all_objects_against_brute_force(spark):
    out = defaultdict(list)
    for e in street_grid(spark, DATA).edges.select("u", "v", "time_min", "oneway").collect():
        out[e["u"]].append((e["v"], np.float32(e["time_min"])))
        if not e["oneway"]:
            out[e["v"]].append((e["u"], np.float32(e["time_min"])))
    places = [(r["object_id"], r["node_id"]) for r in objects(spark, DATA).collect()]
    far = {n: nearest(out, n) for _, n in places}
    want = {(a, b): far[s][t] for a, s in places for b, t in places if t in far[s]}
    plain = lambda name: {(r["origin_id"], r["dest_id"]): np.float32(r["dist"]) for r in registry.QUERIES[name](spark, DATA).collect()}
    assert {a for a, _ in want} == {a for a, _ in places}
    assert plain("od_matrix") == want
    assert plain("od_threshold") == {k: d for k, d in want.items() if d <= np.float32(1.5)}


def broadcast_keys(spark, run):
    """Keys of the hash joins that broadcast a side, of all plans that a run executes with Spark's own threshold."""
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty(30_000)
    before = max((store.executionsList().apply(k).executionId() for k in range(store.executionsList().size())), default=-1)
    run()
    bus.waitUntilEmpty(30_000)
    told = store.executionsList()
    plans = [told.apply(k).physicalPlanDescription() for k in range(told.size()) if told.apply(k).executionId() > before]
    assert any("SortMergeJoin" in p for p in plans)
    return {key for p in plans for key in re.findall(r"BroadcastHashJoin.*?\nLeft keys \[\d+\]: \[(.*?)\]\n", p)}


@needs_data
def test_project_points_broadcasts_no_table(spark):
    keys = broadcast_keys(spark, lambda: registry.QUERIES["project_points"](spark, DATA).count())
    # sizes of blocks, one row a block
    assert {re.sub(r"#\d+L?", "", k) for k in keys} <= {"_block"}


@needs_data
def test_intermodal_join_broadcasts_no_table(spark):
    keys = broadcast_keys(spark, lambda: registry.QUERIES["intermodal_join"](spark, DATA).count())
    # sizes of blocks, modes of transport, the one largest component
    assert {re.sub(r"#\d+L?", "", k) for k in keys} <= {"_block", "lower(trim(type, None))", "component_id"}
