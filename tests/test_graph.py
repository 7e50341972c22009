"""Operators on hand-built graphs with literal answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from streetloom.functions import geom, tags
from streetloom.functions.crs import estimate_utm, from_utm, to_utm
from streetloom.functions.registry import TRAIN, TransportRegistry, TransportSpec
from streetloom.model import CityGraph, GraphChanges, GraphMeta, empty
from streetloom.operators import components, edit, paths, projection, spatial
from streetloom.operators.arcs import arcs, boolean_arcs
from streetloom.operators.order import dense_positions
from streetloom.operators.validation import resolve_nodes, validate_changes

from . import micro
from .micro import as_set


def ids(spark, *values, name="source"):
    return spark.createDataFrame([(v,) for v in values], f"{name} long")


def test_arcs_follow_direction_and_rule(spark):
    assert as_set(arcs(micro.oneway(spark)), "src", "dst", "w") == {(0, 1, 1.0), (1, 2, 2.0), (2, 1, 2.0), (2, 3, 4.0)}
    for rule, w in (("min", 1.0), ("max", 5.0)):
        got = as_set(arcs(micro.parallel(spark), rule=rule), "src", "dst", "w")
        assert {(0, 1, w), (1, 0, w)} <= got
    assert as_set(boolean_arcs(micro.oneway(spark), weak=True), "src", "dst") == {(0, 1), (1, 0), (1, 2), (2, 1), (2, 3), (3, 2)}
    two_rows = micro.build(spark, {0: (0, 0), 1: (1, 0)}, [(0, 1, 1, 3), (1, 0, 1, 2)])
    assert as_set(arcs(two_rows), "src", "dst", "w") == {(0, 1, 2.0), (1, 0, 2.0)}
    assert as_set(arcs(micro.line(spark), node_ids=ids(spark, 0, 1, name="node_id")), "src", "dst") == {(0, 1), (1, 0)}
    with pytest.raises(KeyError):
        arcs(micro.line(spark), weight="none")
    with pytest.raises(ValueError):
        arcs(micro.line(spark), rule="sum")
    broken = micro.line(spark)
    with pytest.raises(ValueError, match="missing weights"):
        arcs(broken.with_(edges=broken.edges.withColumn("time_min", F.when(F.col("u") > 0, F.col("time_min")))))


@pytest.mark.parametrize("limit", [paths.KERNEL_ARCS, 0])
def test_single_source(spark, limit):
    assert dict(as_set(paths.single_source(micro.line(spark), 0, kernel_arcs=limit), "node", "dist")) == {0: 0, 1: 1, 2: 3, 3: 7}
    assert dict(as_set(paths.single_source(micro.line(spark), 0, cutoff=3, kernel_arcs=limit), "node", "dist")) == {0: 0, 1: 1, 2: 3}
    one = micro.oneway(spark)
    assert dict(as_set(paths.single_source(one, 3, kernel_arcs=limit), "node", "dist")) == {3: 0}
    assert dict(as_set(paths.single_source(one, 3, reverse=True, kernel_arcs=limit), "node", "dist")) == {0: 7, 1: 6, 2: 4, 3: 0}


@pytest.mark.parametrize("limit", [paths.KERNEL_ARCS, 0])
def test_many_sources(spark, limit):
    g = micro.line(spark)
    assert as_set(paths.nearest_source(g, ids(spark, 0, 3), kernel_arcs=limit), "node", "source", "dist") == {(0, 0, 0), (1, 0, 1), (2, 0, 3), (3, 3, 0)}
    assert as_set(paths.multi_source(g, ids(spark, 0, 3), kernel_arcs=limit), "node", "dist") == {(0, 0), (1, 1), (2, 3), (3, 0)}
    tie = micro.build(spark, {5: (0, 0), 1: (1, 0), 2: (2, 0)}, [(5, 1, 1, 1), (1, 2, 1, 1)])
    assert (1, 5) in as_set(paths.nearest_source(tie, ids(spark, 2, 5), kernel_arcs=limit), "node", "source")  # first in node order
    assert as_set(paths.per_source(g, ids(spark, 0, 3, 3), kernel_arcs=limit).filter("node = 2"), "source", "dist") == {(0, 3), (3, 4)}


@pytest.mark.parametrize("limit", [paths.KERNEL_ARCS, 0])
def test_nearest_source_goes_in_rounds_where_sums_round_to_one(spark, limit):
    # 2 is one arc from 8, and 5 is a little nearer by two arcs; the little is lost on the way from 8 to 9
    far = float(np.float32(1) + np.float32(2.0**-23))
    places = {n: (n, 0) for n in (2, 5, 7, 8, 9, *range(10, 31))}
    g = micro.build(spark, places, [(2, 8, 1, far), (5, 7, 1, 0.5), (7, 8, 1, 0.5), (8, 9, 1, 2), *((n, n + 1, 1, 0.01) for n in range(10, 30))])
    got = as_set(paths.nearest_source(g, ids(spark, 2, 5), kernel_arcs=limit), "node", "source", "dist")
    assert got == {(2, 2, 0), (5, 5, 0), (7, 5, 0.5), (8, 5, 1), (9, 2, 3)}


def test_path_errors(spark):
    g = micro.line(spark)
    with pytest.raises(ValueError, match="not nodes"):
        paths.single_source(g, 99)
    with pytest.raises(ValueError, match="cutoff"):
        paths.single_source(g, 0, cutoff=-1)
    with pytest.raises(ValueError, match="max_workers"):
        paths.per_source(g, ids(spark, 0), max_workers=0)


def test_od_matrix_searches_from_the_smaller_side(spark):
    g = micro.line(spark)
    side = lambda *rows: spark.createDataFrame(rows, "object_id string, node_id long")
    got = paths.od_matrix(g, side(("a", 0), ("b", 1), ("c", 3), ("d", 3)), side(("x", 2)))
    assert as_set(got, "origin_id", "dest_id", "dist") == {("a", "x", 3), ("b", "x", 2), ("c", "x", 4), ("d", "x", 4)}
    one = micro.oneway(spark)
    assert as_set(paths.od_matrix(one, side(("a", 0), ("b", 1), ("c", 3)), side(("x", 2))), "origin_id", "dist") == {("a", 3), ("b", 2)}
    wide = paths.dense(paths.od_matrix(g, side(("a", 0)), side(("x", 1), ("y", 3)), threshold=2))
    assert wide.collect()[0]["x"] == 1


def test_kernel_matches_plain_dijkstra():
    import heapq

    rng = np.random.default_rng(3)
    n = 60
    src, dst, w = rng.integers(0, n, 300), rng.integers(0, n, 300), rng.integers(0, 5, 300).astype(np.float32) / 3
    order = np.argsort(src, kind="stable")
    indptr = np.searchsorted(src[order], np.arange(n + 1))
    seen, cell = paths.relax(indptr, dst[order].astype(np.int32), w[order], np.zeros(3, int), np.array([0, 7, 9]), 1, np.float32(np.inf), np.array([0, 7, 9]))
    best, heap = {}, [(np.float32(0), o, o) for o in (0, 7, 9)]
    while heap:
        d, o, v = heapq.heappop(heap)
        if v in best:
            continue
        best[v] = (d, o)
        for k in range(indptr[v], indptr[v + 1]):
            heapq.heappush(heap, (np.float32(d + w[order][k]), o, int(dst[order][k])))
    got = {int(v): ((c >> np.uint64(32)).astype(np.uint32).view(np.float32), int(c & np.uint64(0xFFFFFFFF))) for v, c in zip(seen, cell, strict=True)}
    assert got == best



def test_searches_side_by_side_match_single_ones_and_stop_early():
    # streets of 6 x 2000; the first of each row is left and not reached, so what its search reaches differs from the others
    rng = np.random.default_rng(5)
    at = np.arange(12000)
    right, down = at[(at % 6 < 5) & (rng.random(12000) < 0.9)], at[(at < 11994) & (at % 6 > 0) & (rng.random(12000) < 0.9)]
    src, dst = np.concatenate([right, right[right % 6 > 0] + 1, down, down + 6]), np.concatenate([right + 1, right[right % 6 > 0], down + 6, down])
    csr = paths.Csr(src, dst, rng.choice(np.array([0.1, 0.15, 0.2, 0.3, 1.205], np.float32), len(src)), at)
    inf, wide = np.float32(np.inf), paths.Wide(12000, 8 * 12001)
    goals, used = paths.Goals(csr, np.arange(0, 900, 7), []), []
    for first, cutoff, aim in ((600, np.float32(2), None), (600, inf, None), (600, inf, goals), (608, inf, goals), (616, inf, goals)):
        seeds = np.arange(first, first + 8)
        assert paths.relax_wide(csr, seeds, cutoff, wide, aim)
        used.append(wide.used)
        seen, cell = paths.relax(csr.indptr, csr.heads, csr.weights, np.arange(8), seeds, 8, cutoff)
        want = np.full(8 * 12000, inf)
        want[seen] = paths.distances(cell)
        asked = at if aim is None else goals.wanted
        assert np.array_equal(wide.of(asked, np.arange(8)), want.reshape(8, 12000).T[asked])
    assert max(used[3:]) < 0.8 * used[2] == 0.8 * used[1]
    assert not paths.relax_wide(csr, np.arange(8), inf, paths.Wide(12000, 8 * 100))  # no room


def test_od_matrix_repeats_labels_and_splits_searches_without_room(spark, monkeypatch):
    places = {n: (10 * n, 0) for n in range(40)}
    g = micro.build(spark, places, [(n, n + 1, 10, 1) for n in range(39)])
    side = spark.createDataFrame([(f"{k}{n}", n) for n in range(40) for k in "ab"], "object_id string, node_id long")
    want = {(f"{a}{n}", f"{b}{m}", abs(n - m)) for n in range(40) for m in range(40) for a in "ab" for b in "ab"}
    monkeypatch.setattr(paths, "OUT_ROWS", 100)
    assert as_set(paths.od_matrix(g, side, side, max_workers=1), "origin_id", "dest_id", "dist") == want
    monkeypatch.setattr(paths, "WIDE_CELLS", 8 * 41)
    assert as_set(paths.od_matrix(g, side, side, max_workers=1), "origin_id", "dest_id", "dist") == want
    assert as_set(paths.od_matrix(g, side, side, threshold=2), "origin_id", "dest_id", "dist") == {x for x in want if x[2] <= 2}


def test_arcs_reach_the_driver_as_arrow(spark, monkeypatch):
    def rows(self):
        raise AssertionError("rows of Python objects in the driver")

    g = micro.line(spark)
    monkeypatch.setattr(type(g.nodes), "toPandas", rows)
    found = [paths.single_source(g, 0), paths.nearest_source(g, ids(spark, 0, 3)).select("node", "dist")]
    monkeypatch.undo()
    assert [as_set(x, "node", "dist") for x in found] == [{(0, 0), (1, 1), (2, 3), (3, 7)}, {(0, 0), (1, 1), (2, 3), (3, 0)}]


def test_searches_read_arcs_a_few_times():
    class Read(np.ndarray):
        total = 0

        def __getitem__(self, at):
            Read.total += np.size(at)
            return np.asarray(super().__getitem__(at))

    n = 2000  # steps of one are nearer and have more arcs than steps of two
    src = np.repeat(np.arange(n), 2)
    dst = src + np.tile([1, 2], n)
    inside = dst < n
    src, dst, w = src[inside], dst[inside], np.tile(np.float32([1, 3]), n)[inside]
    indptr = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))])
    seen, cell = paths.relax(indptr, dst.astype(np.int32), w.view(Read), np.zeros(1, int), np.zeros(1, int), 1, np.float32(np.inf))
    assert ((cell >> np.uint64(32)).astype(np.uint32).view(np.float32) == seen).all() and len(seen) == n
    assert Read.total < 10 * len(w)  # 500 times before, 2 now


def test_searches_share_their_cells():
    indptr, heads, w = np.array([0, 1, 2, 3, 3]), np.array([1, 2, 3], np.int32), np.float32([1, np.inf, 1])
    space = paths.Space(8)
    for cutoff, many in ((1, 2), (np.inf, 1), (0, 2), (np.inf, 2)):
        alone = paths.relax(indptr, heads, w, np.arange(many), np.arange(many), many, np.float32(cutoff))
        shared = paths.relax(indptr, heads, w, np.arange(many), np.arange(many), many, np.float32(cutoff), space=space)
        assert all((a == b).all() for a, b in zip(alone, shared, strict=True))
        assert (space.cell == paths.NEVER).all()


def test_kernel_returns_asked_nodes(spark):
    g = micro.line(spark)
    for limit in (paths.KERNEL_ARCS, 0):
        got = paths.per_source(g, ids(spark, 0, 3), kernel_arcs=limit, targets=ids(spark, 1, 2, 2, 99, name="node"))
        assert as_set(got, "source", "node", "dist") == {(0, 1, 1), (0, 2, 3), (3, 1, 6), (3, 2, 4)}


def test_sources_are_searched_in_many_tasks(spark):
    g = micro.line(spark)
    assert paths.per_source(g, ids(spark, 0, 1, 2, 3)).rdd.getNumPartitions() > 1
    assert paths.per_source(g, ids(spark, 0, 1, 2, 3), max_workers=1).rdd.getNumPartitions() == 1


def test_components(spark):
    apart = components.connected_components(micro.disconnected(spark))
    assert as_set(apart, "node_id", "component_id") == {(0, 0), (1, 0), (2, 0), (10, 10), (11, 10)}
    assert components.number_of(apart) == 2
    assert as_set(components.largest(micro.disconnected(spark)), "node_id") == {(0,), (1,), (2,)}
    strong = components.strong_components(micro.oneway(spark))
    assert as_set(strong, "node_id", "component_id") == {(0, 0), (1, 1), (2, 1), (3, 3)}
    joins = components.strong_components(micro.oneway(spark), kernel_arcs=0)
    assert as_set(joins, "node_id", "component_id") == {(0, 0), (1, 1), (2, 1), (3, 3)}
    assert components.number_of(components.weak_components(micro.oneway(spark))) == 1
    with pytest.raises(ValueError):
        components.connected_components(micro.oneway(spark))
    with pytest.raises(ValueError):
        components.largest(micro.line(spark), "other")
    with pytest.warns(UserWarning):
        components.strong_components(micro.line(spark))
    kept = components.keep_largest(micro.oneway(spark))
    assert as_set(kept.edges, "u", "v") == {(1, 2)}
    assert components.largest(empty(spark)).count() == 0


def test_strong_kernel_against_reachability():
    rng = np.random.default_rng(5)
    for _ in range(20):
        n = 12
        src, dst = rng.integers(0, n, 20), rng.integers(0, n, 20)
        reach = np.eye(n, dtype=bool)
        for a, b in zip(src, dst, strict=True):
            reach[a, b] = True
        for k in range(n):
            reach |= reach[:, k : k + 1] & reach[k : k + 1]
        want = [int(np.flatnonzero(reach[v] & reach[:, v]).min()) for v in range(n)]
        assert components.strong_kernel(src, dst, n).tolist() == want


def test_edits(spark):
    g = micro.parallel(spark)
    simple = edit.simplify_multiedges(g)
    assert as_set(simple.edges, "u", "v", "time_min") == {(0, 1, 1.0), (1, 2, 2.0)}
    assert "k" not in simple.edges.columns and simple.meta.epsg == 3857 and not simple.meta.is_multigraph
    assert as_set(edit.simplify_multiedges(g, rule="max").edges, "time_min") == {(5.0,), (2.0,)}
    named = edit.relabel(micro.disconnected(spark))
    assert as_set(named.nodes, "node_id") == {(k,) for k in range(5)} and (3, 4) in as_set(named.edges, "u", "v")
    cut = edit.clip(micro.line(spark), [[(-5.0, -5.0), (15.0, -5.0), (15.0, 5.0), (-5.0, 5.0)]])
    assert as_set(cut.nodes, "node_id") == {(0,), (1,)} and as_set(cut.edges, "u", "v") == {(0, 1)}
    with pytest.raises(TypeError):
        edit.clip(micro.line(spark), "box")
    with pytest.raises(ValueError, match="not nodes"):
        edit.subgraph(micro.line(spark), ids(spark, 0, 42, name="node_id"))
    keyed = spark.createDataFrame([(0, 0, 1), (1, 0, 1), (2, 1, 2), (3, 0, 1)], "edge_id long, u long, v long")
    assert [r["k"] for r in edit.edge_keys(keyed).orderBy("edge_id").collect()] == [0, 1, 0, 2]
    made = edit.to_directed(micro.line(spark), default=True)
    assert made.meta.is_directed and as_set(made.edges, "oneway") == {(True,)}
    back = edit.to_undirected(made)
    assert not back.meta.is_directed and "oneway" in back.edges.columns


def test_join_graphs(spark):
    left = micro.build(spark, {0: (0, 0), 1: (10, 0)}, [(0, 1, 10, 1)])
    right = micro.build(spark, {1: (10, 0), 2: (20, 0)}, [(1, 2, 10, 1)])
    tagged = lambda g, t: g.with_(nodes=g.nodes.withColumn("tag", F.lit(t)))
    for side, want in (("left", "L"), ("right", "R")):
        out = edit.join_graphs(tagged(left, "L"), tagged(right, "R"), node_conflict=side, graph_type="both")
        assert out.meta.graph_type == "both" and dict(as_set(out.nodes, "node_id", "tag"))[1] == want
    with pytest.raises(ValueError, match="both graphs"):
        edit.join_graphs(left, left)
    with pytest.raises(ValueError, match="differ"):
        edit.join_graphs(left, micro.oneway(spark))


def test_changes(spark):
    g = micro.line(spark)
    none = empty(spark, g.meta)
    cut = lambda *pairs: spark.createDataFrame(pairs, "u long, v long")
    out = edit.apply_changes(g, GraphChanges(none.nodes, none.edges, cut((1, 2)), g.meta))
    assert as_set(out.edges, "u", "v") == {(0, 1), (2, 3)}
    with pytest.raises(ValueError, match="no such edges"):
        edit.apply_changes(g, GraphChanges(none.nodes, none.edges, cut((7, 8)), g.meta))
    with pytest.raises(ValueError, match="exist"):
        edit.apply_changes(g, GraphChanges(g.nodes, none.edges, cut((1, 2)), g.meta))
    with pytest.raises(ValueError, match="another kind"):
        edit.apply_changes(g, GraphChanges(none.nodes, none.edges, cut((1, 2)), GraphMeta(is_directed=True)))
    with pytest.raises(ValueError, match="repeated"):
        validate_changes(GraphChanges(none.nodes, none.edges, cut((1, 2), (1, 2)), g.meta))


def test_validation(spark):
    g = micro.line(spark).validate()
    empty(spark, GraphMeta(is_multigraph=True, direction_col="oneway")).validate()
    bad = {
        "repeated_ids": g.with_(nodes=g.nodes.union(g.nodes)),
        "repeated_keys": g.with_(edges=g.edges.union(g.edges)),
        "null_lines": g.with_(edges=g.edges.withColumn("geometry", F.lit(None).cast("array<struct<x:double,y:double>>"))),
        "dangling": g.with_(nodes=g.nodes.filter("node_id < 3")),
        "null_points": g.with_(nodes=g.nodes.withColumn("x", F.lit(None).cast("double"))),
    }
    for name, graph in bad.items():
        with pytest.raises(ValueError, match=name):
            graph.validate()
    with pytest.raises(ValueError, match="missing columns"):
        g.with_(edges=g.edges.drop("time_min")).validate()
    with pytest.raises(ValueError, match="either"):
        resolve_nodes(g)
    with pytest.raises(ValueError, match="not nodes"):
        resolve_nodes(g, nodes=ids(spark, 0, 50, name="node_id"))
    own = spark.createDataFrame([("a", 2)], "object_id string, own long")
    assert as_set(resolve_nodes(g, objects=own, node_column="own"), "object_id", "node_id") == {("a", 2)}


def test_nearest_nodes_and_edges(spark):
    g = micro.line(spark)
    at = lambda *rows: spark.createDataFrame(rows, "object_id string, x double, y double")
    got = spatial.nearest_nodes(g, at(("far", 31.0, 0.0), ("near", -1.0, 0.0), ("mid", 21.0, 0.0), ("tie", 5.0, 0.0), ("away", 900.0, 700.0)))
    assert dict(as_set(got, "object_id", "node_id")) == {"far": 3, "near": 0, "mid": 2, "tie": 0, "away": 3}
    hit = spatial.nearest_edges(g, at(("p", 15.0, 5.0), ("n", 10.0, 3.0), ("away", 15.0, 1000.0)), 10.0)
    assert as_set(hit, "object_id", "edge_id", "along") == {("p", 1, 5.0), ("n", 0, 10.0), ("n", 1, 0.0)}
    assert spatial.nearest_edges(g, at(("away", 15.0, 1000.0))).collect()[0]["distance"] == 1000.0


def test_nearest_nodes_against_brute_force(spark):
    rng = np.random.default_rng(1)
    spots = {k: (float(x), float(y)) for k, (x, y) in enumerate(rng.normal(0, 50, (80, 2)) ** 3 / 2500)}
    g = micro.build(spark, spots, [(0, 1, 1, 1)])
    wanted = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.normal(0, 80, (60, 2)))]
    got = dict(as_set(spatial.nearest_nodes(g, spark.createDataFrame(wanted, "object_id long, x double, y double")), "object_id", "node_id"))
    for k, x, y in wanted:
        assert got[k] == min(spots, key=lambda i: (math.dist(spots[i], (x, y)), i))


def test_projection(spark):
    g = edit.to_directed(micro.line(spark))
    at = lambda *rows: spark.createDataFrame(rows, "object_id long, x double, y double")
    changes, mapping = projection.project_objects(g, at((1000, 15.0, 5.0)), 5.0)
    out = edit.apply_changes(g, changes).validate()
    assert as_set(changes.delete, "u", "v") == {(1, 2)}
    assert as_set(out.edges, "u", "v", "length_meter", "time_min") == {(0, 1, 10.0, 1.0), (2, 3, 10.0, 4.0), (1, 4, 5.0, 1.0), (4, 2, 5.0, 1.0), (5, 4, 5.0, 1.0)}
    assert dict(as_set(mapping, "object_id", "node_id")) == {1000: 5}
    # at an end: no split, but a connector
    changes, mapping = projection.project_objects(g, at((7, 0.0, 3.0)), 5.0)
    out = edit.apply_changes(g, changes).validate()
    assert out.edges.count() == 4 and as_set(out.edges.filter("u = 4"), "v", "length_meter") == {(0, 3.0)}
    # without links an object is its projection node; out of range it is nothing
    changes, mapping = projection.project_objects(g, at((1, 15.0, 5.0), (2, 15.0, 1000.0)), 5.0, 10.0, False)
    assert as_set(mapping, "object_id", "node_id") == {(1, 4)}
    # two objects of one 10 m cell share a node
    changes, mapping = projection.project_objects(g, at((1, 14.0, 5.0), (2, 14.5, -2.0)), 5.0)
    assert changes.nodes.count() == 3
    for wrong in ({"speed_m_per_min": 0.0}, {"speed_m_per_min": 1.0, "max_dist": -1.0}):
        with pytest.raises(ValueError):
            projection.project_objects(g, at((1, 15.0, 5.0)), **wrong)
    with pytest.raises(ValueError, match="repeated"):
        projection.project_objects(g, at((1, 15.0, 5.0), (1, 15.0, 5.0)), 1.0)


def test_geometry_columns(spark):
    line = spark.createDataFrame([([(0.0, 0.0), (3.0, 4.0), (3.0, 10.0)],)], "g array<struct<x:double,y:double>>")
    row = line.select(geom.length(F.col("g")).alias("n"), geom.cumulative(F.col("g")).alias("c"), geom.interpolate(F.col("g"), F.lit(8.0)).alias("p"), geom.project(F.col("g"), F.lit(5.0), F.lit(6.0)).alias("q")).first()
    assert row["n"] == 11 and row["c"] == [0, 5, 11] and tuple(row["p"]) == (3.0, 7.0) and tuple(row["q"]) == (2.0, 7.0)
    assert geom.convex_hull([(0, 0), (1, 0), (1, 1), (0, 1), (0.5, 0.5)]) == [(0, 0), (1, 0), (1, 1), (0, 1)]
    ring = [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0)]]
    spots = spark.createDataFrame([(1.0, 1.0), (5.0, 5.0), (10.0, 3.0), (11.0, 3.0), (4.0, 5.0)], "x double, y double")
    assert [r[0] for r in spots.select(geom.in_polygon(F.col("x"), F.col("y"), ring)).collect()] == [True, False, True, False, True]


def test_utm(spark):
    assert estimate_utm(30.3, 59.9, 30.32, 59.92) == 32636 and estimate_utm(179.9, -10, 180, -9) == 32760
    one = spark.createDataFrame([(30.3158, 59.9391), (-73.9857, 40.7484)], "lon double, lat double")
    for epsg in (32636, 32618):
        x, y = to_utm(F.col("lon"), F.col("lat"), epsg)
        lon, lat = from_utm(F.col("x"), F.col("y"), epsg)
        k = 0 if epsg == 32636 else 1
        back = one.select("lon", "lat", x.alias("x"), y.alias("y")).select("lon", "lat", "x", "y", lon.alias("l2"), lat.alias("t2")).collect()[k]
        assert abs(back["lon"] - back["l2"]) < 1e-9 and abs(back["lat"] - back["t2"]) < 1e-9
    # on the central meridian easting is 500 km and northing the scaled meridian arc
    mid = spark.createDataFrame([(33.0, 0.0)], "lon double, lat double")
    x, y = to_utm(F.col("lon"), F.col("lat"), 32636)
    assert tuple(round(v, 6) for v in mid.select(x, y).first()) == (500000.0, 0.0)
    with pytest.raises(ValueError):
        to_utm(F.col("lon"), F.col("lat"), 3857)


@pytest.mark.parametrize(("said", "want"), [("50", 50 / 0.06), ("50 km/h", 50 / 0.06), ("50kmh", 50 / 0.06), ("60kph", 1000.0), ("30 mph", 30 * 1.60934 / 0.06), (None, None), ("", None), ("   ", None), ("walk", None), ("50 knots", None)])
def test_maxspeed(spark, said, want):
    got = spark.createDataFrame([(said,)], "s string").select(tags.maxspeed_m_per_min(F.col("s"))).first()[0]
    assert got is None if want is None else abs(got - want) < 1e-9


def test_roles_and_classes(spark):
    cases = [({"public_transport": "station"}, "station"), ({"railway": "station"}, "station"), ({"station": "subway"}, "station"), ({"railway": "platform"}, "platform"), ({"public_transport": "stop_position"}, "stop"), ({"railway": "halt"}, "stop"), ({"railway": "subway_entrance"}, "entrance"), ({"entrance": "yes"}, "entrance"), ({"entrance": "entry"}, "entry_only"), ({"entrance": "exit"}, "exit_only"), ({"entrance": "yes", "entry": "yes"}, "entry_only"), ({"entrance": "yes", "exit": "yes"}, "exit_only"), ({"amenity": "cafe"}, "")]
    df = spark.createDataFrame(cases, "t map<string,string>, want string")
    assert df.filter(tags.infer_role(F.col("t")) != F.col("want")).count() == 0
    lists = spark.createDataFrame([(["motorway"],), (["motorway", "residential"],), (["nonsense"],), (None,)], "h array<string>")
    category, speed = tags.highway_list_props(F.col("h"))
    got = [(r[0], round(r[1] * 0.06)) for r in lists.select(category, speed).collect()]
    assert got == [("federal", 110), ("local", 40), ("local", 40), ("local", 40)]
    with pytest.raises(ValueError):
        tags.tag_filter("highway=primary", F.col("t"))


def test_registry(spark):
    minutes = lambda spec, length, limit=None: spark.range(1).select(spec.travel_time(F.lit(float(length)), None if limit is None else F.lit(float(limit)))).first()[0]
    bus = TransportRegistry().get(" BUS ")
    v = 90 * 1000 / 60 * 0.7
    assert minutes(bus, 0) == 0 and abs(minutes(bus, 3000) - (1400 / v + 1300 / v + 1650 / v)) < 1e-9
    assert abs(minutes(bus, 500) - 1000 / (v * 500 / 1350)) < 1e-9
    slow = max(200 * 0.7, 60)
    assert abs(minutes(bus, 3000, 200) - (2700 / slow + 1650 / slow)) < 1e-9
    assert abs(minutes(bus, 3000, float("nan")) - minutes(bus, 3000)) < 1e-12
    reg = TransportRegistry()
    with pytest.raises(KeyError):
        reg.get("rocket")
    with pytest.raises(KeyError):
        reg.add(TransportSpec("bus", 1, 1, 1, 1))
    reg.add(TRAIN)
    assert reg.update("train", coef=0.5).coef == 0.5 and reg.ensure("ferry").vmax_kmh == 25
    reg.remove("train")
    assert reg.list_types() == ["bus", "ferry", "subway", "tram", "trolleybus"] and reg.try_get("train") is None
    for bad in ({"vmax_kmh": 0}, {"coef": 0}, {"accel_m": -1}):
        with pytest.raises(ValueError):
            reg.update("bus", **bad)


def test_dense_positions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    assert dense_positions(df, [F.col("v")]).filter("pos <> v").count() == 0
    assert isinstance(empty(spark), CityGraph)
