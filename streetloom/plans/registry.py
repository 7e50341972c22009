"""The registered graph queries and their DuckDB twins."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells, geom, tags
from ..functions.crs import from_utm, to_utm
from ..functions.registry import TransportRegistry, travel_time
from ..model import CityGraph, GraphChanges, GraphMeta
from ..operators import components, edit, paths, projection, spatial
from ..operators.arcs import arcs
from ..operators.merge import combine_first
from ..operators.order import shared_folder
from ..operators.validation import report
from ..sources.archive import read_graph, write_graph
from ..sources.elements import elements_of
from ..streaming.edge_weights import windowed_weights
from . import samples, streets, transit
from .derived import WIDTH, broken_grid, objects, street_grid, supply_multigraph, table, transit_rides

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def _grid_sql(right: str, down: str) -> str:
    return f"""
n as (select c_custkey::bigint as id, (c_custkey % 40)::bigint as cx, (c_custkey // 40)::bigint as cy,
  case c_mktsegment when 'AUTOMOBILE' then 1000.0::double when 'BUILDING' then 667.0::double when 'FURNITURE' then 500.0::double when 'MACHINERY' then 333.0::double else 83.0::double end as speed from customer),
e as (select 2*id as edge_id, id as u, id+1 as v, id % 5 = 0 as oneway, round_even(100.0::double/speed, 3) as t from n where cx <> 39 and {right} and id+1 in (select id from n)
  union all select 2*id+1, id, id+40, false, round_even(100.0::double/speed, 3) from n where {down} and id+40 in (select id from n)),
a as (select s, d, min(t::float) as w from (select u as s, v as d, t from e union all select v, u, t from e where not oneway) group by s, d)"""


C1 = _grid_sql("(id*7+3) % 11 <> 0", "(id*5+1) % 7 <> 0")
C6 = _grid_sql("(id*7+3) % 11 > 5", "(id*5+1) % 7 > 3")
C2 = """
m as (select row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as edge_id, l_suppkey::bigint as u,
  ((l_suppkey + 1 + l_partkey % 7) % (select count(*) from supplier))::bigint as v, l_quantity as t from lineitem)"""
C4 = """
o as (select s_suppkey::bigint as object_id, 100.0::double*(s_suppkey*37%40)+13 as x, 100.0::double*(s_suppkey*11%37)+29 as y, (s_suppkey*7) % (select count(*) from customer) as node_id from supplier)"""


def _search(seeds: str, limit: float | None = None, key: str = "node", turned: bool = False) -> str:
    s, d = ("d", "s") if turned else ("s", "d")
    bound = f" and r.dist + a.w <= {limit}::float" if limit is not None else ""
    return f"""
r(node, dist) using key (node) as ({seeds} union
  select a.{d}, min(r.dist + a.w) from r join a on a.{s} = r.node left join recurring.r q on q.node = a.{d}
  where (q.dist is null or r.dist + a.w < q.dist){bound} group by a.{d})"""


# --- arcs and validation -----------------------------------------------------------------------

for _rule in ("min", "max"):
    query(f"arcs_{_rule}", f"with {C2} select u as src, v as dst, {_rule}(t::float) as w from m group by u, v")(lambda spark, sf_dir, rule=_rule: arcs(supply_multigraph(spark, sf_dir), rule=rule, check=False))


@query("arcs_directions", f"with {C1} select s as src, d as dst, w from a")
def arcs_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arcs(street_grid(spark, sf_dir), check=False)


@query("validate_report", f"with {C1} select (select count(*) from n)::bigint as nodes, 0::bigint as repeated_ids, 0::bigint as null_ids, 0::bigint as null_points, (select count(*) from e)::bigint as edges, 0::bigint as repeated_keys, 0::bigint as null_ends, 0::bigint as null_lines, 0::bigint as null_directions, 0::bigint as dangling")
def validate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(street_grid(spark, sf_dir))


# --- shortest paths ----------------------------------------------------------------------------

_ONE = "select 0::bigint, 0::float"


@query("sssp", f"with recursive {C1}, {_search(_ONE)} select node, dist from r")
def sssp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.single_source(street_grid(spark, sf_dir), 0)


@query("sssp_cutoff", f"with recursive {C1}, {_search(_ONE, 2.0)} select node, dist from r")
def sssp_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.single_source(street_grid(spark, sf_dir), 0, cutoff=2.0)


@query("sssp_reverse", f"with recursive {C1}, {_search('select 77::bigint, 0::float', turned=True)} select node, dist from r")
def sssp_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.single_source(street_grid(spark, sf_dir), 77, reverse=True)


@query("sssp_joins", f"with recursive {C1}, {_search(_ONE, 0.5)} select node, dist from r")
def sssp_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.single_source(street_grid(spark, sf_dir), 0, cutoff=0.5, kernel_arcs=0)


def _every(spark: SparkSession, sf_dir: str, step: int) -> DataFrame:
    return table(spark, sf_dir, "customer").filter(F.col("c_custkey") % step == 0).select(F.col("c_custkey").cast("long").alias("source"))


@query("multi_source", f"with recursive {C1}, {_search('select id, 0::float from n where id % 97 = 0')} select node, dist from r")
def multi_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.multi_source(street_grid(spark, sf_dir), _every(spark, sf_dir, 97))


_NEAREST = f"""with recursive {C1}, r(node, dist, owner) using key (node) as (
  select id, 0::float, id from n where id % 97 = 0 union
  select node, dist, owner from (
    select a.d as node, r.dist + a.w as dist, r.owner as owner, q.dist as qd, q.owner as qo,
      row_number() over (partition by a.d order by r.dist + a.w, r.owner) as k
    from r join a on a.s = r.node left join recurring.r q on q.node = a.d)
  where k = 1 and (qd is null or dist < qd or dist = qd and owner < qo))
select node, owner as source, dist from r"""


@query("nearest_source", _NEAREST)
def nearest_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.nearest_source(street_grid(spark, sf_dir), _every(spark, sf_dir, 97))


@query("nearest_source_joins", _NEAREST)
def nearest_source_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by joins of the frontier, as for graphs too large to broadcast."""
    return paths.nearest_source(street_grid(spark, sf_dir), _every(spark, sf_dir, 97), kernel_arcs=0)


def _many(seeds: str, limit: str) -> str:
    return f"""
r(source, node, dist) using key (source, node) as ({seeds} union
  select r.source, a.d, min(r.dist + a.w) from r join a on a.s = r.node left join recurring.r q on q.source = r.source and q.node = a.d
  where (q.dist is null or r.dist + a.w < q.dist){limit} group by r.source, a.d)"""


@query("parallel_paths", f"with recursive {C1}, {_many('select id, id, 0::float from n where id % 311 = 0', '')} select source, node, dist from r")
def parallel_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches from the sources of the definition: customers whose number is a multiple of 311."""
    return paths.per_source(street_grid(spark, sf_dir), _every(spark, sf_dir, 311))


def _od(limit: str) -> str:
    return f"with recursive {C1}, {C4}, {_many('select distinct node_id, node_id, 0::float from o', limit)} select p.object_id as origin_id, q.object_id as dest_id, r.dist from r join o p on p.node_id = r.source join o q on q.node_id = r.node"


@query("od_matrix", _od(""))
def od_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of objects that a path joins."""
    places = objects(spark, sf_dir).select("object_id", "node_id")
    return paths.od_matrix(street_grid(spark, sf_dir), places, places)


@query("od_threshold", _od(" and r.dist + a.w <= 1.5::float"))
def od_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of objects within 1.5 minutes."""
    places = objects(spark, sf_dir).select("object_id", "node_id")
    return paths.od_matrix(street_grid(spark, sf_dir), places, places, threshold=1.5)


# --- components --------------------------------------------------------------------------------

_WEAK = f"""with recursive {C6}, b as (select u as s, v as d from e union select v, u from e),
r(node, label) using key (node) as (select id, id from n union
  select b.d, min(r.label) from r join b on b.s = r.node join recurring.r q on q.node = b.d where r.label < q.label group by b.d)"""


@query("weak_components", f"{_WEAK} select node as node_id, label as component_id from r")
def weak_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.weak_components(broken_grid(spark, sf_dir))


@query("connected_components", f"{_WEAK} select node as node_id, label as component_id from r")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.connected_components(edit.to_undirected(broken_grid(spark, sf_dir)))


@query("component_sizes", f"{_WEAK} select label as component_id, count(*) as size, min(node::varchar) as least_text, row_number() over (order by count(*) desc, min(node::varchar))::int as place from r group by label")
def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.ranked_sizes(components.weak_components(broken_grid(spark, sf_dir)))


_LARGEST = f"{_WEAK}, top as (select label from r group by label order by count(*) desc, min(node::varchar) limit 1), kept as (select node from r where label in (select label from top))"


@query("largest_component", f"{_LARGEST} select node as node_id from kept")
def largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.largest(broken_grid(spark, sf_dir), "weak")


@query("keep_largest", f"{_LARGEST} select edge_id, u, v, t as time_min from e where u in (select node from kept) and v in (select node from kept)")
def keep_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.keep_largest(broken_grid(spark, sf_dir), "weak").edges.select("edge_id", "u", "v", "time_min")


_REACH = f"""with recursive {C6}, f(s, d) as (select id, id from n union select f.s, a.d from f join a on a.s = f.d)
select p.s as node_id, min(p.d) as component_id from f p join f q on q.s = p.d and q.d = p.s group by p.s"""


@query("strong_components", _REACH)
def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.strong_components(broken_grid(spark, sf_dir))


# --- edits -------------------------------------------------------------------------------------

for _rule, _way in (("min", "asc"), ("max", "desc")):
    query(f"simplify_{_rule}", f"with {C2} select edge_id, u, v, t as time_min from (select *, row_number() over (partition by u, v order by t {_way}, edge_id) as k from m) where k = 1")(lambda spark, sf_dir, rule=_rule: edit.simplify_multiedges(supply_multigraph(spark, sf_dir), rule=rule).edges.select("edge_id", "u", "v", "time_min"))


@query("simplify_undirected", f"with {C2} select edge_id, u, v, t as time_min from (select *, row_number() over (partition by least(u, v), greatest(u, v) order by t, edge_id) as k from m) where k = 1")
def simplify_undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = supply_multigraph(spark, sf_dir)
    return edit.simplify_multiedges(edit.to_undirected(graph)).edges.select("edge_id", "u", "v", "time_min")


@query("edge_keys", f"with {C2} select edge_id, u, v, (row_number() over (partition by u, v order by edge_id) - 1)::int as k from m")
def edge_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit.edge_keys(supply_multigraph(spark, sf_dir).edges.drop("k")).select("edge_id", "u", "v", "k")


@query("subgraph", f"with {C1} select edge_id, u, v from e where u % 3 <> 0 and v % 3 <> 0")
def subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = street_grid(spark, sf_dir)
    return edit.subgraph(graph, graph.nodes.filter("node_id % 3 <> 0").select("node_id")).edges.select("edge_id", "u", "v")


@query("relabel", f"with {C1}, l as (select id, row_number() over (order by id) - 1 as k from n where id % 3 <> 0) select e.edge_id, p.k as u, q.k as v from e join l p on p.id = e.u join l q on q.id = e.v")
def relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = street_grid(spark, sf_dir)
    return edit.relabel(graph.with_(nodes=graph.nodes.filter("node_id % 3 <> 0"))).edges.select("edge_id", "u", "v")


#: A slanted quadrilateral over the grid.
AREA = [[(150.0, 50.0), (2050.0, 350.0), (3350.0, 2450.0), (450.0, 1850.0)]]
_SIDES = [(a, b) for a, b in zip(AREA[0], [*AREA[0][1:], AREA[0][0]], strict=True)]
_WITHIN = " and ".join(f"({b[0] - a[0]}::double) * (100.0::double*cy - {a[1]}) - ({b[1] - a[1]}::double) * (100.0::double*cx - {a[0]}) >= 0" for a, b in _SIDES)


@query("clip_polygon", f"with {C1}, c as (select id from n where {_WITHIN}) select edge_id, u, v from e where u in (select id from c) and v in (select id from c)")
def clip_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit.clip(street_grid(spark, sf_dir), AREA).edges.select("edge_id", "u", "v")


for _side in ("left", "right"):

    def _joined(spark: SparkSession, sf_dir: str, side: str = _side) -> DataFrame:
        graph = street_grid(spark, sf_dir)
        part = lambda keep, rows, name: graph.with_(nodes=graph.nodes.filter(keep).withColumn("tag", F.lit(name)), edges=graph.edges.filter(rows))
        out = edit.join_graphs(part("node_id % 4 < 3", "edge_id % 2 = 0", "L"), part("node_id % 4 > 0", "edge_id % 2 = 1", "R"), node_conflict=side)
        return out.nodes.select("node_id", "tag")

    query(f"join_graphs_{_side}", f"with {C1} select id as node_id, case when id % 4 = 0 then 'L' when id % 4 = 3 then 'R' else '{'L' if _side == 'left' else 'R'}' end as tag from n")(_joined)


@query("apply_changes", f"with {C1} select edge_id, u, v, t as time_min from e where edge_id % 10 <> 3 union all select 2000000000 + id, 1000000000 + id, id, 1.0::double from n where id % 50 = 0")
def apply_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = street_grid(spark, sf_dir)
    some = graph.nodes.filter("node_id % 50 = 0")
    nodes = some.select((F.col("node_id") + 1_000_000_000).alias("node_id"), (F.col("pos") + 1_000_000_000).alias("pos"), "x", (F.col("y") + 10.0).alias("y"))
    line = F.array(geom.point(F.col("x"), F.col("y") + 10.0), geom.point(F.col("x"), F.col("y")))
    edges = some.select((F.col("node_id") + 2_000_000_000).alias("edge_id"), (F.col("node_id") + 1_000_000_000).alias("u"), F.col("node_id").alias("v"), line.alias("geometry"), F.lit(10.0).alias("length_meter"), F.lit(1.0).alias("time_min"), F.lit(False).alias("oneway"))
    changes = GraphChanges(nodes, edges, graph.edges.filter("edge_id % 10 = 3").select("u", "v"), graph.meta)
    return edit.apply_changes(graph, changes).edges.select("edge_id", "u", "v", "time_min")


@query("to_directed", f"with {C1} select edge_id, coalesce(case when edge_id % 3 = 0 then null else oneway end, true) as oneway from e")
def to_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = street_grid(spark, sf_dir)
    gaps = graph.edges.withColumn("oneway", F.when(F.col("edge_id") % 3 != 0, F.col("oneway")))
    return edit.to_directed(CityGraph(graph.nodes, gaps, GraphMeta(graph.meta.epsg)), default=True).edges.select("edge_id", "oneway")


@query("to_undirected", f"with {C1} select s as src, d as dst, min(t::float) as w from (select u as s, v as d, t from e union all select v, u, t from e) group by s, d")
def to_undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arcs(edit.to_undirected(street_grid(spark, sf_dir)), check=False)


# --- space -------------------------------------------------------------------------------------


@query("nearest_nodes", f"with {C1}, {C4} select object_id, id as node_id, round(sqrt(d2), 6) as distance from (select o.object_id, n.id, (o.x-100.0::double*n.cx)*(o.x-100.0::double*n.cx)+(o.y-100.0::double*n.cy)*(o.y-100.0::double*n.cy) as d2, row_number() over (partition by o.object_id order by (o.x-100.0::double*n.cx)*(o.x-100.0::double*n.cx)+(o.y-100.0::double*n.cy)*(o.y-100.0::double*n.cy), n.id) as k from o, n) where k = 1")
def nearest_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spatial.nearest_nodes(street_grid(spark, sf_dir), objects(spark, sf_dir))
    return found.select("object_id", "node_id", F.round("distance", 6).alias("distance"))


_NEAR = f"""with {C1}, {C4}, g as (select edge_id, 100.0::double*(u%40) as ax, 100.0::double*(u//40) as ay, 100.0::double*(v%40) as bx, 100.0::double*(v//40) as by_ from e),
h as (select object_id, edge_id, x, y, ax, ay, bx, by_, least(1.0::double, greatest(0.0::double, ((x-ax)*(bx-ax)+(y-ay)*(by_-ay))/10000.0::double)) as t from o, g where abs(x-(ax+bx)/2) < 2000 and abs(y-(ay+by_)/2) < 2000),
j as (select object_id, edge_id, t*100.0::double as along, sqrt((x-ax-(bx-ax)*t)*(x-ax-(bx-ax)*t)+(y-ay-(by_-ay)*t)*(y-ay-(by_-ay)*t)) as distance from h),
w as (select *, rank() over (partition by object_id order by round(distance, 6)) as k from j)"""


@query("nearest_edges", f"{_NEAR} select object_id, edge_id, round(distance, 6) as distance, round(along, 6) as along from w where k = 1 and distance <= 150")
def nearest_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spatial.nearest_edges(street_grid(spark, sf_dir), objects(spark, sf_dir), 150.0)
    return found.select("object_id", "edge_id", F.round("distance", 6).alias("distance"), F.round("along", 6).alias("along"))


@query("project_points")
def project_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects within 25 m of a street, linked to it; the edges of the changed graph."""
    graph = street_grid(spark, sf_dir)
    changes, _ = projection.project_objects(graph, objects(spark, sf_dir).select("object_id", "x", "y"), 83.0, 25.0)
    return edit.apply_changes(graph, changes).edges.select("edge_id", "u", "v", "length_meter", "time_min", "oneway")


@query("utm_roundtrip", f"with {C1} select id as node_id, round(100.0::double*cx + 300000, 3) as x, round(100.0::double*cy + 6600000, 3) as y from n")
def utm_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = street_grid(spark, sf_dir).nodes.select("node_id", (F.col("x") + 300000).alias("x"), (F.col("y") + 6600000).alias("y"))
    lon, lat = from_utm(F.col("x"), F.col("y"), 32636)
    x, y = to_utm(F.col("lon"), F.col("lat"), 32636)
    return nodes.select("node_id", lon.alias("lon"), lat.alias("lat")).select("node_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


# --- lines and nodes of rides ------------------------------------------------------------------

_RIDES = """w as (select event_id, user_id % 20 as route, event_id % 500 as v,
  case event_type when 'view' then 'bus' when 'click' then 'trolleybus' when 'signup' then 'tram' when 'purchase' then 'subway' else 'bus' end as mode,
  lag(event_id % 500) over (partition by user_id % 20 order by ts, event_id) as u from events),
x as (select event_id, route, mode, u, v, 400.0::double*(u%25) as x1, 400.0::double*(u//25) as y1, 400.0::double*(v%25) as x2, 400.0::double*(v//25) as y2 from w where u is not null and u <> v)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rides with a bend half-way: (event_id, route, mode, u, v, geometry)."""
    bent = F.array(geom.point(F.col("x1"), F.col("y1")), geom.point(F.col("x2"), F.col("y1")), geom.point(F.col("x2"), F.col("y2")))
    return transit_rides(spark, sf_dir).withColumn("geometry", bent)


@query("edge_lengths", f"with {_RIDES} select event_id, abs(x1-x2) + abs(y1-y2) as length, round(x1 + least(abs(x1-x2), (abs(x1-x2)+abs(y1-y2))/2) * sign(x2-x1), 6) as mid_x from x")
def edge_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("geometry")
    return _lines(spark, sf_dir).select("event_id", geom.length(line).alias("length"), F.round(geom.midpoint(line)["x"], 6).alias("mid_x"))


@query("segments", f"with {_RIDES} select event_id, 0::int as nth, x1 as ax, y1 as ay, x2 as bx, y1 as by_ from x union all select event_id, 1::int, x2, y1, x2, y2 from x")
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    many = _lines(spark, sf_dir).select("event_id", F.posexplode(geom.segments(F.col("geometry"))).alias("nth", "s"))
    return many.select("event_id", "nth", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by_"))


@query("factorize_nodes", f"with {_RIDES}, p as (select x1 as x, y1 as y, event_id as k from x union all select x2, y2, event_id + (select max(event_id) + 1 from x) from x), g as (select x, y, min(k) as k from p group by x, y) select row_number() over (order by k) - 1 as node_id, x, y from g")
def factorize_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = streets.factorize(_lines(spark, sf_dir).withColumnRenamed("event_id", "edge_id"))
    return nodes.select("node_id", "x", "y")


_SPEC = "case mode when 'bus' then {bus} when 'trolleybus' then {tro} when 'tram' then {tram} else {sub} end::double"
_TIME = f"""with {_RIDES}, s as (select event_id, sqrt((x1-x2)*(x1-x2)+(y1-y2)*(y1-y2)) as l, {_SPEC.format(bus=90, tro=70, tram=75, sub=80)} as vmax, {_SPEC.format(bus=700, tro=750, tram=500, sub=450)} as acc, {_SPEC.format(bus=650, tro=700, tram=450, sub=450)} as brk, {_SPEC.format(bus='0.7', tro='0.7', tram='0.8', sub='0.9')} as coef from x),
v as (select *, greatest(vmax*1000.0::double/60.0::double*coef, 60.0::double) as v, acc+brk as ramp from s)
select event_id, round(case when l <= 0 then 0.0::double when l < ramp then 2.0::double*l/greatest(v*l/ramp, 60.0::double) else 2.0::double*acc/v+2.0::double*brk/v+(l-ramp)/v end, 6) as minutes from v"""


@query("travel_time", _TIME)
def travel_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rides = transit_rides(spark, sf_dir)
    size = geom.distance(geom.point(F.col("x1"), F.col("y1")), geom.point(F.col("x2"), F.col("y2")))
    timed = rides.join(TransportRegistry().to_df(spark), "mode")
    return timed.select("event_id", F.round(travel_time(F.col("vmax"), F.col("accel"), F.col("brake"), F.col("coef"), size), 6).alias("minutes"))


@query("boarding_split", f"with {_RIDES} select event_id as pos, u, v, mode as type, true as oneway from x where event_id % 2 = 1 union all select event_id, u, v, 'alighting', true from x where event_id % 2 = 0 union all select event_id, v, u, 'boarding', true from x where event_id % 2 = 0")
def boarding_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rides = _lines(spark, sf_dir).select(F.col("event_id").alias("pos"), "u", "v", F.when(F.col("event_id") % 2 == 0, "boarding").otherwise(F.col("mode")).alias("type"), F.lit(None).cast("boolean").alias("oneway"), "geometry", F.lit(None).cast("double").alias("length_meter"), F.lit(None).cast("double").alias("time_min"))
    return transit.split_boarding(rides, 1.0).select("pos", "u", "v", "type", "oneway")


@query("platform_merge", f"with {_RIDES} select x2 as x, y2 as y, count(*)::bigint as n_sources, count(distinct route)::int as n_routes from x group by x2, y2")
def platform_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    stops = transit_rides(spark, sf_dir).select(F.col("event_id").alias("pos"), F.col("event_id").cast("string").alias("node_id"), F.lit("platform").alias("type"), F.col("route").cast("string").alias("route"), F.col("x2").alias("x"), F.col("y2").alias("y"))
    nodes, mapping = transit.merge_platforms(stops)
    counts = mapping.groupBy("node_id").agg(F.count(F.lit(1)).alias("n_sources"))
    return nodes.join(counts, "node_id").select("x", "y", "n_sources", F.size("routes").alias("n_routes"))


@query("collapse_attrs", f"with {_RIDES}, d as (select v, route, min(event_id) as k from x group by v, route) select v as target, string_agg(route::varchar, '|' order by k) as routes from d group by v")
def collapse_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transit_rides(spark, sf_dir).select(F.col("v").alias("target"), F.col("event_id").alias("pos"), F.col("route").cast("string").alias("route"))
    return transit.collapse(rows, "route").select("target", F.array_join("route", "|").alias("routes"))


# --- tags --------------------------------------------------------------------------------------

_CLASSES = [*tags.HIGHWAYS, "service", "path"]
_CLASS_SQL = "[" + ", ".join(f"'{c}'" for c in _CLASSES) + "]"


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, _CLASSES))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.element_at(names, (F.col("c_custkey") % len(_CLASSES) + 1).cast("int")).alias("highway"))


@query("highway_props", f"select c_custkey as id, case when h in ('motorway','trunk','motorway_link','trunk_link') then 'federal' when h in ('primary','secondary','primary_link','secondary_link') then 'regional' else 'local' end as category, case h when 'motorway' then 110*1000.0::double/60 when 'trunk' then 90*1000.0::double/60 when 'motorway_link' then 90*1000.0::double/60 when 'trunk_link' then 90*1000.0::double/60 when 'primary' then 1000.0::double when 'secondary' then 1000.0::double when 'tertiary' then 1000.0::double when 'primary_link' then 1000.0::double when 'secondary_link' then 1000.0::double when 'tertiary_link' then 1000.0::double when 'living_street' then 20*1000.0::double/60 else 40*1000.0::double/60 end as speed from (select c_custkey, {_CLASS_SQL}[(c_custkey % {len(_CLASSES)} + 1)::int] as h from customer)")
def highway_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classes(spark, sf_dir).select("id", tags.highway_category(F.col("highway")).alias("category"), tags.highway_speed(F.col("highway")).alias("speed"))


_SPEED_TEXTS = ["50", "50 km/h", "60kph", "30 mph", "walk", "", "  40kmh ", "50 knots", "72.5"]
_SPEED_SQL = "[" + ", ".join(f"'{c}'" for c in _SPEED_TEXTS) + "]"


@query("maxspeed_parse", f"with t as (select c_custkey as id, lower(trim({_SPEED_SQL}[(c_custkey % {len(_SPEED_TEXTS)} + 1)::int])) as s from customer) select id, round(case when try_cast(s as double) is not null then try_cast(s as double)*1000.0::double/60.0::double when regexp_matches(s, '^\\d+(\\.\\d+)?\\s*mph$') then regexp_extract(s, '^([0-9.]+)', 1)::double*1.60934::double*1000.0::double/60.0::double when regexp_matches(s, '^\\d+(\\.\\d+)?\\s*(km/h|kmh|kph)$') then regexp_extract(s, '^([0-9.]+)', 1)::double*1000.0::double/60.0::double end, 6) as speed from t")
def maxspeed_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, _SPEED_TEXTS)), (F.col("c_custkey") % len(_SPEED_TEXTS) + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.round(tags.maxspeed_m_per_min(said), 6).alias("speed"))


@query("oneway_norm", "select c_custkey as id, case c_custkey % 6 when 0 then true when 1 then false when 2 then true when 3 then true when 4 then false else false end as oneway from customer")
def oneway_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, ["Yes ", "no", "-1", "1", "maybe"]), F.lit(None).cast("string")), (F.col("c_custkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), tags.oneway(said).alias("oneway"))


@query("role_infer", "select c_custkey as id, case c_custkey % 7 when 0 then 'station' when 1 then 'platform' when 2 then 'stop' when 3 then 'entrance' when 4 then 'entry_only' when 5 then 'exit_only' else '' end as role from customer")
def role_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda **t: F.create_map(*[F.lit(x) for p in t.items() for x in p])
    said = [one(public_transport="station"), one(railway="platform"), one(public_transport="stop_position"), one(railway="subway_entrance"), one(entrance="yes", entry="yes"), one(entrance="exit"), one(amenity="cafe")]
    which = F.element_at(F.array(*said), (F.col("c_custkey") % len(said) + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), tags.infer_role(which).alias("role"))


@query("tag_filter", "select event_id, event_type, (props->>'k')::bigint as k from events where (props->>'k') is not null and not regexp_matches(props->>'k', '^1') and event_type <> 'error' and regexp_matches(event_type, 'view|click')")
def tag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "events").withColumn("tags", F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("kind"), F.col("event_type"))))
    kept = said.filter(tags.tag_filter('["k"]["k"!~"^1"]["kind"!="error"]["kind"~"view|click"]', F.col("tags")))
    return kept.select("event_id", "event_type", F.col("tags")["k"].cast("long").alias("k"))


@query("tag_extract", "select event_id as id, props->>'k' as k, event_type as kind, props->>'k' as dotted, null::varchar as none from events")
def tag_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"), F.from_json("props", "map<string,string>").alias("tags"))
    paths_in = {"k": "k", "kind": "kind", "dotted": "tags.k", "none": "tags.none"}
    return said.select(F.col("event_id").alias("id"), *(cells.extract(said.schema, p).alias(n) for n, p in paths_in.items()))


@query("merge_maps", "select l_orderkey as id, l_returnflag as flag, max(l_linenumber)::varchar as last from lineitem group by all")
def merge_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.struct("l_linenumber", F.col("l_returnflag").alias("flag"))
    said = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(one)).alias("said"))
    maps = F.transform("said", lambda s: F.create_map(s["flag"], s["l_linenumber"].cast("string")))
    return said.select("id", F.explode(cells.merged(maps)).alias("flag", "last"))


# --- builders and files ------------------------------------------------------------------------


@query("drive_graph")
def drive_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = streets.drive_graph(samples.grid_elements(spark, sf_dir), samples.EPSG, add_category=True, keep_largest_part=False)
    return graph.edges.select("edge_id", "u", "v", "k", "length_meter", "time_min", "oneway", "category")


@query("walk_graph")
def walk_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streets.walk_graph(samples.grid_elements(spark, sf_dir), samples.EPSG).edges.select("edge_id", "u", "v", "k", "length_meter", "time_min")


@query("pt_ground")
def pt_ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transit.public_transport_graph(elements_of(spark, samples.ROUTES), samples.EPSG, ["bus", "tram"]).edges.select("edge_id", "u", "v", "k", "length_meter", "time_min", "oneway", "type", "route")


@query("subway")
def subway(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transit.public_transport_graph(elements_of(spark, samples.SUBWAY), samples.EPSG, ["subway"]).edges.select("edge_id", "u", "v", "k", "length_meter", "time_min", "oneway", "type", "route")


@query("intermodal_join")
def intermodal_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rides as lines, with a platform beside each stop, hung on the streets."""
    rides = transit_rides(spark, sf_dir)
    half = lambda c: F.col(c) / 4 + 7.0
    stop = lambda c, a, b: rides.select(F.col("event_id").alias("pos"), F.concat(F.lit("s"), F.col(c)).alias("node_id"), F.col("mode").alias("type"), F.col("route").cast("string").alias("route"), half(a).alias("x"), half(b).alias("y"))
    # every event has a position below n, so those of both stops and their platforms lie apart
    n = (table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0) + 1
    stops = stop("u", "x1", "y1").unionByName(stop("v", "x2", "y2").withColumn("pos", F.col("pos") + n))
    platforms = stops.withColumns({"pos": F.col("pos") + 2 * n, "node_id": F.concat(F.lit("p"), "node_id"), "type": F.lit("platform"), "y": F.col("y") + 3})
    line = lambda ax, ay, bx, by: F.array(geom.point(ax, ay), geom.point(bx, by))
    ride = rides.select(F.col("event_id").alias("pos"), F.concat(F.lit("s"), F.col("u")).alias("u"), F.concat(F.lit("s"), F.col("v")).alias("v"), F.col("mode").alias("type"), F.col("route").cast("string").alias("route"), line(half("x1"), half("y1"), half("x2"), half("y2")).alias("geometry"))
    board = stops.select((F.col("pos") + n).alias("pos"), F.col("node_id").alias("u"), F.concat(F.lit("p"), "node_id").alias("v"), F.lit("boarding").alias("type"), "route", line(F.col("x"), F.col("y"), F.col("x"), F.col("y") + 3).alias("geometry"))
    lines = transit.assemble(stops.unionByName(platforms), ride.unionByName(board), epsg=32636)
    return transit.join_transit_walk(lines, street_grid(spark, sf_dir)).edges.select("edge_id", "u", "v", "k", "length_meter", "time_min", "oneway", "type", "route")


@query(
    "combine_first",
    """with c as (select c_nationkey as nation, min(c_acctbal) as balance, min(c_name) as richest from customer where c_acctbal > 9900 group by 1),
s as (select s_nationkey as nation, min(s_acctbal) as balance, count(*) as suppliers from supplier group by 1)
select coalesce(c.nation, s.nation)::bigint as nation, coalesce(c.balance, s.balance)::double as balance, richest, suppliers from c full join s on c.nation = s.nation""",
)
def combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of nations from rich customers, completed by those of suppliers."""
    rich = table(spark, sf_dir, "customer").filter("c_acctbal > 9900").groupBy(F.col("c_nationkey").cast("long").alias("nation")).agg(F.min("c_acctbal").cast("double").alias("balance"), F.min("c_name").alias("richest"))
    others = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("nation")).agg(F.min("s_acctbal").cast("double").alias("balance"), F.count(F.lit(1)).alias("suppliers"))
    return combine_first(rich, others, ["nation"])


@query("unique_values", "select c_nationkey::bigint as nation, list_aggregate(list_sort(list_distinct(list(c_mktsegment))), 'string_agg', ',') as segments from customer group by 1")
def uniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("nation")).agg(cells.unique_values(F.col("c_mktsegment")).alias("segments"))
    return found.withColumn("segments", F.array_join("segments", ","))


@query("archive_roundtrip", f"with {C1} select edge_id, u, v, t as time_min, oneway from e")
def archive_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/{next(tempfile._get_candidate_names())}"
    write_graph(street_grid(spark, sf_dir), path)
    return read_graph(spark, path).edges.select("edge_id", "u", "v", "time_min", "oneway")


@query("windowed_weights", f"select time_bucket(interval '5 minutes', ts) as start, (event_id % {WIDTH})::bigint as edge_id, round(avg(value), 6) as time_min, count(*)::bigint as n from events group by 1, 2")
def windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "events").select("ts", (F.col("event_id") % WIDTH).cast("long").alias("edge_id"), F.col("value").alias("minutes"))
    return windowed_weights(seen).select("start", "edge_id", F.round("time_min", 6).alias("time_min"), "n")
