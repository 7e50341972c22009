"""Small element tables that the builder queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.crs import from_utm
from ..sources.elements import ELEMENT
from .derived import street_grid

EPSG = 32636
X0, Y0 = 300000.0, 6600000.0


def grid_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The street grid as ways: one for each edge, classes and limits by edge number."""
    edges = street_grid(spark, sf_dir).edges

    def place(p):
        lon, lat = from_utm(p["x"] + X0, p["y"] + Y0, EPSG)
        return F.struct(F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"))

    classes = F.element_at(F.array(*map(F.lit, ["residential", "primary", "footway", "tertiary"])), (F.floor(F.col("u") / 40) % 4 + 1).cast("int"))
    tags = F.create_map(F.lit("highway"), classes, F.lit("oneway"), F.when(F.col("oneway"), F.when(F.col("u") % 2 == 0, "-1").otherwise("yes")).otherwise("no"), F.lit("maxspeed"), F.when(F.col("u") % 3 == 0, "30").otherwise("walk"))
    ways = edges.select(F.lit("way").alias("type"), F.col("edge_id").alias("id"), tags.alias("tags"), F.transform("geometry", place).alias("geometry"))
    return ways.select(*[F.col(f.name) if f.name in ways.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in ELEMENT])


def _way(number: int, points: list[tuple[float, float]], **tags: str) -> dict:
    return {"type": "way", "id": number, "tags": {"highway": "primary", **tags}, "geometry": [{"lat": a, "lon": b} for a, b in points]}


def _node(number: int, lat: float, lon: float, **tags: str) -> dict:
    return {"type": "node", "id": number, "lat": lat, "lon": lon, "tags": tags}


def _member(kind: str, ref: int, role: str = "", points: list | None = None, at: tuple | None = None) -> dict:
    out = {"type": kind, "ref": ref, "role": role}
    if points:
        out["geometry"] = [{"lat": a, "lon": b} for a, b in points]
    if at:
        out |= {"lat": at[0], "lon": at[1]}
    return out


_A = [(59.900, 30.300), (59.902, 30.300), (59.904, 30.300)]
_B = [(59.908, 30.300), (59.906, 30.300), (59.904, 30.300)]
#: A bus whose second way runs backwards, and a tram without platforms.
ROUTES = [
    _way(1, _A, maxspeed="60"),
    _way(2, _B, maxspeed="40"),
    {"type": "relation", "id": 10, "tags": {"type": "route", "route": "bus", "ref": "7"}, "members": [_member("way", 1, points=_A), _member("way", 2, points=_B), _member("node", 20, "stop", at=(59.9001, 30.300)), _member("node", 21, "stop", at=(59.9040, 30.300)), _member("node", 22, "stop", at=(59.9078, 30.300)), _member("node", 30, "platform", at=(59.9001, 30.3002)), _member("node", 31, "platform", at=(59.9040, 30.3002)), _member("node", 32, "platform", at=(59.9078, 30.3002))]},
    {"type": "relation", "id": 11, "tags": {"type": "route", "route": "tram", "name": "Circle"}, "members": [_member("way", 1, points=_A), _member("node", 40, "stop", at=(59.9002, 30.300)), _member("node", 41, "stop", at=(59.9036, 30.300))]},
]
#: A line of two stations with entrances, one of them down 40 m, and a second line to change to.
SUBWAY = [
    {"type": "relation", "id": 50, "tags": {"type": "route", "route": "subway", "ref": "M1"}, "members": [_member("way", 60, points=_A), _member("node", 70, "stop", at=_A[0]), _member("node", 71, "stop", at=_A[2])]},
    _node(70, *_A[0], public_transport="stop_position"),
    _node(71, *_A[2], public_transport="stop_position"),
    _node(80, 59.9000, 30.3003, public_transport="platform", depth="40"),
    _node(81, 59.9040, 30.3003, public_transport="platform"),
    _node(82, 59.9040, 30.3010, public_transport="platform"),
    _node(90, 59.9003, 30.3003, railway="subway_entrance"),
    _node(91, 59.9043, 30.3003, railway="subway_entrance", entrance="exit"),
    {"type": "relation", "id": 100, "tags": {"public_transport": "stop_area"}, "members": [_member("node", n) for n in (70, 80, 90)]},
    {"type": "relation", "id": 101, "tags": {"public_transport": "stop_area"}, "members": [_member("node", n) for n in (71, 81, 91)]},
    {"type": "relation", "id": 102, "tags": {"public_transport": "stop_area"}, "members": [_member("node", 82)]},
    {"type": "relation", "id": 110, "tags": {"public_transport": "stop_area_group"}, "members": [_member("relation", 101), _member("relation", 102)]},
]
