"""Street and transport elements as tables, and their cache and download."""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geom import convex_hull
from ..functions.tags import maxspeed_m_per_min, tag_filter

_POINT = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])
_MEMBER = T.StructType([T.StructField("type", T.StringType()), T.StructField("ref", T.LongType()), T.StructField("role", T.StringType()), T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()), T.StructField("geometry", T.ArrayType(_POINT))])
ELEMENT = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
        T.StructField("geometry", T.ArrayType(_POINT)),
        T.StructField("members", T.ArrayType(_MEMBER)),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("center", _POINT),
    ]
)
RING = list[tuple[float, float]]


@dataclass
class Config:
    """Settings of downloads."""

    url: str = "https://overpass-api.de/api/interpreter"
    timeout: int | None = None
    snapshot: str | None = None
    min_interval: float = 1.0
    max_retries: int = 3
    backoff_base: float = 0.5
    cache_dir: str | None = None
    _last: float = field(default=0.0, repr=False)

    def set_snapshot(self, date: str | None = None, year: int | None = None, month: int | None = None, day: int | None = None) -> None:
        """A date as text, or as parts; none of both clears it."""
        if date is not None and year is not None:
            raise ValueError("give a date or its parts")
        if date is None and year is None:
            self.snapshot = None
            return
        if date is not None and re.fullmatch(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z", date):
            found = datetime.strptime(date, "%Y-%m-%dT%H:%M:%SZ")
        else:
            found = datetime.strptime(date, "%Y-%m-%d") if date is not None else datetime(year, month or 1, day or 1)
        self.snapshot = found.strftime("%Y-%m-%dT%H:%M:%SZ")

    def header(self) -> str:
        parts = ["[out:json]"]
        parts += [f"[timeout:{self.timeout}]"] if self.timeout else []
        parts += [f'[date:"{self.snapshot}"]'] if self.snapshot else []
        return "".join(parts) + ";"


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements of a folder or file of JSON lines; types are fixed, so nothing is inferred."""
    return spark.read.schema(ELEMENT).json(path)


def elements_of(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Elements given as Python dictionaries."""
    return spark.createDataFrame([json.dumps(r) for r in rows], "string").select(F.from_json("value", ELEMENT).alias("e")).select("e.*")


def network_elements(elements: DataFrame, said: str) -> DataFrame:
    """Ways that a tag filter lets through."""
    return elements.filter((F.col("type") == "way") & tag_filter(said, F.col("tags")))


def route_elements(elements: DataFrame, types: list[str], snapshot: bool = False) -> DataFrame:
    """Route relations of some types; with a snapshot there is no subway."""
    wanted = [t for t in types if not (snapshot and t == "subway")]
    return elements.filter((F.col("type") == "relation") & F.col("tags")["route"].isin(*wanted)) if wanted else elements.limit(0)


def classified(elements: DataFrame, subway_details: bool = False) -> DataFrame:
    """Add what route assembly needs: transport_type, is_way_data, way_speed, and the subway's kinds of relations."""
    tag = lambda k: F.coalesce(F.col("tags")[k], F.lit(""))
    relation = F.col("type") == "relation"
    way = (F.col("type") == "way") & F.col("tags")["highway"].isNotNull()
    area, group = relation & (tag("public_transport") == "stop_area"), relation & (tag("public_transport") == "stop_area_group")
    station = (tag("public_transport") == "station") | (tag("railway") == "station")
    kind = F.when(F.lit(subway_details) & (area | group | station), "subway").otherwise(F.col("tags")["route"])
    return elements.withColumns({"transport_type": kind, "is_way_data": way, "way_speed": F.when(way, maxspeed_m_per_min(F.col("tags")["maxspeed"])), "is_stop_area": area, "is_stop_area_group": group, "is_station": station})


def member_tags(members: DataFrame, elements: DataFrame) -> DataFrame:
    """Members (type, ref, …) with the tags and place of their element."""
    facts = elements.select("type", F.col("id").alias("ref"), F.col("tags").alias("member_tags"), F.coalesce("lat", "center.lat").alias("member_lat"), F.coalesce("lon", "center.lon").alias("member_lon"), F.col("geometry").alias("member_geometry"))
    return members.join(facts, ["type", "ref"], "left")


def stitch_rings(lines: list[RING]) -> list[RING]:
    """Closed rings from lines that share ends."""
    left, rings = [list(x) for x in lines if len(x) > 1], []
    while left:
        ring = left.pop(0)
        grown = True
        while ring[0] != ring[-1] and grown:
            grown = False
            for k, other in enumerate(left):
                if other[0] == ring[-1]:
                    ring += other[1:]
                elif other[-1] == ring[-1]:
                    ring += other[::-1][1:]
                else:
                    continue
                del left[k]
                grown = True
                break
        if ring[0] == ring[-1] and len(ring) > 3:
            rings.append(ring)
    return rings


def boundary(relation: dict) -> list[RING]:
    """Rings of a boundary relation, the outer one first, holes after it; of several outer ones their hull."""
    lines = {"outer": [], "inner": []}
    for member in relation.get("members") or []:
        if member.get("geometry"):
            lines.setdefault(member.get("role") or "outer", []).append([(p["lon"], p["lat"]) for p in member["geometry"]])
    outer, inner = stitch_rings(lines["outer"]), stitch_rings(lines["inner"])
    if not outer:
        raise ValueError("the relation has no closed outer boundary")
    return normalise_territory([[ring, *(inner if len(outer) == 1 else [])] for ring in outer])


def normalise_territory(territory) -> list[RING]:
    """A polygon stays; several become the convex hull of all."""
    if territory is None:
        raise ValueError("a territory is needed")
    if not isinstance(territory, list) or not territory:
        raise TypeError("a territory is a polygon (list of rings) or a list of polygons")
    if isinstance(territory[0][0], tuple):
        return territory
    if len(territory) == 1:
        return territory[0]
    hull = convex_hull([p for polygon in territory for ring in polygon for p in ring])
    return [[*hull, hull[0]]]


def cache_key(url: str, method: str, query: str) -> str:
    return hashlib.sha1(f"{url}\n{method}\n{query}".encode()).hexdigest()


def cache_save(folder: str, prefix: str, key: str, data: dict) -> str:
    """Write one answer; a reader sees it whole or not at all."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{prefix}_{key}.json")
    with open(f"{path}.part", "w") as file:
        json.dump(data, file)
    os.replace(f"{path}.part", path)
    return path


def cache_load(folder: str, prefix: str, key: str) -> dict | None:
    try:
        with open(os.path.join(folder, f"{prefix}_{key}.json")) as file:
            return json.load(file)
    except (FileNotFoundError, ValueError):
        return None


class RequestError(RuntimeError):
    """A download that did not succeed."""


def download(query: str, config: Config, prefix: str = "network") -> dict:
    """One answer, from the cache or from the service, with retries on the driver."""
    key = cache_key(config.url, "POST", query)
    if config.cache_dir and (known := cache_load(config.cache_dir, prefix, key)) is not None:
        return known
    for attempt in range(config.max_retries + 1):
        time.sleep(max(0.0, config._last + config.min_interval - time.monotonic()))
        config._last = time.monotonic()
        try:
            body = urllib.parse.urlencode({"data": query}).encode()
            with urllib.request.urlopen(urllib.request.Request(config.url, body), timeout=(config.timeout or 60) + 10) as answer:
                found = json.load(answer)
            break
        except urllib.error.HTTPError as error:
            if error.code not in (429, 502, 503, 504) or attempt == config.max_retries:
                raise RequestError(f"{error.code} from {config.url}") from error
            wait = error.headers.get("Retry-After", "")
            time.sleep(float(wait) if wait.isdigit() else min(60.0, config.backoff_base**attempt))
        except OSError as error:
            if attempt == config.max_retries:
                raise RequestError(str(error)) from error
            time.sleep(min(60.0, config.backoff_base**attempt))
    if config.cache_dir:
        cache_save(config.cache_dir, prefix, key, found)
    return found


def network_query(polygon: list[RING], said: str, config: Config) -> str:
    around = " ".join(f"{lat} {lon}" for lon, lat in polygon[0])
    return f'{config.header()}(way{said}(poly:"{around}"););out geom;'
