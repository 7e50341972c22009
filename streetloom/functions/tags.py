"""Map tags of street and transport elements as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geom import rounded

# Street classes with their category and default speed in km/h.
HIGHWAYS = {
    "motorway": ("federal", 110),
    "trunk": ("federal", 90),
    "primary": ("regional", 60),
    "secondary": ("regional", 60),
    "tertiary": ("local", 60),
    "unclassified": ("local", 40),
    "residential": ("local", 40),
    "motorway_link": ("federal", 90),
    "trunk_link": ("federal", 90),
    "primary_link": ("regional", 60),
    "secondary_link": ("regional", 60),
    "tertiary_link": ("local", 60),
    "living_street": ("local", 20),
}
UNKNOWN = "unclassified"


def oneway(tag: Column) -> Column:
    """Whether a oneway tag makes a street one-way; missing means no."""
    return F.lower(F.trim(F.coalesce(tag, F.lit("no")))).isin("yes", "true", "1", "-1")


def reversed_oneway(tag: Column) -> Column:
    return F.trim(F.coalesce(tag, F.lit(""))) == "-1"


def _lookup(values: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def highway_category(tag: Column) -> Column:
    return F.coalesce(_lookup({k: v[0] for k, v in HIGHWAYS.items()})[F.lower(tag)], F.lit(HIGHWAYS[UNKNOWN][0]))


def highway_speed(tag: Column) -> Column:
    """Metres per minute of a street class."""
    return F.coalesce(_lookup({k: v[1] * 1000 / 60 for k, v in HIGHWAYS.items()})[F.lower(tag)], F.lit(HIGHWAYS[UNKNOWN][1] * 1000 / 60))


# Categories, the most local first.
CATEGORIES = ["local", "regional", "federal"]


def highway_list_props(tags: Column) -> tuple[Column, Column]:
    """Category and speed of a street with several classes: the most local and the lowest of the known ones."""
    known = F.filter(F.transform(tags, F.lower), lambda t: t.isin(*HIGHWAYS))
    rank = _lookup({k: CATEGORIES.index(v[0]) for k, v in HIGHWAYS.items()})
    speed = _lookup({k: v[1] * 1000 / 60 for k, v in HIGHWAYS.items()})
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), F.array_min(F.transform(known, lambda t: rank[t])) + 1)
    none = F.coalesce(F.size(known), F.lit(0)) <= 0
    return F.when(none, HIGHWAYS[UNKNOWN][0]).otherwise(category), F.when(none, HIGHWAYS[UNKNOWN][1] * 1000 / 60).otherwise(F.array_min(F.transform(known, lambda t: speed[t])))


def drive_speed(maxspeed: Column, highway: Column) -> Column:
    """A plain number of km/h wins over the class, anything else does not count."""
    return F.coalesce(rounded(maxspeed.try_cast("double") * 1000.0 / 60.0, 3), highway_speed(highway))


def maxspeed_m_per_min(text: Column) -> Column:
    """Metres per minute of a speed with or without unit; null if it is none."""
    clean = F.lower(F.trim(text))
    spelled = r"^(\d+(?:\.\d+)?)\s*(km/h|kmh|kph|mph)$"
    number, unit = F.regexp_extract(clean, spelled, 1).try_cast("double"), F.regexp_extract(clean, spelled, 2)
    with_unit = F.when(unit == "mph", number * 1.60934 * 1000.0 / 60.0).otherwise(number * 1000.0 / 60.0)
    return F.coalesce(clean.try_cast("double") * 1000.0 / 60.0, with_unit)


def infer_role(tags: Column) -> Column:
    """Role that the tags of a member without one imply; empty if none."""
    tag = lambda k: F.lower(F.coalesce(tags[k], F.lit("")))
    yes = lambda c: c.isin("yes", "true", "1")
    transport, railway, entrance = tag("public_transport"), tag("railway"), tag("entrance")
    into, out = tag("entry"), tag("exit")
    door = (railway == "subway_entrance") | entrance.isin("yes", "main", "service", "entrance", "entry", "exit")
    return (
        F.when((transport == "station") | (railway == "station") | (tag("station") == "subway"), "station")
        .when((transport == "platform") | (railway == "platform"), "platform")
        .when(transport.isin("stop_position", "stop") | railway.isin("stop", "halt"), "stop")
        .when(door & ((entrance == "entry") | (yes(into) & ~yes(out))), "entry_only")
        .when(door & ((entrance == "exit") | (yes(out) & ~yes(into))), "exit_only")
        .when(door, "entrance")
        .otherwise("")
    )


_CLAUSE = re.compile(r"""\[\s*"([^"]+)"\s*(?:(!?[=~])\s*"((?:[^"\\]|\\.)*)"\s*)?\]""")


def tag_filter(said: str, tags: Column) -> Column:
    """Predicate of clauses like ["k"]["k"="v"]["k"!="v"]["k"~"re"]["k"!~"re"]; a missing tag passes negations."""
    clauses = list(_CLAUSE.finditer(said))
    if not clauses or _CLAUSE.sub("", said).strip():
        raise ValueError(f"not a tag filter: {said}")

    def one(found: re.Match) -> Column:
        value = tags[found[1]]
        if found[2] is None:
            return value.isNotNull()
        filled = F.coalesce(value, F.lit(""))
        return {"=": value.isNotNull() & (filled == found[3]), "!=": filled != found[3], "~": value.isNotNull() & filled.rlike(found[3]), "!~": ~(value.isNotNull() & filled.rlike(found[3]))}[found[2]]

    return reduce(lambda a, b: a & b, map(one, clauses))


# Filters of the street networks.
NETWORKS = {
    "drive": '["highway"]["area"!~"yes"]["access"!~"private"]["highway"!~"abandoned|bridleway|bus_guideway|construction|corridor|cycleway|elevator|escalator|footway|no|path|pedestrian|planned|platform|proposed|raceway|razed|service|steps|track"]["motor_vehicle"!~"no"]["motorcar"!~"no"]["service"!~"alley|driveway|emergency_access|parking|parking_aisle|private"]',
    "drive_service": '["highway"]["area"!~"yes"]["access"!~"private"]["highway"!~"abandoned|bridleway|bus_guideway|construction|corridor|cycleway|elevator|escalator|footway|no|path|pedestrian|planned|platform|proposed|raceway|razed|steps|track"]["motor_vehicle"!~"no"]["motorcar"!~"no"]["service"!~"emergency_access|parking|parking_aisle|private"]',
    "walk": '["highway"]["area"!~"yes"]["access"!~"private"]["highway"!~"abandoned|bus_guideway|construction|cycleway|motor|no|planned|platform|proposed|raceway|razed"]["foot"!~"no"]["service"!~"private"]["sidewalk"!~"separate"]["sidewalk:both"!~"separate"]["sidewalk:left"!~"separate"]["sidewalk:right"!~"separate"]',
}
