"""Geometry on lines held as array<struct<x double, y double>>, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


def segments(line: Column) -> Column:
    """Consecutive vertex pairs: array<struct<a, b>>."""
    n = F.greatest(F.size(line) - 1, F.lit(0))
    return F.zip_with(F.slice(line, 1, n), F.slice(line, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def length(line: Column) -> Column:
    return F.aggregate(segments(line), F.lit(0.0), lambda total, s: total + distance(s["a"], s["b"]))


def cumulative(line: Column) -> Column:
    """Distance from the start to every vertex."""
    return F.aggregate(segments(line), F.array(F.lit(0.0)), lambda so_far, s: F.concat(so_far, F.array(F.element_at(so_far, -1) + distance(s["a"], s["b"]))))


def start(line: Column) -> Column:
    return F.element_at(line, 1)


def end(line: Column) -> Column:
    return F.element_at(line, -1)


def between(a: Column, b: Column, share: Column) -> Column:
    return point(a["x"] + (b["x"] - a["x"]) * share, a["y"] + (b["y"] - a["y"]) * share)


def interpolate(line: Column, along: Column) -> Column:
    """The point at a distance along a line, clamped to its ends."""
    zero = F.struct(F.lit(0.0).alias("done"), F.element_at(line, 1).alias("at"))

    def step(state: Column, s: Column) -> Column:
        part = distance(s["a"], s["b"])
        share = F.when(part > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (along - state["done"]) / part))).otherwise(F.lit(0.0))
        return F.struct((state["done"] + part).alias("done"), F.when(along > state["done"], between(s["a"], s["b"], share)).otherwise(state["at"]).alias("at"))

    return F.aggregate(segments(line), zero, step)["at"]


def midpoint(line: Column) -> Column:
    return interpolate(line, length(line) / 2)


def centroid(line: Column) -> Column:
    """The mean of the segments' midpoints, weighted by their lengths."""
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def step(total: Column, s: Column) -> Column:
        part, at = distance(s["a"], s["b"]), between(s["a"], s["b"], F.lit(0.5))
        return F.struct((total["n"] + part).alias("n"), (total["x"] + part * at["x"]).alias("x"), (total["y"] + part * at["y"]).alias("y"))

    return F.aggregate(segments(line), zero, step, lambda t: F.when(t["n"] > 0, point(t["x"] / t["n"], t["y"] / t["n"])).otherwise(F.element_at(line, 1)))


def inner_point(rings: Column) -> Column:
    """A point inside a polygon (rings, holes after the shell): the middle of the widest stretch of a level line.

    The level lies between two neighbouring heights of vertices, next to the middle of the polygon, so that it meets no vertex.
    """
    heights = F.array_sort(F.array_distinct(F.flatten(F.transform(rings, lambda r: F.transform(r, lambda p: p["y"])))))
    middle = (F.array_min(heights) + F.array_max(heights)) / 2
    below, above = F.array_max(F.filter(heights, lambda y: y <= middle)), F.array_min(F.filter(heights, lambda y: y > middle))
    level = (below + F.coalesce(above, below)) / 2
    closed = F.transform(rings, lambda r: F.concat(r, F.slice(r, 1, 1)))
    crossings = F.flatten(F.transform(closed, lambda r: F.transform(F.filter(segments(r), lambda s: (s["a"]["y"] > level) != (s["b"]["y"] > level)), lambda s: s["a"]["x"] + (level - s["a"]["y"]) * (s["b"]["x"] - s["a"]["x"]) / (s["b"]["y"] - s["a"]["y"]))))
    xs = F.array_sort(crossings)
    starts = F.filter(F.transform(xs, lambda x, i: F.when(i % 2 == 0, F.struct((F.get(xs, i + 1) - x).alias("wide"), x.alias("x")))), lambda x: x.isNotNull())
    widest = F.array_max(starts)
    return F.when(F.size(xs) > 1, point(widest["x"] + widest["wide"] / 2, level)).otherwise(F.element_at(F.element_at(rings, 1), 1))


def segment_share(px: Column, py: Column, a: Column, b: Column) -> Column:
    """Where on a segment the nearest point to (px, py) lies, 0 to 1."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    square = dx * dx + dy * dy
    return F.when(square > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - a["x"]) * dx + (py - a["y"]) * dy) / square))).otherwise(F.lit(0.0))


def segment_distance(px: Column, py: Column, a: Column, b: Column) -> Column:
    return distance(point(px, py), between(a, b, segment_share(px, py, a, b)))


def project(line: Column, px: Column, py: Column) -> Column:
    """struct<dist, along>: distance to the line, and distance along it of the nearest point."""
    first = F.struct(F.lit(float("inf")).alias("dist"), F.lit(0.0).alias("along"), F.lit(0.0).alias("done"))

    def step(state: Column, s: Column) -> Column:
        part, near = distance(s["a"], s["b"]), segment_distance(px, py, s["a"], s["b"])
        better = near < state["dist"]
        return F.struct(
            F.when(better, near).otherwise(state["dist"]).alias("dist"),
            F.when(better, state["done"] + part * segment_share(px, py, s["a"], s["b"])).otherwise(state["along"]).alias("along"),
            (state["done"] + part).alias("done"),
        )

    return F.aggregate(segments(line), first, step, lambda s: F.struct(s["dist"].alias("dist"), s["along"].alias("along")))


def box(line: Column) -> tuple[Column, Column, Column, Column]:
    xs, ys = F.transform(line, lambda p: p["x"]), F.transform(line, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def in_polygon(x: Column, y: Column, polygon: list[list[tuple[float, float]]]) -> Column:
    """Whether a point is inside a polygon or on its border; a polygon is a list of rings, holes after the shell.

    The bounding box comes first as plain comparisons, which a scan can take over.
    """
    shell = polygon[0]
    low_x, high_x = min(p[0] for p in shell), max(p[0] for p in shell)
    low_y, high_y = min(p[1] for p in shell), max(p[1] for p in shell)
    crossings, border = F.lit(0), F.lit(False)
    for ring in polygon:
        closed = [*ring, ring[0]] if ring[0] != ring[-1] else ring
        for (ax, ay), (bx, by) in zip(closed, closed[1:], strict=False):
            side = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
            border = border | ((side == 0) & x.between(min(ax, bx), max(ax, bx)) & y.between(min(ay, by), max(ay, by)))
            if ay != by:
                crossings = crossings + (((F.lit(ay) > y) != (F.lit(by) > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)).cast("int")
    return x.between(low_x, high_x) & y.between(low_y, high_y) & (border | (crossings % 2 == 1))


def convex_hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Hull of a few points on the driver, counter-clockwise, by monotone chains."""
    ordered = sorted(set(points))
    if len(ordered) < 3:
        return ordered
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    chains = []
    for run in (ordered, ordered[::-1]):
        chain: list[tuple[float, float]] = []
        for p in run:
            while len(chain) > 1 and turn(chain[-2], chain[-1], p) <= 0:
                chain.pop()
            chain.append(p)
        chains.append(chain[:-1])
    return chains[0] + chains[1]


def rounded(x: Column, digits: int) -> Column:
    """Half-even rounding of the scaled value, as numerical libraries do it."""
    return F.rint(x * F.lit(float(10**digits))) / F.lit(float(10**digits))
