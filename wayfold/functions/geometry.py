"""Planar geometry as column expressions.

A polyline is array<struct<x, y>>. A geometry is struct<type, parts>: its kind and its parts, each a
polyline: one point to a part for points, one line to a part for lines, one ring to a part for
polygons. Coordinates are planar, in the units of their layer; further dimensions are left out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
GEOMETRY = f"struct<type:string,parts:array<array<{POINT}>>>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def geometry(kind: str | Column, parts: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("type"), parts.alias("parts"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once: without it, nested expressions would grow without measure."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _distance(a: Column, b: Column) -> Column:
    return _let(F.struct((a["x"] - b["x"]).alias("x"), (a["y"] - b["y"]).alias("y")), lambda v: F.sqrt(v["x"] * v["x"] + v["y"] * v["y"]))


def _legs(coords: Column) -> Column:
    """The segments of a polyline: their ends and length."""

    def made(c: Column) -> Column:
        n = F.greatest(F.size(c) - 1, F.lit(0))
        return F.zip_with(F.slice(c, F.lit(1), n), F.slice(c, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b"), _distance(a, b).alias("size")))

    return _let(coords, made)


def segments(geom: Column) -> Column:
    """All segments (a, b, size) of a geometry; a part of one point is a segment without length."""
    one = lambda p: F.array(F.struct(p[0].alias("a"), p[0].alias("b"), F.lit(0.0).alias("size")))
    return F.flatten(F.transform(F.filter(geom["parts"], lambda p: F.size(p) > 0), lambda p: F.when(F.size(p) == 1, one(p)).otherwise(_legs(p))))


def line(geom: Column) -> Column:
    """The first part of a geometry as a polyline."""
    return F.get(geom["parts"], F.lit(0))


def length(coords: Column) -> Column:
    """Planar length; a point or an empty line has none."""
    return F.aggregate(_legs(coords), F.lit(0.0), lambda total, leg: total + leg["size"])


def size(geom: Column) -> Column:
    """Length of all parts together."""
    return F.aggregate(geom["parts"], F.lit(0.0), lambda total, part: total + length(part))


def end_points(coords: Column) -> tuple[Column, Column]:
    return F.try_element_at(coords, F.lit(1)), F.try_element_at(coords, F.lit(-1))


def _between(a: Column, b: Column, t: Column) -> Column:
    return _let(t, lambda t: point(a["x"] + t * (b["x"] - a["x"]), a["y"] + t * (b["y"] - a["y"])))


def interpolate(coords: Column, distance: Column) -> Column:
    """The point at ``distance`` along a polyline, kept within its ends."""
    start = F.struct(distance.cast("double").alias("left"), F.lit(None).cast(POINT).alias("at"))

    def walk(state, leg):
        inside = state["left"] <= leg["size"]
        t = F.when(leg["size"] > 0, F.greatest(state["left"], F.lit(0.0)) / leg["size"]).otherwise(0.0)
        here = F.when(state["at"].isNull() & inside, _between(leg["a"], leg["b"], t)).otherwise(state["at"])
        return F.struct((state["left"] - leg["size"]).alias("left"), here.alias("at"))

    return _let(coords, lambda c: F.coalesce(F.aggregate(_legs(c), start, walk)["at"], F.try_element_at(c, F.lit(-1))))


def midpoint(coords: Column) -> Column:
    return _let(coords, lambda c: interpolate(c, length(c) / 2))


def _share_on(p: Column, a: Column, b: Column) -> Column:
    """Where on a-b, 0 to 1, the point nearest to p lies."""

    def share(d: Column) -> Column:
        t = ((p["x"] - a["x"]) * d["x"] + (p["y"] - a["y"]) * d["y"]) / d["n"]
        return F.when(d["n"] > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))).otherwise(0.0)

    step = F.struct((b["x"] - a["x"]).alias("x"), (b["y"] - a["y"]).alias("y"))
    return _let(_let(step, lambda d: F.struct(d["x"].alias("x"), d["y"].alias("y"), (d["x"] * d["x"] + d["y"] * d["y"]).alias("n"))), share)


def point_to_segment(p: Column, a: Column, b: Column) -> Column:
    """Distance of a point from a segment."""
    return _let(_between(a, b, _share_on(p, a, b)), lambda q: _distance(p, q))


def segment_distance(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Distance between segments a-b and c-d; 0 where they cross."""
    side = lambda p, q, r: (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])
    cross = (side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)
    return F.when(cross, 0.0).otherwise(F.least(point_to_segment(a, c, d), point_to_segment(b, c, d), point_to_segment(c, a, b), point_to_segment(d, a, b)))


def project(coords: Column, p: Column) -> Column:
    """How far along a polyline the point nearest to p lies; the first of several."""
    start = F.struct(F.lit(0.0).alias("before"), F.lit(float("inf")).alias("gap"), F.lit(0.0).alias("along"))

    def walk(state, leg):
        t = _share_on(p, leg["a"], leg["b"])
        found = _let(t, lambda t: F.struct(_distance(p, _between(leg["a"], leg["b"], t)).alias("gap"), (state["before"] + t * leg["size"]).alias("along")))
        closest = _let(found, lambda n: F.when(n["gap"] < state["gap"], n).otherwise(F.struct(state["gap"].alias("gap"), state["along"].alias("along"))))
        return _let(closest, lambda n: F.struct((state["before"] + leg["size"]).alias("before"), n["gap"].alias("gap"), n["along"].alias("along")))

    return F.aggregate(_legs(coords), start, walk)["along"]


def cut(coords: Column, distance: Column) -> Column:
    """A polyline cut in two at ``distance``: struct<first, second>, the cut point in both."""
    start = F.struct(F.lit(0.0).alias("along"), F.lit(0).alias("n"))

    def count(state, leg):
        return _let(state["along"] + leg["size"], lambda along: F.struct(along.alias("along"), (state["n"] + F.when(along <= distance, 1).otherwise(0)).alias("n")))

    def parts(c: Column, m: Column) -> Column:
        first = F.concat(F.slice(c, F.lit(1), m["n"] + 1), F.array(m["at"]))
        second = F.concat(F.array(m["at"]), F.slice(c, m["n"] + 2, F.greatest(F.size(c) - m["n"] - 1, F.lit(0))))
        return F.struct(first.alias("first"), second.alias("second"))

    # n legs end before the cut
    return _let(coords, lambda c: _let(F.struct(interpolate(c, distance).alias("at"), F.aggregate(_legs(c), start, count)["n"].alias("n")), lambda m: parts(c, m)))


def centroid(geom: Column) -> Column:
    """Mean of points; of lines (and of rings, which stand for polygons) the mean of their legs' middles by length."""
    none = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(s: Column, n: Column, x: Column, y: Column) -> Column:
        return F.struct((s["n"] + n).alias("n"), (s["x"] + n * x).alias("x"), (s["y"] + n * y).alias("y"))

    lines = F.aggregate(segments(geom), none, lambda s, leg: add(s, leg["size"], (leg["a"]["x"] + leg["b"]["x"]) / 2, (leg["a"]["y"] + leg["b"]["y"]) / 2))
    points = F.aggregate(F.flatten(geom["parts"]), none, lambda s, p: add(s, F.lit(1.0), p["x"], p["y"]))
    by_length = _let(lines, lambda s: F.when(~geom["type"].isin("Point", "MultiPoint") & (s["n"] > 0), s))
    return _let(F.coalesce(by_length, points), lambda s: F.when(s["n"] > 0, point(s["x"] / s["n"], s["y"] / s["n"])))


def bearing(a: Column, b: Column) -> Column:
    """Clockwise angle from north, 0 to 2 pi; 0 for one point."""
    return F.pmod(F.atan2(b["x"] - a["x"], b["y"] - a["y"]), F.lit(2 * 3.141592653589793))


def turn_angle(a: Column, b: Column, c: Column) -> Column:
    """How far the way a-b-c bends at b: whole degrees, folded to 0..90."""
    back, on = F.degrees(F.atan2(a["y"] - b["y"], a["x"] - b["x"])), F.degrees(F.atan2(c["y"] - b["y"], c["x"] - b["x"]))
    bend = F.abs(180 - F.rint(F.pmod(on - back, F.lit(360.0))))
    return F.when(bend > 90, 180 - bend).otherwise(bend)


def clip_span(a: Column, b: Column, hull: Column) -> Column:
    """The part of segment a-b inside a convex polygon (corners counter-clockwise): struct<t0, t1>, null if none."""
    corners = F.concat(hull, F.slice(hull, 1, 1))
    inward = lambda p, q, r: (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])
    start = F.struct(F.lit(0.0).alias("t0"), F.lit(1.0).alias("t1"))

    def bound(state, side):
        at = F.struct(inward(side["a"], side["b"], a).alias("u"), inward(side["a"], side["b"], b).alias("v"))

        def narrowed(w):
            u, v = w["u"], w["v"]
            t0 = F.when((u < 0) & (v < 0), 2.0).when(u < 0, F.greatest(state["t0"], u / (u - v))).otherwise(state["t0"])
            t1 = F.when((u >= 0) & (v < 0), F.least(state["t1"], u / (u - v))).otherwise(state["t1"])
            return F.struct(t0.alias("t0"), t1.alias("t1"))

        return _let(at, narrowed)

    return _let(F.aggregate(_legs(corners), start, bound), lambda span: F.when((F.size(hull) >= 3) & (span["t0"] < span["t1"]), span))


def mercator_to_degrees(p: Column) -> Column:
    """A point of the spherical web map projection as longitude and latitude."""
    r = 6378137.0  # fixed: the sphere's radius
    return point(F.degrees(p["x"] / r), F.degrees(2 * F.atan(F.exp(p["y"] / r)) - F.lit(3.141592653589793 / 2)))
