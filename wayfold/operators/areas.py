"""Service areas: hulls of what origins reach, and the streets inside them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from wayfold.functions import geometry as G
from wayfold.session import prepare


def corners(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the convex hull counter-clockwise from the leftmost, lowest one; points on a side are no corners."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def chain(ordered):
        out: list[tuple[float, float]] = []
        for p in ordered:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(points) + chain(reversed(points))


def hulls(points: DataFrame, key: str) -> DataFrame:
    """(key, hull): corners of the convex hull of the points (key, x, y) of each key.

    Each task first reduces its share of a key's points to their hull, so what meets in one place is corners only.
    """
    prepare(points.sparkSession)

    @pandas_udf(f"array<{G.POINT}>")
    def hull(points: pd.Series) -> pd.Series:
        return points.map(lambda ps: [{"x": x, "y": y} for x, y in corners([(p["x"], p["y"]) for p in ps])])

    spread = points.where("x is not null and y is not null").withColumn("_deal", F.pmod(F.xxhash64("x", "y"), F.lit(16)))
    part = spread.groupBy(key, "_deal").agg(F.collect_set(F.struct("x", "y")).alias("_points"))
    part = part.select(key, hull("_points").alias("_points"))
    whole = part.groupBy(key).agg(F.flatten(F.collect_list("_points")).alias("_points"))
    return whole.select(key, hull("_points").alias("hull"))


def dead_ends(arcs: DataFrame) -> DataFrame:
    """Nodes (node) that one way only leads to."""
    return arcs.groupBy(F.col("src").alias("node")).agg(F.count_distinct("dst").alias("_ways")).where("_ways < 2").select("node")


def areas(reached: DataFrame, nodes: DataFrame, arcs: DataFrame, served: DataFrame) -> DataFrame:
    """(oid, hull, network_hull): hulls of the destinations and of the street nodes that each origin reaches.

    ``reached`` is (oid, node, cost), ``served`` (oid, x, y) the destinations' points; origins without any have no
    area. Tips of dead ends belong to no area.
    """
    inner = reached.join(dead_ends(arcs), "node", "left_anti").join(nodes.select("node", "x", "y"), "node")
    mine = hulls(served.select("oid", "x", "y"), "oid")
    return mine.join(hulls(inner.select("oid", "x", "y"), "oid").withColumnRenamed("hull", "network_hull"), "oid", "left")


def clipped(areas: DataFrame, edges: DataFrame, side: float) -> DataFrame:
    """Street pieces (oid, edge_id, a, b) inside the union of each area's two hulls.

    Edges are (edge_id, coords). Areas and street segments meet by cells of ``side``, so each area is compared with the
    streets around it only. Pieces inside both hulls come once.
    """
    hull, more = F.col("hull"), F.coalesce("network_hull", F.array().cast(f"array<{G.POINT}>"))
    both = areas.select("oid", hull.alias("h1"), more.alias("h2"), F.concat(hull, more).alias("_all"))
    low = lambda c: F.array_min(F.transform("_all", lambda p: p[c]))
    high = lambda c: F.array_max(F.transform("_all", lambda p: p[c]))
    low_h = lambda c: F.least(F.array_min(F.transform("h1", lambda p: p[c])), F.array_min(F.transform("h2", lambda p: p[c])))
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / side), F.floor(b / side)))
    both = both.withColumn("cx", cells(low("x"), high("x"))).withColumn("cy", cells(low("y"), high("y"))).drop("_all")
    legs = edges.select("edge_id", F.posexplode(G.segments(G.geometry("LineString", F.array("coords")))).alias("n", "leg"))
    ends = lambda c, f: f(F.col(f"leg.a.{c}"), F.col(f"leg.b.{c}"))
    legs = legs.withColumn("cx", cells(ends("x", F.least), ends("x", F.greatest))).withColumn("cy", cells(ends("y", F.least), ends("y", F.greatest)))
    a, b = F.col("leg.a"), F.col("leg.b")
    met = legs.join(both, ["cx", "cy"])
    # A segment and an area may share several cells: the least one they share speaks for them.
    corner = lambda c: F.greatest(F.floor(low_h(c) / side), F.floor(ends(c, F.least) / side))
    met = met.where((F.col("cx") == corner("x")) & (F.col("cy") == corner("y")))
    spans = met.select("oid", "edge_id", "n", "leg", G.clip_span(a, b, F.col("h1")).alias("s1"), G.clip_span(a, b, F.col("h2")).alias("s2"))
    apart = F.col("s1").isNotNull() & F.col("s2").isNotNull() & ((F.col("s1.t1") < F.col("s2.t0")) | (F.col("s2.t1") < F.col("s1.t0")))
    union = F.struct(F.least("s1.t0", "s2.t0").alias("t0"), F.greatest("s1.t1", "s2.t1").alias("t1"))
    kept = F.when(apart, F.array("s1", "s2")).when(F.col("s1").isNotNull() | F.col("s2").isNotNull(), F.array(union))
    at = lambda t: G._between(a, b, t)
    return spans.select("oid", "edge_id", "n", "leg", F.inline(kept)).select("oid", "edge_id", "n", at(F.col("t0")).alias("a"), at(F.col("t1")).alias("b"))

