"""Street network construction: costs, nodes, redundant edges, tags, attachments and chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators.ordering import running
from wayfold.session import Scratch

LEAST_COST = 0.01


def street_cost(length: Column, attribute: Column | None = None) -> Column:
    """An edge's cost: its length where the attribute is missing or 0, else the attribute, at least 0.01."""
    if attribute is None:
        return length
    return F.when(attribute.isNull() | (attribute == 0), length).otherwise(F.greatest(attribute, F.lit(LEAST_COST)))


def exact_nodes(ends: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct end points (x, y) with ``node_id`` by rank of x, then y, and ``degree``."""
    points = ends.groupBy("x", "y").agg(F.count(F.lit(1)).alias("degree"))
    return running(points, ["x", "y"], F.lit(1), "node_id", scratch)


def _pair():
    return F.least("s", "e"), F.greatest("s", "e")


def _by_weight():
    return Window.partitionBy(*_pair()).orderBy("w", "street_id")


def discard_redundant(streets: DataFrame) -> DataFrame:
    """The lightest street between each pair of nodes; self-loops go."""
    return streets.filter("s <> e").withColumn("_rn", F.row_number().over(_by_weight())).filter("_rn = 1").drop("_rn")


def split_redundant(streets: DataFrame, last_node: int, last_street: int) -> DataFrame:
    """Keep the lightest of parallel streets; cut each other one at a new node in its middle.

    New ids follow the last ones and are made from the street's own id, so no global order is needed.
    """
    ranked = streets.withColumn("_rn", F.row_number().over(_by_weight()))
    middle, first = F.lit(last_node + 1) + F.col("street_id"), F.lit(last_street + 1) + 2 * F.col("street_id")
    half_w, half_len = (F.col("w") / 2).alias("w"), (F.col("len") / 2).alias("len")
    parent = F.col("street_id").alias("parent_id")
    whole = F.array(F.struct(F.col("street_id").alias("edge_id"), parent, "s", "e", "w", "len"))
    halves = F.array(
        F.struct(first.alias("edge_id"), parent, F.col("s").alias("s"), middle.alias("e"), half_w, half_len),
        F.struct((first + 1).alias("edge_id"), parent, middle.alias("s"), F.col("e").alias("e"), half_w, half_len),
    )
    return ranked.select(F.inline(F.when(F.col("_rn") == 1, whole).otherwise(halves)))


def keep_redundant(streets: DataFrame) -> DataFrame:
    """All streets stay; of parallel ones the last inserted is the one that routes use."""
    return streets.withColumn("used", F.max("street_id").over(Window.partitionBy(*_pair())) == F.col("street_id"))


def tag_edges(streets: DataFrame, tolerance: float, kind: Column | None = None) -> DataFrame:
    """Quality tags by cost: redundant, shorter than the tolerance, within three times it, cycle, bad geometry, or none.

    The first that holds counts; ``kind`` is the geometry's kind, if not all are lines.
    """
    tag = (
        F.when(F.count(F.lit(1)).over(Window.partitionBy(*_pair())) > 1, "redundant_edge")
        .when(F.col("w") < tolerance, "shorter than tolerance")
        .when(F.col("w") < 3 * tolerance, "within 3x tolerance")
        .when(F.col("s") == F.col("e"), "cycle_edge")
        .when(F.lit("LineString") != (kind if kind is not None else F.lit("LineString")), "bad_geometry_type")
        .otherwise("")
    )
    return streets.withColumn("tag", tag)


def attach(features: DataFrame) -> DataFrame:
    """Offsets of features at the share ``part`` along their edge: w_s from its start, w_e from its end."""
    offset = F.col("w") * F.col("part")
    return features.select("id", "edge_id", "s", "e", offset.alias("w_s"), (F.col("w") - offset).alias("w_e"), "wt")


def edge_chain(attached: DataFrame, key: str) -> DataFrame:
    """Features of an edge in order from its start, each with the cost from the one before (or the start)."""
    order = Window.partitionBy("edge_id").orderBy("w_s", key)
    return attached.select("edge_id", key, F.row_number().over(order).alias("place"), (F.col("w_s") - F.coalesce(F.lag("w_s").over(order), F.lit(0.0))).alias("gap"))


def arcs(edges: DataFrame) -> DataFrame:
    """Both directions of every edge: src, dst, edge_id, w. An edge without a cost is no way."""
    w = F.greatest("w", F.lit(0.0)).alias("w")
    there = F.struct(F.col("s").alias("src"), F.col("e").alias("dst"), "edge_id", w)
    back = F.struct(F.col("e").alias("src"), F.col("s").alias("dst"), "edge_id", w)
    return edges.where("w is not null").select(F.inline(F.array(there, back)))


def entries(attached: DataFrame, key: str) -> DataFrame:
    """The two ends of each feature's edge with the cost to reach them."""
    start = F.struct(F.col(key), F.col("s").alias("node"), F.col("w_s").alias("cost"), "edge_id")
    end = F.struct(F.col(key), F.col("e").alias("node"), F.col("w_e").alias("cost"), "edge_id")
    return attached.select(F.inline(F.array(start, end)))


def within_tolerance(points: DataFrame, tolerance: float) -> DataFrame:
    """Pairs a < b of points (id, x, y) at most ``tolerance`` apart, found through grid cells of that size.

    The join is dealt out by cell: sizes estimated from compressed files miss that one side holds every point
    nine times, and would have the driver broadcast it.
    """
    cell = lambda c: F.floor(F.col(c) / tolerance)
    near = points.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x").alias("cx"), cell("y").alias("cy"))
    around = F.array(*[F.struct((cell("x") + i).alias("cx"), (cell("y") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    far = points.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.inline(around))
    gap = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    return near.join(far.hint("merge"), ["cx", "cy"]).filter("a < b").select("a", "b", gap.alias("gap")).filter(F.col("gap") <= tolerance)
