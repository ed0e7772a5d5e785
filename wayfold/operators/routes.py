"""Bounded shortest paths as relaxation rounds over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.session import Scratch


def relax(arcs: DataFrame, seeds: DataFrame, limit: float, scratch: Scratch, key: str = "oid") -> DataFrame:
    """Least cost (key, node, cost) of every node within ``limit`` of the seeds (key, node, cost).

    Each round joins the last round's improvements to the arcs (src, dst, w) and merges them into the
    known costs with one aggregation by (key, node). Rounds are written to the shared folder.
    """
    known = seeds.filter(F.col("cost") <= limit).groupBy(key, "node").agg(F.min("cost").alias("cost")).withColumn("fresh", F.lit(True))
    known = scratch.keep(known)
    while not known.filter("fresh").isEmpty():
        moved = known.filter("fresh").join(arcs.where("w is not null").select(F.col("src").alias("node"), "dst", "w"), "node")
        moved = moved.select(key, F.col("dst").alias("node"), F.lit(None).cast("double").alias("old"), (F.col("cost") + F.col("w")).alias("new")).filter(F.col("new") <= limit)
        both = known.select(key, "node", F.col("cost").alias("old"), F.lit(None).cast("double").alias("new")).unionByName(moved)
        merged = both.groupBy(key, "node").agg(F.min("old").alias("old"), F.min("new").alias("new"))
        fresh = F.coalesce(F.col("new") < F.col("old"), F.col("old").isNull())
        step = scratch.keep(merged.select(key, "node", F.least("old", "new").alias("cost"), fresh.alias("fresh")))
        scratch.drop(known)
        known = step
    return known.drop("fresh")
