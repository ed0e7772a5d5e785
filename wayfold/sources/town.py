"""A town of bent, oblique streets with ragged ends over the ``part``, ``customer`` and ``supplier`` tables.

The grid's junctions are moved off their places, every street bends in its middle, and its ends stop
a little beside the junctions, so that ends which belong together are near-coincident only. All
coordinates are multiples of an eighth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import geometry as G
from wayfold.session import table
from wayfold.sources.grid import STEP, Grid


def _wobble(key: Column, factor: int, span: int) -> Column:
    """A whole number of -(span // 2) to span // 2 that looks irregular."""
    return ((key * factor) % span - span // 2).cast("double")


class Town:
    """Streets as lines (street_id, coords, w, len) and features (id, geometry, wt) of one data folder."""

    def __init__(self, spark, sf_dir: str):
        self.grid = Grid(spark, sf_dir)
        self.spark, self.sf_dir, self.scratch = spark, sf_dir, self.grid.scratch

    def junctions(self) -> DataFrame:
        node = F.col("node")
        return self.grid.nodes().select("node", (F.col("x") + _wobble(node, 37, 41)).alias("x"), (F.col("y") + _wobble(node, 53, 37)).alias("y"))

    def streets(self) -> DataFrame:
        at = lambda n: self.junctions().select(F.col("node").alias(n), F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y"))
        lines = self.grid.streets().where("s <> e").join(at("s"), "s").join(at("e"), "e")
        k, x, y = F.col("street_id"), [], []
        for c, out, jitter, bend, span in (("x", x, (7, 13), 29, 31), ("y", y, (11, 17), 31, 29)):
            s, e = F.col(f"s{c}"), F.col(f"e{c}")
            out += [s + _wobble(k, jitter[0], 5) / 8, (s + e) / 2 + _wobble(k, bend, span), e + _wobble(k, jitter[1], 5) / 8]
        coords = F.array(*[G.point(a, b) for a, b in zip(x, y, strict=True)])
        lines = lines.select("street_id", coords.alias("coords"), F.col("cost").cast("double").alias("w"))
        return lines.withColumn("len", G.length(F.col("coords")))

    def _features(self, name: str, key: str, factors: tuple[int, int], classes: int) -> DataFrame:
        k, side = F.col(key), self.grid.g * int(STEP)
        places = [((k * f) % max(side, 1)).cast("double") for f in factors]
        geom = G.geometry("Point", F.array(F.array(G.point(*places))))
        return table(self.spark, self.sf_dir, name).select(k.alias("id"), geom.alias("geometry"), (k % classes).cast("double").alias("wt"))

    def homes(self) -> DataFrame:
        return self._features("customer", "c_custkey", (7919, 104729), 4)

    def shops(self) -> DataFrame:
        return self._features("supplier", "s_suppkey", (611953, 15485863), 5)
