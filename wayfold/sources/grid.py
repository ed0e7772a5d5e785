"""A street grid over the ``part``, ``customer`` and ``supplier`` tables.

Nodes are parts on a square grid 100 units apart, costs are integers and attachments sit at eighths
of an edge, so sums are exact in any order.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators import network
from wayfold.operators.ordering import running
from wayfold.session import Scratch, table

STEP = 100.0


class Grid:
    """The streets of one data folder and the features attached to them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.scratch = spark, sf_dir, Scratch(spark)
        self.n = table(spark, sf_dir, "part").count()  # answered by the file footers
        self.g = math.isqrt(self.n - 1) + 1 if self.n else 0

    def cells(self) -> DataFrame:
        gx = F.col("node") % self.g
        parts = table(self.spark, self.sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_size").cast("bigint").alias("p_size"))
        return parts.withColumn("gx", gx).withColumn("gy", F.expr(f"node div {max(self.g, 1)}"))

    def nodes(self) -> DataFrame:
        return self.cells().select("node", (F.col("gx") * STEP).alias("x"), (F.col("gy") * STEP).alias("y"))

    def streets(self) -> DataFrame:
        """street_id, s, e, cost, len: eastward and northward streets, some parallel ones and self-loops."""
        node, size = F.col("node"), F.col("p_size")
        east, north = (F.col("gx") + 1 < self.g) & (node + 1 < self.n), node + self.g < self.n

        def street(kind, there, s, e, cost, length):
            fields = (4 * node + kind).alias("street_id"), s.alias("s"), e.alias("e"), cost.cast("bigint").alias("cost"), F.lit(length).alias("len")
            return F.when(there, F.struct(*fields))

        kinds = F.array(
            street(0, east, node, node + 1, 50 + size, STEP),
            street(1, north, node, node + self.g, 50 + (7 * size) % 50, STEP),
            street(2, east & (node % 50 == 0), node + 1, node, 63 + size, STEP),
            street(3, node % 97 == 0, node, node, F.lit(40), 40.0),
        )
        return self.cells().select(F.inline(F.array_compact(kinds)))

    def edges(self) -> DataFrame:
        """The network's edges, lightest of each pair, numbered by ``seq`` in order of their id."""
        edges = network.discard_redundant(self.streets().select("street_id", "s", "e", F.col("cost").cast("double").alias("w"), "len"))
        return self.scratch.keep(running(edges.withColumnRenamed("street_id", "edge_id"), ["edge_id"], F.lit(1), "seq", self.scratch))

    def _attached(self, edges: DataFrame, name: str, key: str, factor: int, classes: int) -> DataFrame:
        m = max(edges.count(), 1)
        k = F.col(key)
        features = table(self.spark, self.sf_dir, name).select(k.alias("id"), ((k * factor) % m).alias("seq"), ((k % 7 + 1) / 8).alias("part"), (k % classes).cast("double").alias("wt"))
        return network.attach(features.join(edges, "seq"))

    def origins(self, edges: DataFrame) -> DataFrame:
        return self._attached(edges, "customer", "c_custkey", 7919, 4).withColumnRenamed("id", "oid")

    def destinations(self, edges: DataFrame) -> DataFrame:
        return self._attached(edges, "supplier", "s_suppkey", 104729, 5).withColumnRenamed("id", "did")
