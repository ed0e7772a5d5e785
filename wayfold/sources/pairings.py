"""Pairing tables: one row for each origin-destination run of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TYPES = {"Radius": "double", "Beta": "double", "Decay": "boolean", "Closest_destination": "boolean", "Detour": "double", "Elastic_Weights": "boolean", "Plateau": "double", "Turns": "boolean", "Turn_Threshold": "double", "Turn_Penalty": "double"}
#: Columns every table needs; those of flow tables besides.
COMMON = ("Flow_Name", "Network_File", "Network_Cost", "Origin_File", "Origin_Name", "Origin_Weight", "Destination_File", "Destination_Name", "Destination_Weight", "Radius", "Beta", "KNN_Weight", "Plateau", "Turns", "Turn_Threshold", "Turn_Penalty")
FLOW = ("Decay", "Decay_Mode", "Closest_destination", "Detour", "Elastic_Weights")


def read(spark: SparkSession, path: str, needed: tuple[str, ...] = COMMON) -> DataFrame:
    """The table with typed columns, and ``row`` from the first, unnamed column (or its order in the file).

    Names are matched without regard to case, since both spellings of some occur.
    """
    raw = spark.read.option("header", True).option("multiLine", True).csv(path)
    names = {c.lower(): c for c in raw.columns}
    known = {n.lower(): n for n in (*COMMON, *FLOW, "Exposure_Attribute")}
    missing = [n for n in needed if n.lower() not in names]
    if missing:
        raise ValueError(f"the pairing table lacks {', '.join(missing)}")
    order = F.monotonically_increasing_id()
    first = raw.columns[0]
    row = F.coalesce(F.col(f"`{first}`").try_cast("long"), order) if first.lower() not in known else order
    typed = [F.trim(F.col(f"`{names[k]}`")).try_cast(TYPES.get(n, "string")).alias(n) for k, n in known.items() if k in names]
    return raw.select(row.cast("long").alias("row"), *typed)


def changes(pairings: DataFrame) -> DataFrame:
    """Marks rows before which the streets are read (``new_streets``) or their network is built anew (``new_network``)."""
    order = Window.orderBy("row")  # a table of runs, one row each
    differs = lambda c: ~F.col(c).eqNullSafe(F.lag(c).over(order)) | (F.row_number().over(order) == 1)
    out = pairings.withColumn("new_streets", differs("Network_File"))
    return out.withColumn("new_network", F.col("new_streets") | differs("Network_Cost"))
