"""Accessibility of origins from the distances (oid, did, dist) to destinations with weight ``wt``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_weights(pairs: DataFrame, destinations: DataFrame) -> DataFrame:
    return pairs.join(destinations.select("did", "wt"), "did")


def reach(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("oid").agg(F.sum("wt").alias("reach"))


def gravity(pairs: DataFrame, beta: float, alpha: float = 1) -> DataFrame:
    """Sum of wt^alpha / e^(beta * dist)."""
    return pairs.groupBy("oid").agg(F.sum(F.pow("wt", F.lit(float(alpha))) * F.exp(-beta * F.col("dist"))).alias("gravity"))


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest destinations of each origin, ties to the smaller id, with their rank."""
    order = Window.partitionBy("oid").orderBy("dist", "did")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def knn_access(pairs: DataFrame, weights: list[float], beta: float, plateau: float) -> DataFrame:
    """Sum over the nearest destinations of their rank's weight, decayed beyond the plateau."""
    share = F.element_at(F.array(*map(F.lit, weights)), F.col("rank"))
    decay = F.when(F.col("dist") < plateau, 1.0).otherwise(F.exp(-beta * (F.col("dist") - plateau)))
    return nearest(pairs, len(weights)).groupBy("oid").agg(F.sum(share * decay).alias("knn_access"))


def closest_destination(pairs: DataFrame) -> DataFrame:
    """One destination per origin, ties to the smaller id; partial minima, no window."""
    best = F.min(F.struct("dist", "did")).alias("best")
    return pairs.groupBy("oid").agg(best).select("oid", "best.did", "best.dist")


def closest_facility(pairs: DataFrame) -> DataFrame:
    """The origin that serves each destination, ties to the smaller id."""
    best = F.min(F.struct("dist", "oid")).alias("best")
    return pairs.groupBy("did").agg(best).select("did", "best.oid", "best.dist")


def on_origins(origins: DataFrame, metric: DataFrame, *names: str, decimals: int = 6) -> DataFrame:
    """Every origin with its metrics, 0 where it reaches nothing."""
    value = lambda n: F.round(F.coalesce(n, F.lit(0.0)), decimals).alias(n)
    return origins.select("oid").join(metric, "oid", "left").select("oid", *[value(n) for n in names])


def normalised(df: DataFrame, value: Column, name: str) -> DataFrame:
    """(value - min) / (max - min); one aggregated row reaches the driver."""
    low, high = df.agg(F.min(value), F.max(value)).first()
    scale = (value - F.lit(low)) / F.lit(high - low) if low is not None and high > low else F.lit(0.0)
    return df.withColumn(name, scale)
