"""Trip flows over simple paths: destination choice, decay, path choice, exposure and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators import access, search


def huff(pairs: DataFrame, beta: float) -> DataFrame:
    """Probability ``p_dest`` of each destination; origins whose destinations all weigh 0 go."""
    pull = F.col("wt") * F.exp(-beta * F.col("dist"))
    total = F.sum("pull").over(Window.partitionBy("oid"))
    return pairs.withColumn("pull", pull).withColumn("total", total).filter("total > 0").withColumn("p_dest", F.col("pull") / F.col("total")).drop("pull", "total")


def path_choice(paths: DataFrame, beta: float, method: str = "equal") -> DataFrame:
    """Probability ``p_path`` of each path of a pair: equal, exponent or power."""
    pull = {"equal": F.lit(1.0), "exponent": F.exp(-beta * F.col("cost")), "power": F.pow("cost", F.lit(-2.0))}[method]
    return paths.withColumn("pull", pull).withColumn("p_path", F.col("pull") / F.sum("pull").over(Window.partitionBy("oid", "did"))).drop("pull")


def taken(paths: DataFrame, chosen: DataFrame, pairs: DataFrame, origins: DataFrame, beta: float, decay: str | None = None, choice: str = "equal") -> DataFrame:
    """Paths with the people who take them (``flow``) and the factors p_path, p_dest, decay and owt.

    ``chosen`` gives the pairs (oid, did, p_dest) that trips are made between, ``pairs`` all within reach: exponential decay goes
    by the nearest of these. Origins of weight 0 make no trips.
    """
    nearest = pairs.groupBy("oid").agg(F.min("dist").alias("nearest"))
    owt = origins.filter("wt <> 0").select("oid", F.col("wt").alias("owt"))
    out = path_choice(paths, beta, choice).join(chosen.select("oid", "did", "p_dest"), ["oid", "did"]).join(nearest, "oid").join(owt, "oid")
    factor = {None: F.lit(1.0), "exponent": F.exp(-beta * F.col("nearest")), "power": F.pow("cost", F.lit(-2.0))}[decay]
    return out.withColumn("decay", factor).withColumn("flow", F.col("p_path") * F.col("p_dest") * F.col("decay") * F.col("owt"))


def trips(paths: DataFrame, pairs: DataFrame, origins: DataFrame, beta: float, closest: bool, decay: str | None = None, choice: str = "equal") -> DataFrame:
    """``taken`` to the closest destination of each origin, or to all of them with Huff probabilities."""
    chosen = access.closest_destination(pairs).withColumn("p_dest", F.lit(1.0)) if closest else huff(pairs, beta)
    return taken(paths, chosen, pairs, origins, beta, decay, choice)


def betweenness(taken: DataFrame) -> DataFrame:
    """Flow over each edge."""
    return search.path_edges(taken.select("flow", "path")).groupBy("edge_id").agg(F.sum("flow").alias("betweenness"))


def origin_stats(taken: DataFrame) -> DataFrame:
    """Trip statistics of each origin."""
    p = F.col("p_path") * F.col("p_dest")
    return taken.groupBy("oid").agg(
        F.sum(p * F.col("cost")).alias("mean_path_length"),
        F.sum(p * F.col("decay") * F.col("cost")).alias("probable_travel_distance"),
        F.min("dist").alias("closest_destination"),
        F.max("dist").alias("furthest_destination"),
        F.count(F.lit(1)).alias("paths"),
        F.count_distinct("did").alias("destinations"),
    )


def diagnostics(taken: DataFrame, chosen: DataFrame) -> DataFrame:
    """What is known of each origin's trips."""
    p = F.col("p_path") * F.col("p_dest")
    ways = taken.groupBy("oid").agg(
        F.sum(p * F.col("cost")).alias("mean_path_length"),
        F.sum(p * F.col("decay") * F.col("cost")).alias("probable_travel_distance"),
        F.count("*").alias("path_count"),
        F.sum(F.size("path")).alias("path_segment_count"),
    )
    ends = chosen.groupBy("oid").agg(F.min("dist").alias("closest_destination_distance"), F.max("dist").alias("furthest_destination_distance"), F.count("*").alias("eligible_destinations"))
    return ends.join(ways, "oid", "left")


def path_exposure(taken: DataFrame, edges: DataFrame) -> DataFrame:
    """Cost-weighted mean of an edge attribute ``a`` along each path, summed to origins by probability."""
    steps = search.path_edges(taken).join(edges.select("edge_id", "w", "a"), "edge_id")
    means = steps.groupBy("oid", "did", "path_no").agg(
        (F.sum(F.col("w") * F.col("a")) / F.sum("w")).alias("mean"),
        *[F.first(c).alias(c) for c in ("cost", "p_path", "p_dest", "decay")],
    )
    p = F.col("p_path") * F.col("p_dest") * F.col("mean")
    return means.groupBy("oid").agg(F.sum(p).alias("exposure"), F.sum(p * F.col("decay")).alias("decayed_exposure"), F.sum(p * F.col("cost")).alias("hazard_meters"), F.sum(p * F.col("decay") * F.col("cost")).alias("decayed_hazard_meters"))


def error_summary(simulated: DataFrame, golden: DataFrame, key: str, thresholds: tuple[float, ...] = (0.1, 1.0, 3.0, 5.0)) -> DataFrame:
    """How far simulated flows are from given ones, segment by segment, in percent of the simulated flow.

    Every simulated segment takes part in the sums; one where nothing is simulated or given has no error. A given flow
    over a segment without simulated flow is infinitely far off.
    """
    both = simulated.select(key, F.col("betweenness").alias("s")).join(golden.select(key, F.col("betweenness").alias("g")), key, "left")
    off = F.abs(F.col("s") - F.col("g"))
    gap = F.when(F.col("s") != 0, off / F.abs("s") * 100).when(off > 0, float("inf"))
    rows = both.withColumn("gap", gap)
    over = [F.count_if(F.col("gap") > t).alias(f"over_{t:g}".replace(".", "_")) for t in thresholds]
    return rows.agg(F.sum("s").alias("flow_sum"), F.sum("g").alias("golden_sum"), F.avg("gap").alias("mean_error"), F.median("gap").alias("median_error"), F.max("gap").alias("max_error"), *over)
