"""Queries on a town of bent streets: topology, features on edges, and the analysis tools end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold import tools, workflows
from wayfold.functions import geometry as G
from wayfold.operators import areas, search, topology
from wayfold.sources.town import Town
from wayfold.workspace import Workspace

RADIUS, BETA, DETOUR, NEAR, APART = 400.0, 0.003, 1.15, 1.0, 0.5
KNN, PLATEAU = "[.5, .25, .15, .1]", 100.0


#: The last town that was made ready: its network serves all queries on it.
_made: dict[tuple[str, str], Workspace] = {}


def ready(spark, sf_dir) -> Workspace:
    """The town as a workspace: streets, homes as origins and shops as destinations on its network."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _made:
        town, w = Town(spark, sf_dir), Workspace(spark)
        line = G.geometry("LineString", F.array("coords"))
        w.load_layer("streets", town.streets().select(F.col("street_id").alias("id"), F.col("w").alias("cost"), (F.col("street_id") % 11).cast("double").alias("heat"), line.alias("geometry")))
        w.create_street_network("streets", "cost", NEAR)
        w.load_layer("homes", town.homes())
        w.load_layer("shops", town.shops())
        w.insert_node("homes", "origin", "wt")
        w.insert_node("shops", "destination", "wt")
        w.create_graph()
        _made.clear()
        _made[key] = w
    return _made[key].copy()


def _rounded(df, *names, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


def edge_endpoints(spark, sf_dir):
    town = Town(spark, sf_dir)
    return topology.exact(town.streets(), town.scratch)[1].select("street_id", "s", "e")


def nodes_tolerance(spark, sf_dir):
    town = Town(spark, sf_dir)
    return topology.within(town.streets(), APART, town.scratch)[0]


def edges_snapped(spark, sf_dir):
    town = Town(spark, sf_dir)
    edges = topology.within(town.streets(), APART, town.scratch)[1]
    a, b = G.end_points(F.col("coords"))
    return edges.select("street_id", "s", "e", a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"), F.round("len", 6).alias("len"), "snapped", F.round("snapping_distance", 6).alias("snapping_distance"))


def split_nodes(spark, sf_dir):
    town = Town(spark, sf_dir)
    nodes = topology.split(*topology.within(town.streets(), NEAR, town.scratch), town.scratch)[0]
    return _rounded(nodes, "x", "y")


def split_lines(spark, sf_dir):
    town = Town(spark, sf_dir)
    edges = topology.split(*topology.within(town.streets(), NEAR, town.scratch), town.scratch)[1]
    return edges.select("edge_id", "parent_id", "s", "e", F.round("w", 6).alias("w"), F.round(G.length(F.col("coords")), 6).alias("drawn"))


def insert_node(spark, sf_dir):
    placed = ready(spark, sf_dir).network.features("origin")
    return _rounded(placed.select("source_id", "edge_id", "s", "e", "w_s", "w_e", "wt", F.col("at.x").alias("x"), F.col("at.y").alias("y")), "w_s", "w_e", "x", "y")


def connectors(spark, sf_dir):
    w = ready(spark, sf_dir)
    line = G.line(F.col("geometry"))
    return workflows.connectors(w, "origin", "homes").select("id", F.round(G.length(line), 6).alias("length"))


def tool_accessibility(spark, sf_dir):
    w = ready(spark, sf_dir)
    tools.accessibility(w, RADIUS, beta=BETA, save_reach_as="reach", save_gravity_as="gravity", knn_weights=KNN, knn_plateau=PLATEAU, save_knn_access_as="knn")
    return _rounded(w["homes"].df.select("id", "reach", "gravity", "knn"), "reach", "gravity", "knn")


def tool_accessibility_weight(spark, sf_dir):
    w = ready(spark, sf_dir)
    w["shops"].df = w["shops"].df.withColumn("jobs", F.when(F.col("id") % 3 > 0, (F.col("id") % 13).cast("double")))
    tools.accessibility(w, RADIUS, destination_weight="jobs", alpha=2, beta=BETA, save_reach_as="wt", save_gravity_as="gravity")
    return _rounded(w["homes"].df.select("id", F.col("wt").alias("reach"), "gravity"), "reach", "gravity")


def tool_facilities(spark, sf_dir):
    w = ready(spark, sf_dir)
    tools.accessibility(w, RADIUS, closest_facility=True, save_closest_facility_as="home", save_closest_facility_distance_as="distance")
    return _rounded(w["shops"].df.select("id", "home", "distance"), "distance")


def tool_facility_reach(spark, sf_dir):
    w = ready(spark, sf_dir)
    tools.accessibility(w, RADIUS, beta=BETA, save_reach_as="reach", save_gravity_as="gravity", closest_facility=True, save_closest_facility_as="home", save_closest_facility_distance_as="distance")
    return _rounded(w["homes"].df.select("id", "reach", "gravity"), "reach", "gravity")


def _flows(spark, sf_dir, **more):
    w = ready(spark, sf_dir)
    tools.betweenness(w, RADIUS, DETOUR, beta=BETA, save_betweenness_as="flow", save_reach_as="reach", save_gravity_as="gravity", **more)
    return w


def tool_betweenness(spark, sf_dir):
    w = _flows(spark, sf_dir, closest_destination=False, decay=True)
    return _rounded(w["streets"].df.select("id", "flow"), "flow")


def tool_betweenness_closest(spark, sf_dir):
    w = _flows(spark, sf_dir)
    return _rounded(w["streets"].df.select("id", "flow"), "flow")


def tool_betweenness_origins(spark, sf_dir):
    w = _flows(spark, sf_dir, closest_destination=False, decay=True, keep_diagnostics=True)
    stats = ["closest_destination_distance", "furthest_destination_distance", "mean_path_length", "probable_travel_distance"]
    counts = ["eligible_destinations", "path_count", "path_segment_count"]
    out = w["homes"].df.select("id", "reach", "gravity", *[F.col(f"flow_{c}").alias(c) for c in stats + counts])
    return _rounded(out, "gravity", *stats)


def tool_exposure(spark, sf_dir):
    w = _flows(spark, sf_dir, closest_destination=False, path_exposure_attribute="heat", save_path_exposure_as="exposure")
    return _rounded(w["homes"].df.select("id", "exposure"), "exposure")


def tool_elastic(spark, sf_dir):
    w = _flows(spark, sf_dir, closest_destination=False, elastic_weight=True, knn_weight=KNN, knn_plateau=PLATEAU, save_elastic_weight_as="elastic")
    return _rounded(w["homes"].df.select("id", "elastic"), "elastic")


def tool_alternative_paths(spark, sf_dir):
    """All paths of one origin, as the tool gives them; of all origins by ``alternative_paths`` on the grid."""
    w = ready(spark, sf_dir)
    first = w.network.features("origin").agg(F.min("source_id")).first()[0]
    out = tools.alternative_paths(w, first, RADIUS, DETOUR)
    return out.select("destination", F.round("distance", 6).alias("distance"), F.concat_ws(",", F.transform("edges", lambda e: e.cast("string"))).alias("edges"), F.round(G.size(F.col("geometry")), 6).alias("drawn"))


def _areas(w):
    s = w.network.streets
    origins, destinations = w.network.features("origin").withColumnRenamed("id", "oid"), w.network.features("destination").withColumnRenamed("id", "did")
    pairs = w.scratch.keep(search.distances(s, origins, destinations, RADIUS))
    reached = search.scope(s, origins.join(pairs, "oid", "left_semi"), RADIUS)
    points = w["shops"].df.select(F.col("id").alias("source_id"), F.col("geometry.parts")[0][0].alias("p"))
    served = pairs.join(destinations.select("did", "source_id"), "did").join(points, "source_id").select("oid", "p.x", "p.y")
    return w.scratch.keep(areas.areas(reached, s.nodes, search.arcs(s), served).join(origins.select("oid", "source_id"), "oid"))


def service_area_hull(spark, sf_dir):
    found = _areas(ready(spark, sf_dir))
    corner = lambda c, kind: found.select("source_id", F.lit(kind).alias("kind"), F.explode(c).alias("p"))
    return corner("hull", "destinations").unionByName(corner("network_hull", "streets")).select("source_id", "kind", "p.x", "p.y")


def service_area_streets(spark, sf_dir):
    w = ready(spark, sf_dir)
    _, pieces, _ = tools.service_area(w, RADIUS)
    return pieces.groupBy("origin_id").agg(F.round(F.sum(G.size(F.col("geometry"))), 4).alias("length"))


def service_area_tool(spark, sf_dir):
    hit, _, scopes = tools.service_area(ready(spark, sf_dir), RADIUS)
    rows = scopes.select(F.col("origin_id").alias("id"), "name")
    return rows.unionByName(hit.select("id", F.lit("destination").alias("name")))


QUERIES = (
    edge_endpoints, nodes_tolerance, edges_snapped, split_nodes, split_lines, insert_node, connectors, tool_accessibility, tool_accessibility_weight, tool_facilities, tool_facility_reach, tool_betweenness,
    tool_betweenness_closest, tool_betweenness_origins, tool_exposure, tool_elastic, tool_alternative_paths, service_area_hull, service_area_streets, service_area_tool,
)


def queries() -> dict:
    return {q.__name__: q for q in QUERIES}
