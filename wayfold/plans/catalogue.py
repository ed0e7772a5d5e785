"""The query catalogue of the network engine, on the street grid over the data tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold import workflows
from wayfold.functions import geometry, styling
from wayfold.operators import access, flow, network, search, topology
from wayfold.plans import oracles, town, town_sql
from wayfold.session import table
from wayfold.sources import pairings
from wayfold.sources.grid import Grid

RADIUS, BETA, ALPHA, DETOUR = 400.0, 0.003, 2.0, 1.15
KNN, PLATEAU, TOLERANCE = [0.5, 0.25, 0.15, 0.1], 100.0, 51.0


class World:
    """Edges, features, distances and paths of one data folder, each built when first asked for."""

    def __init__(self, spark, sf_dir):
        self.grid = Grid(spark, sf_dir)
        self.scratch, self._made = self.grid.scratch, {}

    def _once(self, name, make):
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    @property
    def edges(self):
        return self._once("edges", self.grid.edges)

    @property
    def origins(self):
        return self._once("origins", lambda: self.scratch.keep(self.grid.origins(self.edges)))

    @property
    def destinations(self):
        return self._once("destinations", lambda: self.scratch.keep(self.grid.destinations(self.edges)))

    @property
    def streets(self):
        return self._once("streets", lambda: search.Streets(self.edges, self.grid.nodes(), self.scratch))

    @property
    def pairs(self):
        def make():
            return self.scratch.keep(access.with_weights(search.distances(self.streets, self.origins, self.destinations, RADIUS), self.destinations))

        return self._once("pairs", make)

    def paths(self, closest: bool, detour: float):
        chosen = access.closest_destination(self.pairs) if closest else self.pairs.select("oid", "did", "dist")
        return search.paths(self.streets, self.origins, self.destinations, chosen, detour, RADIUS)

    def trips(self, closest: bool, detour: float, decay=None, origins=None):
        return flow.trips(self.paths(closest, detour), self.pairs, self.origins if origins is None else origins, BETA, closest, decay)


def _streets(w):
    return w.grid.streets().withColumn("w", F.col("cost").cast("double"))


def street_cost_rule(spark, sf_dir):
    streets = Grid(spark, sf_dir).streets()
    attribute = F.when(F.col("street_id") % 37 == 0, 0).when(F.col("street_id") % 41 == 0, -1).otherwise(F.col("cost")).cast("double")
    return streets.select("street_id", network.street_cost(F.col("len"), attribute).alias("weight"))


def network_nodes_exact(spark, sf_dir):
    grid = Grid(spark, sf_dir)
    at, ends = grid.nodes(), grid.streets().select(F.explode(F.array("s", "e")).alias("node"))
    return network.exact_nodes(ends.join(at, "node").select("x", "y"), grid.scratch).select("node_id", "x", "y", "degree")


def edges_discard(spark, sf_dir):
    return network.discard_redundant(_streets(World(spark, sf_dir))).select("street_id", "s", "e", "w")


def edges_split(spark, sf_dir):
    w = World(spark, sf_dir)
    last = w.grid.streets().agg(F.max("street_id")).first()[0] or 0
    return network.split_redundant(_streets(w), w.grid.n - 1, last).select("edge_id", "parent_id", "s", "e", "w", "len")


def edges_keep(spark, sf_dir):
    return network.keep_redundant(_streets(World(spark, sf_dir))).select("street_id", "used")


def edge_tags(spark, sf_dir):
    return network.tag_edges(_streets(World(spark, sf_dir)), TOLERANCE).select("street_id", "tag")


def attach_origins(spark, sf_dir):
    return World(spark, sf_dir).origins.select("oid", "edge_id", "w_s", "w_e", "wt")


def attach_destinations(spark, sf_dir):
    return World(spark, sf_dir).destinations.select("did", "edge_id", "w_s", "w_e", "wt")


def edge_chain(spark, sf_dir):
    return network.edge_chain(World(spark, sf_dir).origins, "oid")


def _line(w):
    at = w.grid.nodes()
    s, e = at.select(F.col("node").alias("s"), F.struct("x", "y").alias("a")), at.select(F.col("node").alias("e"), F.struct("x", "y").alias("b"))
    return w.edges.join(s, "s").join(e, "e")


def line_length(spark, sf_dir):
    coords = F.array("a", "b")
    mid = geometry.midpoint(coords)
    return _line(World(spark, sf_dir)).select("edge_id", geometry.length(coords).alias("length"), mid["x"].alias("mid_x"), mid["y"].alias("mid_y"))


def nearest_edge(spark, sf_dir):
    w = World(spark, sf_dir)
    side, k = w.grid.g * 100, F.col("c_custkey")
    points = table(spark, sf_dir, "customer").select(k.alias("id"), ((k * 7919) % side).cast("double").alias("x"), ((k * 104729) % side).cast("double").alias("y"))
    segments = _line(w).select("edge_id", F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2"))
    points = points.select(F.col("id").alias("row"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return topology.nearest_edge(points, segments, w.scratch).withColumnRenamed("row", "id")


def endpoints_within_tolerance(spark, sf_dir):
    nodes = Grid(spark, sf_dir).nodes()
    return network.within_tolerance(nodes.select(F.col("node").alias("id"), "x", "y"), 150.0).select("a", "b", F.round("gap", 6).alias("gap"))


def od_distance(spark, sf_dir):
    return World(spark, sf_dir).pairs.select("oid", "did", "dist")


def node_scope(spark, sf_dir):
    w = World(spark, sf_dir)
    return search.scope(w.streets, w.origins, RADIUS)


def reach(spark, sf_dir):
    w = World(spark, sf_dir)
    return access.on_origins(w.origins, access.reach(w.pairs), "reach")


def gravity(spark, sf_dir):
    w = World(spark, sf_dir)
    return access.on_origins(w.origins, access.gravity(w.pairs, BETA), "gravity")


def gravity_alpha(spark, sf_dir):
    w = World(spark, sf_dir)
    return access.on_origins(w.origins, access.gravity(w.pairs, BETA, ALPHA), "gravity")


def knn_access(spark, sf_dir):
    w = World(spark, sf_dir)
    return access.on_origins(w.origins, access.knn_access(w.pairs, KNN, BETA, PLATEAU), "knn_access")


def knn_weight(spark, sf_dir):
    w = World(spark, sf_dir)
    knn = access.knn_access(w.pairs, KNN, BETA, PLATEAU).join(w.origins.select("oid", "wt"), "oid")
    return access.on_origins(w.origins, knn.withColumn("knn_weight", F.col("knn_access") * F.col("wt")), "knn_weight")


def closest_destination(spark, sf_dir):
    return access.closest_destination(World(spark, sf_dir).pairs)


def top_k_destinations(spark, sf_dir):
    return access.nearest(World(spark, sf_dir).pairs, 3).select("oid", "rank", "did", "dist")


def closest_facility(spark, sf_dir):
    return access.closest_facility(World(spark, sf_dir).pairs)


def closest_facility_reach(spark, sf_dir):
    w = World(spark, sf_dir)
    served = access.with_weights(access.closest_facility(w.pairs), w.destinations)
    return access.on_origins(w.origins, access.reach(served), "reach")


def service_area_destinations(spark, sf_dir):
    w = World(spark, sf_dir)
    return w.destinations.join(w.pairs, "did", "left_semi").select("did", "wt")


def alternative_paths(spark, sf_dir):
    paths = World(spark, sf_dir).paths(False, DETOUR)
    return paths.select("oid", "did", F.round("cost", 6).alias("cost"), F.concat_ws(",", F.transform("path", lambda e: e.cast("string"))).alias("path"))


def huff_probability(spark, sf_dir):
    return flow.huff(World(spark, sf_dir).pairs, BETA).select("oid", "did", F.round("p_dest", 6).alias("p_dest"))


def _flow(closest, detour, decay):
    def query(spark, sf_dir):
        return flow.betweenness(World(spark, sf_dir).trips(closest, detour, decay)).select("edge_id", F.round("betweenness", 6).alias("betweenness"))

    return query


def betweenness_elastic(spark, sf_dir):
    w = World(spark, sf_dir)
    knn = access.knn_access(w.pairs, KNN, BETA, 0.0)
    origins = w.origins.join(knn, "oid").withColumn("wt", F.col("knn_access") * F.col("wt"))
    return flow.betweenness(w.trips(False, 1.0, None, origins)).select("edge_id", F.round("betweenness", 6).alias("betweenness"))


def betweenness_origin_stats(spark, sf_dir):
    stats = flow.origin_stats(World(spark, sf_dir).trips(False, DETOUR, "exponent"))
    return stats.select("oid", *[F.round(c, 6).alias(c) for c in ("mean_path_length", "probable_travel_distance")], "closest_destination", "furthest_destination", "paths", "destinations")


def path_exposure(spark, sf_dir):
    w = World(spark, sf_dir)
    out = flow.path_exposure(w.trips(False, DETOUR, "exponent"), w.edges.withColumn("a", (F.col("edge_id") % 11).cast("double")))
    return out.select("oid", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


def turn_penalty_distance(spark, sf_dir):
    w = World(spark, sf_dir)
    return search.distances(w.streets, w.origins, w.destinations, RADIUS, search.Turns())


def _painted(df, *names):
    return df.select("p_partkey", *[F.round(F.col("color")[k], 6).alias(n) for k, n in enumerate(names)])


def color_gradient(spark, sf_dir):
    return _painted(styling.color(table(spark, sf_dir, "part"), Grid(spark, sf_dir).scratch, "p_size", "gradient"), "red", "green", "blue")


def color_quantile(spark, sf_dir):
    return _painted(styling.color(table(spark, sf_dir, "part"), Grid(spark, sf_dir).scratch, "p_size", "quantile"), "red", "green", "blue")


def color_categorical(spark, sf_dir):
    given = {1: [10, 20, 30], 2: [40, 50, 60], styling.OTHER: [7, 8, 9]}
    return _painted(styling.color(table(spark, sf_dir, "part"), Grid(spark, sf_dir).scratch, "p_size", given=given), "red", "green", "blue")


def text_labels(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", styling.label(F.col("p_size"), "int").alias("size"), styling.label(F.col("p_name"), "string").alias("name"), styling.thousands(F.col("p_partkey") * 1001.7).alias("thousands"))


def diagnostics_width(spark, sf_dir):
    return styling.diagnostics_width(table(spark, sf_dir, "part"), F.col("p_size"), "width").select("p_partkey", F.round("width", 6).alias("width"))


def web_map_degrees(spark, sf_dir):
    at = geometry.mercator_to_degrees(geometry.point(F.col("x") * 1000, F.col("y") * -1000))
    return Grid(spark, sf_dir).nodes().select("node", F.round(at["x"], 7).alias("longitude"), F.round(at["y"], 7).alias("latitude"))


def node_bearing(spark, sf_dir):
    a, b = geometry.point(F.lit(500.0), F.lit(300.0)), geometry.point(F.col("x"), F.col("y"))
    return Grid(spark, sf_dir).nodes().select("node", F.round(geometry.bearing(a, b), 7).alias("bearing"))


def knn_totals(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), (k % 7).cast("double").alias("a"), F.when(k % 11 > 0, (k % 5).cast("double")).alias("b"))
    return workflows.totals(rows, ["a", "b"]).select("id", "total_knn_access", F.round("normalized_knn_access", 6).alias("normalized_knn_access"))


def pairing_changes(spark, sf_dir):
    k = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(k.cast("long").alias("row"), F.col("n_regionkey").cast("string").alias("Network_File"), F.when(k % 5 > 0, (F.floor(k / 2) % 3).cast("string")).alias("Network_Cost"))
    return pairings.changes(rows).select("row", "new_streets", "new_network")


def flow_error_summary(spark, sf_dir):
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    simulated = part.select(k.alias("id"), F.when(k % 17 > 0, F.col("p_size")).otherwise(0).cast("double").alias("betweenness"))
    golden = part.where(k % 13 > 0).select(k.alias("id"), F.when(k % 34 > 0, F.col("p_size") * (100 + k % 7 - 3) / 100).otherwise(0.0).alias("betweenness"))
    out = flow.error_summary(simulated, golden, "id")
    return out.select(*[F.round(c, 6).alias(c) if c in ("golden_sum", "median_error") else F.col(c) for c in out.columns])


def radius_scale(spark, sf_dir):
    return styling.radius(table(spark, sf_dir, "part"), F.col("p_size"), "radius").select("p_partkey", F.round("radius", 6).alias("radius"))


def flow_width(spark, sf_dir):
    return styling.flow_width(table(spark, sf_dir, "part"), F.col("p_size"), "width").select("p_partkey", F.round("width", 6).alias("width"))


def queries() -> dict:
    plain = (street_cost_rule, network_nodes_exact, edges_discard, edges_split, edges_keep, edge_tags, attach_origins, attach_destinations, edge_chain, line_length, nearest_edge, endpoints_within_tolerance, node_scope, od_distance, reach, gravity, gravity_alpha, knn_access, knn_weight, closest_destination, top_k_destinations, closest_facility, closest_facility_reach, service_area_destinations, alternative_paths, huff_probability, betweenness_elastic, betweenness_origin_stats, path_exposure, turn_penalty_distance, color_gradient, color_quantile, color_categorical, text_labels, diagnostics_width, web_map_degrees, node_bearing, knn_totals, pairing_changes, flow_error_summary, radius_scale, flow_width)
    flows = {
        "betweenness_closest": _flow(True, 1.0, None),
        "betweenness_huff": _flow(False, 1.0, None),
        "betweenness_decay_exponent": _flow(False, 1.0, "exponent"),
        "betweenness_decay_power": _flow(False, 1.0, "power"),
        "betweenness_detour": _flow(False, DETOUR, "exponent"),
    }
    return {q.__name__: q for q in plain} | flows | town.queries()


def oracle_sql() -> dict[str, str]:
    return oracles.sql() | town_sql.sql()
