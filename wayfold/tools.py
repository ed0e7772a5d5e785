"""The analysis tools: accessibility, service areas, alternative paths and betweenness.

Each checks its arguments first (TypeError for a wrong type, ValueError for a wrong value), works on the
network of a ``Workspace`` whose graph has been made, and saves its results as columns of the layers that
origins, destinations and streets come from; a column of the same name is replaced. ``num_cores`` is checked
and otherwise ignored: Spark deals out the work.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import geometry as G
from wayfold.operators import access, areas, flow, search
from wayfold.workspace import Network, Workspace, need, need_number


def check_ready(workspace: Workspace) -> Network:
    """The network, if it has streets, origins, destinations and a graph."""
    need(workspace, Workspace, "workspace")
    if not len(workspace.layers):
        raise ValueError("there are no layers: call load_layer")
    network = workspace.network
    if network is None or network.street_nodes.isEmpty():
        raise ValueError("there is no street network: call create_street_network")
    for role in ("origin", "destination"):
        if network.layer_of(role) is None or network.features(role).isEmpty():
            raise ValueError(f"there are no {role}s: call insert_node")
    if network.streets is None:
        raise ValueError("there is no graph: call create_graph")
    return network


def knn_list(weights, name: str = "knn_weights") -> list[float]:
    """Weights of the nearest, second nearest, ... destination, as a list or as its text."""
    if isinstance(weights, str):
        return [float(x) for x in weights.strip()[1:-1].split(",")]
    if isinstance(weights, list):
        return [float(x) for x in weights]
    raise ValueError(f"{name} must be a list of numbers such as [0.5, 0.25, 0.25]")


def _name(value: str | None, name: str) -> None:
    if value is not None:
        need(value, str, name)


def _origins(network: Network) -> DataFrame:
    return network.features("origin").withColumnRenamed("id", "oid")


def _destinations(network: Network) -> DataFrame:
    return network.features("destination").withColumnRenamed("id", "did")


def save(workspace: Workspace, layer: str, results: DataFrame, names: dict[str, str], zero: tuple[str, ...] = ()) -> None:
    """Put results (source_id, column ...) on a layer under new names; ``zero`` lists columns where missing is 0."""
    base = workspace[layer].df
    taken = {n.lower() for n in names.values()}
    kept = [f"`{c}`" for c in base.columns if c.lower() not in taken]
    new = [F.col(c).alias(f"_new_{k}") for k, c in enumerate(names)]
    both = base.select(*kept).join(results.select(F.col("source_id").alias("_source"), *new), F.col("id") == F.col("_source"), "left")

    def value(k: int, c: str) -> Column:
        return F.coalesce(F.col(f"_new_{k}"), F.lit(0)) if c in zero else F.col(f"_new_{k}")

    workspace[layer].df = workspace.scratch.keep(both.select(*kept, *[value(k, c).alias(n) for k, (c, n) in enumerate(names.items())]))


def accessibility(
    workspace: Workspace, search_radius: float, destination_weight: str | None = None, alpha: float = 1, beta: float | None = None, save_reach_as: str | None = None, save_gravity_as: str | None = None,
    knn_weights: str | list | None = None, knn_plateau: float | None = None, save_knn_access_as: str | None = None, closest_facility: bool = False, save_closest_facility_as: str | None = None,
    save_closest_facility_distance_as: str | None = None, turn_penalty: bool = False, num_cores: int = 1,
) -> None:
    """Reach, gravity and K-nearest access of origins; the closest origin of each destination.

    With ``closest_facility`` each destination counts for its closest origin only, in reach and in gravity. Weights are those
    given when destinations were inserted, or ``destination_weight``, an attribute of their layer.
    """
    network = check_ready(workspace)
    need_number(search_radius, "search_radius", 0)
    layer = network.layer_of("destination")
    if destination_weight is not None:
        need(destination_weight, str, "destination_weight")
        if destination_weight not in workspace[layer].df.columns:
            raise ValueError(f"layer {layer} has no column {destination_weight!r}")
    need(alpha, (int, float), "alpha")
    if beta is not None:
        need(beta, (int, float), "beta")
    for value, name in ((save_reach_as, "save_reach_as"), (save_gravity_as, "save_gravity_as"), (save_knn_access_as, "save_knn_access_as")):
        _name(value, name)
    if save_gravity_as is not None and beta is None:
        raise ValueError("save_gravity_as needs beta")
    if save_knn_access_as is None:
        knn_weights = None
    else:
        if knn_weights is None:
            raise ValueError("save_knn_access_as needs knn_weights")
        knn_weights = knn_list(knn_weights)
        if knn_plateau is None:
            knn_plateau = search_radius
        else:
            need_number(knn_plateau, "knn_plateau", 0, search_radius)
            if beta is None:
                raise ValueError("knn_plateau needs beta")
    need(closest_facility, bool, "closest_facility")
    facility_names = {"save_closest_facility_as": save_closest_facility_as, "save_closest_facility_distance_as": save_closest_facility_distance_as}
    for name, value in facility_names.items():
        if closest_facility:
            need(value, str, name)
        elif value is not None:
            raise ValueError(f"{name} needs closest_facility=True")
    need(turn_penalty, bool, "turn_penalty")
    need_number(num_cores, "num_cores", 1)

    scratch, origins, destinations = workspace.scratch, _origins(network), _destinations(network)
    weighed = destinations.select("did", F.coalesce("wt", F.lit(0.0)).alias("wt"))
    if destination_weight is not None:
        given = workspace[layer].df.select(F.col("id").alias("source_id"), F.coalesce(F.nanvl(F.col(f"`{destination_weight}`").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("wt"))
        weighed = destinations.select("did", "source_id").join(given, "source_id", "left").select("did", F.coalesce("wt", F.lit(0.0)).alias("wt"))
    found = search.distances(network.streets, origins, destinations, search_radius, network.turns if turn_penalty else None)
    pairs = scratch.keep(access.with_weights(found, weighed))
    counted = pairs
    if closest_facility:
        closest = scratch.keep(access.closest_facility(pairs))
        counted = access.with_weights(closest, weighed)
    sums = [F.sum("wt").alias("reach")]
    if beta is not None:
        sums.append(F.sum(F.pow("wt", F.lit(float(alpha))) * F.exp(-float(beta) * F.col("dist"))).alias("gravity"))
    metrics = origins.select("oid", "source_id", "source_layer").join(counted.groupBy("oid").agg(*sums), "oid", "left")
    if knn_weights is not None:
        metrics = metrics.join(access.knn_access(pairs, knn_weights, float(beta or 0.0), float(knn_plateau)), "oid", "left")
    wanted = {"reach": save_reach_as, "gravity": save_gravity_as, "knn_access": save_knn_access_as}
    wanted = {k: v for k, v in wanted.items() if v is not None}
    home = network.layer_of("origin")
    if wanted:
        save(workspace, home, metrics.where(F.col("source_layer") == home), wanted, tuple(wanted))
    if closest_facility:
        by = origins.select("oid", F.col("source_id").alias("closest_facility"))
        served = closest.join(by, "oid").join(destinations.select("did", "source_id", "source_layer"), "did").where(F.col("source_layer") == layer)
        save(workspace, layer, served.withColumn("closest_facility_distance", F.col("dist")), {"closest_facility": save_closest_facility_as, "closest_facility_distance": save_closest_facility_distance_as})


def service_area(workspace: Workspace, search_radius: float, origin_ids: int | list | None = None, turn_penalty: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(destinations, network_edges, scopes) of what the origins reach.

    Destinations are the rows of their layer that any origin reaches; edges (origin_id, edge_id, geometry) the street pieces inside
    each origin's area; scopes two rows per origin (name, origin_id, geometry): its area, the union of the hulls of the destinations and of
    the street nodes in reach as two polygons, and the origin itself. Origins that reach no destination have none.
    """
    network = check_ready(workspace)
    need_number(search_radius, "search_radius", 0)
    if origin_ids is not None:
        need(origin_ids, (int, list), "origin_ids")
    need(turn_penalty, bool, "turn_penalty")
    scratch, origins, destinations = workspace.scratch, _origins(network), _destinations(network)
    home, layer = network.layer_of("origin"), network.layer_of("destination")
    if isinstance(origin_ids, list):
        asked = workspace.spark.createDataFrame([(i,) for i in origin_ids], "id long").distinct()
        unknown = [r["id"] for r in asked.join(workspace[home].df.select("id"), "id", "left_anti").collect()]
        if unknown:
            raise ValueError(f"no origins have the ids {unknown}")
        origins = origins.where(F.col("source_layer") == home).join(asked.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    elif origin_ids is not None:
        origins = origins.where((F.col("source_layer") == home) & (F.col("source_id") == origin_ids))
    turns = network.turns if turn_penalty else None
    pairs = scratch.keep(search.distances(network.streets, origins, destinations, search_radius, turns).join(destinations.select("did", "source_id"), "did"))
    reached = search.scope(network.streets, origins.join(pairs.select("oid"), "oid", "left_semi"), search_radius, turns)
    shapes = workspace[layer].df.select(F.col("id").alias("source_id"), F.explode(F.flatten("geometry.parts")).alias("p"))
    served = pairs.select("oid", "source_id").join(shapes, "source_id").select("oid", "p.x", "p.y")
    arcs = search.arcs(network.streets)
    found = scratch.keep(areas.areas(reached, network.streets.nodes, arcs, served))
    side = search_radius or 1.0
    lines = network.edges.select("edge_id", "coords")
    pieces = areas.clipped(found, lines, side)
    names = origins.select("oid", F.col("source_id").alias("origin_id"))
    pieces = pieces.join(names, "oid").select("origin_id", "edge_id", "n", G.geometry("LineString", F.array(F.array("a", "b"))).alias("geometry"))
    ring = lambda c: F.concat(F.col(c), F.slice(c, 1, 1))
    rings = F.filter(F.array(ring("hull"), ring("network_hull")), lambda r: r.isNotNull())
    border = found.join(names, "oid").select(F.lit("service area border").alias("name"), "origin_id", G.geometry("MultiPolygon", rings).alias("geometry"))
    places = found.join(names, "oid").join(workspace[home].df.select(F.col("id").alias("origin_id"), "geometry"), "origin_id")
    scopes = border.unionByName(places.select(F.lit("origin").alias("name"), "origin_id", "geometry"))
    hit = workspace[layer].df.join(pairs.select(F.col("source_id").alias("id")), "id", "left_semi")
    return hit, pieces, scopes


def alternative_paths(workspace: Workspace, origin_id: int, search_radius: float, detour_ratio: float = 1, turn_penalty: bool = False) -> DataFrame:
    """(destination, distance, edges, geometry) of every simple path from one origin, shortest first.

    Paths are no longer than ``detour_ratio`` times the shortest one to their destination. The first and the last edge are whole.
    """
    need(workspace, Workspace, "workspace")
    network = check_ready(workspace)
    need(origin_id, int, "origin_id")
    origins = _origins(network).where(F.col("source_id") == origin_id)
    if origins.isEmpty():
        raise ValueError(f"no origin has the id {origin_id}")
    need_number(search_radius, "search_radius", 0)
    need_number(detour_ratio, "detour_ratio", 1)
    need(turn_penalty, bool, "turn_penalty")
    turns, destinations = network.turns if turn_penalty else None, _destinations(network)
    pairs = workspace.scratch.keep(search.distances(network.streets, origins, destinations, search_radius, turns))
    found = search.paths(network.streets, origins, destinations, pairs, detour_ratio, search_radius, turns)
    found = workspace.scratch.keep(found.join(destinations.select("did", F.col("source_id").alias("destination")), "did"))
    steps = search.path_edges(found.select("did", "path_no", "path")).join(network.edges.select("edge_id", "coords"), "edge_id")
    shapes = steps.groupBy("did", "path_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "coords"))), lambda x: x["coords"]).alias("parts"))
    out = found.join(shapes, ["did", "path_no"]).select("destination", F.col("cost").alias("distance"), F.col("path").alias("edges"), G.geometry("MultiLineString", F.col("parts")).alias("geometry"))
    return out.orderBy("distance", "destination", "edges")


@dataclass
class Flows:
    """What ``betweenness`` found: flow per edge (edge_id, parent_id, betweenness), origin metrics, and the paths taken."""

    edges: DataFrame
    origins: DataFrame
    trips: DataFrame


def betweenness(
    workspace: Workspace, search_radius: float, detour_ratio: float = 1, decay: bool = False, decay_method: str = "exponent", beta: float = 0.003, num_cores: int = 1, closest_destination: bool = True,
    elastic_weight: bool = False, knn_weight: str | list | None = None, knn_plateau: float = 0, turn_penalty: bool = False, save_betweenness_as: str | None = None, save_reach_as: str | None = None,
    save_gravity_as: str | None = None, save_elastic_weight_as: str | None = None, keep_diagnostics: bool = False, path_exposure_attribute: str | None = None, save_path_exposure_as: str | None = None,
) -> Flows:
    """Trips from origins to their closest destination, or to all in reach by the Huff model, as flow over streets.

    Reach and gravity are unweighted here: the number of destinations and the sum of their decays. Exponential decay goes by the
    distance to an origin's closest destination, power decay by each path's cost. Every path's flow counts for whole edges, its
    first and last among them. Origins that weigh 0 make no trips.
    """
    network = check_ready(workspace)
    need_number(search_radius, "search_radius", 0)
    need_number(detour_ratio, "detour_ratio", 1)
    need(decay, bool, "decay")
    if decay:
        need(decay_method, str, "decay_method")
        if decay_method not in ("exponent", "power"):
            raise ValueError("decay_method must be exponent or power")
    if decay or save_gravity_as is not None or not closest_destination or elastic_weight:
        need(beta, (int, float), "beta")
    need(num_cores, int, "num_cores")
    need_number(num_cores, "num_cores", 1)
    need(closest_destination, bool, "closest_destination")
    need(elastic_weight, bool, "elastic_weight")
    if elastic_weight:
        if knn_weight is None:
            raise ValueError("elastic_weight needs knn_weight")
        knn_weight = knn_list(knn_weight, "knn_weight")
        need_number(knn_plateau, "knn_plateau", 0)
    need(turn_penalty, bool, "turn_penalty")
    saved = {"save_betweenness_as": save_betweenness_as, "save_reach_as": save_reach_as, "save_gravity_as": save_gravity_as, "save_elastic_weight_as": save_elastic_weight_as, "save_path_exposure_as": save_path_exposure_as}
    for name, value in saved.items():
        _name(value, name)
    if save_elastic_weight_as is not None and not elastic_weight:
        raise ValueError("save_elastic_weight_as needs elastic_weight=True")
    need(keep_diagnostics, bool, "keep_diagnostics")
    streets_layer = network.source_layer
    if path_exposure_attribute is not None:
        need(path_exposure_attribute, str, "path_exposure_attribute")
        if path_exposure_attribute not in workspace[streets_layer].df.columns:
            raise ValueError(f"layer {streets_layer} has no column {path_exposure_attribute!r}")
    elif save_path_exposure_as is not None:
        raise ValueError("save_path_exposure_as needs path_exposure_attribute")

    scratch, destinations = workspace.scratch, _destinations(network)
    origins = _origins(network).where("wt <> 0")
    turns, beta = network.turns if turn_penalty else None, float(beta if beta is not None else 0.0)
    weights = destinations.select("did", F.coalesce("wt", F.lit(0.0)).alias("wt"))
    pairs = scratch.keep(access.with_weights(search.distances(network.streets, origins, destinations, search_radius, turns), weights))
    asking = origins
    if elastic_weight:
        knn = access.knn_access(pairs, knn_weight, beta, float(knn_plateau))
        asking = scratch.keep(origins.join(knn, "oid").withColumn("knn_weight", F.col("knn_access") * F.col("wt")).withColumn("wt", F.col("knn_weight")))
    chosen = scratch.keep(access.closest_destination(pairs).withColumn("p_dest", F.lit(1.0)) if closest_destination else flow.huff(pairs, beta).select("oid", "did", "dist", "p_dest"))
    found = search.paths(network.streets, origins, destinations, chosen.select("oid", "did", "dist"), detour_ratio, search_radius, turns)
    trips = scratch.keep(flow.taken(found, chosen, pairs, asking, beta, decay_method if decay else None))
    flows = network.edges.select("edge_id", "parent_id").join(flow.betweenness(trips), "edge_id", "left")
    flows = scratch.keep(flows.withColumn("betweenness", F.coalesce("betweenness", F.lit(0.0))))
    if save_betweenness_as is not None:
        first = flows.groupBy(F.col("parent_id").alias("source_id")).agg(F.min_by("betweenness", "edge_id").alias("betweenness"))
        save(workspace, streets_layer, first, {"betweenness": save_betweenness_as})

    made = pairs.join(chosen.select("oid").distinct(), "oid", "left_semi").groupBy("oid").agg(F.count("*").alias("reach"), F.sum(F.exp(-beta * F.col("dist"))).alias("gravity"))
    stats = flow.diagnostics(trips, chosen)
    metrics = origins.join(made, "oid", "left").join(stats, "oid", "left")
    if elastic_weight:
        metrics = metrics.join(asking.select("oid", "knn_weight", "knn_access"), "oid", "left")
    if path_exposure_attribute is not None:
        value = workspace[streets_layer].df.select(F.col("id").alias("parent_id"), F.col(f"`{path_exposure_attribute}`").cast("double").alias("a"))
        metrics = metrics.join(flow.path_exposure(trips, network.edges.select("edge_id", "parent_id", "w").join(value, "parent_id")), "oid", "left")
    metrics = scratch.keep(metrics)
    names = {"reach": save_reach_as, "gravity": save_gravity_as, "knn_weight": save_elastic_weight_as, "hazard_meters": save_path_exposure_as}
    names = {k: v for k, v in names.items() if v is not None}
    zero = tuple(names)
    if keep_diagnostics:
        prefix = save_betweenness_as or "betweenness"
        table = metrics.withColumnsRenamed({"wt": "weight", "edge_id": "nearest_edge_id", "s": "edge_start_node", "e": "edge_end_node", "w_s": "weight_to_start", "w_e": "weight_to_end"}).drop("at")
        names |= {c: f"{prefix}_{c}" for c in table.columns if c not in names and c not in ("oid", "source_id")}
    else:
        table = metrics
    home = network.layer_of("origin")
    if names:
        save(workspace, home, table.where(F.col("source_layer") == home), names, zero)
    return Flows(flows, metrics, trips)
