"""The workspace, the tools' argument checks, and a batch from files to files."""

import csv
import json

import pytest

from wayfold import tools, workflows
from wayfold.functions import geometry as G
from wayfold.layers import Layer, Layers
from wayfold.operators import areas, search, topology
from wayfold.session import Scratch
from wayfold.workspace import Workspace


def lines(spark, *streets):
    """Streets (id, points, cost)."""
    return spark.createDataFrame([(i, ("LineString", [[(float(x), float(y)) for x, y in p]]), c) for i, p, c in streets], f"id long, geometry {G.GEOMETRY}, cost double")


def points(spark, *rows):
    return spark.createDataFrame([(i, ("Point", [[(float(x), float(y))]]), float(w)) for i, x, y, w in rows], f"id long, geometry {G.GEOMETRY}, wt double")


SQUARE = [(0, [(0, 0), (100, 0)], 100.0), (1, [(100, 0), (100, 100)], 100.0), (2, [(0, 0), (0, 100)], 100.0), (3, [(0, 100), (100, 100)], 100.0), (4, [(100, 100), (180, 100)], 80.0)]


@pytest.fixture(scope="module")
def square(spark):
    w = Workspace(spark)
    w.load_layer("streets", lines(spark, *SQUARE))
    w.create_street_network("streets", "cost")
    w.load_layer("homes", points(spark, (10, 50, -3, 2), (11, 0, 50, 0)))
    w.load_layer("shops", points(spark, (20, 100, 50, 4), (21, 50, 103, 0)))
    w.insert_node("homes", "origin", "wt")
    w.insert_node("shops", "destination", "wt")
    w.create_graph()
    return w


def test_square(square):
    w = square.copy()
    tools.accessibility(w, 200, beta=0.0, save_reach_as="reach", save_gravity_as="gravity", closest_facility=True, save_closest_facility_as="home", save_closest_facility_distance_as="far")
    assert {r.id: (r.reach, r.gravity) for r in w["homes"].df.collect()} == {10: (4.0, 4.0), 11: (0.0, 0.0)}
    assert {r.id: (r.home, r.far) for r in w["shops"].df.collect()} == {20: (10, 100.0), 21: (11, 100.0)}
    found = tools.alternative_paths(w, 10, 250, 3.0).collect()
    assert [(r.destination, r.distance, r.edges) for r in found] == [(20, 100.0, [0, 1]), (21, 200.0, [0, 1, 3]), (21, 200.0, [0, 2, 3]), (20, 300.0, [0, 2, 3, 1])]
    tools.betweenness(w, 250, closest_destination=False, beta=0.0, save_betweenness_as="flow", save_reach_as="reach", keep_diagnostics=True)
    assert {r.id: r.flow for r in w["streets"].df.collect()} == {0: 2.0, 1: 2.0, 2: 0.0, 3: 0.0, 4: 0.0}
    assert {r.id: (r.reach, r.flow_path_count) for r in w["homes"].df.collect()} == {10: (2, 3), 11: (0, None)}
    hit, pieces, scopes = tools.service_area(w, 200, [10])
    assert sorted(r.id for r in hit.collect()) == [20, 21] and sorted(r.name for r in scopes.collect()) == ["origin", "service area border"]
    assert 4 not in {r.edge_id for r in pieces.collect()}  # the tip of the dead end belongs to no area
    with pytest.raises(ValueError):
        tools.service_area(w, 200, [10, 99])


def test_turns_cost(square):
    w = square.copy()
    w.set_turn_parameters(45, 30)
    tools.accessibility(w, 400, closest_facility=True, save_closest_facility_as="home", save_closest_facility_distance_as="far", turn_penalty=True)
    assert {r.id: r.far for r in w["shops"].df.collect()} == {20: 130.0, 21: 130.0}
    paths = tools.alternative_paths(w, 10, 400, 1.0, True).collect()
    assert [(r.destination, r.distance) for r in paths] == [(20, 130.0), (21, 260.0), (21, 260.0)]
    w.set_turn_parameters(45, 30)


BAD = [
    (tools.accessibility, dict(search_radius="x"), TypeError), (tools.accessibility, dict(search_radius=-1), ValueError), (tools.accessibility, dict(search_radius=True), TypeError),
    (tools.accessibility, dict(search_radius=9, destination_weight=3), TypeError), (tools.accessibility, dict(search_radius=9, destination_weight="none"), ValueError),
    (tools.accessibility, dict(search_radius=9, alpha="1"), TypeError), (tools.accessibility, dict(search_radius=9, beta="1"), TypeError),
    (tools.accessibility, dict(search_radius=9, save_reach_as=1), TypeError), (tools.accessibility, dict(search_radius=9, save_gravity_as="g"), ValueError),
    (tools.accessibility, dict(search_radius=9, save_knn_access_as="k"), ValueError), (tools.accessibility, dict(search_radius=9, save_knn_access_as="k", knn_weights=3), ValueError),
    (tools.accessibility, dict(search_radius=9, save_knn_access_as="k", knn_weights=[1], knn_plateau="a"), TypeError), (tools.accessibility, dict(search_radius=9, save_knn_access_as="k", knn_weights=[1], knn_plateau=-1), ValueError),
    (tools.accessibility, dict(search_radius=9, save_knn_access_as="k", knn_weights=[1], knn_plateau=10), ValueError), (tools.accessibility, dict(search_radius=9, save_knn_access_as="k", knn_weights=[1], knn_plateau=5), ValueError),
    (tools.accessibility, dict(search_radius=9, closest_facility=1), TypeError), (tools.accessibility, dict(search_radius=9, save_closest_facility_as="a"), ValueError),
    (tools.accessibility, dict(search_radius=9, save_closest_facility_distance_as="a"), ValueError), (tools.accessibility, dict(search_radius=9, closest_facility=True), TypeError), (tools.accessibility, dict(search_radius=9, turn_penalty=1), TypeError),
    (tools.service_area, dict(search_radius=None), TypeError), (tools.service_area, dict(search_radius=9, origin_ids="a"), TypeError), (tools.service_area, dict(search_radius=9, turn_penalty=0), TypeError),
    (tools.alternative_paths, dict(origin_id="a", search_radius=9), TypeError), (tools.alternative_paths, dict(origin_id=99, search_radius=9), ValueError), (tools.alternative_paths, dict(origin_id=10, search_radius=9, detour_ratio=0.5), ValueError), (tools.alternative_paths, dict(origin_id=10, search_radius=9, detour_ratio="2"), TypeError),
    (tools.betweenness, dict(search_radius=9, detour_ratio=0.9), ValueError), (tools.betweenness, dict(search_radius=9, decay=1), TypeError), (tools.betweenness, dict(search_radius=9, decay=True, decay_method="linear"), ValueError), (tools.betweenness, dict(search_radius=9, decay=True, decay_method=3), TypeError),
    (tools.betweenness, dict(search_radius=9, decay=True, beta=None), TypeError), (tools.betweenness, dict(search_radius=9, num_cores=0), ValueError), (tools.betweenness, dict(search_radius=9, num_cores=1.5), TypeError), (tools.betweenness, dict(search_radius=9, closest_destination=1), TypeError),
    (tools.betweenness, dict(search_radius=9, elastic_weight=1), TypeError), (tools.betweenness, dict(search_radius=9, elastic_weight=True), ValueError), (tools.betweenness, dict(search_radius=9, elastic_weight=True, knn_weight=3), ValueError), (tools.betweenness, dict(search_radius=9, elastic_weight=True, knn_weight=[1], knn_plateau=-1), ValueError),
    (tools.betweenness, dict(search_radius=9, save_betweenness_as=1), TypeError), (tools.betweenness, dict(search_radius=9, save_elastic_weight_as="a"), ValueError), (tools.betweenness, dict(search_radius=9, keep_diagnostics=1), TypeError),
    (tools.betweenness, dict(search_radius=9, path_exposure_attribute=1), TypeError), (tools.betweenness, dict(search_radius=9, path_exposure_attribute="none"), ValueError), (tools.betweenness, dict(search_radius=9, save_path_exposure_as="a"), ValueError),
]


def test_argument_checks(square):
    for tool, given, error in BAD:
        with pytest.raises(error):
            tool(square, **given)
    w = square
    for call, error in [
        (lambda: w.create_street_network(1), TypeError), (lambda: w.create_street_network("none"), ValueError), (lambda: w.create_street_network("streets", "none"), ValueError), (lambda: w.create_street_network("streets", 1), TypeError),
        (lambda: w.create_street_network("streets", None, -1), ValueError), (lambda: w.create_street_network("streets", None, "a"), TypeError), (lambda: w.create_street_network("streets", None, 0, "melt"), ValueError), (lambda: w.create_street_network("streets", None, 0, 5), TypeError),
        (lambda: w.set_turn_parameters(181), ValueError), (lambda: w.set_turn_parameters(45, -1), ValueError), (lambda: w.set_turn_parameters("a"), TypeError), (lambda: w.insert_node("none", "origin"), ValueError),
        (lambda: w.insert_node("homes", "start"), ValueError), (lambda: w.insert_node("homes", 1), TypeError), (lambda: w.insert_node("homes", "origin", "none"), ValueError), (lambda: tools.check_ready(None), TypeError), (lambda: tools.check_ready(Workspace(w.spark)), ValueError),
    ]:
        with pytest.raises(error):
            call()


def test_layers():
    all_layers = Layers()
    for n in "abc":
        all_layers.add(Layer(n, None))
    all_layers.add(Layer("d", None), first=True)
    all_layers.add(Layer("e", None), before="b")
    all_layers.add(Layer("f", None), after="b")
    all_layers.add(Layer("g", None), pos=0)
    assert list(all_layers) == ["g", "d", "a", "e", "b", "f", "c"] and len(all_layers) == 7 and "e" in all_layers and all_layers[1].label == "d" and all_layers.pos_at_label("b") == 4
    all_layers[0] = Layer("z", None)
    all_layers["new"] = Layer("x", None)
    assert list(all_layers) == ["z", "d", "a", "e", "b", "f", "c", "new"] and str(all_layers).startswith("z, d")
    for call, error in [(lambda: all_layers["no"], KeyError), (lambda: all_layers.add(Layer("a", None)), KeyError), (lambda: all_layers.get_layer_at_pos(99), IndexError), (lambda: all_layers.insert_at("1", Layer("q", None)), ValueError)]:
        with pytest.raises(error):
            call()


def test_tolerance_is_greedy_and_not_transitive(spark):
    # ends 0.8 of the tolerance apart in a row; the costliest street's start comes first
    streets = [(k, [(0.8 * k, 0.0), (50.0 + k, 60.0 + 10 * k)], 10.0 - k) for k in range(5)]
    df = lines(spark, *streets).selectExpr("id AS street_id", "geometry.parts[0] AS coords", "cost AS w", "1D AS len")
    nodes, edges = topology.within(df, 1.0, Scratch(spark))
    starts = {r.street_id: r.s for r in edges.collect()}
    assert starts == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2} and {r.node_id: r.degree for r in nodes.collect() if r.node_id < 3} == {0: 2, 1: 2, 2: 1}
    assert topology.within(df.limit(0), 1.0, Scratch(spark))[0].count() == 0


def test_odd_features_and_far_ones(spark):
    rows = [(0, 1.0, 1.0), (1, None, 1.0), (2, float("nan"), 1.0), (3, float("inf"), 0.0), (4, 1e6, -1e6), (4, 1.0, 9.0)]
    made = spark.createDataFrame([(i, n, x, y, x, y) for n, (i, x, y) in enumerate(rows)], "id long, row long, x1 double, y1 double, x2 double, y2 double").drop("id")
    edges = spark.createDataFrame([(7, 0.0, 0.0, 10.0, 0.0), (5, 0.0, 10.0, 10.0, 10.0), (9, 0.0, 2.0, 0.0, 0.0)], "edge_id long, x1 double, y1 double, x2 double, y2 double")
    got = {r.row: r.edge_id for r in topology.nearest_edge(made, edges, Scratch(spark)).collect()}
    assert got == {0: 7, 4: 7, 5: 5}
    assert topology.nearest_edge(made, edges.limit(0), Scratch(spark)).count() == 0


def test_cheap_streets_are_searched_whole(spark):
    """Where costs say nothing of lengths, the part of a tile comes from rounds; results are the same."""
    edges = spark.createDataFrame([(k, k, k + 1, 0.5 if k % 7 else 20.0, 100.0) for k in range(60)], "edge_id long, s long, e long, w double, len double")
    nodes = spark.createDataFrame([(k, 100.0 * k, 0.0) for k in range(61)], "node long, x double, y double")
    cheap = edges.withColumn("w", edges.w * (edges.edge_id != 30).cast("double"))
    feature = "id long, edge_id long, s long, e long, w_s double, w_e double, wt double"
    o = spark.createDataFrame([(1, 5, 5, 6, 0.25, 0.25, 1.0), (2, 40, 40, 41, 0.1, 0.4, 1.0)], feature).withColumnRenamed("id", "oid")
    d = spark.createDataFrame([(3, 45, 45, 46, 0.25, 0.25, 1.0), (4, 5, 5, 6, 0.5, 0.0, 1.0)], feature).withColumnRenamed("id", "did")
    streets = search.Streets(cheap, nodes, Scratch(spark))
    assert not streets.reach(60.0)[1]
    got = {(r.oid, r.did): round(r.dist, 6) for r in search.distances(streets, o, d, 150.0).collect()}
    cost = [0.0 if k == 30 else 0.5 if k % 7 else 20.0 for k in range(60)]
    assert got == {(1, 4): 0.25, (1, 3): round(0.25 + sum(cost[6:45]) + 0.25, 6), (2, 3): round(0.4 + sum(cost[41:45]) + 0.25, 6), (2, 4): round(0.1 + sum(cost[6:40]), 6)}


def test_hull_corners():
    assert areas.corners([(0, 0), (2, 0), (1, 0), (2, 2), (0, 2), (1, 1), (0, 0)]) == [(0, 0), (2, 0), (2, 2), (0, 2)]
    assert areas.corners([(1, 1), (0, 0)]) == [(0, 0), (1, 1)]


def feature(properties, kind, coordinates):
    return {"type": "Feature", "properties": properties, "geometry": {"type": kind, "coordinates": coordinates}}


def test_workflows(spark, tmp_path):
    def put(name, features):
        (tmp_path / name).write_text(json.dumps({"type": "FeatureCollection", "features": features}))

    put("net.geojson", [feature({"cost": c}, "LineString", p) for _, p, c in SQUARE])
    put("homes.geojson", [feature({"people": 2}, "Point", [50, -3]), feature({"people": 0}, "Point", [0, 50])])
    put("shops.geojson", [feature({"jobs": 4}, "Point", [100, 50]), feature({"jobs": 1}, "Point", [50, 103])])
    common = "net.geojson,{},homes.geojson,Homes,people,shops.geojson,Shops,jobs,200,0.001"
    head = ",Flow_Name,Network_File,Network_Cost,Origin_File,Origin_Name,Origin_Weight,Destination_File,Destination_Name,Destination_Weight,Radius,Beta,"
    (tmp_path / "pairings.csv").write_text(head + "Decay,Decay_Mode,Closest_Destination,Detour,Elastic_Weights,KNN_Weight,Plateau,Turns,Turn_Threshold,Turn_Penalty\n" + f"0,One,{common.format('Geometric')},TRUE,exponent,FALSE,1.15,FALSE,,,FALSE,0,0\n")
    w = workflows.betweenness_flow_simulation(spark, data_folder=str(tmp_path), output_folder=f"{tmp_path}/out")
    assert "One" in w["streets"].df.columns and {"reach_One", "One_path_count"} <= set(w["Homes"].df.columns)
    record = json.loads((tmp_path / "out/betweenness_record.geoJSON").read_text())
    assert len(record["features"]) == 5 and record["features"][0]["properties"]["One"] > 0
    log = list(csv.DictReader(open(tmp_path / "out/time_log.csv")))
    assert log[-1]["event"] == "all output saved" and abs(sum(float(r["seconds_elapsed"]) for r in log) - float(log[-1]["cumulative_seconds"])) < 1e-6
    assert (tmp_path / "out/One_O(Homes)_D(Shops)/flow_map_dark.html").exists()
    (tmp_path / "pairing.csv").write_text(head + "KNN_Weight,Plateau,Turns,Turn_Threshold,Turn_Penalty\n" + f"0,A,{common.format('Geometric')},\"[.75, .25]\",50,FALSE,0,0\n")
    w = workflows.KNN_accessibility(spark, data_folder=str(tmp_path), output_folder=f"{tmp_path}/knn")
    rows = {r.id: r for r in w["Homes"].df.collect()}
    assert rows[0].total_knn_access == pytest.approx(rows[0].A_knn_access) and {r.normalized_knn_access for r in rows.values()} <= {0.0, 1.0}
    assert (tmp_path / "knn/origin_record.csv").exists()
