"""Small cases of the network operators."""

import pytest
from pyspark.sql import functions as F

from wayfold.functions import geometry, styling
from wayfold.operators import access, network, routes, search
from wayfold.session import Scratch

EDGES = "edge_id bigint, s bigint, e bigint, w double"
FEATURE = "{} bigint, edge_id bigint, s bigint, e bigint, w_s double, w_e double, wt double"


def features(spark, key, *rows):
    return spark.createDataFrame(list(rows), FEATURE.format(key))


def streets(spark, *edges):
    """A network whose nodes lie 10 apart on a line, by number."""
    made = spark.createDataFrame(list(edges), EDGES)
    return search.Streets(made, spark.createDataFrame([(n, 10.0 * n, 0.0) for n in range(10)], "node long, x double, y double"), Scratch(spark))


def test_same_edge_distance_and_path(spark):
    net = streets(spark, (0, 0, 1, 10.0))
    o, d = features(spark, "oid", (1, 0, 0, 1, 2.0, 8.0, 1.0)), features(spark, "did", (7, 0, 0, 1, 5.0, 5.0, 1.0))
    pairs = search.distances(net, o, d, 50.0)
    assert [tuple(r) for r in pairs.collect()] == [(1, 7, 3.0)]
    assert [(r.cost, r.path) for r in search.paths(net, o, d, pairs, 1.15, 50.0).collect()] == [(3.0, [0])]


def test_square_has_two_ways_within_a_detour(spark):
    net = streets(spark, (0, 0, 1, 10.0), (1, 1, 2, 10.0), (2, 2, 3, 10.0), (3, 3, 0, 10.0))
    o, d = features(spark, "oid", (1, 0, 0, 1, 5.0, 5.0, 1.0)), features(spark, "did", (7, 2, 2, 3, 5.0, 5.0, 1.0))
    pairs = spark.createDataFrame([(1, 7, 20.0)], "oid bigint, did bigint, dist double")
    assert sorted(r.path for r in search.paths(net, o, d, pairs, 1.0, 50.0).collect()) == [[0, 1, 2], [0, 3, 2]]


def test_unreachable_empty_and_missing(spark):
    net = streets(spark, (0, 0, 1, 10.0), (1, 5, 6, 10.0), (2, 1, 5, None))
    o, d = features(spark, "oid", (1, 0, 0, 1, 5.0, 5.0, 1.0), (2, 0, 0, 1, None, None, 1.0)), features(spark, "did", (7, 1, 5, 6, 5.0, 5.0, 1.0))
    pairs = access.with_weights(search.distances(net, o, d, 100.0), d)
    assert [r.reach for r in access.on_origins(o, access.reach(pairs), "reach").collect()] == [0.0, 0.0]
    assert search.scope(net, o.limit(0), 9.0).count() == 0 and search.distances(net, o, d.limit(0), 9.0).count() == 0
    assert {(r.node, r.cost) for r in search.scope(net, o, 9.0).collect()} == {(0, 5.0), (1, 5.0)}


def test_rounds_and_tiles_agree(spark, sf):
    from wayfold.plans.catalogue import RADIUS, World

    w = World(spark, sf)
    seeds = network.entries(w.origins, "oid").select("oid", "node", "cost")
    rounds = routes.relax(network.arcs(w.edges), seeds, RADIUS, w.scratch)
    assert sorted(map(tuple, rounds.collect())) == sorted(map(tuple, search.scope(w.streets, w.origins, RADIUS).collect()))


def test_geometry(spark):
    line = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (3.0, 4.0), (3.0, 10.0))])
    row = spark.range(1).select(geometry.length(line).alias("n"), geometry.interpolate(line, F.lit(8.0)).alias("p"), geometry.turn_angle(line[0], line[1], line[2]).alias("t")).first()
    assert row.n == 11.0 and tuple(row.p) == (3.0, 7.0) and row.t == 37.0


def test_percent_rank_averages_ties_and_skips_missing(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (None,), (5.0,)], "v double")
    got = styling.percent_rank(df, "v", "r", Scratch(spark)).collect()
    assert sorted((r.v, r.r) for r in got if r.v is not None) == [(1.0, 0.25), (2.0, 0.625), (2.0, 0.625), (5.0, 1.0)]


def test_cost_rule(spark):
    df = spark.createDataFrame([(None,), (0.0,), (-1.0,), (7.0,)], "a double")
    got = [r[0] for r in df.select(network.street_cost(F.lit(9.0), F.col("a"))).collect()]
    assert got == [9.0, 9.0, pytest.approx(0.01), 7.0]


def test_within_tolerance_broadcasts_no_points(spark):
    at = [(k, float(k * 37 % 50), float(k * 11 % 40)) for k in range(120)] + [(500, None, 1.0), (501, 3.0, 4.0), (502, 3.0, 4.0), (503, -9.0, -9.0)]
    got = network.within_tolerance(spark.createDataFrame(at, "id long, x double, y double"), 5.0)
    sound = [p for p in at if p[1] is not None]
    gap = lambda p, q: ((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2) ** 0.5
    assert sorted(map(tuple, got.collect())) == sorted((p[0], q[0], gap(p, q)) for p in sound for q in sound if p[0] < q[0] and gap(p, q) <= 5.0)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
