"""DuckDB SQL for the catalogue's queries."""

from __future__ import annotations

GRID = """
g_dim AS (SELECT CAST(COUNT(*) AS BIGINT) AS n, CAST(CEIL(SQRT(COUNT(*))) AS BIGINT) AS g FROM part),
g_cell AS (SELECT p_partkey AS node, p_partkey % g AS gx, (p_partkey - p_partkey % g) // g AS gy, CAST(p_size AS BIGINT) AS p_size, n, g FROM part, g_dim),
g_at AS (SELECT node, gx * 100.0::DOUBLE AS x, gy * 100.0::DOUBLE AS y, gx, gy FROM g_cell),
g_street AS (
  SELECT 4 * node AS street_id, node AS s, node + 1 AS e, 50 + p_size AS cost, 100.0::DOUBLE AS len FROM g_cell WHERE gx + 1 < g AND node + 1 < n
  UNION ALL SELECT 4 * node + 1, node, node + g, 50 + (7 * p_size) % 50, 100.0::DOUBLE FROM g_cell WHERE node + g < n
  UNION ALL SELECT 4 * node + 2, node + 1, node, 63 + p_size, 100.0::DOUBLE FROM g_cell WHERE gx + 1 < g AND node + 1 < n AND node % 50 = 0
  UNION ALL SELECT 4 * node + 3, node, node, 40, 40.0::DOUBLE FROM g_cell WHERE node % 97 = 0),
g_edge AS (SELECT street_id AS edge_id, s, e, CAST(cost AS DOUBLE) AS w, len FROM g_street WHERE s <> e QUALIFY ROW_NUMBER() OVER (PARTITION BY LEAST(s, e), GREATEST(s, e) ORDER BY cost, street_id) = 1),
g_num AS (SELECT *, ROW_NUMBER() OVER (ORDER BY edge_id) - 1 AS seq, COUNT(*) OVER () AS m FROM g_edge),
o AS (SELECT c_custkey AS oid, edge_id, s, e, w * (c_custkey % 7 + 1) / 8 AS w_s, w - w * (c_custkey % 7 + 1) / 8 AS w_e, CAST(c_custkey % 4 AS DOUBLE) AS wt FROM customer JOIN g_num ON (c_custkey * 7919) % m = seq),
d AS (SELECT s_suppkey AS did, edge_id, s, e, w * (s_suppkey % 7 + 1) / 8 AS w_s, w - w * (s_suppkey % 7 + 1) / 8 AS w_e, CAST(s_suppkey % 5 AS DOUBLE) AS wt FROM supplier JOIN g_num ON (s_suppkey * 104729) % m = seq),
adj AS MATERIALIZED (SELECT s, e, w, edge_id FROM g_edge UNION ALL SELECT e, s, w, edge_id FROM g_edge)"""

SCOPE = """,
scope(oid, node, cost) USING KEY (oid, node) AS (
  SELECT oid, node, MIN(c) FROM (SELECT oid, s AS node, w_s AS c FROM o UNION ALL SELECT oid, e, w_e FROM o) z WHERE c <= 400 GROUP BY 1, 2
  UNION
  SELECT t.oid, a.e, MIN(t.cost + a.w) FROM scope t JOIN adj a ON a.s = t.node LEFT JOIN recurring.scope r ON r.oid = t.oid AND r.node = a.e
  WHERE t.cost + a.w <= 400 AND (r.cost IS NULL OR t.cost + a.w < r.cost) GROUP BY 1, 2)"""

PAIRS = SCOPE + """,
p AS MATERIALIZED (SELECT z.oid, z.did, MIN(z.dist) AS dist, ANY_VALUE(d.wt) AS wt FROM (
  SELECT t.oid, x.did, t.cost + x.c AS dist FROM scope t JOIN (SELECT did, s AS node, w_s AS c FROM d UNION ALL SELECT did, e, w_e FROM d) x USING (node)
  UNION ALL SELECT o.oid, d.did, ABS(o.w_e - d.w_e) FROM o JOIN d USING (edge_id)) z JOIN d USING (did) WHERE z.dist <= 400 GROUP BY 1, 2),
near AS (SELECT oid, MIN(dist) AS nearest FROM p GROUP BY 1),
huff AS (SELECT oid, did, dist, wt * EXP(-0.003 * dist) / SUM(wt * EXP(-0.003 * dist)) OVER (PARTITION BY oid) AS p_dest FROM p QUALIFY SUM(wt * EXP(-0.003 * dist)) OVER (PARTITION BY oid) > 0),
closest AS (SELECT oid, did, dist, 1.0::DOUBLE AS p_dest FROM p QUALIFY ROW_NUMBER() OVER (PARTITION BY oid ORDER BY dist, did) = 1),
rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY oid ORDER BY dist, did) AS rank FROM p),
ends AS (SELECT did, s AS node, w_s AS c, edge_id FROM d UNION ALL SELECT did, e, w_e, edge_id FROM d)"""


def _paths(chosen: str, detour: float) -> str:
    """All walks over distinct nodes from the ends of an origin's edge, then those that end well."""
    return PAIRS + f""",
far AS (SELECT oid, MAX(dist) * {detour} + 1e-5 AS top FROM {chosen} GROUP BY 1),
walk AS (
  SELECT o.oid, o.edge_id AS eo, z.node, z.way, z.c AS cost, [z.node] AS seen, []::BIGINT[] AS inside, top FROM o JOIN far USING (oid),
    LATERAL (SELECT o.s AS node, 1 AS way, o.w_s AS c UNION ALL SELECT o.e, 2, o.w_e) z WHERE z.c <= top
  UNION ALL
  SELECT oid, eo, a.e, way, cost + a.w, list_append(seen, a.e), list_append(inside, a.edge_id), top FROM walk JOIN adj a ON a.s = walk.node
  WHERE a.edge_id <> eo AND NOT list_contains(seen, a.e) AND cost + a.w <= top),
paths AS MATERIALIZED (
  SELECT k.oid, k.did, k.dist, k.p_dest, GREATEST(v.cost + x.c, 0.01) AS cost, list_append(list_prepend(v.eo, v.inside), d.edge_id) AS path
  FROM {chosen} k JOIN d USING (did) JOIN o ON o.oid = k.oid JOIN walk v ON v.oid = k.oid
    JOIN (SELECT did, s AS node, 1 AS side, w_s AS c FROM d UNION ALL SELECT did, e, 2, w_e FROM d) x ON x.did = k.did AND x.node = v.node
  WHERE v.cost + x.c <= k.dist * {detour} + 1e-5 AND NOT list_contains(v.inside, d.edge_id)
    AND (o.edge_id <> d.edge_id OR (o.w_s < d.w_s AND v.way = 1 AND x.side = 2) OR (o.w_s > d.w_s AND v.way = 2 AND x.side = 1))
  UNION ALL
  SELECT k.oid, k.did, k.dist, k.p_dest, GREATEST(ABS(o.w_s - d.w_s), 0.01), [o.edge_id] FROM {chosen} k JOIN d USING (did) JOIN o ON o.oid = k.oid
  WHERE o.edge_id = d.edge_id AND ABS(o.w_s - d.w_s) <= k.dist * {detour} + 1e-5)"""


def _trips(chosen: str, detour: float, decay: str, weight: str = "o.wt") -> str:
    return _paths(chosen, detour) + f""",
kw AS (SELECT oid, SUM(CASE rank WHEN 1 THEN 0.5 WHEN 2 THEN 0.25 WHEN 3 THEN 0.15 ELSE 0.1 END::DOUBLE * EXP(-0.003 * dist)) AS k FROM rk WHERE rank <= 4 GROUP BY 1),
trips AS MATERIALIZED (
  SELECT *, p_path * p_dest * decay * owt AS flow FROM (
    SELECT q.*, 1.0::DOUBLE / COUNT(*) OVER (PARTITION BY q.oid, q.did) AS p_path, {decay} AS decay, {weight} AS owt
    FROM paths q JOIN near ON near.oid = q.oid JOIN o ON o.oid = q.oid LEFT JOIN kw ON kw.oid = q.oid) WHERE owt <> 0)"""


EXPONENT, POWER, NONE = "EXP(-0.003 * near.nearest)", "1.0::DOUBLE / (q.cost * q.cost)", "1.0::DOUBLE"
FLOW = "SELECT edge_id, ROUND(SUM(flow), 6) AS betweenness FROM (SELECT flow, UNNEST(path) AS edge_id FROM trips) GROUP BY 1"


def _metric(name: str, value: str, source: str = "p", where: str = "TRUE") -> str:
    return f"SELECT o.oid, ROUND(COALESCE(v, 0), 6) AS {name} FROM o LEFT JOIN (SELECT oid, {value} AS v FROM {source} WHERE {where} GROUP BY 1) USING (oid)"


KNN = "SUM(CASE rank WHEN 1 THEN 0.5 WHEN 2 THEN 0.25 WHEN 3 THEN 0.15 ELSE 0.1 END::DOUBLE * CASE WHEN dist < 100 THEN 1 ELSE EXP(-0.003 * (dist - 100)) END)"
PAIR = "PARTITION BY LEAST(s, e), GREATEST(s, e)"


def sql() -> dict[str, str]:
    grid, pairs = f"WITH {GRID} ", f"WITH RECURSIVE {GRID}{PAIRS} "
    trips = lambda *a: f"WITH RECURSIVE {GRID}{_trips(*a)} "
    facility = "(SELECT * FROM p QUALIFY ROW_NUMBER() OVER (PARTITION BY did ORDER BY dist, oid) = 1)"
    return {
        "street_cost_rule": grid + "SELECT street_id, CASE WHEN a = 0 THEN len ELSE GREATEST(a, 0.01) END::DOUBLE AS weight FROM (SELECT *, CASE WHEN street_id % 37 = 0 THEN 0 WHEN street_id % 41 = 0 THEN -1 ELSE cost END::DOUBLE AS a FROM g_street)",
        "network_nodes_exact": grid + "SELECT ROW_NUMBER() OVER (ORDER BY x, y) - 1 AS node_id, x, y, degree FROM (SELECT x, y, COUNT(*) AS degree FROM (SELECT s AS node FROM g_street UNION ALL SELECT e FROM g_street) JOIN g_at USING (node) GROUP BY 1, 2)",
        "edges_discard": grid + "SELECT edge_id AS street_id, s, e, w FROM g_edge",
        "edges_split": grid + f""", r AS (SELECT *, CAST(cost AS DOUBLE) AS w, ROW_NUMBER() OVER ({PAIR} ORDER BY cost, street_id) AS rn, (SELECT MAX(street_id) FROM g_street) + 1 AS top, (SELECT n FROM g_dim) AS n FROM g_street)
          SELECT street_id AS edge_id, street_id AS parent_id, s, e, w, len FROM r WHERE rn = 1
          UNION ALL SELECT top + 2 * street_id, street_id, s, n + street_id, w / 2, len / 2 FROM r WHERE rn > 1
          UNION ALL SELECT top + 2 * street_id + 1, street_id, n + street_id, e, w / 2, len / 2 FROM r WHERE rn > 1""",
        "edges_keep": grid + f"SELECT street_id, MAX(street_id) OVER ({PAIR}) = street_id AS used FROM g_street",
        "edge_tags": grid + f"SELECT street_id, CASE WHEN COUNT(*) OVER ({PAIR}) > 1 THEN 'redundant_edge' WHEN cost < 51 THEN 'shorter than tolerance' WHEN cost < 153 THEN 'within 3x tolerance' WHEN s = e THEN 'cycle_edge' ELSE '' END AS tag FROM g_street",
        "attach_origins": grid + "SELECT oid, edge_id, w_s, w_e, wt FROM o",
        "attach_destinations": grid + "SELECT did, edge_id, w_s, w_e, wt FROM d",
        "edge_chain": grid + "SELECT edge_id, oid, CAST(ROW_NUMBER() OVER k AS INTEGER) AS place, w_s - COALESCE(LAG(w_s) OVER k, 0) AS gap FROM o WINDOW k AS (PARTITION BY edge_id ORDER BY w_s, oid)",
        "line_length": grid + "SELECT edge_id, ABS(a.x - b.x) + ABS(a.y - b.y) AS length, (a.x + b.x) / 2 AS mid_x, (a.y + b.y) / 2 AS mid_y FROM g_edge JOIN g_at a ON a.node = s JOIN g_at b ON b.node = e",
        "nearest_edge": grid + """, pt AS (SELECT c_custkey AS id, CAST((c_custkey * 7919) % (g * 100) AS DOUBLE) AS x, CAST((c_custkey * 104729) % (g * 100) AS DOUBLE) AS y FROM customer, g_dim),
          sg AS (SELECT edge_id, LEAST(a.x, b.x) AS x1, GREATEST(a.x, b.x) AS x2, LEAST(a.y, b.y) AS y1, GREATEST(a.y, b.y) AS y2 FROM g_edge JOIN g_at a ON a.node = s JOIN g_at b ON b.node = e),
          m AS (SELECT id, edge_id, SQRT(POW(GREATEST(x1 - x, 0, x - x2), 2) + POW(GREATEST(y1 - y, 0, y - y2), 2)) AS distance FROM pt, sg)
          SELECT id, b.edge_id AS edge_id, b.distance AS distance FROM (SELECT id, MIN({'distance': distance, 'edge_id': edge_id}) AS b FROM m GROUP BY 1)""",
        "endpoints_within_tolerance": grid + "SELECT a.node AS a, b.node AS b, ROUND(SQRT(POW(a.x - b.x, 2) + POW(a.y - b.y, 2)), 6) AS gap FROM g_at a JOIN g_at b ON b.gx BETWEEN a.gx - 1 AND a.gx + 1 AND b.gy BETWEEN a.gy - 1 AND a.gy + 1 AND a.node < b.node",
        "node_scope": f"WITH RECURSIVE {GRID}{SCOPE} SELECT oid, node, cost FROM scope",
        "od_distance": pairs + "SELECT oid, did, dist FROM p",
        "reach": pairs + _metric("reach", "SUM(wt)"),
        "gravity": pairs + _metric("gravity", "SUM(wt * EXP(-0.003 * dist))"),
        "gravity_alpha": pairs + _metric("gravity", "SUM(wt * wt * EXP(-0.003 * dist))"),
        "knn_access": pairs + _metric("knn_access", KNN, "rk", "rank <= 4"),
        "knn_weight": pairs + _metric("knn_weight", f"{KNN} * ANY_VALUE(owt)", "(SELECT rk.*, o.wt AS owt FROM rk JOIN o USING (oid))", "rank <= 4"),
        "closest_destination": pairs + "SELECT oid, did, dist FROM closest",
        "top_k_destinations": pairs + "SELECT oid, CAST(rank AS INTEGER) AS rank, did, dist FROM rk WHERE rank <= 3",
        "closest_facility": pairs + f"SELECT did, oid, dist FROM {facility}",
        "closest_facility_reach": pairs + _metric("reach", "SUM(wt)", facility),
        "service_area_destinations": pairs + "SELECT did, wt FROM d WHERE did IN (SELECT did FROM p)",
        "alternative_paths": f"WITH RECURSIVE {GRID}{_paths('(SELECT *, 1.0::DOUBLE AS p_dest FROM p)', 1.15)} SELECT oid, did, ROUND(cost, 6) AS cost, array_to_string(path, ',') AS path FROM paths",
        "huff_probability": pairs + "SELECT oid, did, ROUND(p_dest, 6) AS p_dest FROM huff",
        "betweenness_closest": trips("closest", 1.0, NONE) + FLOW,
        "betweenness_huff": trips("huff", 1.0, NONE) + FLOW,
        "betweenness_decay_exponent": trips("huff", 1.0, EXPONENT) + FLOW,
        "betweenness_decay_power": trips("huff", 1.0, POWER) + FLOW,
        "betweenness_detour": trips("huff", 1.15, EXPONENT) + FLOW,
        "betweenness_elastic": trips("huff", 1.0, NONE, "o.wt * kw.k") + FLOW,
        "betweenness_origin_stats": trips("huff", 1.15, EXPONENT) + "SELECT oid, ROUND(SUM(p_path * p_dest * cost), 6) AS mean_path_length, ROUND(SUM(p_path * p_dest * decay * cost), 6) AS probable_travel_distance, MIN(dist) AS closest_destination, MAX(dist) AS furthest_destination, COUNT(*) AS paths, COUNT(DISTINCT did) AS destinations FROM trips GROUP BY 1",
        "path_exposure": trips("huff", 1.15, EXPONENT)
        + """, x AS (SELECT oid, did, path, cost, p_path * p_dest AS pr, decay, SUM(w * (edge_id % 11)) / SUM(w) AS mean FROM (SELECT *, UNNEST(path) AS edge_id FROM trips) JOIN g_edge USING (edge_id) GROUP BY ALL)
          SELECT oid, ROUND(SUM(pr * mean), 6) AS exposure, ROUND(SUM(pr * mean * decay), 6) AS decayed_exposure, ROUND(SUM(pr * mean * cost), 6) AS hazard_meters, ROUND(SUM(pr * mean * decay * cost), 6) AS decayed_hazard_meters FROM x GROUP BY 1""",
        "turn_penalty_distance": f"""WITH RECURSIVE {GRID},
          tn AS MATERIALIZED (SELECT a.s AS a, a.e AS b, c.e AS c, c.w, CASE WHEN (x.gx = y.gx) <> (y.gx = z.gx) THEN 30.0 ELSE 0.0 END::DOUBLE AS pen
            FROM adj a JOIN adj c ON c.s = a.e JOIN g_at x ON x.node = a.s JOIN g_at y ON y.node = a.e JOIN g_at z ON z.node = c.e),
          sc(oid, a, b, cost) USING KEY (oid, a, b) AS (
            SELECT oid, a, b, MIN(c) FROM (SELECT oid, e AS a, s AS b, w_s AS c FROM o UNION ALL SELECT oid, s, e, w_e FROM o) z WHERE c <= 400 GROUP BY 1, 2, 3
            UNION
            SELECT t.oid, n.b, n.c, MIN(t.cost + n.w + n.pen) FROM sc t JOIN tn n ON n.a = t.a AND n.b = t.b LEFT JOIN recurring.sc r ON r.oid = t.oid AND r.a = n.b AND r.b = n.c
            WHERE t.cost + n.w + n.pen <= 400 AND (r.cost IS NULL OR t.cost + n.w + n.pen < r.cost) GROUP BY 1, 2, 3)
          SELECT oid, did, MIN(dist) AS dist FROM (
            SELECT sc.oid, x.did, sc.cost + n.pen + x.c AS dist FROM sc JOIN tn n ON n.a = sc.a AND n.b = sc.b
              JOIN (SELECT did, s AS node, e AS other, w_s AS c FROM d UNION ALL SELECT did, e, s, w_e FROM d) x ON x.node = n.b AND x.other = n.c
            UNION ALL SELECT o.oid, d.did, ABS(o.w_e - d.w_e) FROM o JOIN d USING (edge_id)) WHERE dist <= 400 GROUP BY 1, 2""",
        "color_gradient": "SELECT p_partkey, ROUND(255 - v, 6) AS red, ROUND(v, 6) AS green, 0::DOUBLE AS blue FROM (SELECT p_partkey, (p_size - MIN(p_size) OVER ()) / (MAX(p_size) OVER () - MIN(p_size) OVER ()) * 255.0::DOUBLE AS v FROM part)",
        "color_quantile": "SELECT p_partkey, ROUND(255 - v, 6) AS red, ROUND(v, 6) AS green, 0::DOUBLE AS blue FROM (SELECT p_partkey, (RANK() OVER (ORDER BY p_size) + (COUNT(*) OVER (PARTITION BY p_size) - 1) / 2) / COUNT(*) OVER () * 255.0::DOUBLE AS v FROM part)",
        "color_categorical": "SELECT p_partkey, CASE p_size WHEN 1 THEN 10 WHEN 2 THEN 40 ELSE 7 END::DOUBLE AS red, CASE p_size WHEN 1 THEN 20 WHEN 2 THEN 50 ELSE 8 END::DOUBLE AS green, CASE p_size WHEN 1 THEN 30 WHEN 2 THEN 60 ELSE 9 END::DOUBLE AS blue FROM part",
        "text_labels": "SELECT p_partkey, CAST(p_size AS VARCHAR) AS size, p_name AS name, FORMAT('{:,}', CAST(FLOOR(p_partkey * 1001.7::DOUBLE) AS BIGINT)) AS thousands FROM part",
        "diagnostics_width": "SELECT p_partkey, ROUND(((p_size - MIN(p_size) OVER ()) / (MAX(p_size) OVER () - MIN(p_size) OVER ()) + 0.1::DOUBLE) * 5, 6) AS width FROM part",
        "web_map_degrees": grid + "SELECT node, ROUND(DEGREES(x * 1000 / 6378137.0::DOUBLE), 7) AS longitude, ROUND(DEGREES(2 * ATAN(EXP(y * -1000 / 6378137.0::DOUBLE)) - PI() / 2), 7) AS latitude FROM g_at",
        "node_bearing": grid + "SELECT node, ROUND(CASE WHEN a < 0 THEN a + 2 * PI() ELSE a END, 7) AS bearing FROM (SELECT node, ATAN2(x - 500::DOUBLE, y - 300::DOUBLE) AS a FROM g_at)",
        "knn_totals": "SELECT id, t AS total_knn_access, ROUND((t - MIN(t) OVER ()) / (MAX(t) OVER () - MIN(t) OVER ()), 6) AS normalized_knn_access FROM (SELECT c_custkey AS id, CAST(c_custkey % 7 + CASE WHEN c_custkey % 11 > 0 THEN c_custkey % 5 ELSE 0 END AS DOUBLE) AS t FROM customer)",
        "pairing_changes": "SELECT r AS row, f IS DISTINCT FROM pf OR n = 1 AS new_streets, f IS DISTINCT FROM pf OR c IS DISTINCT FROM pc OR n = 1 AS new_network FROM (SELECT *, LAG(f) OVER (ORDER BY r) AS pf, LAG(c) OVER (ORDER BY r) AS pc, ROW_NUMBER() OVER (ORDER BY r) AS n FROM (SELECT CAST(n_nationkey AS BIGINT) AS r, n_regionkey AS f, CASE WHEN n_nationkey % 5 > 0 THEN (n_nationkey // 2) % 3 END AS c FROM nation))",
        "flow_error_summary": """WITH b AS (SELECT CASE WHEN p_partkey % 17 > 0 THEN p_size ELSE 0 END::DOUBLE AS s, CASE WHEN p_partkey % 13 > 0 THEN CASE WHEN p_partkey % 34 > 0 THEN p_size * (100 + p_partkey % 7 - 3) / 100 ELSE 0 END::DOUBLE END AS g FROM part),
          x AS (SELECT s, g, CASE WHEN s <> 0 THEN ABS(s - g) / ABS(s) * 100 WHEN ABS(s - g) > 0 THEN 'inf'::DOUBLE END AS gap FROM b)
          SELECT SUM(s) AS flow_sum, ROUND(SUM(g), 6) AS golden_sum, AVG(gap) AS mean_error, ROUND(MEDIAN(gap), 6) AS median_error, MAX(gap) AS max_error, COUNT(*) FILTER (gap > 0.1) AS over_0_1, COUNT(*) FILTER (gap > 1) AS over_1, COUNT(*) FILTER (gap > 3) AS over_3, COUNT(*) FILTER (gap > 5) AS over_5 FROM x""",
        "radius_scale": "SELECT p_partkey, ROUND(5 + 5 * (p_size - MIN(p_size) OVER ()) / (MAX(p_size) OVER () - MIN(p_size) OVER ()), 6) AS radius FROM part",
        "flow_width": "SELECT p_partkey, ROUND(p_size / MAX(p_size) OVER () * 40 + 0.5, 6) AS width FROM part",
    }
