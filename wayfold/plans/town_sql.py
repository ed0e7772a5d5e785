"""DuckDB SQL for the queries on the town."""

from __future__ import annotations

from wayfold.plans import oracles

BASE = oracles.GRID[: oracles.GRID.index("g_edge AS")].rstrip().rstrip(",")


def _wobble(factor: int, span: int, by: str = "street_id") -> str:
    return f"CAST(({by} * {factor}) % {span} - {span // 2} AS DOUBLE)"


def _gap(a: str, b: str, c: str, d: str) -> str:
    """Distance between the points (a, b) and (c, d)."""
    return f"SQRT(({a} - {c}) * ({a} - {c}) + ({b} - {d}) * ({b} - {d}))"


LINES = f"""{BASE},
t_at AS (SELECT node, x + {_wobble(37, 41, "node")} AS x, y + {_wobble(53, 37, "node")} AS y FROM g_at),
t_raw AS (SELECT street_id, CAST(cost AS DOUBLE) AS w,
    a.x + {_wobble(7, 5)} / 8 AS x1, a.y + {_wobble(11, 5)} / 8 AS y1, (a.x + b.x) / 2 + {_wobble(29, 31)} AS x2, (a.y + b.y) / 2 + {_wobble(31, 29)} AS y2,
    b.x + {_wobble(13, 5)} / 8 AS x3, b.y + {_wobble(17, 5)} / 8 AS y3
  FROM g_street JOIN t_at a ON a.node = s JOIN t_at b ON b.node = e WHERE s <> e),
t_line AS MATERIALIZED (SELECT *, {_gap("x1", "y1", "x2", "y2")} + {_gap("x2", "y2", "x3", "y3")} AS len FROM t_raw),
t_tip AS (SELECT street_id, w, 0 AS side, x1 AS x, y1 AS y FROM t_line UNION ALL SELECT street_id, w, 1, x3, y3 FROM t_line)"""


def _nodes(tolerance: float) -> str:
    """Ends in order; an end is a node unless an earlier node is within the tolerance."""
    return f"""{LINES},
t_end AS MATERIALIZED (SELECT *, ROW_NUMBER() OVER (ORDER BY side, w DESC, street_id) - 1 AS r, CAST(FLOOR(x / 2) AS BIGINT) AS cx, CAST(FLOOR(y / 2) AS BIGINT) AS cy FROM t_tip),
t_off AS (SELECT i, j FROM (VALUES (-1), (0), (1)) u(i), (VALUES (-1), (0), (1)) v(j)),
t_nb AS MATERIALIZED (SELECT a.r AS lo, b.r AS hi FROM t_end a JOIN (SELECT r, x, y, cx + i AS cx, cy + j AS cy FROM t_end, t_off) b USING (cx, cy) WHERE a.r < b.r AND {_gap("a.x", "a.y", "b.x", "b.y")} <= {tolerance}),
t_state(r, st) USING KEY (r) AS (
  SELECT r, 0 FROM t_end
  UNION
  SELECT c.r, CASE WHEN MAX(CASE WHEN l.st = 1 THEN 1 ELSE 0 END) = 1 THEN 2 ELSE 1 END
  FROM recurring.t_state c LEFT JOIN t_nb n ON n.hi = c.r LEFT JOIN recurring.t_state l ON l.r = n.lo
  WHERE c.st = 0 AND EXISTS (SELECT 1 FROM t_state) GROUP BY c.r
  HAVING MAX(CASE WHEN l.st = 1 THEN 1 ELSE 0 END) = 1 OR COUNT(CASE WHEN l.st = 0 THEN 1 END) = 0),
t_seed AS MATERIALIZED (SELECT r, x, y, ROW_NUMBER() OVER (ORDER BY r) - 1 AS node_id FROM t_state JOIN t_end USING (r) WHERE st = 1),
t_own AS MATERIALIZED (SELECT e.street_id, e.side, s.node_id, s.x, s.y
  FROM (SELECT r, MIN(lo) AS lo FROM (SELECT n.hi AS r, n.lo FROM t_nb n JOIN t_seed d ON d.r = n.lo UNION ALL SELECT r, r FROM t_seed) GROUP BY 1) m JOIN t_end e USING (r) JOIN t_seed s ON s.r = m.lo),
t_node AS MATERIALIZED (SELECT node_id, x, y, CAST(COUNT(*) AS INTEGER) AS degree FROM t_own GROUP BY ALL),
t_edge AS MATERIALIZED (SELECT l.street_id, a.node_id AS s, b.node_id AS e, l.w, l.len, a.x AS x1, a.y AS y1, l.x2, l.y2, b.x AS x3, b.y AS y3,
    {_gap("a.x", "a.y", "l.x2", "l.y2")} AS n1, {_gap("l.x2", "l.y2", "b.x", "b.y")} AS n2
  FROM t_line l JOIN t_own a ON a.street_id = l.street_id AND a.side = 0 JOIN t_own b ON b.street_id = l.street_id AND b.side = 1)"""


PAIR = "PARTITION BY LEAST(s, e), GREATEST(s, e) ORDER BY w, street_id"


def _placed(name: str, points: str) -> str:
    """Points (id, px, py, wt) on their nearest edges."""
    q = "ax + t * dx", "ay + t * dy"
    return f"""{name}_pt AS ({points}),
{name}_all AS (SELECT *, {_gap("px", "py", f"({q[0]})", f"({q[1]})")} AS gap FROM (
  SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN GREATEST(0::DOUBLE, LEAST(1::DOUBLE, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy))) ELSE 0::DOUBLE END AS t
  FROM (SELECT *, bx - ax AS dx, yb - ay AS dy FROM {name}_pt, seg))),
{name}_best AS (SELECT id, MIN({{'gap': gap, 'edge_id': edge_id}}) AS b FROM {name}_all GROUP BY 1),
{name}_leg AS (SELECT a.* FROM {name}_all a JOIN {name}_best b ON b.id = a.id AND b.b.edge_id = a.edge_id QUALIFY ROW_NUMBER() OVER (PARTITION BY a.id ORDER BY a.gap, a.n) = 1),
{name}_on AS MATERIALIZED (SELECT id, edge_id, s, e, w, wt, px, py, ax + t * dx AS x, ay + t * dy AS y, gap, w * ((before + t * {_gap("bx", "yb", "ax", "ay")}) / len) AS w_s FROM {name}_leg JOIN g_edge USING (edge_id))"""


def _points(table: str, key: str, f1: int, f2: int, classes: int) -> str:
    return f"SELECT {key} AS id, CAST(({key} * {f1}) % (g * 100) AS DOUBLE) AS px, CAST(({key} * {f2}) % (g * 100) AS DOUBLE) AS py, CAST({key} % {classes} AS DOUBLE) AS wt FROM {table}, g_dim"


NETWORK = f"""{_nodes(1.0)},
g_edge AS MATERIALIZED (SELECT street_id AS edge_id, * EXCLUDE (street_id) FROM t_edge WHERE s <> e QUALIFY ROW_NUMBER() OVER ({PAIR}) = 1),
seg AS MATERIALIZED (SELECT edge_id, 0 AS n, x1 AS ax, y1 AS ay, x2 AS bx, y2 AS yb, 0::DOUBLE AS before FROM g_edge UNION ALL SELECT edge_id, 1, x2, y2, x3, y3, n1 FROM g_edge),
adj AS MATERIALIZED (SELECT s, e, w, edge_id FROM g_edge UNION ALL SELECT e, s, w, edge_id FROM g_edge),
{_placed("home", _points("customer", "c_custkey", 7919, 104729, 4))},
{_placed("shop", _points("supplier", "s_suppkey", 611953, 15485863, 5))},
o AS MATERIALIZED (SELECT id AS oid, edge_id, s, e, w_s, w - w_s AS w_e, wt FROM home_on),
d AS MATERIALIZED (SELECT id AS did, edge_id, s, e, w_s, w - w_s AS w_e, wt FROM shop_on)"""

EXPONENT, PLAIN = "EXP(-0.003 * near.nearest)", "1.0::DOUBLE"


def _trips(chosen: str, decay: str, detour: float = 1.15) -> str:
    """The trips of origins that weigh something."""
    return f"WITH RECURSIVE {NETWORK}" + oracles._trips(chosen, detour, decay)


FLOW = """, f AS (SELECT edge_id, SUM(flow) AS v FROM (SELECT flow, UNNEST(path) AS edge_id FROM trips) GROUP BY 1)
SELECT street_id AS id, CASE WHEN g.edge_id IS NOT NULL THEN ROUND(COALESCE(v, 0), 6) END AS flow FROM t_line LEFT JOIN g_edge g ON g.edge_id = street_id LEFT JOIN f ON f.edge_id = street_id"""

#: Corners of hulls yb walking around: from the leftmost, lowest point on to the one with all others to the left.
HULLS = """,
dead AS (SELECT s AS node FROM adj GROUP BY 1 HAVING COUNT(DISTINCT e) < 2),
hp AS MATERIALIZED (
  SELECT DISTINCT oid, 'destinations' AS kind, px AS x, py AS y FROM p JOIN shop_on ON id = did
  UNION SELECT oid, 'streets', n.x, n.y FROM scope JOIN t_node n ON n.node_id = node WHERE oid IN (SELECT oid FROM p) AND node NOT IN (SELECT node FROM dead)),
h0 AS (SELECT oid, kind, MIN({'x': x, 'y': y}) AS c, COUNT(*) AS n FROM hp GROUP BY 1, 2),
hull AS (
  SELECT oid, kind, c.x AS x, c.y AS y, c.x AS fx, c.y AS fy, 0::DOUBLE AS heading, 0 AS k, n FROM h0
  UNION ALL
  SELECT oid, kind, nx, ny, fx, fy, ATAN2(ny - y, nx - x), k + 1, n FROM (
    SELECT h.*, q.x AS nx, q.y AS ny, ROW_NUMBER() OVER (PARTITION BY h.oid, h.kind ORDER BY
      ROUND(CASE WHEN turn < -1e-9 THEN turn + 2 * PI() WHEN turn > 2 * PI() - 1e-9 THEN turn - 2 * PI() ELSE turn END, 9), (q.x - h.x) * (q.x - h.x) + (q.y - h.y) * (q.y - h.y) DESC) AS rn
    FROM hull h JOIN hp q ON q.oid = h.oid AND q.kind = h.kind AND (q.x <> h.x OR q.y <> h.y), LATERAL (SELECT CASE WHEN h.k = 0 THEN ATAN2(q.y - h.y, q.x - h.x) + PI() / 2 ELSE
      ATAN2(q.y - h.y, q.x - h.x) - h.heading + CASE WHEN ATAN2(q.y - h.y, q.x - h.x) - h.heading < -1e-9 THEN 2 * PI() ELSE 0 END END AS turn) t
    WHERE h.n > 1 AND (h.k = 0 OR h.x <> h.fx OR h.y <> h.fy) AND h.k < 200) WHERE rn = 1),
corner AS MATERIALIZED (SELECT oid, kind, x, y, k, COUNT(*) OVER (PARTITION BY oid, kind) AS m FROM hull WHERE k = 0 OR x <> fx OR y <> fy)"""

#: Lengths of streets inside the union of both hulls: each segment is cut yb the sides of each hull, then spans are united.
CLIP = """,
side AS (SELECT a.oid, a.kind, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS yb FROM corner a JOIN corner b ON b.oid = a.oid AND b.kind = a.kind AND b.k = (a.k + 1) % a.m WHERE a.m > 2),
box AS (SELECT oid, kind, MIN(x) AS x0, MAX(x) AS x1, MIN(y) AS y0, MAX(y) AS y1 FROM corner GROUP BY 1, 2),
span AS (
  SELECT oid, kind, edge_id, n, len, MAX(GREATEST(0, lo)) AS t0, MIN(LEAST(1, hi)) AS t1 FROM (
    SELECT oid, kind, edge_id, n, len, CASE WHEN u < 0 AND v < 0 THEN 2 WHEN u < 0 THEN u / (u - v) ELSE 0 END AS lo, CASE WHEN u >= 0 AND v < 0 THEN u / (u - v) ELSE 1 END AS hi FROM (
      SELECT i.oid, i.kind, g.edge_id, g.n, SQRT((g.bx - g.ax) * (g.bx - g.ax) + (g.yb - g.ay) * (g.yb - g.ay)) AS len,
        (i.bx - i.ax) * (g.ay - i.ay) - (i.yb - i.ay) * (g.ax - i.ax) AS u, (i.bx - i.ax) * (g.yb - i.ay) - (i.yb - i.ay) * (g.bx - i.ax) AS v
      FROM box JOIN seg g ON GREATEST(g.ax, g.bx) >= x0 AND LEAST(g.ax, g.bx) <= x1 AND GREATEST(g.ay, g.yb) >= y0 AND LEAST(g.ay, g.yb) <= y1 JOIN side i ON i.oid = box.oid AND i.kind = box.kind))
  GROUP BY 1, 2, 3, 4, 5 HAVING MAX(GREATEST(0, lo)) < MIN(LEAST(1, hi)))"""

SPLIT = f"""WITH RECURSIVE {_nodes(1.0)}, r AS (SELECT *, ROW_NUMBER() OVER ({PAIR}) AS rn, (n1 + n2) / 2 AS half, (SELECT MAX(node_id) FROM t_node) + 1 AS ln, (SELECT MAX(street_id) FROM t_edge) + 1 AS le FROM t_edge)"""


def sql() -> dict[str, str]:
    pairs = f"WITH RECURSIVE {NETWORK}{oracles.PAIRS} "
    facility = "(SELECT * FROM p QUALIFY ROW_NUMBER() OVER (PARTITION BY did ORDER BY dist, oid) = 1)"
    knn = "SUM(CASE rank WHEN 1 THEN 0.5 WHEN 2 THEN 0.25 WHEN 3 THEN 0.15 ELSE 0.1 END::DOUBLE * CASE WHEN dist < 100 THEN 1 ELSE EXP(-0.003 * (dist - 100)) END)"
    home = "FROM customer LEFT JOIN"
    return {
        "edge_endpoints": f"WITH {LINES}, n AS (SELECT x, y, ROW_NUMBER() OVER (ORDER BY x, y) - 1 AS node_id FROM (SELECT DISTINCT x, y FROM t_tip)) SELECT street_id, a.node_id AS s, b.node_id AS e FROM t_line JOIN n a ON a.x = x1 AND a.y = y1 JOIN n b ON b.x = x3 AND b.y = y3",
        "nodes_tolerance": f"WITH RECURSIVE {_nodes(0.5)} SELECT node_id, x, y, degree FROM t_node",
        "edges_snapped": f"WITH RECURSIVE {_nodes(0.5)} SELECT street_id, s, e, x1, y1, x3 AS x2, y3 AS y2, ROUND(len, 6) AS len, ABS(len - (n1 + n2)) > 0 AS snapped, ROUND(ABS(len - (n1 + n2)), 6) AS snapping_distance FROM t_edge",
        "split_nodes": f"""{SPLIT} SELECT node_id, ROUND(x, 6) AS x, ROUND(y, 6) AS y, degree FROM t_node UNION ALL
          SELECT ln + street_id, ROUND(CASE WHEN half <= n1 THEN x1 + half / n1 * (x2 - x1) ELSE x2 + (half - n1) / n2 * (x3 - x2) END, 6), ROUND(CASE WHEN half <= n1 THEN y1 + half / n1 * (y2 - y1) ELSE y2 + (half - n1) / n2 * (y3 - y2) END, 6), 2 FROM r WHERE rn > 1""",
        "split_lines": f"""{SPLIT} SELECT street_id AS edge_id, street_id AS parent_id, s, e, ROUND(w, 6) AS w, ROUND(n1 + n2, 6) AS drawn FROM r WHERE rn = 1
          UNION ALL SELECT le + 2 * street_id, street_id, s, ln + street_id, ROUND(w / 2, 6), ROUND(half, 6) FROM r WHERE rn > 1 UNION ALL SELECT le + 2 * street_id + 1, street_id, ln + street_id, e, ROUND(w / 2, 6), ROUND(half, 6) FROM r WHERE rn > 1""",
        "insert_node": f"WITH RECURSIVE {NETWORK} SELECT id AS source_id, edge_id, s, e, ROUND(w_s, 6) AS w_s, ROUND(w - w_s, 6) AS w_e, wt, ROUND(x, 6) AS x, ROUND(y, 6) AS y FROM home_on",
        "connectors": f"WITH RECURSIVE {NETWORK} SELECT id, ROUND(gap, 6) AS length FROM home_on",
        "tool_accessibility": pairs + f"SELECT c_custkey AS id, ROUND(COALESCE(reach, 0), 6) AS reach, ROUND(COALESCE(gravity, 0), 6) AS gravity, ROUND(COALESCE(knn, 0), 6) AS knn {home} (SELECT oid, SUM(wt) AS reach, SUM(wt * EXP(-0.003 * dist)) AS gravity FROM p GROUP BY 1) a ON a.oid = c_custkey LEFT JOIN (SELECT oid, {knn} AS knn FROM rk WHERE rank <= 4 GROUP BY 1) k ON k.oid = c_custkey",
        "tool_accessibility_weight": pairs + f"SELECT c_custkey AS id, ROUND(COALESCE(reach, 0), 6) AS reach, ROUND(COALESCE(gravity, 0), 6) AS gravity {home} (SELECT oid, SUM(j) AS reach, SUM(j * j * EXP(-0.003 * dist)) AS gravity FROM (SELECT *, CASE WHEN did % 3 > 0 THEN did % 13 ELSE 0 END::DOUBLE AS j FROM p) GROUP BY 1) a ON a.oid = c_custkey",
        "tool_facilities": pairs + f"SELECT s_suppkey AS id, oid AS home, ROUND(dist, 6) AS distance FROM supplier LEFT JOIN {facility} f ON f.did = s_suppkey",
        "tool_facility_reach": pairs + f"SELECT c_custkey AS id, ROUND(COALESCE(reach, 0), 6) AS reach, ROUND(COALESCE(gravity, 0), 6) AS gravity {home} (SELECT oid, SUM(wt) AS reach, SUM(wt * EXP(-0.003 * dist)) AS gravity FROM {facility} GROUP BY 1) a ON a.oid = c_custkey",
        "tool_betweenness": _trips("huff", EXPONENT) + FLOW,
        "tool_betweenness_closest": _trips("closest", PLAIN) + FLOW,
        "tool_betweenness_origins": _trips("huff", EXPONENT)
        + f""", g AS (SELECT oid, COUNT(*) AS reach, SUM(EXP(-0.003 * dist)) AS gravity FROM p JOIN o USING (oid) WHERE o.wt <> 0 AND oid IN (SELECT oid FROM huff) GROUP BY 1),
          e AS (SELECT oid, MIN(dist) AS lo, MAX(dist) AS hi, COUNT(*) AS n FROM huff JOIN o USING (oid) WHERE o.wt <> 0 GROUP BY 1),
          t AS (SELECT oid, SUM(p_path * p_dest * cost) AS mean, SUM(p_path * p_dest * decay * cost) AS far, COUNT(*) AS n, CAST(SUM(LEN(path)) AS BIGINT) AS m FROM trips GROUP BY 1)
          SELECT c_custkey AS id, COALESCE(reach, 0) AS reach, ROUND(COALESCE(gravity, 0), 6) AS gravity, ROUND(lo, 6) AS closest_destination_distance, ROUND(hi, 6) AS furthest_destination_distance, ROUND(mean, 6) AS mean_path_length, ROUND(far, 6) AS probable_travel_distance, e.n AS eligible_destinations, t.n AS path_count, m AS path_segment_count
          {home} g ON g.oid = c_custkey LEFT JOIN e ON e.oid = c_custkey LEFT JOIN t ON t.oid = c_custkey""",
        "tool_exposure": _trips("huff", PLAIN)
        + f""", x AS (SELECT oid, did, path, cost, p_path * p_dest AS pr, SUM(w * (edge_id % 11)) / SUM(w) AS mean FROM (SELECT *, UNNEST(path) AS edge_id FROM trips) JOIN g_edge USING (edge_id) GROUP BY ALL)
          SELECT c_custkey AS id, ROUND(COALESCE(v, 0), 6) AS exposure {home} (SELECT oid, SUM(pr * mean * cost) AS v FROM x GROUP BY 1) a ON a.oid = c_custkey""",
        "tool_elastic": pairs + f"SELECT c_custkey AS id, ROUND(COALESCE(v, 0), 6) AS elastic {home} (SELECT rk.oid, {knn} * ANY_VALUE(o.wt) AS v FROM rk JOIN o USING (oid) WHERE rank <= 4 AND o.wt <> 0 GROUP BY 1) a ON a.oid = c_custkey",
        "tool_alternative_paths": f"WITH RECURSIVE {NETWORK}{oracles._paths('(SELECT *, 1.0::DOUBLE AS p_dest FROM p WHERE oid = (SELECT MIN(oid) FROM o))', 1.15)} SELECT did AS destination, ROUND(cost, 6) AS distance, array_to_string(path, ',') AS edges, ROUND(SUM(n1 + n2), 6) AS drawn FROM (SELECT did, cost, path, UNNEST(path) AS edge_id FROM paths) JOIN g_edge USING (edge_id) GROUP BY did, cost, path",
        "service_area_hull": pairs.rstrip() + HULLS + " SELECT oid AS source_id, kind, x, y FROM corner",
        "service_area_streets": pairs.rstrip() + HULLS + CLIP
        + """ SELECT oid AS origin_id, ROUND(SUM(len * (part - twice)), 4) AS length FROM (
            SELECT oid, edge_id, n, len, SUM(t1 - t0) AS part, CASE WHEN COUNT(*) = 2 THEN GREATEST(0, MIN(t1) - MAX(t0)) ELSE 0 END AS twice FROM span GROUP BY 1, 2, 3, 4) GROUP BY 1""",
        "service_area_tool": pairs + "SELECT DISTINCT oid AS id, name FROM p, (VALUES ('service area border'), ('origin')) v(name) UNION ALL SELECT DISTINCT did, 'destination' FROM p",
    }
