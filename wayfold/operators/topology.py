"""From street lines to a network: end points as nodes, exactly or within a tolerance, and features on its edges.

Streets are (street_id, coords, w, len): a line, its cost and its length. Lines without two points, or
with a coordinate that is missing or not finite, and streets without a cost connect nothing and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import geometry as G
from wayfold.operators.ordering import running
from wayfold.session import Scratch


def finite(*coords: Column) -> Column:
    out = F.lit(True)
    for c in coords:
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out


def sound(streets: DataFrame) -> DataFrame:
    """The streets that can connect something."""
    whole = F.forall("coords", lambda p: p.isNotNull() & finite(p["x"], p["y"]))
    return streets.where((F.size("coords") >= 2) & whole & F.col("w").isNotNull())


def _ends(streets: DataFrame) -> DataFrame:
    """(street_id, side, x, y, w): both ends of every street, 0 its start and 1 its end."""
    a, b = G.end_points(F.col("coords"))
    end = lambda side, p: F.struct(F.lit(side).alias("side"), p["x"].alias("x"), p["y"].alias("y"))
    return streets.select("street_id", "w", F.inline(F.array(end(0, a), end(1, b))))


def _with_ends(streets: DataFrame, ends: DataFrame) -> DataFrame:
    """Streets with the node ids s and e from (street_id, side, node_id)."""
    both = ends.groupBy("street_id").agg(F.max(F.when(F.col("side") == 0, F.col("node_id"))).alias("s"), F.max(F.when(F.col("side") == 1, F.col("node_id"))).alias("e"))
    return streets.join(both, "street_id")


def exact(streets: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, x, y, degree), by rank of x, then y, and streets with s and e."""
    streets = sound(streets)
    ends = scratch.keep(_ends(streets))
    points = ends.groupBy("x", "y").agg(F.count("*").cast("int").alias("degree"))
    nodes = scratch.keep(running(points, ["x", "y"], F.lit(1), "node_id", scratch).select("node_id", "x", "y", "degree"))
    of = ends.join(nodes, ["x", "y"]).select("street_id", "side", "node_id")
    return nodes, scratch.keep(_with_ends(streets, of))


def _cell(c: str, size: float) -> Column:
    return F.floor(F.col(c) / size)


#: A cell and the eight around it. Long expressions are written as SQL text here: each step of a Column costs a call.
AROUND = "inline(array(" + ", ".join(f"struct(cx + ({i}) AS cx, cy + ({j}) AS cy)" for i in (-1, 0, 1) for j in (-1, 0, 1)) + "))"


def _beside(df: DataFrame) -> DataFrame:
    """Every row in its own cell and the eight around it."""
    return df.selectExpr(*[f"`{c}`" for c in df.columns if c not in ("cx", "cy")], AROUND)


def within(streets: DataFrame, tolerance: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """As ``exact``, with ends up to ``tolerance`` apart as one node, and lines drawn to their nodes.

    Ends come in order: starts before ends, costly streets first, then by id. Each end that no earlier
    node has taken becomes a node and takes all free ends within the tolerance; so ends that are near the
    same node need not be near each other. This is found in rounds: an end is a node as soon as no undecided
    end of its cell or the eight around it comes before it, and what is near a node is decided. Equal
    points are one from the start, and no pairs of ends are formed, so a crowded place costs no more
    than its ends. Nodes are numbered in that order. ``len`` and ``w`` stay those of the undrawn line;
    ``snapped`` says whether the drawn one has another length, ``snapping_distance`` by how much.
    """
    streets = sound(streets)
    ordered = running(_ends(streets).withColumn("_light", -F.col("w")), ["side", "_light", "street_id"], F.lit(1), "rank", scratch)
    ends = scratch.keep(ordered.select("street_id", "side", "x", "y", "rank"))
    size = tolerance * (1 + 1e-6)
    points = ends.groupBy("x", "y").agg(F.min("rank").alias("rank")).select("x", "y", "rank", _cell("x", size).alias("cx"), _cell("y", size).alias("cy"))
    points = rest = scratch.keep(points)
    near = lambda a, b: (F.col(f"{a}x") - F.col(f"{b}x")) * (F.col(f"{a}x") - F.col(f"{b}x")) + (F.col(f"{a}y") - F.col(f"{b}y")) * (F.col(f"{a}y") - F.col(f"{b}y"))
    seeds = None
    while not rest.isEmpty():
        first = scratch.keep(rest.groupBy("cx", "cy").agg(F.min(F.struct("rank", "x", "y")).alias("p")).select("cx", "cy", "p.*"))
        before = _beside(first.select("rank", "cx", "cy")).groupBy("cx", "cy").agg(F.min("rank").alias("least"))
        new = scratch.keep(first.join(before, ["cx", "cy"]).where("rank = least").select("x", "y", "rank", "cx", "cy"))
        seeds = new if seeds is None else seeds.unionByName(new)
        around = _beside(new.select(F.col("x").alias("sx"), F.col("y").alias("sy"), "cx", "cy"))
        taken = rest.join(around, ["cx", "cy"]).where(F.sqrt(near("", "s")) <= tolerance).select("rank").distinct()
        left = scratch.keep(rest.join(taken, "rank", "left_anti"))
        if rest is not points:
            scratch.drop(rest)
        rest = left
    if seeds is None:
        seeds = points
    nodes = scratch.keep(running(seeds.select("x", "y", "rank", "cx", "cy"), ["rank"], F.lit(1), "node_id", scratch))
    around = _beside(nodes.select(F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("rank").alias("srank"), "node_id", "cx", "cy"))
    owner = points.join(around, ["cx", "cy"]).where(F.sqrt(near("", "s")) <= tolerance).groupBy("x", "y").agg(F.min(F.struct("srank", "node_id", "sx", "sy")).alias("node"))
    owned = scratch.keep(ends.join(owner, ["x", "y"]).select("street_id", "side", "node.node_id", "node.sx", "node.sy"))
    degree = owned.groupBy("node_id").agg(F.count("*").cast("int").alias("degree"))
    nodes = scratch.keep(nodes.join(degree, "node_id").select("node_id", "x", "y", "degree"))
    at = lambda side: F.max(F.when(F.col("side") == side, F.struct(F.col("sx").alias("x"), F.col("sy").alias("y"))))
    both = owned.groupBy("street_id").agg(F.max(F.when(F.col("side") == 0, F.col("node_id"))).alias("s"), F.max(F.when(F.col("side") == 1, F.col("node_id"))).alias("e"), at(0).alias("_a"), at(1).alias("_b"))
    drawn = F.concat(F.array("_a"), F.slice("coords", F.lit(2), F.size("coords") - 2), F.array("_b"))
    edges = streets.join(both, "street_id").withColumn("_old", G.length(F.col("coords"))).withColumn("coords", drawn)
    gap = F.abs(F.col("_old") - G.length(F.col("coords")))
    edges = edges.withColumn("snapping_distance", gap).withColumn("snapped", F.col("snapping_distance") > 0)
    return nodes, scratch.keep(edges.drop("_a", "_b", "_old"))


def _by_weight() -> Window:
    return Window.partitionBy(F.least("s", "e"), F.greatest("s", "e")).orderBy("w", "street_id")


def split(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Keep the lightest of parallel edges; cut each other one in its middle, at a new node of degree 2.

    Edges are (street_id, s, e, w, len, coords); the result has edge_id and parent_id. New ids follow the
    last ones and are made from the street's own id, so they need no global order.
    """
    last_node = nodes.agg(F.max("node_id")).first()[0] or 0
    last_edge = edges.agg(F.max("street_id")).first()[0] or 0
    ranked = scratch.keep(edges.withColumn("_rn", F.row_number().over(_by_weight())))
    middle, first = F.lit(last_node + 1) + F.col("street_id"), F.lit(last_edge + 1) + 2 * F.col("street_id")
    halves = G.cut(F.col("coords"), G.length(F.col("coords")) / 2)
    half_w, half_len = (F.col("w") / 2).alias("w"), (F.col("len") / 2).alias("len")
    parent = F.col("street_id").alias("parent_id")
    whole = F.array(F.struct(F.col("street_id").alias("edge_id"), parent, "s", "e", "w", "len", "coords"))
    two = F.array(
        F.struct(first.alias("edge_id"), parent, F.col("s").alias("s"), middle.alias("e"), half_w, half_len, F.col("_halves.first").alias("coords")),
        F.struct((first + 1).alias("edge_id"), parent, middle.alias("s"), F.col("e").alias("e"), half_w, half_len, F.col("_halves.second").alias("coords")),
    )
    cut = ranked.withColumn("_halves", F.when(F.col("_rn") > 1, halves))
    out = cut.select(F.inline(F.when(F.col("_rn") == 1, whole).otherwise(two)))
    at = G.end_points(F.col("_halves.first"))[1]
    new = cut.where("_rn > 1").select(middle.alias("node_id"), at["x"].alias("x"), at["y"].alias("y"), F.lit(2).alias("degree"))
    return scratch.keep(nodes.select("node_id", "x", "y", "degree").unionByName(new)), scratch.keep(out)


def _cells(df: DataFrame, cell: float) -> DataFrame:
    """Segments (x1, y1, x2, y2) once for each cell they may touch.

    Long segments are covered piece by piece, so an oblique one takes cells in proportion to its length.
    """
    pieces = f"greatest(ceil(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) / {cell!r}D), 1L)"
    df = df.selectExpr("*", f"{pieces} AS _n").selectExpr("*", "explode(sequence(0L, _n - 1)) AS _k")
    ends = lambda c: (f"{c}1 + _k / _n * ({c}2 - {c}1)", f"{c}1 + (_k + 1) / _n * ({c}2 - {c}1)")
    span = lambda c: "sequence(floor(least({0}, {1}) / {2!r}D), floor(greatest({0}, {1}) / {2!r}D))".format(*ends(c), cell)
    return df.selectExpr("*", f"explode({span('x')}) AS cx").selectExpr("*", f"explode({span('y')}) AS cy").drop("_n", "_k")


def _share(p: str, a: str, b: str) -> str:
    """Where on a-b, 0 to 1, the point nearest to p lies; points are named by their columns' first letter."""
    n = f"(({b}x - {a}x) * ({b}x - {a}x) + ({b}y - {a}y) * ({b}y - {a}y))"
    return f"CASE WHEN {n} > 0 THEN greatest(0D, least(1D, (({p}x - {a}x) * ({b}x - {a}x) + ({p}y - {a}y) * ({b}y - {a}y)) / {n})) ELSE 0D END"


def _gap(p: str, a: str, b: str, t: str) -> str:
    """Distance of p from the point at the share ``t`` of a-b."""
    x, y = (f"({p}{c} - ({a}{c} + {t} * ({b}{c} - {a}{c})))" for c in "xy")
    return f"sqrt({x} * {x} + {y} * {y})"


def _side(p: str, q: str, r: str) -> str:
    return f"(({q}x - {p}x) * ({r}y - {p}y) - ({q}y - {p}y) * ({r}x - {p}x))"


def nearest_edge(features: DataFrame, edges: DataFrame, scratch: Scratch, cell: float | None = None) -> DataFrame:
    """(row, edge_id, distance): the nearest edge of every feature, ties to the smaller id.

    Features are segments (row, x1, y1, x2, y2), several to a row if need be, a point being a segment
    without length; edges are segments (edge_id, x1, y1, x2, y2). Rows with a missing or infinite coordinate,
    and all rows if there are no edges, have no result. Cells double until the best distance found is within
    one cell, or until a cell is as large as everything, so the rounds are bounded.
    """
    sides = ["x1", "y1", "x2", "y2"]
    edges = scratch.keep(edges.where(finite(*map(F.col, sides))))
    rest = scratch.keep(features.where(finite(*map(F.col, sides))))
    reach = lambda df: [f(c) for c in sides for f in (F.min, F.max)]
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    bounds, mean = list(edges.agg(*reach(edges)).first()), edges.agg(F.avg(F.sqrt(dx * dx + dy * dy))).first()[0]
    schema = "row long, edge_id long, distance double"
    if bounds[0] is None or rest.isEmpty():
        return features.sparkSession.createDataFrame([], schema)
    bounds += list(rest.agg(*reach(rest)).first())
    whole = 2 * max(max(bounds[1::2]) - min(bounds[::2]), 1e-9)
    cell = cell or 2 * (mean or 0) or whole
    out = None
    shares = [(p, *line, f"_{p}") for p, line in (("a", "pq"), ("b", "pq"), ("p", "ab"), ("q", "ab"))]
    cross = f"{_side('a', 'b', 'p')} * {_side('a', 'b', 'q')} < 0 AND {_side('p', 'q', 'a')} * {_side('p', 'q', 'b')} < 0"
    gap = f"CASE WHEN {cross} THEN 0D ELSE least({', '.join(_gap(*x) for x in shares)}) END"
    while True:
        last = cell >= whole
        size = float(max(whole, 1e-9) if last else cell)
        mine = _beside(_cells(rest, size).selectExpr("row", "cx", "cy", "x1 AS ax", "y1 AS ay", "x2 AS bx", "y2 AS by"))
        theirs = _cells(edges, size).selectExpr("edge_id", "cx", "cy", "x1 AS px", "y1 AS py", "x2 AS qx", "y2 AS qy")
        met = mine.join(theirs, ["cx", "cy"]).selectExpr("*", *[f"{_share(p, u, v)} AS {t}" for p, u, v, t in shares])
        best = met.selectExpr("row", f"struct({gap} AS distance, edge_id) AS found").groupBy("row").agg(F.min("found").alias("best")).select("row", "best.edge_id", "best.distance")
        done = scratch.keep(best if last else best.where(F.col("distance") <= size))
        out = done if out is None else out.unionByName(done)
        if last:
            return out
        left = scratch.keep(rest.join(done, "row", "left_anti"))
        scratch.drop(rest)
        rest = left
        if rest.isEmpty():
            return out
        cell *= 2


def insert(features: DataFrame, edges: DataFrame, scratch: Scratch, weight: Column | None = None) -> DataFrame:
    """Features (id, geometry, ...) set on their nearest edges: (source_id, edge_id, s, e, w_s, w_e, wt, at).

    The edge is the nearest to the geometry; the place on it is where the geometry's centroid is projected;
    costs to its ends share the edge's cost by length. Edges are (edge_id, s, e, w, len, coords). The weight is 1 if
    none is given. Features without a usable geometry, and all if there are no edges, are left out.
    """
    rows = scratch.keep(features.select(F.col("id").alias("source_id"), "geometry", (F.lit(1.0) if weight is None else weight.cast("double")).alias("wt")))
    # Equal geometries, such as a placeholder's, are looked up once.
    places = scratch.keep(rows.where("geometry is not null").select("geometry").distinct().withColumn("_row", F.monotonically_increasing_id()))
    ends = lambda df: df.select(*df.columns[:1], *[F.col(f"_leg.{p}.{c}").alias(f"{c}{n}") for n, p in ((1, "a"), (2, "b")) for c in "xy"])
    mine = ends(places.select(F.col("_row").alias("row"), F.explode(G.segments(F.col("geometry"))).alias("_leg")))
    theirs = ends(edges.select("edge_id", F.explode(G.segments(G.geometry("LineString", F.array("coords")))).alias("_leg")))
    best = nearest_edge(mine, theirs, scratch)
    found = rows.join(places.join(best, F.col("_row") == F.col("row")).drop("_row", "row"), "geometry").join(edges.select("edge_id", "s", "e", "w", "len", "coords"), "edge_id")
    found = found.withColumn("_middle", G.centroid(F.col("geometry"))).withColumn("_along", G.project(F.col("coords"), F.col("_middle")))
    w_s = F.when(F.col("len") > 0, F.col("w") * (F.col("_along") / F.col("len"))).otherwise(0.0)
    found = found.withColumn("w_s", w_s)
    return scratch.keep(found.select("source_id", "edge_id", "s", "e", "w_s", (F.col("w") - F.col("w_s")).alias("w_e"), "wt", G.interpolate(F.col("coords"), F.col("_along")).alias("at"), "distance"))
