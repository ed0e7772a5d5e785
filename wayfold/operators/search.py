"""Network search by tiles: distances, reachable nodes, turn costs and all simple paths.

Origins are dealt to square tiles of the plane. Each tile gets, once, the streets that a search of the
given length can touch from inside it, and the destinations there; each of its origins is then searched
in a worker over that part of the graph. So a search shuffles once and has no rounds, whatever the
number of hops. A tile's part is proved whole: no street costs less than ``r`` for a unit of length, so
nothing beyond ``limit / r`` is reached. Where some streets are so cheap that this says little, the part
is found by relaxation rounds over (tile, node) instead, a small table beside (origin, node).

A crowded tile is split: its origins (or pairs) go to several tasks, each with the tile's streets, and
its destinations too. A task holds one tile's streets and at most about ``DESTINATIONS`` destinations;
origins, pairs and results stream through it.

Edges are (edge_id, s, e, w, and len if known), nodes (node, x, y), features (id, edge_id, s, e, w_s,
w_e). Edges with a null cost or end and features with a null offset take no part: they connect nothing.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.operators import routes
from wayfold.session import Scratch, prepare

SLACK = 1e-5  # fixed: paths may exceed the detour limit by this much
LEAST_PATH = 0.01  # fixed: no path costs less
#: Origins (or pairs) and destinations of a tile that one task takes, about.
ORIGINS, DESTINATIONS = 2048, 1 << 16
#: How much further than on an average street a search may get before tiles are grown by rounds instead.
WIDEST = 8.0
FLUSH = 1 << 16


@dataclass(frozen=True)
class Turns:
    """A turn at a street node of over ``threshold`` degrees costs ``penalty``."""

    threshold: float = 45.0
    penalty: float = 30.0


class Streets:
    """A street network: its edges and nodes, and the edges with the points of their ends."""

    def __init__(self, edges: DataFrame, nodes: DataFrame, scratch: Scratch):
        self.edges, self.nodes, self.scratch = edges, nodes, scratch
        self._located: DataFrame | None = None
        self._rates: tuple | None = None

    @property
    def located(self) -> DataFrame:
        """(edge_id, s, e, w, sx, sy, ex, ey, size, used) of the edges that connect something; routes take those ``used`` (all, if not said)."""
        if self._located is None:
            at = lambda n: self.nodes.select(F.col("node").alias(n), F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y"))
            edges = self.edges.where("w is not null and s is not null and e is not null").withColumn("w", F.greatest(F.col("w").cast("double"), F.lit(0.0)))
            chord = F.sqrt((F.col("sx") - F.col("ex")) ** 2 + (F.col("sy") - F.col("ey")) ** 2)
            size = F.greatest(chord, F.col("len")) if "len" in edges.columns else chord
            both = edges.join(at("s"), "s", "left").join(at("e"), "e", "left")
            self._located = self.scratch.keep(both.select("edge_id", "s", "e", "w", "sx", "sy", "ex", "ey", size.alias("size"), (F.col("used") if "used" in edges.columns else F.lit(True)).alias("used")))
        return self._located

    def reach(self, limit: float) -> tuple[float, bool]:
        """How far in the plane a search of ``limit`` can get, and whether that is proved for every street."""
        if self._rates is None:
            rate = F.when(F.col("size") > 0, F.col("w") / F.col("size"))
            lost = F.count_if(F.col("size").isNull() | F.isnan("size"))
            self._rates = tuple(self.located.agg(F.min(rate), F.sum("w") / F.sum("size"), lost).first())
        least, mean, lost = self._rates
        usual = limit / mean if mean else limit
        proved = not lost and least and limit / least <= WIDEST * usual
        return (limit / least if proved else usual) or 1.0, bool(proved)


def _tile(x: Column, side: float) -> Column:
    return F.coalesce(F.floor(F.nanvl(x, F.lit(0.0)) / side), F.lit(0)).cast("long")


def _anchored(features: DataFrame, streets: Streets) -> DataFrame:
    """Features with a point (ax, ay): their share along the straight line between their edge's ends."""
    ends = streets.located.select("edge_id", F.col("w").alias("_w"), "sx", "sy", "ex", "ey")
    t = F.when(F.col("_w") > 0, F.col("w_s") / F.col("_w")).otherwise(0.0)
    both = features.where("w_s is not null and w_e is not null").join(ends, "edge_id")
    return both.withColumns({"ax": F.col("sx") + t * (F.col("ex") - F.col("sx")), "ay": F.col("sy") + t * (F.col("ey") - F.col("sy"))}).drop("_w", "sx", "sy", "ex", "ey")


def arcs(streets: Streets) -> DataFrame:
    """Both directions of every edge, with the points of its ends."""
    there = F.struct(F.col("s").alias("src"), F.col("e").alias("dst"), "edge_id", "w", F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("ex").alias("tox"), F.col("ey").alias("toy"))
    back = F.struct(F.col("e").alias("src"), F.col("s").alias("dst"), "edge_id", "w", F.col("ex").alias("x"), F.col("ey").alias("y"), F.col("sx").alias("tox"), F.col("sy").alias("toy"))
    return streets.located.where("used").select(F.inline(F.array(there, back)))


def _around(df: DataFrame, x: str, y: str, side: float, halo: float) -> DataFrame:
    """Every row once for each tile that has its point within ``halo``."""
    span = lambda c: F.sequence(_tile(F.col(c) - halo, side), _tile(F.col(c) + halo, side))
    return df.withColumn("tx", F.explode(span(x))).withColumn("ty", F.explode(span(y)))


def _dealt(streets: Streets, askers: DataFrame, limit: float, others: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(arcs, askers, others), each with (tx, ty, chunk): the parts of the work.

    ``askers`` and ``others`` have a point (ax, ay) and a key column ``id``.
    """
    scratch = streets.scratch
    halo, proved = streets.reach(limit)
    side = 2 * halo
    askers = askers.withColumns({"tx": _tile(F.col("ax"), side), "ty": _tile(F.col("ay"), side)})
    ways = arcs(streets)
    if proved:
        ways = _around(ways, "x", "y", side, halo)
        near = _around(others, "ax", "ay", side, halo) if others is not None else None
    else:
        seeds = askers.select(F.concat_ws(",", "tx", "ty").alias("tile"), F.explode(F.array("s", "e")).alias("node"), F.lit(0.0).alias("cost")).distinct()
        part = routes.relax(ways, seeds, limit, scratch, "tile").select(F.split("tile", ",").alias("t"), "node")
        part = scratch.keep(part.select(F.col("t")[0].cast("long").alias("tx"), F.col("t")[1].cast("long").alias("ty"), "node"))
        ways = ways.join(part.withColumnRenamed("node", "src"), "src")
        near = None
        if others is not None:
            ends = others.withColumn("node", F.explode(F.array("s", "e"))).join(part, "node").drop("node")
            # One on a street of the askers is near them even if no end of it is.
            same = others.join(askers.select("edge_id", "tx", "ty").distinct(), "edge_id").select(ends.columns)
            near = ends.unionByName(same).distinct()
    tiles = askers.groupBy("tx", "ty").agg(F.ceil(F.count("*") / ORIGINS).cast("int").alias("parts"))
    if near is not None:
        crowd = near.groupBy("tx", "ty").agg(F.ceil(F.count("*") / DESTINATIONS).cast("int").alias("crowds"))
        tiles = tiles.join(crowd, ["tx", "ty"], "left")
    else:
        tiles = tiles.withColumn("crowds", F.lit(1))
    tiles = scratch.keep(tiles.withColumn("crowds", F.coalesce("crowds", F.lit(1))))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    one = lambda n: F.array(F.pmod(F.xxhash64("id"), F.col(n)).cast("int"))

    def chunked(df: DataFrame, part: Column, crowd: Column) -> DataFrame:
        out = df.join(tiles, ["tx", "ty"]).withColumn("_part", F.explode(part)).withColumn("_crowd", F.explode(crowd))
        return out.withColumn("chunk", F.col("_part") * F.col("crowds") + F.col("_crowd")).drop("_part", "_crowd", "parts", "crowds")

    ways = chunked(ways, every("parts"), every("crowds"))
    askers = chunked(askers, one("parts"), every("crowds"))
    return ways, askers, None if near is None else chunked(near, every("parts"), one("crowds"))


COLUMNS = "tx long, ty long, chunk int, kind int, a long, b long, c long, d long, u double, v double, p double, q double, r double, t double, z array<double>, l array<long>"


def _rows(df: DataFrame, kind: int, **given: Column) -> DataFrame:
    """Rows of one kind in the common form that the kernels read."""
    named = {"kind": F.lit(kind), **given}
    return df.select(*[(F.col(n) if n in ("tx", "ty", "chunk") else named.get(n, F.lit(None))).cast(t).alias(n) for n, t in (c.split() for c in COLUMNS.split(", "))])


def _arc_rows(arcs: DataFrame, turns: Turns | None) -> DataFrame:
    points = {"p": F.col("x"), "q": F.col("y"), "r": F.col("tox"), "t": F.col("toy")} if turns else {}
    return _rows(arcs, 0, a=F.col("src"), b=F.col("dst"), c=F.col("edge_id"), u=F.col("w"), **points)


def _run(rows: DataFrame, kernel, schema: str) -> DataFrame:
    prepare(rows.sparkSession)
    dealt = rows.repartition("tx", "ty", "chunk").sortWithinPartitions("tx", "ty", "chunk", "kind", "c", "a", "b")
    return dealt.mapInArrow(kernel, schema)


class _Part:
    """One tile's streets and destinations in a worker."""

    def __init__(self, turns: Turns | None):
        self.turns = turns
        self.out: dict[int, list[tuple[int, float, int]]] = defaultdict(list)
        self.point: dict[int, tuple[float, float]] = {}
        self.at: dict[int, list[tuple[int, float, int]]] = defaultdict(list)
        self.on: dict[int, list[tuple[int, float]]] = defaultdict(list)
        self.bends: dict[tuple[int, int, int], float] = {}

    def arcs(self, c: dict[str, list]) -> None:
        for a, b, e, w in zip(c["a"], c["b"], c["c"], c["u"], strict=True):
            self.out[a].append((b, w, e))
        if self.turns:
            for a, b, x, y, x2, y2 in zip(c["a"], c["b"], c["p"], c["q"], c["r"], c["t"], strict=True):
                self.point[a], self.point[b] = (x, y), (x2, y2)

    def destinations(self, c: dict[str, list]) -> None:
        for did, s, edge, e, w_s, w_e in zip(c["a"], c["b"], c["c"], c["d"], c["u"], c["v"], strict=True):
            self.at[s].append((did, w_s, e))
            self.at[e].append((did, w_e, s))
            self.on[edge].append((did, w_e))

    def turn(self, a: int, b: int, c: int) -> float:
        """The cost of going on from a over b to c: whole degrees, folded to 0..90."""
        if self.turns is None:
            return 0.0
        key = (a, b, c)
        cost = self.bends.get(key)
        if cost is None:
            pa, pb, pc = self.point.get(a), self.point.get(b), self.point.get(c)
            cost = 0.0
            if pa and pb and pc and None not in (*pa, *pb, *pc):
                back = math.degrees(math.atan2(pa[1] - pb[1], pa[0] - pb[0]))
                on = math.degrees(math.atan2(pc[1] - pb[1], pc[0] - pb[0]))
                bend = abs(180 - round((on - back) % 360.0))
                cost = self.turns.penalty if min(bend, abs(180 - bend)) > self.turns.threshold else 0.0
            self.bends[key] = cost
        return cost

    def spread(self, seeds: list[tuple[float, int]], limit: float) -> dict[int, float]:
        """Least cost of every node within ``limit`` of the seeds (cost, node)."""
        heap = [s for s in seeds if s[0] <= limit]
        heapify(heap)
        best: dict[int, float] = {}
        done: dict[int, float] = {}
        out = self.out
        while heap:
            cost, node = heappop(heap)
            if node in done:
                continue
            done[node] = cost
            for to, w, _ in out.get(node, ()):
                there = cost + w
                if there <= limit and to not in done and there < best.get(to, math.inf):
                    best[to] = there
                    heappush(heap, (there, to))
        return done

    def spread_turning(self, seeds: list[tuple[float, int, int]], limit: float) -> dict[tuple[int, int], float]:
        """As ``spread`` over (node before, node), for seeds (cost, node before, node)."""
        heap = [s for s in seeds if s[0] <= limit]
        heapify(heap)
        best: dict[tuple[int, int], float] = {}
        done: dict[tuple[int, int], float] = {}
        while heap:
            cost, before, node = heappop(heap)
            if (before, node) in done:
                continue
            done[before, node] = cost
            for to, w, _ in self.out.get(node, ()):
                there = cost + w + self.turn(before, node, to)
                if there <= limit and (node, to) not in done and there < best.get((node, to), math.inf):
                    best[node, to] = there
                    heappush(heap, (there, node, to))
        return done


class _Found:
    """Result rows, let go in batches."""

    def __init__(self, names: list[str], types: list[pa.DataType]):
        self.names, self.types = names, types
        self.columns: list[list] = [[] for _ in names]

    def add(self, *values) -> None:
        for column, value in zip(self.columns, values, strict=True):
            column.append(value)

    def take(self, least: int = FLUSH) -> Iterator[pa.RecordBatch]:
        if len(self.columns[0]) >= max(1, least):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(self.columns, self.types, strict=True)], self.names)
            self.columns = [[] for _ in self.names]


def _parts(batches: Iterator[pa.RecordBatch], turns: Turns | None) -> Iterator[tuple[_Part, int, dict[str, list]]]:
    """(part, kind, columns) of runs of rows of one part and kind; streets and destinations are taken up on the way."""
    key, part = None, _Part(turns)
    for batch in batches:
        if not batch.num_rows:
            continue
        mark = np.stack([batch.column(i).to_numpy() for i in range(4)])
        start = np.flatnonzero(np.r_[True, (mark[:, 1:] != mark[:, :-1]).any(axis=0)])
        for a, b in zip(start.tolist(), [*start[1:].tolist(), batch.num_rows], strict=True):
            here, kind = tuple(mark[:3, a].tolist()), int(mark[3, a])
            if here != key:
                key, part = here, _Part(turns)
            rows = batch.slice(a, b - a)
            columns = {n: rows.column(n).to_pylist() for n in batch.schema.names[4:]}
            if kind == 0:
                part.arcs(columns)
            elif kind == 1:
                part.destinations(columns)
            else:
                yield part, kind, columns


def _origin_rows(origins: DataFrame) -> DataFrame:
    return _rows(origins, 2, a=F.col("id"), b=F.col("s"), c=F.col("edge_id"), d=F.col("e"), u=F.col("w_s"), v=F.col("w_e"))


def _features(features: DataFrame, key: str) -> DataFrame:
    return features.select(F.col(key).alias("id"), "edge_id", "s", "e", "w_s", "w_e")


def scope(streets: Streets, origins: DataFrame, radius: float, turns: Turns | None = None) -> DataFrame:
    """Least cost (oid, node, cost) of every node within ``radius`` of each origin."""
    ways, asked, _ = _dealt(streets, _anchored(_features(origins, "oid"), streets), radius)

    def kernel(batches):
        found = _Found(["oid", "node", "cost"], [pa.int64(), pa.int64(), pa.float64()])
        for part, _, c in _parts(batches, turns):
            for oid, s, e, w_s, w_e in zip(c["a"], c["b"], c["d"], c["u"], c["v"], strict=True):
                if turns is None:
                    best = part.spread([(w_s, s), (w_e, e)], radius)
                else:
                    best = {}
                    for (_, node), cost in part.spread_turning([(w_s, e, s), (w_e, s, e)], radius).items():
                        best[node] = min(cost, best.get(node, math.inf))
                for node, cost in best.items():
                    found.add(oid, node, cost)
                yield from found.take()
        yield from found.take(0)

    return _run(_arc_rows(ways, turns).unionByName(_origin_rows(asked)), kernel, "oid long, node long, cost double")


def distances(streets: Streets, origins: DataFrame, destinations: DataFrame, radius: float, turns: Turns | None = None) -> DataFrame:
    """Shortest distance (oid, did, dist) of all pairs within ``radius``, inclusive.

    With ``turns`` the search runs over (node before, node), so costs are exact; the first and the last
    stretch are taken to run straight between the ends of their edges.
    """
    asked, near = _anchored(_features(origins, "oid"), streets), _anchored(_features(destinations, "did"), streets)
    ways, asked, near = _dealt(streets, asked, radius, near)
    there = _rows(near, 1, a=F.col("id"), b=F.col("s"), c=F.col("edge_id"), d=F.col("e"), u=F.col("w_s"), v=F.col("w_e"))

    def kernel(batches):
        found = _Found(["oid", "did", "dist"], [pa.int64(), pa.int64(), pa.float64()])
        for part, _, c in _parts(batches, turns):
            for oid, s, edge, e, w_s, w_e in zip(c["a"], c["b"], c["c"], c["d"], c["u"], c["v"], strict=True):
                best: dict[int, float] = {}
                for did, end in part.on.get(edge, ()):
                    best[did] = min(best.get(did, math.inf), abs(w_e - end))
                if turns is None:
                    reached = ((node, None, cost) for node, cost in part.spread([(w_s, s), (w_e, e)], radius).items())
                else:
                    reached = ((node, before, cost) for (before, node), cost in part.spread_turning([(w_s, e, s), (w_e, s, e)], radius).items())
                for node, before, cost in reached:
                    for did, last, beyond in part.at.get(node, ()):
                        dist = cost + last if before is None else cost + part.turn(before, node, beyond) + last
                        if dist < best.get(did, math.inf):
                            best[did] = dist
                for did, dist in best.items():
                    if dist <= radius:
                        found.add(oid, did, dist)
                yield from found.take()
        yield from found.take(0)

    rows = _arc_rows(ways, turns).unionByName(there).unionByName(_origin_rows(asked))
    return _run(rows, kernel, "oid long, did long, dist double")


def _ways(part: _Part, o: tuple, d: tuple, limit: float, left: dict[int, float]) -> Iterator[tuple[float, list[int]]]:
    """Cost and interior edges of every simple path from o to d (edge, s, e, w_s, w_e) within ``limit``.

    Interior edges are never the origin's or the destination's edge. Where both share one edge, a path
    around leaves by the end away from the destination and comes back by the other.
    """
    (eo, os, oe, o_s, o_e), (ed, ds, de, d_s, d_e) = o, d
    same = eo == ed
    starts = [(os, oe, o_s)] if not same or o_s < d_s else []
    starts += [(oe, os, o_e)] if not same or o_s > d_s else []
    goals: dict[int, list[tuple[float, int]]] = defaultdict(list)
    if not same or o_s > d_s:
        goals[ds].append((d_s, de))
    if not same or o_s < d_s:
        goals[de].append((d_e, ds))
    far = math.inf
    for first, behind, cost in starts:
        if cost + left.get(first, far) > limit:
            continue
        seen, inside = {first}, []
        for last, beyond in goals.get(first, ()):
            total = cost + part.turn(behind, first, beyond) + last
            if total <= limit:
                yield total, []
        stack = [(first, behind, cost, iter(part.out.get(first, ())))]
        while stack:
            node, before, cost, ways = stack[-1]
            step = next(ways, None)
            if step is None:
                stack.pop()
                seen.discard(node)
                if inside:
                    inside.pop()
                continue
            to, w, edge = step
            if edge in (eo, ed) or to in seen:
                continue
            there = cost + w + part.turn(before, node, to)
            if there + left.get(to, far) > limit:
                continue
            seen.add(to)
            inside.append(edge)
            for last, beyond in goals.get(to, ()):
                total = there + part.turn(node, to, beyond) + last
                if total <= limit:
                    yield total, list(inside)
            stack.append((to, node, there, iter(part.out.get(to, ()))))


def paths(streets: Streets, origins: DataFrame, destinations: DataFrame, pairs: DataFrame, detour: float, radius: float, turns: Turns | None = None) -> DataFrame:
    """All simple paths (oid, did, dist, path_no, cost, path: edge ids) of ``pairs`` (oid, did, dist) within detour * dist.

    Paths begin with the origin's edge and end with the destination's; where one direct stretch joins
    the two, that is their edge alone. Costs back from the destination, without turns, bound the search to each
    pair's ellipse. The number of paths grows exponentially with the detour; they stream out one by one.
    """
    longest = detour * radius + SLACK
    o, d = _features(origins, "oid"), _features(destinations, "did")
    asked = _anchored(pairs.join(o, pairs.oid == o.id).select("oid", "did", "dist", "edge_id", "s", "e", "w_s", "w_e"), streets).withColumn("id", F.xxhash64("oid", "did"))
    to = d.select(F.col("id").alias("did"), F.array("edge_id", "s", "e").alias("l"), F.array("w_s", "w_e").alias("z"))
    ways, asked, _ = _dealt(streets, asked.join(to, "did"), longest)
    asked = _rows(asked, 2, a=F.col("oid"), b=F.col("s"), c=F.col("did"), d=F.col("e"), u=F.col("w_s"), v=F.col("w_e"), p=F.col("dist"), z=F.col("z"), l=F.concat(F.col("l"), F.array("edge_id")))

    def kernel(batches):
        found = _Found(["oid", "did", "dist", "path_no", "cost", "path"], [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.list_(pa.int64())])
        back: tuple[int, _Part | None, dict] = (0, None, {})  # of the destination at hand: rows come by it
        for part, _, c in _parts(batches, turns):
            for oid, os, did, oe, o_s, o_e, dist, (d_s, d_e), (ed, ds, de, eo) in zip(c["a"], c["b"], c["c"], c["d"], c["u"], c["v"], c["p"], c["z"], c["l"], strict=True):
                if back[0] != did or back[1] is not part:
                    back = did, part, part.spread([(d_s, ds), (d_e, de)], longest)
                limit, n = detour * dist + SLACK, 0
                if eo == ed and abs(o_s - d_s) <= limit:
                    found.add(oid, did, dist, n, max(abs(o_s - d_s), LEAST_PATH), [eo])
                    n += 1
                for cost, inside in _ways(part, (eo, os, oe, o_s, o_e), (ed, ds, de, d_s, d_e), limit, back[2]):
                    found.add(oid, did, dist, n, max(cost, LEAST_PATH), [eo, *inside, ed])
                    n += 1
                    yield from found.take()
            yield from found.take()
        yield from found.take(0)

    return _run(_arc_rows(ways, turns).unionByName(asked), kernel, "oid long, did long, dist double, path_no int, cost double, path array<long>")


def path_edges(found: DataFrame) -> DataFrame:
    """One row per path and place."""
    return found.select("*", F.posexplode("path").alias("place", "edge_id"))


