"""Minimum-cost-flow resharding.

Rows lie in old shards; the new shards have capacities. A min-cost flow from the old shards' bytes
to the new capacities, at the cost of the bytes that change shard (or any cost per pair given), says
how many bytes go from where to where: what can stay stays, so the fewest bytes move. The flow is
carried out in blocks, hashed parts of the old shards that are equal in bytes (``BLOCK_BYTES`` at most,
while there are no more than ``MAX_BLOCKS``), the more of them the larger a shard: whole blocks go as one
transfer, and the few blocks on the border of two transfers are cut between rows. This leaves a shard
off by up to half of the row at each of its cuts. A last repair moves rows out of the border blocks and
one whole block of each shard, the largest that fit first: of each shard some of every order of size
and the smallest. What it leaves
depends on the rows there: without any that fit the gap, the bound of the cuts stands.

The driver sees the shards and the sums of at most ``MAX_BLOCKS`` blocks, never rows in proportion to
the table. Rows are numbered in two steps, block by block, so a hot source, or a crowd of equal rows,
is spread over its blocks.

Size of a row: UTF-8 bytes of its text (null: none) plus 1. Null doc_id: placed by its text's hash.
Repeated rows each get a place. Null source: a source of its own. Empty table: no rows. Other columns
are not read. All shards may be empty.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.session import Scratch

BLOCK_BYTES, MAX_BLOCKS = 64 << 20, 1 << 16
LEAST_BLOCKS = 16
REPAIR_ROWS = 64
#: Besides the smallest, so many rows of each power of two of bytes.
GRADED_ROWS = 4


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Flows (source, sink) -> amount of least total ``cost(source, sink)``, by successive shortest paths.

    Supplies and capacities have the same sum. Dijkstra with potentials over the bipartite residual
    graph; each augmentation is as large as the path allows.
    """
    n, m = len(supply), len(capacity)
    left, room = list(supply), list(capacity)
    flow: dict[tuple[int, int], int] = defaultdict(int)
    price = [[cost(i, j) for j in range(m)] for i in range(n)]
    up, down = [0] * n, [min((price[i][j] for i in range(n)), default=0) for j in range(m)]
    while any(left):
        dist: dict[tuple[int, int], float] = {(0, i): 0 for i in range(n) if left[i]}
        before: dict[tuple[int, int], tuple[int, int]] = {}
        heap = [(0, 0, i) for i in range(n) if left[i]]
        done, goal = set(), None
        while heap:
            d, side, x = heapq.heappop(heap)
            if (side, x) in done:
                continue
            done.add((side, x))
            if side == 1 and room[x]:
                goal = x
                break
            if side == 0:
                near = ((1, j, price[x][j] + up[x] - down[j]) for j in range(m))
            else:
                near = ((0, i, -price[i][x] + down[x] - up[i]) for i in range(n) if flow[i, x])
            for s, y, c in near:
                if d + c < dist.get((s, y), float("inf")):
                    dist[s, y] = d + c
                    before[s, y] = (side, x)
                    heapq.heappush(heap, (d + c, s, y))
        if goal is None:
            raise ValueError("the capacities hold less than the supplies")
        end = dist[1, goal]
        for i in range(n):
            up[i] += min(dist.get((0, i), end), end)
        for j in range(m):
            down[j] += min(dist.get((1, j), end), end)
        path, at = [], (1, goal)
        while at in before:
            path.append((before[at], at))
            at = before[at]
        amount = min(left[at[1]], room[goal], *(flow[b[1], a[1]] for a, b in path if a[0] == 1))
        for a, b in path:
            if a[0] == 0:
                flow[a[1], b[1]] += amount
            else:
                flow[b[1], a[1]] -= amount
        left[at[1]] -= amount
        room[goal] -= amount
    return {k: v for k, v in flow.items() if v}


def plan_cuts(blocks: list[tuple[int, int, int]], flow: dict[tuple[int, int], int]) -> list[tuple[int, int, int, list[tuple[int, int]]]]:
    """(old, block, offset, cuts) for each (old, block, bytes): the bytes before it in its old shard, and the
    new shards its bytes go to, each with the offset in the old shard up to which it takes them."""
    lines: dict[int, list[tuple[int, int]]] = {}
    for old in {b[0] for b in blocks}:
        at, cuts = 0, []
        for j in sorted((j for i, j in flow if i == old), key=lambda j: (j != old, j)):  # what stays comes first
            at += flow[old, j]
            cuts.append((at, j))
        lines[old] = cuts
    out, offset = [], defaultdict(int)
    for old, block, size in sorted(blocks):
        start = offset[old]
        offset[old] += size
        mine = [c for k, c in enumerate(lines[old]) if c[0] > start and (k == 0 or lines[old][k - 1][0] < start + size)]
        out.append((old, block, start, mine or lines[old][-1:]))
    return out


def repair(loads: list[int], small: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Moves (index in small, from, to) of rows (shard, size) that even the loads out, the largest useful first."""
    target = sum(loads) / len(loads)
    loads = list(loads)
    by: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i, (shard, size) in enumerate(small):
        by[shard].append((size, i))
    moves = []
    stuck: set[int] = set()
    while len(stuck) < len(loads):
        rich, poor = max(set(range(len(loads))) - stuck, key=lambda j: (loads[j], -j)), min(range(len(loads)), key=lambda j: (loads[j], j))
        if loads[rich] <= target:
            break
        most = min(loads[rich] - target, target - loads[poor])
        fit = max((x for x in by[rich] if x[0] <= max(most, (loads[rich] - loads[poor]) / 2)), default=None)
        if fit is None:  # no poorer shard comes up later, so none will fit
            stuck.add(rich)
            continue
        by[rich].remove(fit)
        loads[rich] -= fit[0]
        loads[poor] += fit[0]
        moves.append((fit[1], rich, poor))
    return moves


def reshard(docs: DataFrame, old_shard: Column, old_shards: int, shards: int = 16, capacities: list[int] | None = None, cost=None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard, moved) of every row.

    ``old_shard`` gives a number from 0 to ``old_shards`` - 1. Without ``capacities`` the new shards
    share the bytes evenly.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), old_shard.cast("int").alias("old"))
    # Written with a number of its own, so that rows alike in all else are spread over the blocks too.
    sized = scratch.keep(sized.withColumn("spread", F.xxhash64("doc_id", "text_crc32", F.monotonically_increasing_id())))
    held = {r["old"]: r["size"] for r in sized.groupBy("old").agg(F.sum("size").alias("size")).collect()}
    total = sum(held.values())
    each = max(1, -(-total // (MAX_BLOCKS // 2)), min(BLOCK_BYTES, total // (LEAST_BLOCKS * old_shards)))
    fine = F.array(*[F.lit(max(1, -(-held.get(i, 0) // each))) for i in range(old_shards)])
    rows = sized.withColumn("block", F.pmod("spread", F.get(fine, F.col("old"))).cast("int"))
    blocks = [(r["old"], r["block"], r["size"]) for r in rows.groupBy("old", "block").agg(F.sum("size").alias("size")).collect()]
    if not blocks:
        blocks, total = [(0, 0, 0)], 0
    supply = [0] * old_shards
    for old, _, size in blocks:
        supply[old] += size
    capacities = capacities or [total // shards + (j < total % shards) for j in range(shards)]
    flow = min_cost_flow(supply, capacities, cost or (lambda i, j: int(i != j)))
    cut = plan_cuts(blocks, flow)
    spare = {}  # a whole block of each shard, of which rows may move as they may out of the border blocks
    for o, b, _, cuts in cut:
        if len(cuts) == 1:
            spare.setdefault(cuts[0][1], (o, b))
    spared = set(spare.values())
    plan = [(o, b, s, [{"upto": u, "shard": j} for u, j in cuts] or [{"upto": 1, "shard": 0}], len(cuts) > 1 or (o, b) in spared) for o, b, s, cuts in cut]
    schema = "old int, block int, start long, cuts array<struct<upto:long,shard:int>>, border boolean"
    planned = F.broadcast(spark.createDataFrame(plan, schema))  # MAX_BLOCKS rows at most
    order = Window.partitionBy("old", "block").orderBy("spread", "doc_id", "size")
    mid = F.col("start") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2
    into = F.coalesce(F.get(F.filter("cuts", lambda c: c["upto"] > F.col("mid")), F.lit(0))["shard"], F.element_at("cuts", -1)["shard"])
    placed = rows.join(planned, ["old", "block"]).withColumn("mid", mid).withColumn("shard", into)
    placed = scratch.keep(placed.select("doc_id", "size", "text_crc32", "old", "block", "spread", "shard", "border"))

    loads = [0] * shards
    for r in placed.groupBy("shard").agg(F.sum("size").alias("size")).collect():
        loads[r["shard"]] = r["size"]
    # A bounded number of rows of each shard's border and spare blocks, of graded sizes, told apart by all they are placed by.
    alike = ["old", "block", "shard", "spread", "doc_id", "size", "text_crc32"]
    few = Window.partitionBy("shard").orderBy("size", "spread", "doc_id")
    border = placed.where("border and doc_id is not null").groupBy(alike).count().where("count = 1").select(*alike)
    graded = Window.partitionBy("shard", "grade").orderBy("size", "spread", "doc_id")
    border = scratch.keep(border.withColumn("grade", F.floor(F.log2("size")).cast("int")))
    tried = border.withColumn("n", F.row_number().over(few)).where(F.col("n") <= REPAIR_ROWS).drop("n")
    tried = tried.union(border.withColumn("n", F.row_number().over(graded)).where(F.col("n") <= GRADED_ROWS).drop("n"))
    small = tried.distinct().orderBy("shard", "size", "spread", "doc_id").collect()
    moves = repair(loads, [(r["shard"], r["size"]) for r in small]) if capacities == sorted(capacities, reverse=True) and capacities[0] - capacities[-1] <= 1 else []
    last = {}
    for i, _, to in moves:
        last[i] = to
    if last:
        moved = F.broadcast(spark.createDataFrame([(small[i]["old"], small[i]["block"], small[i]["spread"], small[i]["doc_id"], to) for i, to in last.items()], "old int, block int, spread long, doc_id long, better int"))
        placed = placed.join(moved, ["old", "block", "spread", "doc_id"], "left").withColumn("shard", F.coalesce("better", "shard"))

    counts = placed.groupBy("shard", "old", "block").agg(F.count("*").alias("n"))
    start = F.sum("n").over(Window.partitionBy("shard").orderBy("old", "block").rowsBetween(Window.unboundedPreceding, -1))
    firsts = F.broadcast(counts.select("shard", "old", "block", F.coalesce(start, F.lit(0)).alias("first")))  # bounded by blocks, transfers and repairs
    inside = Window.partitionBy("shard", "old", "block").orderBy("spread", "doc_id", "size")
    out = placed.join(firsts, ["shard", "old", "block"])
    slot = (F.col("first") + F.row_number().over(inside) - 1).cast("long")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("old").alias("old_shard"), (F.col("old") != F.col("shard")).alias("moved"))


def by_source(shards: int, column: str = "source") -> Column:
    """An old layout by source: as many shards as given, one source in one shard."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(shards)).cast("int")


def rewrite(docs: DataFrame, old_shard: Column, placed: DataFrame, layout: dict[int, str], target: str) -> dict[int, str]:
    """Write the affected shards, those that a row enters or leaves, as a new version of a table of shards.

    ``layout`` gives the folder of each old shard; ``docs`` and ``old_shard`` are what ``placed`` was made
    from by ``reshard``. The new shards are written below ``target``, which must not exist yet; no old
    file is touched, so readers of the old version go on. Last of all, ``target/manifest.json`` says
    where every shard of the new version lies: shards that keep exactly their rows in their old
    folders, the rewritten ones in new folders, and shards that lost all rows nowhere. A run that dies
    leaves no manifest. Returns what the manifest says.

    All columns are written, but for one named shard, which gives way to the new number. Rows are matched
    by doc_id (null too), size, text and old shard; those alike in all these are numbered on both sides,
    so each gets one place.
    """
    flows = placed.where("shard <> old_shard").select(F.explode(F.array("shard", "old_shard")).alias("shard")).distinct()
    affected = sorted(r["shard"] for r in flows.collect())  # shard numbers: bounded
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = ["_id", "_size", "_crc", "_old"]
    columns = [f"`{c}`" for c in docs.columns if c.lower() != "shard"]
    row = F.struct(*columns).alias("_row")
    mine = docs.select(F.col("doc_id").cast("long").alias("_id"), (F.octet_length(text) + 1).cast("long").alias("_size"), F.crc32(text.cast("binary")).alias("_crc"), old_shard.cast("int").alias("_old"), row)
    mine = mine.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("_row"))))
    theirs = placed.select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), F.col("text_crc32").alias("_crc"), F.col("old_shard").alias("_old"), F.col("shard").alias("_to"), "slot")
    theirs = theirs.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("_to", "slot"))).where(F.col("_to").isin(affected)).drop("slot")
    same = F.lit(True)
    for c in [*key, "_n"]:
        same = same & mine[c].eqNullSafe(theirs[c])
    target = target.rstrip("/")
    mine.join(theirs, same).select("_row.*", theirs["_to"].alias("shard")).write.partitionBy("shard").parquet(target)
    jvm, conf = docs.sparkSession.sparkContext._jvm, docs.sparkSession.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(conf)
    manifest = {n: folder for n, folder in layout.items() if n not in affected}
    manifest |= {n: f"{target}/shard={n}" for n in affected if fs.exists(path(f"{target}/shard={n}"))}
    out = fs.create(path(f"{target}/manifest.json.tmp"), True)
    out.write(bytearray(json.dumps({str(n): manifest[n] for n in sorted(manifest)}).encode()))
    out.close()
    fs.rename(path(f"{target}/manifest.json.tmp"), path(f"{target}/manifest.json"))
    return manifest


def read_layout(spark, manifest: dict[int, str]) -> DataFrame:
    """The rows of all shards of a manifest, with their shard."""
    parts = [spark.read.parquet(folder).withColumn("shard", F.lit(n)) for n, folder in sorted(manifest.items())]
    return reduce(DataFrame.unionByName, parts)
