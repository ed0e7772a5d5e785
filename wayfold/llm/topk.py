"""Exact top-k inner products by block-at-a-time pruning.

Vectors become integers, floor(scale * x). Candidates are dealt to groups of about ``GROUP`` vectors:
cells by the signs of some components, as many groups to a cell as its rows need. In a group, ranges
of ``BLOCK`` close vectors form blocks, each with a forward index (its rows) and the largest and
smallest value of every component. A query's bound on a block, or on a whole group, is the sum over
components of the larger of the two products, the summed term maxima. Blocks are taken in each
query's order of falling bound and scored through their rows until the bound falls below the k-th
best score; at equal scores the search goes on, as ties go to the smaller id.

A query first meets its home group, the one its own vector lies in. The k-th score found there goes
with it: only groups whose bound reaches it get a copy of the query, and the search in these starts
from it. Queries that meet a group are dealt in tiles of ``TILE``, bounds are compared in tiles of
queries and groups, so a task holds ``GROUP`` vectors and ``TILE`` queries, whatever the table's
size. What is broadcast are the cells, ``1 << PLANES`` rows at most. On vectors without any structure
no bound helps: every query then meets every group.

Null vectors, vectors with null or non-finite components and null ids take no part. Vectors of other
lengths are compared over the components both have. A query never meets its own row; other rows of
its id are candidates like any. Repeated rows each count, and each query row has a list of its own
(``query_row`` tells them apart). Fewer than k candidates: all of them. Empty table: no rows. Scores
beyond 64 bits are held at its ends.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.arrowtools import prepare
from wayfold.session import Scratch

BLOCK, GROUP, TILE = 256, 8192, 4096
PLANES = 12
EXACT = 1 << 53
ENDS = np.iinfo(np.int64)


def _matrix(vectors: list) -> np.ndarray:
    """Rows as float64 where every inner product is exact in it, else as Python integers; short rows end in zeros."""
    width = max(map(len, vectors), default=0)
    top = max((abs(x) for v in vectors for x in (max(v, default=0), min(v, default=0))), default=0)
    kind = np.float64 if top * top * max(1, width) < EXACT // 2 else object
    out = np.zeros((len(vectors), width), kind)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The most that a query's product with any vector between ``low`` and ``high`` can be, queries by ranges."""
    return np.maximum(queries, 0).dot(high.T) + np.minimum(queries, 0).dot(low.T)


def search(asked: np.ndarray, queries: np.ndarray, least: np.ndarray, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, block: int = BLOCK) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], int]:
    """(query numbers, ids, scores) of each query's best k among those of at least ``least``, and how many blocks were scored.

    ``asked`` holds the queries' own rows, ``rows`` those of the vectors.
    """
    width = min(queries.shape[1], vectors.shape[1])
    queries, vectors = queries[:, :width], vectors[:, :width]
    starts = range(0, len(ids), block)
    bounds = _bounds(queries, np.array([vectors[s : s + block].max(axis=0) for s in starts]), np.array([vectors[s : s + block].min(axis=0) for s in starts]))
    order = np.argsort(-bounds, axis=1, kind="stable")
    least = least.astype(object if queries.dtype == object else np.float64)
    active, scored = np.arange(len(asked)), 0
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, vectors.dtype))
    for turn in range(len(starts)):
        blocks = order[active, turn]
        alive = bounds[active, blocks] >= least[active]
        active, blocks = active[alive], blocks[alive]
        if not len(active):
            break
        scored += len(active)
        found = [best]
        for b in np.unique(blocks):
            mine, s = active[blocks == b], b * block
            got = queries[mine].dot(vectors[s : s + block].T)
            got[rows[None, s : s + block] == asked[mine, None]] = -np.inf
            cut = least[mine]
            if got.shape[1] > k:
                cut = np.maximum(cut, np.partition(got, -k, axis=1)[:, -k])
            i, j = np.nonzero((got >= cut[:, None]) & (got > -np.inf))
            found.append((mine[i], ids[s : s + block][j], got[i, j]))
        q, x, score = (np.concatenate(c) for c in zip(*found, strict=True))
        by = np.lexsort((x, -score, q))
        q, x, score = q[by], x[by], score[by]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        least[q[place == k - 1]] = np.maximum(least[q[place == k - 1]], score[place == k - 1])
        best = (q[place < k], x[place < k], score[place < k])
    return best, scored


def _near(rows: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """An order in which close vectors stand together: by the signs of their largest-spread components."""
    m = np.array(vectors, np.float64)
    m -= m.mean(axis=0) if m.size else 0
    spread = np.argsort(-m.var(axis=0), kind="stable")[:12] if m.size else []
    code = np.zeros(len(rows), np.int64)
    for d in spread:
        code = 2 * code + (m[:, d] > 0)
    return np.lexsort((rows, code))


def quantised(table: DataFrame, vector: str, key: str, scale: int, is_query) -> DataFrame:
    """(id, v, asks): integer vectors of the rows that take part."""
    x = F.col(vector).cast("array<double>")
    whole = ~F.exists(F.coalesce(x, F.array()), lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = table.where(F.col(vector).isNotNull() & F.col(key).isNotNull() & whole)
    return rows.select(F.col(key).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))


def _whole(scores: np.ndarray) -> pa.Array:
    return pa.array([min(max(int(s), ENDS.min), ENDS.max) for s in scores.tolist()], pa.int64())


def _floor(least: pa.ChunkedArray) -> np.ndarray:
    return np.array([-np.inf if x is None else x for x in least.to_pylist()], object)


HOME = "group int, row long, id long, v array<long>, high array<long>, low array<long>, least long, vec_ids array<long>, scores array<long>"
MET = "group int, row long, id long, v array<long>, least long"
FOUND = "row long, id long, vec_id long, score long"


def _meet_home(k: int):
    """A group's bounds, and each of its queries with its best k in the group."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        number, ids, vectors = rows.column("row").to_numpy(), rows.column("id").to_numpy(), rows.column("v").to_pylist()
        m = _matrix(vectors)
        group = key[0].as_py()
        out = [{"group": group, "high": [int(x) for x in m.max(axis=0)], "low": [int(x) for x in m.min(axis=0)]}]
        asks = np.flatnonzero(rows.column("asks").to_numpy(zero_copy_only=False))
        if len(asks):
            order = _near(number, m)
            (q, x, score), _ = search(number[asks], m[asks], np.full(len(asks), -np.inf, object), number[order], ids[order], m[order], k)
            lists: list[list] = [[] for _ in asks]
            for i, one, s in zip(q.tolist(), x.tolist(), _whole(score).to_pylist(), strict=True):
                lists[i].append((one, s))
            for a, mine in zip(asks.tolist(), lists, strict=True):
                out.append({"group": group, "row": int(number[a]), "id": int(ids[a]), "v": vectors[a], "least": mine[-1][1] if len(mine) == k else None, "vec_ids": [y for y, _ in mine], "scores": [s for _, s in mine]})
        lists_of = pa.list_(pa.int64())
        return pa.Table.from_pylist(out, pa.schema([("group", pa.int32()), ("row", pa.int64()), ("id", pa.int64()), ("v", lists_of), ("high", lists_of), ("low", lists_of), ("least", pa.int64()), ("vec_ids", lists_of), ("scores", lists_of)]))

    return run


def _reach(queries: pa.Table, groups: pa.Table) -> pa.Table:
    """The queries of a tile with each group of a tile, other than home, whose bound reaches their k-th score."""
    if not queries.num_rows or not groups.num_rows:
        return pa.table({n: pa.array([], t) for n, t in (("group", pa.int32()), ("row", pa.int64()), ("id", pa.int64()), ("v", pa.list_(pa.int64())), ("least", pa.int64()))})
    queries = queries.combine_chunks()
    both = _matrix(queries.column("v").to_pylist() + groups.column("high").to_pylist() + groups.column("low").to_pylist())
    n, g = queries.num_rows, groups.num_rows
    numbers = groups.column("group").to_numpy()
    bounds = _bounds(both[:n], both[n : n + g], both[n + g :])
    near = (bounds >= _floor(queries.column("least"))[:, None]) & (queries.column("group").to_numpy()[:, None] != numbers[None])
    q, x = np.nonzero(near)
    mine = queries.take(pa.array(q))
    return pa.table({"group": pa.array(numbers[x], pa.int32()), "row": mine.column("row"), "id": mine.column("id"), "v": mine.column("v"), "least": mine.column("least")})


def _meet(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in ("row", "id", "vec_id", "score")})
        number, ids = left.column("row").to_numpy(), left.column("id").to_numpy()
        both = _matrix(left.column("v").to_pylist() + right.column("v").to_pylist())
        vectors, queries = both[: len(ids)], both[len(ids) :]
        order = _near(number, vectors)
        asked = right.column("row").to_numpy()
        (q, x, score), _ = search(asked, queries, _floor(right.column("least")), number[order], ids[order], vectors[order], k)
        return pa.table({"row": asked[q], "id": right.column("id").to_numpy()[q], "vec_id": x, "score": _whole(score)})

    return run


def top_k(table: DataFrame, is_query, k: int = 5, vector: str = "embedding", key: str = "vec_id", scale: int = 256, group: int = GROUP, tile: int = TILE) -> DataFrame:
    """(query_id, rank, vec_id, score, query_row): for each row where ``is_query`` holds, the k rows of highest inner product."""
    spark = prepare(table.sparkSession)
    scratch = Scratch(spark)
    rows = scratch.keep(quantised(table, vector, key, scale, is_query).withColumn("row", F.monotonically_increasing_id()))
    n = rows.count()
    planes = min(PLANES, max(0, (n // group).bit_length() - 1))
    signs = [F.when(F.coalesce(F.try_element_at("v", F.lit(d + 1)), F.lit(0)) > 0, 1 << d).otherwise(0) for d in range(planes)]
    cell = sum(signs, F.lit(0)).alias("cell")
    counts = {r["cell"]: r["count"] for r in rows.groupBy(cell).count().collect()}
    cells, first = [], 0
    for c in sorted(counts):
        cells.append((c, first, -(-counts[c] // group)))
        first += cells[-1][2]
    groups = max(1, first)
    firsts = F.broadcast(spark.createDataFrame(cells, "cell int, first int, groups int"))
    dealt = rows.select("row", "id", "v", "asks", cell).join(firsts, "cell").select("row", "id", "v", "asks", (F.col("first") + F.pmod(F.xxhash64("row"), F.col("groups"))).cast("int").alias("group"))
    home = scratch.keep(dealt.groupBy("group").applyInArrow(_meet_home(k), HOME))
    asked = home.where("row is not null").select("group", "row", "id", "v", "least")
    best = home.where("row is not null").select("row", "id", F.inline(F.arrays_zip(F.col("vec_ids").alias("vec_id"), F.col("scores").alias("score"))))
    if groups > 1:
        tiles, spans = max(1, -(-asked.count() // tile)), -(-groups // tile)
        every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
        left = asked.withColumn("tile", F.pmod(F.xxhash64("row"), F.lit(tiles).cast("long"))).withColumn("span", every(spans))
        right = home.where("row is null").select("group", "high", "low", F.pmod("group", F.lit(spans)).cast("long").alias("span")).withColumn("tile", every(tiles))
        met = scratch.keep(left.groupBy("tile", "span").cogroup(right.groupBy("tile", "span")).applyInArrow(_reach, MET))
        crowd = met.groupBy("group").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
        right = met.join(crowd, "group").withColumn("tile", F.pmod(F.xxhash64("row"), F.col("tiles")).cast("int"))
        left = dealt.join(crowd, "group").select("group", "row", "id", "v", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
        found = left.groupBy("group", "tile").cogroup(right.select("group", "row", "id", "v", "least", "tile").groupBy("group", "tile")).applyInArrow(_meet(k), FOUND)
        best = best.unionByName(found)
    # A query's k from every group it met; each task cuts its share before the shuffle.
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select(F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score", F.col("row").alias("query_row"))
