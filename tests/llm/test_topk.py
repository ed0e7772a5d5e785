"""Exact search against brute force: many groups, clusters, ties, repeated and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.llm import topk


def plain(ids, vectors, asks, k):
    q = np.floor(256 * np.asarray(vectors, float)).astype(np.int64)
    out = []
    for a in np.flatnonzero(asks):
        scores = q @ q[a]
        out.append((ids[a], [(int(ids[j]), int(scores[j])) for j in np.lexsort((ids, -scores)) if j != a][:k]))
    return sorted(out)


def lists(df):
    out = {}
    for r in df.orderBy("query_row", "rank").collect():
        out.setdefault((r.query_id, r.query_row), []).append((r.rank, r.vec_id, r.score))
    assert all([x[0] for x in v] == list(range(1, len(v) + 1)) for v in out.values())
    return sorted((i, [x[1:] for x in v]) for (i, _), v in out.items())


def clustered(n, seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(40, 16)) * 4
    return centers[rng.integers(40, size=n)] + rng.normal(size=(n, 16)) * 0.05


@pytest.mark.parametrize("kind", ["clusters", "noise", "ties", "equal"])
def test_against_brute_force(spark, kind):
    rng = np.random.default_rng(1)
    v = {"clusters": clustered(900), "noise": rng.normal(size=(900, 16)), "ties": rng.integers(-1, 2, size=(900, 4)) * 1.0, "equal": np.ones((300, 4))}[kind]
    ids = rng.permutation(len(v) * 3)[: len(v)]
    ids[5], ids[6], ids[7] = 50, 50, 50  # one id on several rows
    df = spark.createDataFrame([(int(i), [float(y) for y in x], "x") for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<double>, row string")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, group=64, tile=8)
    want = plain(ids, v, ids % 50 == 0, 5)
    if kind in ("ties", "equal"):  # several rows of id 50 may stand at equal scores
        assert [(i, [s for _, s in x]) for i, x in lists(got)] == [(i, [s for _, s in x]) for i, x in want]
    assert lists(got) == want


def test_clusters_prune_blocks_and_groups(spark):
    v = np.floor(256 * clustered(8192))
    order = topk._near(np.arange(len(v)), v)
    asked = np.arange(0, len(v), 50)
    _, scored = topk.search(asked, v[asked], np.full(len(asked), -np.inf, object), order, order, v[order], 5)
    assert scored < 0.35 * len(asked) * (len(v) // topk.BLOCK)


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0]), (1, [3.0]), (2, [1.0, 1.0, 9.0]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (None, [1.0, 1.0]), (7, []), (50, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = lists(topk.top_k(df, F.col("vec_id") % 50 == 0))
    one = 256 * 256
    assert got == [(0, [(1, 3 * one), (2, 3 * one), (7, 0), (50, -one)]), (50, [(7, 0), (0, -one), (2, -one), (1, -3 * one)])]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    big = spark.createDataFrame([(0, [1e9, 1e9]), (1, [1e9, 1e9]), (2, [-1e9, 5.0])], "vec_id long, embedding array<double>")
    assert lists(topk.top_k(big, F.col("vec_id") == 0)) == [(0, [(1, 2**63 - 1), (2, max(-(2**63), int(256e9) * (256 * 5 - int(256e9))))])]
