"""Resharding carried out on files."""

import itertools
import json
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wayfold.llm import reshard


@pytest.mark.parametrize("shards", [4, 8])
def test_rewrite(spark, tmp_path, shards):
    rows = [(i % 50 if i % 7 else None, "same" if i % 5 == 0 else "text " * (i % 13), f"n{i}") for i in range(400)]
    docs = spark.createDataFrame([*rows, (None, None, "none"), (1, "one", None), (1, "one", None)], "doc_id long, text string, `my _row` string")
    old = F.pmod(F.crc32(F.coalesce("text", F.lit("")).cast("binary")), F.lit(6)).cast("int")
    docs.withColumn("shard", old).write.partitionBy("shard").parquet(f"{tmp_path}/v1")
    layout = {n: f"{tmp_path}/v1/shard={n}" for n in range(6) if Path(f"{tmp_path}/v1/shard={n}").exists()}
    before = {p: p.stat().st_mtime_ns for p in Path(f"{tmp_path}/v1").rglob("*")}
    stored = reshard.read_layout(spark, layout)
    placed = reshard.reshard(stored, F.col("shard"), 6, shards)
    placed.write.parquet(f"{tmp_path}/placed")
    placed = spark.read.parquet(f"{tmp_path}/placed")
    manifest = reshard.rewrite(stored, F.col("shard"), placed, layout, f"{tmp_path}/v2")
    assert manifest == {int(n): p for n, p in json.loads(Path(f"{tmp_path}/v2/manifest.json").read_text()).items()}
    assert {p: p.stat().st_mtime_ns for p in Path(f"{tmp_path}/v1").rglob("*")} == before  # readers of the old version go on
    now = reshard.read_layout(spark, manifest)
    got = now.collect()
    assert now.columns == stored.columns
    assert Counter(tuple(r)[:3] for r in got) == Counter(tuple(r) for r in docs.collect())
    assert Counter(r.shard for r in got) == Counter(r.shard for r in placed.collect())
    assert set(manifest) == {r.shard for r in got}
    moved = {n for r in placed.where("moved").collect() for n in (r.shard, r.old_shard)}
    assert {n for n in manifest if manifest[n] == layout.get(n)} == set(layout) - moved
    if shards == 4:
        assert 5 not in manifest and max(manifest) == 3


def test_repair_of_a_long_row(spark):
    rows = [(0, "x" * 400_000), *((i, "y" * (20 if i % 2 else 997 * (1 + i % 9))) for i in range(1, 1200))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = {r[0]: r[1] for r in reshard.reshard(docs, F.lit(0), 1, 4).groupBy("shard").agg(F.sum("size")).collect()}
    even = sum(len(t) + 1 for _, t in rows) / 4
    assert len(sizes) == 4 and max(abs(x - even) for x in sizes.values()) <= 100


def test_repair_goes_on_past_a_stuck_shard():
    assert reshard.repair([130, 120, 50], [(1, 10), (1, 10)]) == [(1, 1, 2), (0, 1, 2)]


def cheapest(supply, capacity, cost):
    """Least cost over all integer flows."""
    best = None
    for flow in itertools.product(*[[f for f in itertools.product(range(s + 1), repeat=len(capacity)) if sum(f) == s] for s in supply]):
        if all(sum(f[j] for f in flow) == c for j, c in enumerate(capacity)):
            total = sum(x * cost(i, j) for i, f in enumerate(flow) for j, x in enumerate(f))
            best = total if best is None else min(best, total)
    return best


def test_flow_is_the_cheapest():
    rng = random.Random(4)
    for _ in range(60):
        n, m = rng.randrange(1, 4), rng.randrange(1, 4)
        supply = [rng.randrange(4) for _ in range(n)]
        cuts = sorted(rng.randrange(sum(supply) + 1) for _ in range(m - 1))
        capacity = [b - a for a, b in zip([0, *cuts], [*cuts, sum(supply)])]
        price = [[rng.randrange(6) for _ in range(m)] for _ in range(n)]
        cost = rng.choice([lambda i, j: price[i][j], lambda i, j: int(i != j)])
        flow = reshard.min_cost_flow(supply, capacity, cost)
        assert all(sum(x for (i, _), x in flow.items() if i == k) == s for k, s in enumerate(supply))
        assert all(sum(x for (_, j), x in flow.items() if j == k) == c for k, c in enumerate(capacity))
        assert sum(x * cost(i, j) for (i, j), x in flow.items()) == cheapest(supply, capacity, cost)


def test_cuts_carry_the_flow_out():
    rng = random.Random(8)
    for _ in range(50):
        blocks = [(o, b, rng.randrange(1, 50)) for o in range(3) for b in range(rng.randrange(1, 5))]
        supply = [sum(s for o, _, s in blocks if o == k) for k in range(3)]
        capacity = [sum(supply) // 4 + (j < sum(supply) % 4) for j in range(4)]
        flow = reshard.min_cost_flow(supply, capacity, lambda i, j: int(i != j))
        sent = Counter()
        for old, block, start, cuts in reshard.plan_cuts(blocks, flow):
            size = next(s for o, b, s in blocks if (o, b) == (old, block))
            at = start
            for upto, shard in cuts:
                sent[old, shard] += min(upto, start + size) - at
                at = min(upto, start + size)
            assert at == start + size
        assert +sent == Counter(flow)


def test_law_and_least_movement(spark):
    rng = random.Random(2)
    rows = [(i, "z" * rng.randrange(80), ["hot", "a", "b", "c"][max(0, rng.randrange(-3, 4))]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = reshard.reshard(docs, reshard.by_source(20), 20, 16).toPandas()
    loads = got.groupby("shard")["size"].sum()
    total = got["size"].sum()
    assert len(loads) == 16 and max(abs(loads - total / 16)) <= 80 and set(got.law) == {"bytes"}
    held = got.groupby("old_shard")["size"].sum()
    least = sum(max(0, held.get(n, 0) - total / 16) if n < 16 else held.get(n, 0) for n in range(20))
    assert least <= got[got.moved]["size"].sum() + 16 and got[got.moved]["size"].sum() <= least + 16 * 80


def test_equal_rows_are_spread(spark):
    docs = spark.range(20_000).selectExpr("7L AS doc_id", "'same' AS text", "'one' AS source")
    got = reshard.reshard(docs, reshard.by_source(20), 20, 16)
    sizes = [r["count"] for r in got.groupBy("shard").count().collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 1
    assert got.select("shard", "slot").distinct().count() == 20_000
    assert reshard.reshard(docs.limit(0), reshard.by_source(20), 20, 16).count() == 0
