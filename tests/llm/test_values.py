"""Values of the corpus queries on odd rows, and the two classifiers' algebra against plain forms."""

import hashlib
import itertools
import math
import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

import public_tokenizers
from wayfold.llm import decontaminate, quality, registry, toxicity

LONG = " ".join(f"Word{k % 9973}" for k in range(200000))
ROWS = [(1, None), (2, ""), (3, "One"), (3, "One"), (4, "a b, c d e f g h i j"), (5, None), (None, "one"), (6, LONG), (7, " \n\t")]
BENCH = [(1, "A b c"), (2, None), (None, "one"), (3, ""), (4, "one"), (4, "one"), (5, " ".join(LONG.split()[100000:100010]))]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, index int, y int, row long, word string, n long, ids binary"
    spark.createDataFrame([(i, t, None, None, None, 0.5, 1, 2, 3, "w", 4, None) for i, t in ROWS], schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(BENCH, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def got(spark, folder, name):
    return registry.queries()[name](spark, folder).collect()


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def test_op1_without_labels(spark, folder):
    want = [(i, i is not None and zlib.crc32(str(i).encode()) % 3 == 1, 0.5, 1) for i, _ in ROWS]
    assert ordered(map(tuple, got(spark, folder, "op1_quality_fm"))) == ordered(want)


def test_op9_without_labels(spark, folder):
    rows = got(spark, folder, "op9_toxicity_ordinal")
    assert ordered((r.doc_id, r.held_out, r.predicted, r.grade) for r in rows) == ordered((i, i is not None and zlib.crc32(str(i).encode()) % 3 == 1, 0, 0) for i, _ in ROWS)
    assert all(0 <= r.score < 1e-6 and 0 <= r.expected_severity < 1e-6 for r in rows)


def fingerprint(text):
    words = (text or "").lower().split()
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))


def test_op5(spark, folder):
    prints = [(i, fingerprint(t)) for i, t in ROWS]
    assert all((a ^ b).bit_count() > 3 or a == b for (_, a), (_, b) in itertools.combinations(prints, 2))
    least = lambda p: min((i for i, q in prints if q == p and i is not None), default=None)
    want = [(i, f"{p:016x}", None if i is None else least(p)) for i, p in prints]
    assert ordered((r.doc_id, r.fingerprint, r.component_id) for r in got(spark, folder, "op5_simhash_anchors")) == ordered(want)


def test_op6(spark, folder):
    def row(i, n, hit, *items):
        return i, n, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), len(items) >= 2

    span = LONG.split()[100000:100010]
    windows = {tuple(span[k : k + 8]) for k in range(3)}
    words, hit = LONG.split(), set()
    for k in range(len(words) - 7):
        if words[k] in span[:3] and tuple(words[k : k + 8]) in windows:
            hit.update(range(k, k + 8))
    want = [row(1, 0, 0), row(2, 0, 0), row(3, 1, 1, "4"), row(3, 1, 1, "4"), row(4, 10, 3, "1"), row(5, 0, 0), row(None, 1, 1, "4"), row(6, len(words), len(hit), "5"), row(7, 0, 0)]
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert ordered(tuple(r[c] for c in columns) for r in got(spark, folder, "op6_decontaminate_prefix")) == ordered(want)


def test_op6_in_slices(spark, folder):
    docs, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    one, many = (sorted(map(str, decontaminate.hits(docs, bench, ["doc_id"], limit=n).select("doc_id", "n_words", "spans", "items").collect())) for n in (1 << 20, 8))
    assert one == many


def test_op7(spark, folder):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = got(spark, folder, "op7_packing_tiers")
    for i in {i for i, _ in ROWS}:
        texts = [t for j, t in ROWS if j == i]
        ids = [*tok.encode(texts[0] or "", add_special_tokens=False).ids, 2]
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert sum(r.length for r in mine) == len(ids) * len(texts) and {r.doc_tokens for r in mine} == {len(ids)}
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for _, seq in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), lambda r: r.sequence_id):
        at = 0
        for r in seq:
            assert r.offset == at
            at += r.length
        assert at <= 4096


def test_sum_of_squares_identity():
    rng = np.random.default_rng(3)
    machine = quality.Machine(0.3, rng.normal(size=quality.SIZE).astype(np.float32), rng.normal(size=(quality.SIZE, quality.RANK)).astype(np.float32))
    for text in ("", "one two three two", "A line.\nAnother line, with 12 marks!"):
        index, value = quality.features(text, None)
        pairs = sum(float(machine.factors[i] @ machine.factors[j]) * float(x) * float(y) for (i, x), (j, y) in itertools.combinations(zip(index, value), 2))
        assert machine.raw(index, value) == pytest.approx(0.3 + float(machine.linear[index] @ value) + pairs, rel=1e-4, abs=1e-3)


def test_ordinal_gradient():
    rng = np.random.default_rng(5)
    row, column = (np.array(x) for x in zip(*[(r, c) for r in range(40) for c in range(6) if rng.random() < 0.4]))
    rows, grade = toxicity.Rows(row, column, 40, 6), rng.integers(0, 4, 40)
    w, theta = rng.random(6), np.array([-0.4, 0.5, 1.7])
    loss, by_w, by_theta = toxicity.loss_and_gradient(rows, grade, w, theta)
    plain = 0.0
    for r in range(40):
        f = w[column[row == r]].sum()
        below = [0.0, *(1 / (1 + math.exp(f - t)) for t in theta), 1.0]
        plain -= math.log(below[grade[r] + 1] - below[grade[r]]) / 40
    assert loss == pytest.approx(plain)
    for x, slope in ((w, by_w), (theta, by_theta)):
        for k in range(len(x)):
            x[k] += 1e-5
            more = toxicity.loss_and_gradient(rows, grade, w, theta)[0]
            x[k] -= 2e-5
            less = toxicity.loss_and_gradient(rows, grade, w, theta)[0]
            x[k] += 1e-5
            assert slope[k] == pytest.approx((more - less) / 2e-5, abs=1e-6)
