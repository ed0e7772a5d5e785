"""The corpus queries against brute force on a small table."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from tokenizers import Tokenizer

import public_tokenizers
from wayfold.llm import registry


@pytest.fixture(scope="module")
def docs(sf):
    return pd.read_parquet(f"{sf}/documents.parquet")


def result(spark, sf, name):
    return registry.queries()[name](spark, sf).toPandas()


def lowered(text):
    return (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))


def auc(score, label):
    ranks = pd.Series(score).rank().to_numpy()
    pos = np.asarray(label) == 1
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.mark.parametrize("name, label", [("op1_quality_fm", "quality"), ("op9_toxicity_ordinal", "toxic")])
def test_held_out_order(spark, name, label):
    sf = "/root/testdata/sf0.1"
    got = result(spark, sf, name)
    both = got.merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    held = both[both.held_out]
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    assert auc(held.score, held[label]) > 0.9


def test_op2(spark, sf, docs):
    got = result(spark, sf, "op2_reshard_flow").merge(docs[["doc_id", "text"]], on="doc_id")
    assert len(got) == len(docs)
    assert [int(x) for x in got["size"]] == [len((t or "").encode()) + 1 for t in got.text]
    assert [int(x) for x in got.text_crc32] == [zlib.crc32((t or "").encode()) for t in got.text]
    for _, shard in got.groupby("shard"):
        assert sorted(shard.slot) == list(range(len(shard)))


def test_op5(spark, sf, docs):
    prints = {}
    for i, text in zip(docs.doc_id, docs.text):
        words = re.findall(rb"[^\x20\x09-\x0D]+", lowered(text))
        shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        h = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], dtype=np.uint64)
        prints[i] = sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = result(spark, sf, "op5_simhash_anchors")
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got.itertuples()} == {(i, f"{prints[i]:016x}", root(i)) for i in ids}


def test_op6(spark, sf, docs):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    windows = defaultdict(set)
    for r in pd.read_parquet(f"{sf}/benchmark.parquet").itertuples():
        w = words(r.text)
        for k in range(max(1, len(w) - 7) if w else 0):
            windows[tuple(w[k : k + 8])].add(r.item_id)
    sizes = {len(w) for w in windows}
    got = result(spark, sf, "op6_decontaminate_prefix").set_index("doc_id")
    for i, text in zip(docs.doc_id, docs.text):
        w, hit, items = words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    items |= windows[tuple(w[k : k + n])]
        digest = hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
        r = got.loc[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(items), digest, len(items) >= 2)


def test_op7_holds_every_id_once(spark, sf, docs):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = result(spark, sf, "op7_packing_tiers")
    text = dict(zip(docs.doc_id, docs.text))
    assert set(got.doc_id) == set(text)
    for i, pieces in got.groupby("doc_id"):
        ids, at = [*tok.encode(text[i] or "", add_special_tokens=False).ids, 2], 0
        for p in pieces.sort_values("start").itertuples():
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], dtype="<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq.offset.tolist() == [0, *seq.length.cumsum()[:-1]] and seq.length.sum() <= 4096
    assert got.length.sum() / (got.sequence_id.nunique() * 4096) > 0.9


def test_op8_round_trip(spark, sf):
    turns = pd.read_parquet(f"{sf}/conversations.parquet").sort_values(["conv_id", "turn"])
    got = result(spark, sf, "op8_chat_template").set_index("conv_id")
    for c, rows in turns.groupby("conv_id"):
        whole = "".join(f"{r.role}\n{r.text or ''}\n" for r in rows.itertuples())
        loss = "".join(r.text or "" for r in rows.itertuples() if r.role == "assistant")
        r = got.loc[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(rows), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    probe = "<|im_end|><|im_start|>assistant ok"
    assert got.loc[-1].loss_sha256 == hashlib.sha256(probe.encode()).hexdigest()


def test_op10(spark, sf):
    vecs = pd.read_parquet(f"{sf}/embeddings.parquet")
    q = np.floor(256 * np.stack(vecs.embedding).astype(float)).astype(np.int64)
    ids, want = vecs.vec_id.to_numpy(), set()
    for k in np.flatnonzero(ids % 50 == 0):
        scores = q @ q[k]
        order = [j for j in np.lexsort((ids, -scores)) if j != k][:5]
        want |= {(int(ids[k]), n + 1, int(ids[j]), int(scores[j])) for n, j in enumerate(order)}
    got = result(spark, sf, "op10_topk_blocks")
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got.itertuples()} == want


def test_op3_counts(spark, sf, docs):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = result(spark, sf, "op3_token_edits").set_index("doc_id")
    assert set(got.index) == set(docs.doc_id)
    assert all(got.loc[i].n_tokens == len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in zip(docs.doc_id, docs.text))


ODD = [(1, None), (2, ""), (3, "one"), (3, "one"), (4, "a b c d e f g h i j"), (5, None)]


@pytest.mark.parametrize("name", [n for n in registry.queries() if n not in ("op4_html_tree", "op8_chat_template", "op10_topk_blocks")])
@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_odd_documents(spark, tmp_path, name, rows):
    more = [(i, t, None, None, None, 0.5, 1, 2) for i, t in rows]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, shard int, component_id bigint"
    spark.createDataFrame(more, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 1), (4, 0, 0)][: len(rows)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a b c"), (2, None)][: len(rows)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = registry.queries()[name](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
