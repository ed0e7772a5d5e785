"""The pipeline, stage by stage, against a plain form on a small table."""

import itertools
import re

import pandas as pd
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from wayfold.llm import decontaminate, quality, simhash, toxicity


def words(text):
    data = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", data)


def windows(text):
    w = words(text)
    return {tuple(w[i : i + 8]) for i in range(max(1, len(w) - 7))} if w else set()


def test_pipeline(spark, sf, tmp_path):
    tables = {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels")}
    good, ill = quality.fit(*tables.values()), toxicity.fit(*tables.values())
    items = [windows(t) for t in pd.read_parquet(f"{sf}/benchmark.parquet").text]
    now, stage_out = tables["documents"], {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, sf).write.parquet(path := str(tmp_path / name))
        now = spark.read.parquet(path)
        stage_out[name] = now.toPandas()
        if name != "packing":
            assert now.columns == tables["documents"].columns
    docs = tables["documents"].toPandas()
    docs = docs[[good.score(t, None if pd.isna(n) else int(n)) >= 0.5 for t, n in zip(docs.text, docs.n_chars)]]
    assert sorted(stage_out["quality"].doc_id) == sorted(docs.doc_id)
    docs = docs[[ill.above(t)[0] < 0.5 for t in docs.text]]
    assert sorted(stage_out["toxicity"].doc_id) == sorted(docs.doc_id)

    prints = dict(zip(docs.doc_id, map(simhash.fingerprint, docs.text)))
    least = {i: i for i in prints}
    moved = True
    while moved:
        moved = False
        for a, b in itertools.combinations(prints, 2):
            if (prints[a] ^ prints[b]).bit_count() <= 3 and least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                moved = True
    docs = docs[[least[i] == i for i in docs.doc_id]]
    assert sorted(stage_out["near_duplicates"].doc_id) == sorted(docs.doc_id)

    def found(text):
        w = words(text)
        spans = {tuple(w[i : i + n]) for n in range(1, 9) for i in range(len(w) - n + 1)}
        return sum(not spans.isdisjoint(x) for x in items)

    n_items = dict(zip(docs.doc_id, map(found, docs.text)))
    before, after = docs.set_index("doc_id").text, stage_out["decontamination"].set_index("doc_id").text
    assert sorted(after.index) == sorted(i for i, n in n_items.items() if n < 2)
    for i, text in after.items():
        assert text == before[i] if n_items[i] == 0 else found(text) == 0

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    packed = stage_out["packing"]
    assert set(packed.doc_id) == set(after.index) and (packed.groupby("sequence_id").length.sum() <= 4096).all()
    for i, mine in packed.sort_values("start").groupby("doc_id"):
        size = len(tokenizer.encode(after[i] or "", add_special_tokens=False).ids) + 1
        assert mine.length.sum() == size and list(mine.start) == [0, *mine.length.cumsum()[:-1]]


def test_without_ids(spark):
    rows = [(None, "a", 1), (1, None, 2), (1, "b", 3), (2, "c", 4), (3, "", 5), (-7, "d", 6)]
    docs = simhash._rows(spark.createDataFrame(rows, "doc_id long, text string, n int"))
    gone = spark.createDataFrame([(1,), (-7,), (99,)], "gone_id long")
    left = lambda d, g: sorted(r.row.n for r in simhash.without(d, g).collect())
    assert left(docs, gone) == [1, 4, 5]
    assert left(docs, gone.limit(0)) == [1, 2, 3, 4, 5, 6]
    assert left(docs.limit(0), gone) == []


ODD_NAMES = ["_id", "_first", "my col", "a.b", "row", "slot", "items", "spans", "gone_id", "fp", "changed", "tick`s"]


def test_stages_keep_columns_of_any_name(spark):
    a, b = (" ".join(f"{w}{k}" for k in range(60)) for w in "ab")
    rows = [(5, a), (5, b), (3, b), (7, "w1 w2 w3 w4 w5 w6 w7 w8 w9 and more"), (8, None), (None, "x"), (9, "")]
    columns = ", ".join("`" + n.replace("`", "``") + "` int" for n in ODD_NAMES)
    docs = spark.createDataFrame([(i, t, None, *range(len(ODD_NAMES))) for i, t in rows], f"doc_id long, text string, n_chars int, {columns}")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {tuple(r)[3:] for r in kept.collect()} == {tuple(range(len(ODD_NAMES)))}
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(0, "x"), (3, b), (5, a), (7, rows[3][1]), (8, "")])
    bench = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8")], "item_id long, text string")
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    cut = clean.where("doc_id = 7").first()
    assert (cut.text, cut.n_chars) == (" w9 and more", 12)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for stage in (lambda d: quality.keep_good(d, quality.fit(docs, labels)), lambda d: toxicity.keep_clean(d, toxicity.fit(docs, labels)), simhash.keep_one, lambda d: decontaminate.clean(d, bench)):
        none = stage(docs.limit(0))
        assert none.columns == docs.columns and none.count() == 0
    assert corpus_pipeline.packing.pack_documents(docs.limit(0)).count() == 0


def test_run(spark, sf):
    got = corpus_pipeline.run(spark, sf).toPandas()
    now = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf)
    want = now.toPandas()
    key = ["doc_id", "start", "length", "doc_tokens"]
    assert len(got) == len(want) and set(got.doc_id) == set(want.doc_id)
    assert got.groupby("doc_id").length.sum().equals(want.groupby("doc_id").length.sum()) and not got[key].duplicated().any()


def test_keep_one_by_row(spark):
    a, b, c, d = (" ".join(f"{w}{k}" for k in range(60)) for w in "abcd")
    rows = [(5, a), (5, b), (3, b), (7, c), (7, d), (8, c), (9, a), (9, None), (9, None), (None, a), (None, a), (11, "x"), (11, "X")]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(0, a), (0, a), (3, b), (5, a), (7, c), (7, d), (9, ""), (11, "X")])


def test_keep_one_of_unlike_id(spark):
    a, b = (" ".join(f"{w}{k}" for k in range(60)) for w in "ab")
    docs = spark.createDataFrame([(5, a), (5, b), (3, b)], "doc_id long, text string")
    assert sorted(map(tuple, simhash.keep_one(docs).collect())) == [(3, b), (5, a)]
