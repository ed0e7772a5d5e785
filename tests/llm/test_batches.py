"""Batches of long texts are bounded in bytes, and rows of equal features are fitted once."""

import pyarrow as pa
from pyspark.sql import functions as F

from wayfold.llm import toxicity
from wayfold.llm.arrowtools import map_rows
from wayfold.session import Scratch


def test_batches_of_long_texts_are_bounded_in_bytes(spark):
    docs = spark.range(0, 24, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat('ab', if(id = 7, 6, 1) * (1 << 19))").alias("text"))

    def make():
        return lambda batch: pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["rows", "bytes"])

    seen = map_rows(docs, ["doc_id", "text"], make, "rows long, bytes long").collect()
    assert sum(r["rows"] for r in seen) == 24
    # A batch ends with the row that fills 4 MB, so one text at most, of 6 MB here, stands over it.
    assert max(r["bytes"] for r in seen) <= 11 << 20


def test_long_texts_are_kept_as_short_ones(spark):
    model = toxicity.Ordinal({"bad": 9.0}, [1.0, 2.0, 3.0])
    fill = F.repeat(F.lit("fine "), 300_000)
    docs = spark.range(0, 12, 1, 1).select(F.col("id").alias("doc_id"), F.concat(fill, F.when(F.col("id") % 3 == 0, " bad").otherwise(" good")).alias("text"))
    assert sorted(r["doc_id"] for r in toxicity.keep_clean(docs, model).select("doc_id").collect()) == [i for i in range(12) if i % 3]


def test_rows_of_equal_features_count_once(spark):
    known = spark.createDataFrame([(5, 1, "b a"), (3, 1, "A, b!"), (4, 0, "a b"), (6, 1, "ab"), (7, 0, ""), (8, 0, None)], "doc_id long, y int, text string")
    rows = toxicity._features(known, Scratch(spark)).collect()
    assert sorted((r["id"], r["y"], r["features"]) for r in rows) == [(3, 1, ["a", "b"]), (4, 0, ["a", "b"]), (6, 1, ["ab"]), (7, 0, [])]
