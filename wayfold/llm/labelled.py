"""A bounded, deterministic sample of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.arrowtools import held_out


def sample(docs: DataFrame, labels: DataFrame, label: str, columns: list[str], max_rows: int) -> DataFrame:
    """(doc_id, y, columns...) of at most ``max_rows`` labelled documents outside the held-out fold.

    Rows are taken in order of a hash of doc_id. A null label or doc_id takes no part, the smallest
    label holds where a doc_id has several, and of repeated documents one row is taken. At most
    ``max_rows`` pairs of numbers are broadcast.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min(label).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct(*columns).alias("row")).join(F.broadcast(known), "id")
    return rows.groupBy("id", "y").agg(F.min("row").alias("row")).select(F.col("id").alias("doc_id"), "y", "row.*")
