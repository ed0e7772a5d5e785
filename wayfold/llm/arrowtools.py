"""Arrow helpers for operators that run Python over whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wayfold.session import prepare

BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20


def texts_per_batch(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Few rows and bytes to an Arrow batch: some texts are very long, and a worker and its executor hold a batch whole.

    A batch ends with the row that fills ``BATCH_BYTES``. This lowers the session's settings for
    good: they are read when a plan runs, long after this call.
    """
    prepare(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) <= 0 or int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def map_rows(df: DataFrame, columns: list, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """Map ``columns`` of ``df`` batch by batch; ``make`` builds the worker's function once a task."""
    texts_per_batch(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            if batch.num_rows:
                yield f(batch)

    return df.select(*columns).mapInArrow(run, schema)


def held_out(doc_id="doc_id"):
    """The fold that no model sees: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
