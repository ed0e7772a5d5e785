"""Session helpers: table loading, worker imports, scratch tables in the shared folder."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when it is not installed, as in a source checkout.

    On one machine its folder goes on the workers' path; on a cluster a zip of it is written to the shared
    folder and dealt out by Spark.
    """
    sc = spark.sparkContext
    if _is_local(spark):
        paths = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
        if ROOT not in paths:
            sc.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *(p for p in paths if p)])
    elif sc.applicationId not in _shipped:
        sources = sorted((Path(ROOT) / "wayfold").rglob("*.py"))
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            for p in sources:
                z.writestr(zipfile.ZipInfo(str(p.relative_to(ROOT))), p.read_bytes())
        target = f"{shared_dir(spark)}/wayfold-{sc.applicationId}.zip"
        path = sc._jvm.org.apache.hadoop.fs.Path(target)
        out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(held.getvalue()))
        out.close()
        sc.addPyFile(target)
        _shipped.add(sc.applicationId)
    return spark


#: Applications that have the package already.
_shipped: set[str] = set()


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.split("[")[0] == "local"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where none is named and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not _is_local(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="wayfold-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


class Scratch:
    """Tables written to the shared folder so that later steps never depend on one executor's disk.

    A written table cuts the lineage of iterative plans and carries true sizes, so the optimizer
    can choose join strategies from them. ``drop`` frees a table that no later step reads; the
    rest goes when the process ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/wayfold-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: dict[int, str] = {}
        atexit.register(self._delete, self.base)

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = self.paths.pop(id(df), None)
        if path:
            self._delete(path)

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone; the folder is scratch space
            pass
