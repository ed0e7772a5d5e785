"""GeoJSON and CSV files.

Tables are written by the executors. Where one file is asked for, one task streams all rows into it; a
folder of parts (``single=False``) has no such narrow place. Written files replace old ones only when they are whole.
"""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import geometry as G


def feature_json(df: DataFrame) -> Column:
    """Every row as a GeoJSON feature; columns but ``geometry`` are its properties."""
    kind, parts = F.col("geometry.type"), F.col("geometry.parts")
    xy = lambda p: F.array(p["x"], p["y"])
    lines = F.transform(parts, lambda part: F.transform(part, xy))
    flat = F.transform(F.flatten(parts), xy)
    shape = (
        F.when(kind == "Point", F.to_json(flat[0]))
        .when(kind.isin("MultiPoint", "LineString"), F.to_json(flat))
        .when(kind == "MultiPolygon", F.to_json(F.transform(lines, lambda ring: F.array(ring))))
        .when(kind.isin("MultiLineString", "Polygon"), F.to_json(lines))
    )
    geom = F.when(shape.isNotNull(), F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), shape, F.lit("}"))).otherwise("null")
    named = [F.col(f"`{c}`") for c in df.columns if c != "geometry"]
    properties = F.to_json(F.struct(*named), {"ignoreNullFields": "false"}) if named else F.lit("{}")
    return F.concat(F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":'), geom, F.lit("}"))


def _fs(df: DataFrame, path: str):
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf), jvm.org.apache.hadoop.fs.Path


def _one_file(lines: DataFrame, path: str) -> None:
    """Write the one part of ``lines`` as the file ``path``."""
    parent, _, name = path.rpartition("/")
    staged = f"{parent or '.'}/.{name}-{uuid.uuid4().hex}"
    lines.write.text(staged)
    fs, at = _fs(lines, path)
    parts = sorted(str(s.getPath()) for s in fs.listStatus(at(staged)) if s.getPath().getName().startswith("part-"))
    if len(parts) != 1:
        raise OSError(f"{staged} should hold one part, not {len(parts)}")
    fs.delete(at(path), True)
    if not fs.rename(at(parts[0]), at(path)):
        raise OSError(f"{parts[0]} could not be moved to {path}")
    fs.delete(at(staged), True)


def write_geojson(df: DataFrame, path: str, crs: str | None = None, single: bool = True, before: str = "", after: str = "") -> None:
    """A collection as one file, or a folder of files with a feature on each line."""
    lines = df.select(feature_json(df).alias("value"))
    if not single:
        lines.write.mode("overwrite").text(path)
        return
    head = before + '{"type":"FeatureCollection",' + (f'"crs":{{"type":"name","properties":{{"name":{json.dumps(crs)}}}}},' if crs else "") + '"features":['

    def collect(batches):
        yield pa.RecordBatch.from_arrays([pa.array([head])], ["value"])
        first = True
        for batch in batches:
            out = []
            for v in batch.column(0).to_pylist():
                if v is not None:
                    out.append(v if first else "," + v)
                    first = False
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out)], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]}" + after])], ["value"])

    # A last, empty row keeps a task even where there is no row at all.
    end = df.sparkSession.range(1).select(F.lit(None).cast("string").alias("value"))
    _one_file(lines.unionByName(end).coalesce(1).mapInArrow(collect, "value string"), path)


def well_known_text(geom: Column) -> Column:
    kind, parts = geom["type"], geom["parts"]
    xy = lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))
    ring = lambda part: F.concat(F.lit("("), F.array_join(F.transform(part, xy), ", "), F.lit(")"))
    flat = F.concat(F.lit("("), F.array_join(F.transform(F.flatten(parts), xy), ", "), F.lit(")"))
    nested = F.concat(F.lit("("), F.array_join(F.transform(parts, ring), ", "), F.lit(")"))
    polygons = F.concat(F.lit("(("), F.array_join(F.transform(parts, ring), "), ("), F.lit("))"))
    body = F.when(kind.isin("Point", "LineString", "MultiPoint"), flat).when(kind == "MultiPolygon", polygons).otherwise(nested)
    return F.concat(F.upper(kind), F.lit(" "), body)


def write_csv(df: DataFrame, path: str, single: bool = True) -> None:
    """A table with a header; geometries as well-known text, lists and other nested values as JSON."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name == "geometry" and "parts" in f.dataType.simpleString():
            c = well_known_text(c)
        elif f.dataType.typeName() in ("array", "map", "struct"):
            c = F.to_json(c)
        columns.append(c.cast("string").alias(f.name))
    flat = df.select(*columns)
    if not single:
        flat.write.mode("overwrite").option("header", True).csv(path)
        return
    quoted = lambda c: F.when(c.rlike("[\",\r\n]"), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
    lines = flat.select(F.concat_ws(",", *[quoted(F.col(f"`{c}`")) for c in flat.columns]).alias("value"))
    head = ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in '",\r\n') else c for c in flat.columns)

    def titled(batches):
        yield pa.RecordBatch.from_arrays([pa.array([head])], ["value"])
        for batch in batches:
            kept = batch.filter(batch.column(0).is_valid())
            if kept.num_rows:
                yield kept

    end = df.sparkSession.range(1).select(F.lit(None).cast("string").alias("value"))
    _one_file(lines.unionByName(end).coalesce(1).mapInArrow(titled, "value string"), path)
