"""GeoJSON layers: one collection to a file, or one feature to a line.

Properties and coordinates are read as VARIANT, so files with mixed types, with nested values, or with
names that differ by case only can be read. A file that holds one collection is parsed by one task, as
its format demands; files with a feature on each line (``.geojsonl``, ``.geojsons``, ``.ndjson``,
``.jsonl``) are split like any text. Point, line and polygon geometries and their Multi forms become
``functions.geometry`` structs without Z; other kinds and broken ones become null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import geometry as G
from wayfold.operators.ordering import running
from wayfold.session import Scratch

BY_LINE = (".geojsonl", ".geojsons", ".ndjson", ".jsonl")
FEATURE = "type string, properties variant, geometry struct<type:string,coordinates:variant>"
TYPES = {"BIGINT": "bigint", "TINYINT": "bigint", "SMALLINT": "bigint", "INT": "bigint", "DOUBLE": "double", "FLOAT": "double", "BOOLEAN": "boolean"}
#: The system of a file that names none (fixed by the format).
DEFAULT_CRS = "EPSG:4326"


def _xy(p: str) -> str:
    return f"named_struct('x', {p}[0], 'y', {p}[1])"


#: How each kind's coordinates are read, and how they become parts.
KINDS = {
    "Point": ("array<double>", f"array(array({_xy('c')}))"),
    "MultiPoint": ("array<array<double>>", f"transform(c, p -> array({_xy('p')}))"),
    "LineString": ("array<array<double>>", f"array(transform(c, p -> {_xy('p')}))"),
    "MultiLineString": ("array<array<array<double>>>", f"transform(c, l -> transform(l, p -> {_xy('p')}))"),
    "Polygon": ("array<array<array<double>>>", f"transform(c, l -> transform(l, p -> {_xy('p')}))"),
    "MultiPolygon": ("array<array<array<array<double>>>>", f"flatten(transform(c, g -> transform(g, l -> transform(l, p -> {_xy('p')}))))"),
}


def _geometry() -> F.Column:
    """The struct of a feature's geometry: kind by kind, as the coordinates' nesting differs."""
    parts = "CASE "
    for kind, (shape, made) in KINDS.items():
        read = f"try_variant_get(geometry.coordinates, '$', '{shape}')"
        parts += f"WHEN geometry.type = '{kind}' THEN element_at(transform(array({read}), c -> {made}), 1) "
    return F.expr(f"CASE WHEN size({parts}END) > 0 THEN named_struct('type', geometry.type, 'parts', {parts}END) END").cast(G.GEOMETRY)


def crs_name(stated: str | None) -> str:
    """``EPSG:26986`` of a name such as ``urn:ogc:def:crs:EPSG::26986``; what is no such name stays."""
    if not stated:
        return DEFAULT_CRS
    parts = [p for p in stated.split(":") if p]
    if "CRS84" in parts[-1]:
        return DEFAULT_CRS
    return f"{parts[-2]}:{parts[-1]}" if len(parts) > 2 and parts[-1].isdigit() else stated


def _columns(features: DataFrame, taken: set[str]) -> list[F.Column]:
    """A column for each property: numbers and booleans as such where all values are, else text.

    One that is called like another, but for case, or like a column of the layer, gets a number.
    """
    each = features.where("properties is not null").lateralJoin(features.sparkSession.tvf.variant_explode(F.col("properties").outer()))
    found = each.groupBy("key").agg(F.min("pos").alias("pos"), F.schema_of_variant_agg("value").alias("kind")).where("key is not null").orderBy("pos", "key").collect()
    out = []
    for r in found:  # property names: bounded by the format of the files
        name, n = r["key"], 1
        while name.lower() in taken:
            n += 1
            name = f"{r['key']}_{n}"
        taken.add(name.lower())
        kind = "double" if r["kind"].startswith("DECIMAL") else TYPES.get(r["kind"], "string")
        path = f"$['{r['key']}']" if '"' in r["key"] else f'$["{r["key"]}"]'
        out.append(F.try_variant_get(F.col("properties"), path, kind).alias(name))
    return out


def read(spark: SparkSession, path: str, scratch: Scratch | None = None) -> tuple[DataFrame, str]:
    """(id, geometry, a column for each property) in file order, and the name of the coordinate system."""
    scratch = scratch or Scratch(spark)
    if path.lower().endswith(BY_LINE):
        rows = spark.read.schema(FEATURE).json(path).select("properties", "geometry", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
        rows = rows.where("properties is not null or geometry is not null")
        rows = running(rows.select("_file", "_block", "_line", "properties", "geometry"), ["_file", "_block", "_line"], F.lit(1), "id", scratch)
        stated = None
    else:
        whole = spark.read.schema(f"{FEATURE}, crs variant, features array<struct<type:string,properties:variant,geometry:struct<type:string,coordinates:variant>>>").option("multiLine", True).json(path)
        stated = whole.select(F.try_variant_get("crs", "$.properties.name", "string").alias("crs")).where("crs is not null").limit(1).collect()
        stated = stated[0]["crs"] if stated else None
        single = F.when(F.col("type") == "Feature", F.array(F.struct("type", "properties", "geometry")))
        rows = whole.select(F.posexplode(F.coalesce("features", single)).alias("id", "f")).select(F.col("id").cast("long").alias("id"), "f.properties", "f.geometry")
    rows = scratch.keep(rows.select("id", "properties", "geometry"))
    columns = _columns(rows, {"id", "geometry"})
    return scratch.keep(rows.select("id", _geometry().alias("geometry"), *columns)), crs_name(stated)


def prepare(layer: DataFrame) -> DataFrame:
    """Polygons become their boundaries; if all rows are then multi-lines, their first lines stand for them."""
    kind, parts = F.col("geometry.type"), F.col("geometry.parts")
    outline = F.when(F.size(parts) == 1, "LineString").otherwise("MultiLineString")
    layer = layer.withColumn("geometry", F.when(kind == "Polygon", G.geometry(outline, parts)).otherwise(F.col("geometry")))
    if layer.agg(F.bool_and(kind.eqNullSafe(F.lit("MultiLineString")))).first()[0]:
        layer = layer.withColumn("geometry", G.geometry("LineString", F.slice(parts, 1, 1)))
    return layer
