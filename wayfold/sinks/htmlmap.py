"""Maps as a web page beside its data: styled layers are written by the executors, the page only names them."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions import geometry as G
from wayfold.functions import styling
from wayfold.session import Scratch
from wayfold.sinks.files import _fs, write_geojson

#: The library that draws, from its public place.
SCRIPT = "https://unpkg.com/deck.gl@8.9.36/dist.min.js"
PAGE = """<!DOCTYPE html>
<html><head><meta charset="utf-8"><title>{title}</title><script src="{script}"></script>
<style>body{{margin:0;background:{background}}}#map{{position:absolute;width:100%;height:100%}}</style></head>
<body><div id="map"></div><script>var data=[];</script>
{sources}
<script>
var styles={styles};
var drawn=[];
styles.forEach(function(s,i){{
  drawn.push(new deck.GeoJsonLayer({{id:'layer'+i,data:data[i],opacity:s.opacity,stroked:true,filled:true,pickable:true,
    getLineWidth:function(f){{return f.properties.__width__||1}},getPointRadius:function(f){{return f.properties.__radius__||1}},
    getLineColor:function(f){{return f.properties.color||[150,150,150]}},getFillColor:function(f){{return f.properties.color||[150,150,150]}}}}));
  if(s.text)drawn.push(new deck.TextLayer({{id:'text'+i,data:data[i].features,getPosition:function(f){{return f.properties.__label_at__}},
    getText:function(f){{return f.properties.__text__||''}},getSize:s.textSize,sizeUnits:s.textUnits,getColor:function(f){{return f.properties.color}},
    background:true,getBackgroundColor:s.textBackground,getTextAnchor:'middle',getAlignmentBaseline:'center'}}));
}});
var base={basemap}?[new deck.TileLayer({{id:'base',data:'https://tile.openstreetmap.org/{{z}}/{{x}}/{{y}}.png',tileSize:256,
  renderSubLayers:function(p){{var b=p.tile.bbox;return new deck.BitmapLayer(p,{{data:null,image:p.data,bounds:[b.west,b.south,b.east,b.north]}})}}}})]:[];
new deck.DeckGL({{container:'map',initialViewState:{view},controller:true,layers:base.concat(drawn)}});
</script></body></html>
"""


@dataclass
class Styled:
    """A layer of a map: features (geometry, attributes) and how they are drawn."""

    df: DataFrame
    crs: str = "EPSG:4326"
    color: object = None
    color_by_attribute: str | None = None
    color_method: str | None = None
    radius: str | None = None
    radius_min: float = 5
    radius_max: float = 10
    width: str | None = None
    width_scale: float = 1
    opacity: float = 1
    text: str | None = None


def to_degrees(df: DataFrame, crs: str) -> DataFrame:
    """Geometries in longitude and latitude. Layers of other planar systems are drawn where their numbers put them."""
    if crs not in ("EPSG:3857", "EPSG:900913"):
        return df
    parts = F.transform("geometry.parts", lambda part: F.transform(part, G.mercator_to_degrees))
    return df.withColumn("geometry", F.when(F.col("geometry").isNotNull(), G.geometry(F.col("geometry.type"), parts)))


def styled(s: Styled, scratch: Scratch) -> DataFrame:
    """The columns that the page draws by: color, __radius__, __width__, __text__ and __label_at__, where they are asked for."""
    df = to_degrees(s.df, s.crs)
    if s.radius is not None:
        df = styling.radius(df.where(styling.present(F.col(s.radius))), F.col(s.radius), "__radius__", s.radius_min, s.radius_max)
    if s.width is not None:
        df = df.withColumn("__width__", F.col(s.width) * float(s.width_scale))
    if s.color is not None or s.color_by_attribute is not None or s.color_method is not None:
        df = styling.color(df, scratch, s.color_by_attribute, s.color_method, s.color)
    if s.text is not None:
        at = G.centroid(F.col("geometry"))
        df = df.withColumn("__text__", styling.label(F.col(s.text), dict(df.dtypes)[s.text])).withColumn("__label_at__", F.array(at["x"], at["y"]))
    return df


def flow_map(edges: DataFrame, flow: str, crs: str, scratch: Scratch, most: float | None = None, dark: bool = True) -> Styled:
    """Streets as wide as their flow, labelled with it; streets without one are left out."""
    rows = styling.flow_width(edges.where(styling.present(F.col(flow))), F.col(flow), "_flow_width", most)
    rows = rows.withColumn("_flow_text", styling.thousands(F.col(flow)))
    return Styled(rows, crs, color=[249, 245, 10] if dark else [255, 105, 180], width="_flow_width", opacity=0.99, text="_flow_text")


def write_map(layers: list[Styled], path: str, scratch: Scratch, center: tuple[float, float] | None = None, basemap: bool = False, zoom: int = 17, dark: bool = True) -> None:
    """``path`` and, in the folder ``<path>_data`` beside it, a script with the features of each layer."""
    if not layers:
        raise ValueError("a map needs a layer")
    folder = path + "_data"
    name = folder.rpartition("/")[2]
    sources, styles, fs = [], [], None
    for i, s in enumerate(layers):
        write_geojson(styled(s, scratch), f"{folder}/layer{i}.js", before=f"data[{i}]=", after=";")
        sources.append(f'<script src="{name}/layer{i}.js"></script>')
        styles.append({"opacity": s.opacity, "text": s.text is not None, "textSize": 16, "textUnits": "pixels", "textBackground": [0, 0, 0, 125] if dark else [255, 255, 255, 125]})
    if center is None:
        center = middle(layers[0].df, layers[0].crs)
    view = {"longitude": center[0], "latitude": center[1], "zoom": zoom, "maxZoom": 20, "pitch": 0, "bearing": 0}
    page = PAGE.format(title="map", script=SCRIPT, background="#000" if dark else "#fff", sources="\n".join(sources), styles=json.dumps(styles), basemap=json.dumps(basemap), view=json.dumps(view))
    fs, at = _fs(layers[0].df, path)
    out = fs.create(at(path), True)
    out.write(bytearray(page.encode()))
    out.close()


def middle(df: DataFrame, crs: str) -> tuple[float, float]:
    """The middle of a layer in degrees: of its points, or of its lines by length."""
    legs = to_degrees(df.select("geometry"), crs).select(F.explode(G.segments(F.col("geometry"))).alias("leg"))
    a, b, size = F.col("leg.a"), F.col("leg.b"), F.col("leg.size")
    x, y = (a["x"] + b["x"]) / 2, (a["y"] + b["y"]) / 2
    r = legs.agg(F.sum(size).alias("n"), F.sum(size * x).alias("x"), F.sum(size * y).alias("y"), F.avg(x).alias("px"), F.avg(y).alias("py")).first()
    if r["px"] is None:
        return (0.0, 0.0)
    return (r["x"] / r["n"], r["y"] / r["n"]) if r["n"] else (r["px"], r["py"])
