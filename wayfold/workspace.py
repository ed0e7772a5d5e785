"""The workspace: layers, a street network made from one of them, and features set on it.

A facade over immutable DataFrames; every method that changes something replaces a DataFrame.
"""

from __future__ import annotations

import random
from copy import copy
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import geometry as G
from wayfold.functions import styling
from wayfold.layers import Layer, Layers
from wayfold.operators import network as N
from wayfold.operators import search, topology
from wayfold.operators.ordering import running
from wayfold.session import Scratch, prepare
from wayfold.sinks import htmlmap
from wayfold.sources import geojson

ROLES = ("origin", "destination")


def need(value, kinds: tuple[type, ...] | type, name: str) -> None:
    """A TypeError unless ``value`` is of one of the kinds; a boolean is no number."""
    kinds = kinds if isinstance(kinds, tuple) else (kinds,)
    if isinstance(value, bool) and bool not in kinds or not isinstance(value, kinds):
        raise TypeError(f"{name} must be {' or '.join(k.__name__ for k in kinds)}, not {type(value).__name__}")


def need_number(value, name: str, least: float | None = None, most: float | None = None) -> None:
    need(value, (int, float), name)
    if value != value or least is not None and value < least or most is not None and value > most:
        raise ValueError(f"{name} must lie between {least} and {most}, not at {value}")


class Network:
    """Street nodes (node_id, x, y, degree), edges, and the features set on these.

    Edges are (edge_id, parent_id, s, e, w, len, coords), with ``snapped`` and ``snapping_distance`` where ends were
    moved, and ``used``: whether routes take the edge.
    """

    def __init__(self, street_nodes: DataFrame, edges: DataFrame, source_layer: str, weight_attribute: str | None, scratch: Scratch):
        self.street_nodes, self.edges, self.source_layer, self.weight_attribute, self.scratch = street_nodes, edges, source_layer, weight_attribute, scratch
        self.turn_threshold_degree, self.turn_penalty_amount = 45.0, 30.0
        self.inserted: list[tuple[str, str, DataFrame]] = []  # role, layer, features
        self.next_id = (street_nodes.agg(F.max("node_id")).first()[0] or -1) + 1
        self.streets: search.Streets | None = None  # the graph, once it is asked for
        self.changed: list[tuple[int, str, object]] = []

    @property
    def turns(self) -> search.Turns:
        return search.Turns(float(self.turn_threshold_degree), float(self.turn_penalty_amount))

    def features(self, role: str) -> DataFrame:
        """(id, source_id, source_layer, edge_id, s, e, w_s, w_e, wt, at) of one role."""
        mine = [df for r, _, df in self.inserted if r == role]
        out = mine[0]
        for df in mine[1:]:
            out = out.unionByName(df)
        return out

    def layer_of(self, role: str) -> str | None:
        return next((name for r, name, _ in self.inserted if r == role), None)

    @property
    def nodes(self) -> DataFrame:
        """Street nodes and inserted features as one table."""
        zero = F.lit(0).cast("long")
        streets = self.street_nodes.select(
            F.col("node_id").alias("id"), F.lit(self.source_layer).alias("source_layer"), zero.alias("source_id"), F.lit("street_node").alias("type"), F.lit(0.0).alias("weight"),
            "degree", zero.alias("nearest_edge_id"), zero.alias("edge_start_node"), zero.alias("edge_end_node"), F.lit(0.0).alias("weight_to_start"), F.lit(0.0).alias("weight_to_end"),
            G.geometry("Point", F.array(F.array(G.point(F.col("x"), F.col("y"))))).alias("geometry"),
        )
        out = streets
        for role in dict.fromkeys(r for r, _, _ in self.inserted):
            more = self.features(role).select(
                "id", "source_layer", "source_id", F.lit(role).alias("type"), F.col("wt").alias("weight"), F.lit(0).alias("degree"), F.col("edge_id").alias("nearest_edge_id"),
                F.col("s").alias("edge_start_node"), F.col("e").alias("edge_end_node"), F.col("w_s").alias("weight_to_start"), F.col("w_e").alias("weight_to_end"),
                G.geometry("Point", F.array(F.array("at"))).alias("geometry"),
            )
            out = out.unionByName(more)
        for node, column, value in self.changed:
            old = F.col(column) if column in out.columns else F.lit(None)
            out = out.withColumn(column, F.when(F.col("id") == node, F.lit(value)).otherwise(old))
        return out

    def set_node_value(self, idx: int, label: str, value) -> None:
        """Set one value of one node; columns that are not there yet are null elsewhere."""
        self.changed.append((idx, label, value))

    def layer_tables(self) -> dict[str, DataFrame]:
        """Nodes and edges as tables for layers."""
        edges = self.edges.select(
            F.col("edge_id").alias("id"), F.col("len").alias("length"), F.col("w").alias("weight"), F.col("parent_id").alias("parent_street_id"), F.col("s").alias("start"), F.col("e").alias("end"),
            *[c for c in ("snapped", "snapping_distance") if c in self.edges.columns], G.geometry("LineString", F.array("coords")).alias("geometry"),
        )
        return {"nodes": self.nodes, "edges": edges}


class Workspace:
    """Layers and a network to analyse; see ``tools`` for what is asked of them."""

    def __init__(self, spark: SparkSession, seed: int = 7):
        self.spark = prepare(spark)
        self.scratch = Scratch(spark)
        self.layers = Layers()
        self.network: Network | None = None
        self.geo_center: tuple[float, float] | None = None
        self._rng = random.Random(seed)

    def __getitem__(self, name: str | int) -> Layer:
        return self.layers[name]

    def copy(self) -> Workspace:
        """A workspace of the same layers and network; results saved in one are not seen in the other."""
        out = copy(self)
        out.layers = Layers()
        for name in self.layers:
            out.layers.add(replace(self.layers[name]))
        return out

    def load_layer(self, name: str, source: str | DataFrame, pos: int | None = None, first: bool = False, before: str | None = None, after: str | None = None, crs: str | None = None) -> Layer:
        """Add a layer from a GeoJSON file, a Parquet table or a DataFrame.

        Tables need a ``geometry`` column as ``functions.geometry`` describes it. ``id`` is a feature's number in
        file order; a table's own ``id`` stays, else rows are numbered. The first layer sets the map's middle.
        """
        need(name, str, "name")
        if isinstance(source, str) and not source.lower().rstrip("/").endswith(".parquet"):
            df, stated = geojson.read(self.spark, source, self.scratch)
        else:
            df, stated = (source if isinstance(source, DataFrame) else self.spark.read.parquet(source)), geojson.DEFAULT_CRS
            if "geometry" not in df.columns:
                raise ValueError("a layer needs a column named geometry")
            if "id" not in df.columns:
                df = running(df.withColumn("_line", F.monotonically_increasing_id()), ["_line"], F.lit(1), "id", self.scratch).drop("_line")
            df = self.scratch.keep(df.withColumn("geometry", F.col("geometry").cast(G.GEOMETRY)))
        layer = Layer(name, geojson.prepare(df), crs or stated, source if isinstance(source, str) else "DataFrame", True, styling.random_color(self._rng))
        self.layers.add(layer, pos, first, before, after)
        if self.geo_center is None:
            self.geo_center = htmlmap.middle(layer.df, layer.crs)
        return layer

    def create_street_network(self, source_layer: str, weight_attribute: str | None = None, node_snapping_tolerance: float = 0, redundant_edge_treatment: str = "discard", turn_threshold_degree: float = 45, turn_penalty_amount: float = 30) -> Network:
        """Make the network of a layer of lines; features set on an earlier one go."""
        need(source_layer, str, "source_layer")
        if source_layer not in self.layers:
            raise ValueError(f"no layer {source_layer!r}; there are {self.layers}")
        df = self[source_layer].df
        if weight_attribute is not None:
            need(weight_attribute, str, "weight_attribute")
            if weight_attribute not in df.columns:
                raise ValueError(f"layer {source_layer} has no column {weight_attribute!r}")
        need_number(node_snapping_tolerance, "node_snapping_tolerance", 0)
        need(redundant_edge_treatment, str, "redundant_edge_treatment")
        if redundant_edge_treatment not in ("keep", "discard", "split"):
            raise ValueError("redundant_edge_treatment must be keep, discard or split")
        self._check_turns(turn_threshold_degree, turn_penalty_amount)
        lines = df.where("geometry.type = 'LineString'").withColumn("_coords", G.line(F.col("geometry"))).withColumn("_len", G.length(F.col("_coords")))
        attribute = None if weight_attribute is None else F.col(f"`{weight_attribute}`").cast("double")
        streets = self.scratch.keep(lines.select(F.col("id").alias("street_id"), F.col("_coords").alias("coords"), N.street_cost(F.col("_len"), attribute).alias("w"), F.col("_len").alias("len")))
        if node_snapping_tolerance:
            nodes, edges = topology.within(streets, node_snapping_tolerance, self.scratch)
        else:
            nodes, edges = topology.exact(streets, self.scratch)
        if redundant_edge_treatment == "split":
            nodes, edges = topology.split(nodes, edges, self.scratch)
        elif redundant_edge_treatment == "discard":
            edges = N.discard_redundant(edges)
        else:
            edges = N.keep_redundant(edges)
        if "edge_id" not in edges.columns:
            edges = edges.withColumn("edge_id", F.col("street_id")).withColumnRenamed("street_id", "parent_id")
        self.network = Network(nodes, self.scratch.keep(edges), source_layer, weight_attribute, self.scratch)
        self.set_turn_parameters(turn_threshold_degree, turn_penalty_amount)
        return self.network

    @staticmethod
    def _check_turns(threshold: float, amount: float) -> None:
        need_number(threshold, "turn_threshold_degree", 0, 180)
        need_number(amount, "turn_penalty_amount", 0)

    def set_turn_parameters(self, turn_threshold_degree: float = 45, turn_penalty_amount: float = 30) -> None:
        self._check_turns(turn_threshold_degree, turn_penalty_amount)
        network = self._network()
        network.turn_threshold_degree, network.turn_penalty_amount = turn_threshold_degree, turn_penalty_amount

    def _network(self) -> Network:
        if self.network is None:
            raise ValueError("there is no network yet: call create_street_network first")
        return self.network

    def insert_node(self, layer_name: str, label: str, weight_attribute: str | None = None) -> None:
        """Set a layer's features on the network as origins or destinations, weighing 1 or what an attribute says."""
        need(layer_name, str, "layer_name")
        if layer_name not in self.layers:
            raise ValueError(f"no layer {layer_name!r}; there are {self.layers}")
        need(label, str, "label")
        if label not in ROLES:
            raise ValueError("label must be origin or destination")
        df = self[layer_name].df
        if weight_attribute is not None:
            need(weight_attribute, str, "weight_attribute")
            if weight_attribute not in df.columns:
                raise ValueError(f"layer {layer_name} has no column {weight_attribute!r}")
        network = self._network()
        weight = None if weight_attribute is None else F.col(f"`{weight_attribute}`")
        placed = topology.insert(df, network.edges, self.scratch, weight)
        numbered = running(placed, ["source_id"], F.lit(1), "id", self.scratch).withColumn("id", F.col("id") + network.next_id).withColumn("source_layer", F.lit(layer_name))
        numbered = self.scratch.keep(numbered.select("id", "source_id", "source_layer", "edge_id", "s", "e", "w_s", "w_e", "wt", "at"))
        network.next_id += numbered.count()
        network.inserted.append((label, layer_name, numbered))

    def create_graph(self, light_graph: bool = True, d_graph: bool = True, od_graph: bool = True) -> None:
        """Make the street graph. Features are never built into it, so one graph serves all three purposes."""
        for name, value in (("light_graph", light_graph), ("d_graph", d_graph), ("od_graph", od_graph)):
            need(value, bool, name)
        network = self._network()
        if network.streets is None:
            columns = ["edge_id", "s", "e", "w", "len", *(["used"] if "used" in network.edges.columns else [])]
            nodes = network.street_nodes.select(F.col("node_id").alias("node"), "x", "y")
            network.streets = search.Streets(network.edges.select(*columns), nodes, self.scratch)

    def clear_nodes(self) -> None:
        """Take all features off the network; its nodes and edges stay."""
        network = self._network()
        network.inserted, network.changed = [], []
        network.next_id = (network.street_nodes.agg(F.max("node_id")).first()[0] or -1) + 1

    def network_to_layer(self) -> None:
        """Add the network's nodes and edges as layers, in place of earlier ones."""
        crs = self[self._network().source_layer].crs
        for part, df in self._network().layer_tables().items():
            name = f"network_{part}"
            self.layers[name] = Layer(name, df, crs, None, True, styling.random_color(self._rng))

    def describe(self) -> str:
        """Layers from bottom to top with projection and number of rows, and what is still to do."""
        lines = [f"{'layer':20} | {'visible':7} | {'projection':12} | {'rows':>10} | source"]
        lines += [f"{name:20} | {self[name].show!s:7} | {self[name].crs:12} | {self[name].df.count():10} | {self[name].source}" for name in self.layers]
        if not len(self.layers):
            lines = ["no layers yet: call load_layer"]
        lines.append(f"middle: {self.geo_center}" if self.geo_center else "no middle yet: it comes with the first layer")
        if self.network is None:
            lines.append("no network yet: call create_street_network, insert_node for origins and destinations, then create_graph")
        out = "\n".join(lines)
        print(out)
        return out

    def create_map(self, layer_list: list[dict] | None = None, save_as: str | None = None, basemap: bool = False) -> list[htmlmap.Styled]:
        """A map of the visible layers, or of styled ones: dicts with ``layer`` (a name) or ``df``, and the fields of ``htmlmap.Styled``."""
        if layer_list is None:
            layer_list = [{"layer": name} for name in self.layers if self[name].show]
        drawn = []
        for given in layer_list:
            given = dict(given)
            if "layer" in given:
                layer = self[given.pop("layer")]
                given = {"df": layer.df, "crs": layer.crs, **({} if "color_by_attribute" in given or "color_method" in given else {"color": layer.default_color}), **given}
            drawn.append(htmlmap.Styled(**given))
        if save_as is not None:
            htmlmap.write_map(drawn, save_as, self.scratch, self.geo_center, basemap)
        return drawn
