"""Batch runs over a pairing table: flow simulation and K-nearest accessibility.

Layers are read once and networks are built anew only where a row needs other streets or costs; a row
whose streets come from another file reads that file.
"""

from __future__ import annotations

import platform
import time
from datetime import datetime

import pyspark
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold import tools
from wayfold.functions import geometry as G
from wayfold.functions import styling
from wayfold.operators.access import normalised
from wayfold.sinks import files, htmlmap
from wayfold.sources import pairings
from wayfold.workspace import Workspace

#: End points this close are one node (fixed by the workflows).
SNAP = 0.00001
STREETS = "streets"


class Logger:
    """What a run did, with the seconds since the event before and since the start."""

    def __init__(self, spark: SparkSession, output_folder: str, runs: int):
        self.spark, self.output_folder, self.runs = spark, output_folder.rstrip("/"), runs
        self.start = time.monotonic()
        self.rows: list[tuple[datetime, str | None, str, float]] = []
        self.log(f"started: Spark {pyspark.__version__}, Python {platform.python_version()}")

    def log(self, event: str, pairing=None) -> None:
        seconds = time.monotonic() - self.start if self.rows else 0.0
        before = self.rows[-1][3] if self.rows else 0.0
        name = pairing["Flow_Name"] if pairing is not None else None
        if not self.rows:
            print(f"{'total time':^10s} | {'elapsed':^10s} | {'flow':^40s} | event")
        self.rows.append((datetime.now(), name, event, seconds))
        shown = f"({pairing['number'] + 1}/{self.runs}) {name}" if pairing is not None else "---"
        print(f"{seconds:10.4f} | {seconds - before:10.6f} | {shown:^40s} | {event}")

    def table(self) -> DataFrame:
        """(time, flow_name, event, seconds_elapsed, cumulative_seconds), elapsed being what each event adds."""
        rows = [(n, *r) for n, r in enumerate(self.rows)]
        log = self.spark.createDataFrame(rows, "n int, time timestamp, flow_name string, event string, cumulative_seconds double")
        gap = F.col("cumulative_seconds") - F.coalesce(F.lag("cumulative_seconds").over(Window.orderBy("n")), F.lit(0.0))
        return log.withColumn("seconds_elapsed", gap).orderBy("n").select("time", "flow_name", "event", "seconds_elapsed", "cumulative_seconds")

    def folder(self, pairing) -> str:
        return f"{self.output_folder}/{pairing['Flow_Name']}_O({pairing['Origin_Name']})_D({pairing['Destination_Name']})"

    def pairing_end(self, workspace: Workspace, pairing, flows: tools.Flows, save_flow_map: bool = True, save_flow_geojson: bool = True, save_flow_csv: bool = False, save_origin_geojson: bool = True, save_origin_csv: bool = False, save_diagnostics_map: bool = False) -> None:
        """Write what one row of the table found to a folder of its own."""
        folder, streets, home = self.folder(pairing), workspace[STREETS], workspace[pairing["Origin_Name"]]
        network = workspace.network
        lines = network.edges.select("edge_id", "coords").join(flows.edges, "edge_id").select("edge_id", "betweenness", G.geometry("LineString", F.array("coords")).alias("geometry"))
        if save_flow_map:
            for name, dark in (("flow_map_dark.html", True), ("flow_map_light.html", False)):
                drawn = htmlmap.flow_map(lines, "betweenness", streets.crs, workspace.scratch, dark=dark)
                htmlmap.write_map([drawn], f"{folder}/{name}", workspace.scratch, workspace.geo_center, dark=dark)
        if save_diagnostics_map:
            htmlmap.write_map(diagnostics_map(workspace, pairing, lines), f"{folder}/flow_map.html", workspace.scratch, workspace.geo_center)
        if save_flow_geojson:
            files.write_geojson(streets.df, f"{folder}/betweenness_record_so_far.geoJSON", streets.crs)
        if save_flow_csv:
            files.write_csv(streets.df, f"{folder}/betweenness_record_so_far.csv")
        record = f"{folder}/origin_record_({pairing['Origin_Name']})"
        if save_origin_geojson:
            files.write_geojson(home.df, f"{record}.geoJSON", home.crs)
        if save_origin_csv:
            files.write_csv(home.df, f"{record}.csv")
        files.write_csv(self.table(), f"{folder}/time_log.csv")
        self.log("output saved", pairing)

    def simulation_end(self, workspace: Workspace) -> None:
        streets = workspace[STREETS]
        files.write_geojson(streets.df, f"{self.output_folder}/betweenness_record.geoJSON", streets.crs)
        files.write_csv(streets.df, f"{self.output_folder}/betweenness_record.csv")
        self.log("all output saved")
        files.write_csv(self.table(), f"{self.output_folder}/time_log.csv")


def connectors(workspace: Workspace, role: str, layer: str) -> DataFrame:
    """(id, geometry): the line from each feature's middle to its place on the network; null for one that has none."""
    placed = workspace._network().features(role).where(F.col("source_layer") == layer).select(F.col("source_id").alias("_source"), "at")
    joined = workspace[layer].df.select("id", G.centroid(F.col("geometry")).alias("_from")).join(placed, F.col("id") == F.col("_source"), "left")
    line = F.when(F.col("at").isNotNull() & F.col("_from").isNotNull(), G.geometry("LineString", F.array(F.array("_from", "at"))))
    return joined.select("id", line.alias("geometry"))


def diagnostics_map(workspace: Workspace, pairing, lines: DataFrame) -> list[htmlmap.Styled]:
    """Streets, flows by rank, features, their places and the lines between."""
    crs = workspace[STREETS].crs
    wide = styling.diagnostics_width(lines, F.col("betweenness"), "width").where("betweenness > 0")
    drawn = [htmlmap.Styled(workspace[STREETS].df, crs, color=[0, 255, 255], opacity=0.1), htmlmap.Styled(wide, crs, color_by_attribute="betweenness", color_method="quantile", opacity=0.5, width="width", text="betweenness")]
    for role, color in (("origin", [100, 0, 255]), ("destination", [255, 0, 100])):
        layer = pairing[f"{role.title()}_Name"]
        nodes = workspace._network().nodes.where(F.col("type") == role)
        drawn += [htmlmap.Styled(nodes, crs, color=color, opacity=0.5), htmlmap.Styled(connectors(workspace, role, layer), crs, color=color), htmlmap.Styled(workspace[layer].df, crs, color=color)]
    return drawn


def _rows(spark: SparkSession, path: str, needed: tuple[str, ...]) -> list[dict]:
    """The runs in order; there is one row for each of them."""
    table = pairings.changes(pairings.read(spark, path, needed))
    rows = [r.asDict() for r in table.orderBy("row").collect()]
    if not rows:
        raise ValueError(f"{path} holds no runs")
    return [{**r, "number": n} for n, r in enumerate(rows)]


def _paths(city_name: str | None, data_folder: str | None, output_folder: str | None) -> tuple[str, str]:
    """Where data and output are, by a city's name where no folder is given."""
    if data_folder is None:
        if city_name is None:
            raise ValueError("city_name or data_folder must be given")
        data_folder = f"Cities/{city_name}/Data"
    if output_folder is None:
        stamp = datetime.now().strftime("%Y-%m-%d %H-%M")
        output_folder = f"Cities/{city_name}/Simulations/{stamp}" if city_name is not None else f"{data_folder.rstrip('/')}/Simulations/{stamp}"
    return data_folder.rstrip("/"), output_folder.rstrip("/")


def _attribute(value: str | None, plain: str) -> str | None:
    return None if value is None or value == plain else value


def _ready(workspace: Workspace, row: dict, folder: str, logger: Logger) -> None:
    """Streets, network, layers and features of one row."""
    if row["new_streets"]:
        if STREETS in workspace.layers:
            kept = workspace.layers
            workspace.layers = type(kept)()
            for name in kept:
                if name != STREETS:
                    workspace.layers.add(kept[name])
        workspace.load_layer(STREETS, f"{folder}/{row['Network_File']}", first=True)
        logger.log(f"streets read, projection {workspace[STREETS].crs}", row)
    if row["new_network"]:
        workspace.create_street_network(STREETS, _attribute(row["Network_Cost"], "Geometric"), SNAP, "discard")
        logger.log("network made", row)
    else:
        workspace.clear_nodes()
    workspace.set_turn_parameters(row["Turn_Threshold"] or 0, row["Turn_Penalty"] or 0)
    for role in ("Origin", "Destination"):
        name = row[f"{role}_Name"]
        if name not in workspace.layers:
            workspace.load_layer(name, f"{folder}/{row[f'{role}_File']}")
            logger.log(f"{name} read, projection {workspace[name].crs}", row)
    for role in ("Origin", "Destination"):
        workspace.insert_node(row[f"{role}_Name"], role.lower(), _attribute(row[f"{role}_Weight"], "Count"))
    logger.log("origins and destinations inserted", row)
    workspace.create_graph()


def betweenness_flow_simulation(spark: SparkSession, city_name: str | None = None, data_folder: str | None = None, output_folder: str | None = None, pairings_file: str = "pairings.csv", num_cores: int = 8) -> Workspace:
    """Betweenness for every row of a pairing table; outputs go to a folder per row, and to one of the whole run."""
    folder, output = _paths(city_name, data_folder, output_folder)
    rows = _rows(spark, f"{folder}/{pairings_file}", pairings.COMMON + pairings.FLOW)
    logger, workspace = Logger(spark, output, len(rows)), Workspace(spark)
    for row in rows:
        _ready(workspace, row, folder, logger)
        name, elastic, exposure = row["Flow_Name"], bool(row["Elastic_Weights"]), row.get("Exposure_Attribute")
        flows = tools.betweenness(
            workspace, search_radius=row["Radius"], detour_ratio=row["Detour"], decay=bool(row["Decay"]) and not elastic, decay_method=row["Decay_Mode"] or "exponent", beta=row["Beta"],
            num_cores=num_cores, closest_destination=bool(row["Closest_destination"]), elastic_weight=elastic, knn_weight=row["KNN_Weight"], knn_plateau=row["Plateau"] or 0, turn_penalty=bool(row["Turns"]),
            save_betweenness_as=name, save_reach_as=f"reach_{name}", save_gravity_as=f"gravity_{name}", save_elastic_weight_as=f"elastic_weight_{name}" if elastic else None, keep_diagnostics=True,
            path_exposure_attribute=exposure, save_path_exposure_as=f"exposure_{name}" if exposure else None,
        )
        logger.log("betweenness estimated", row)
        logger.pairing_end(workspace, row, flows)
    logger.simulation_end(workspace)
    return workspace


def totals(origins: DataFrame, names: list[str]) -> DataFrame:
    """``total_knn_access``, the sum over ``names``, and ``normalized_knn_access``, its share between least and most."""
    total = sum((F.coalesce(F.col(f"`{n}`"), F.lit(0.0)) for n in names), F.lit(0.0))
    return normalised(origins.withColumn("total_knn_access", total), F.col("total_knn_access"), "normalized_knn_access")


def KNN_accessibility(spark: SparkSession, city_name: str | None = None, data_folder: str | None = None, output_folder: str | None = None, pairings_file: str = "pairing.csv", num_cores: int = 8) -> Workspace:  # noqa: N802 - a name users know
    """Accessibility for every row of a pairing table, and the total of its K-nearest accesses for the last row's origins."""
    folder, output = _paths(city_name, data_folder, output_folder)
    rows = _rows(spark, f"{folder}/{pairings_file}", pairings.COMMON)
    logger, workspace = Logger(spark, output, len(rows)), Workspace(spark)
    for row in rows:
        _ready(workspace, row, folder, logger)
        name = row["Flow_Name"]
        tools.accessibility(
            workspace, search_radius=row["Radius"], beta=row["Beta"], save_reach_as=f"{name}_reach", save_gravity_as=f"{name}_gravity", knn_weights=row["KNN_Weight"], knn_plateau=row["Plateau"],
            save_knn_access_as=f"{name}_knn_access", turn_penalty=bool(row["Turns"]), num_cores=num_cores,
        )
        files.write_csv(workspace[row["Origin_Name"]].df, f"{output}/origin_record.csv")
        logger.log("accessibility calculated", row)
    layer = workspace[rows[-1]["Origin_Name"]]
    mine = [f"{r['Flow_Name']}_knn_access" for r in rows if r["Origin_Name"] == layer.label]
    layer.df = workspace.scratch.keep(totals(layer.df, mine))
    files.write_geojson(layer.df, f"{output}/origin_record.geoJSON", layer.crs)
    files.write_csv(layer.df, f"{output}/origin_record.csv")
    logger.log("all output saved")
    files.write_csv(logger.table(), f"{output}/time_log.csv")
    return workspace
