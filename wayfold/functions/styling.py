"""Colours, sizes, widths and labels of map features from their values."""

from __future__ import annotations

import random
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.operators.ordering import running
from wayfold.session import Scratch

WHITE = [255, 255, 255]
OTHER = "__other__"
#: Colours of the usual layers and of a network's parts (fixed values).
DEFAULT_COLORS = {
    "streets": [150, 150, 150],
    "blocks": [100, 100, 100],
    "parcels": [50, 50, 50],
    "network_edges": {"__attribute_name__": "type", "street": [155, 155, 155], "project_line": [0, 0, 150], OTHER: [0, 0, 0]},
    "network_nodes": {"__attribute_name__": "type", "street_node": [0, 255, 255], "project_node": [0, 0, 255], "destination": [239, 89, 128], "origin": [86, 5, 255], OTHER: [0, 0, 0]},
}


def present(value: Column) -> Column:
    """A number that is there: neither null nor NaN."""
    return value.isNotNull() & ~F.isnan(value.cast("double"))


def _range(df: DataFrame, value: Column) -> tuple[float | None, float | None]:
    value = F.when(present(value), value.cast("double"))
    return tuple(df.agg(F.min(value), F.max(value)).first())


def share(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Min-max share of a value, 0 where all are equal; missing stays missing."""
    low, high = _range(df, value)
    flat = low is None or high == low
    return df.withColumn(name, F.when(present(value), F.lit(0.0) if flat else (value - F.lit(low)) / F.lit(high - low)))


def percent_rank(df: DataFrame, value: str, name: str, scratch: Scratch) -> DataFrame:
    """Rank of a value over the count of values, ties averaged, missing ones left out."""
    counts = df.filter(present(F.col(value))).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    counts = scratch.keep(running(counts, [value], F.col("_n"), "_before", scratch))
    total = counts.agg(F.sum("_n")).first()[0] or 1
    ranks = counts.select(value, ((F.col("_before") + (F.col("_n") + 1) / 2) / F.lit(total)).alias(name))
    return df.join(ranks, value, "left")


def heat(level: Column) -> Column:
    """[255 - v, v, 0] for a level of 0 to 1, white where it is missing."""
    v = level * 255.0
    return F.when(level.isNull(), F.array(*[F.lit(float(c)) for c in WHITE])).otherwise(F.array(255.0 - v, v, F.lit(0.0)))


def rgb(color) -> Column:
    return F.array(*[F.lit(float(c)) for c in color])


def random_color(rng: random.Random) -> list[int]:
    return [rng.randrange(256) for _ in range(3)]


def color(df: DataFrame, scratch: Scratch, by: str | None = None, method: str | None = None, given=None, seed: int = 7) -> DataFrame:
    """Add ``color``, a list of three numbers.

    ``single_color``: the colour given, or a random one. ``categorical``: the colour given for a value, that of
    ``__other__`` for the rest (white if it is not given); without colours each value gets a random one, the
    seed settles which. ``gradient``: from red for the least to green for the most. ``quantile``: the same
    by rank. The method is categorical if an attribute is given, else one colour. Missing values are white, or
    ``__other__``.
    """
    rng = random.Random(seed)
    method = method or ("categorical" if by is not None else "single_color")
    if by is None and given is None:
        method = "single_color"
    if method == "single_color":
        return df.withColumn("color", rgb(given if given is not None else random_color(rng)))
    if method == "categorical":
        if given is None:
            # Colours for values come from a hash of the value: no list of values is needed.
            h = F.xxhash64(F.col(by).cast("string"), F.lit(seed))
            picked = F.array(*[F.pmod(F.shiftright(h, 8 * k), F.lit(256)).cast("double") for k in range(3)])
            return df.withColumn("color", F.when(F.col(by).isNull(), rgb(WHITE)).otherwise(picked))
        named = {str(k): v for k, v in given.items() if k not in (OTHER, "__attribute_name__")}
        other = rgb(given.get(OTHER, WHITE))
        if not named:
            return df.withColumn("color", other)
        table = F.create_map(*chain.from_iterable((F.lit(k), rgb(v)) for k, v in named.items()))
        return df.withColumn("color", F.coalesce(table[F.col(by).cast("string")], other))
    if method == "gradient":
        return share(df, F.col(by), "_level").withColumn("color", heat(F.col("_level"))).drop("_level")
    if method == "quantile":
        return percent_rank(df, by, "_level", scratch).withColumn("color", heat(F.col("_level"))).drop("_level")
    raise ValueError(f"no colour method {method!r}")


def radius(df: DataFrame, value: Column, name: str, least: float = 5, most: float = 10) -> DataFrame:
    return share(df, value, "_share").withColumn(name, F.lit(float(least)) + F.col("_share") * float(most - least)).drop("_share")


def flow_width(df: DataFrame, value: Column, name: str, most: float | None = None) -> DataFrame:
    high = most if most is not None else _range(df, value)[1]
    return df.withColumn(name, value / F.lit(float(high or 1.0)) * 40 + 0.5)


def diagnostics_width(df: DataFrame, value: Column, name: str) -> DataFrame:
    return share(df, value, "_share").withColumn(name, (F.col("_share") + 0.1) * 5).drop("_share")


def label(value: Column, kind: str) -> Column:
    """A text label: numbers with two decimals at most, other values as they are."""
    if kind in ("double", "float") or kind.startswith("decimal"):
        return F.bround(value, 2).cast("string")
    return value.cast("string")


def thousands(value: Column) -> Column:
    """Whole part with commas between thousands."""
    return F.format_number(value.cast("bigint"), 0)


def parsed_weights(text: Column) -> Column:
    """A list such as ``[.5, .25]`` as numbers."""
    return F.transform(F.split(F.regexp_replace(text, r"[\[\]\s]", ""), ","), lambda x: x.cast("double"))
