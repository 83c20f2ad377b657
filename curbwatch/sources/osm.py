"""Road extracts to directed segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ROADS
from ..functions.geo import haversine_m
from ..functions.text import mapping, number

WAYS = ("elements array<struct<type: string, id: bigint, nodes: array<bigint>, geometry: array<struct<lat: double, lon: double>>, tags: map<string, string>>>")


def speed_kmh(tags: Column) -> tuple[Column, Column]:
    """(km/h, tag or default) of a way."""
    parts = F.split(F.trim(F.lower(F.coalesce(tags["maxspeed"], F.lit("")))), r"\s+")
    value, unit = number(F.get(parts, F.lit(0))), F.get(parts, F.lit(1))
    usable = (value > 0) & (value < float("inf")) & ((F.size(parts) == 1) | ((F.size(parts) == 2) & unit.isin("mph", "km/h", "kmh", "kph")))
    tagged = F.when(F.coalesce(usable, F.lit(False)), value * F.when(unit == "mph", ROADS.mph_to_kmh).otherwise(1.0))
    default = F.coalesce(F.element_at(mapping(ROADS.default_mph), F.coalesce(tags["highway"], F.lit(""))), F.lit(ROADS.default_mph_other)) * ROADS.mph_to_kmh
    return F.coalesce(tagged, default), F.when(tagged.isNotNull(), "tag").otherwise("default")


def lanes(value: Column) -> Column:
    """A whole number of lanes, else null."""
    return F.when(value.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(value).try_cast("int"))


def ways(documents: DataFrame) -> DataFrame:
    return (documents.select(F.explode(F.from_json("body", WAYS)["elements"]).alias("w")).select("w.*").filter(F.col("type") == "way"))


def road_segments(way: DataFrame) -> DataFrame:
    """One row per piece of a way in drawing order; reversed ways are turned first.

    `two_way` pieces stand for an edge in each direction.
    """
    tags = F.col("tags")
    ok = (F.size("nodes") > 0) & (F.size("nodes") == F.size("geometry"))
    back = F.coalesce(tags["oneway"] == "-1", F.lit(False))
    turned = way.filter(ok).withColumns({"nodes": F.when(back, F.reverse("nodes")).otherwise(F.col("nodes")), "geometry": F.when(back, F.reverse("geometry")).otherwise(F.col("geometry"))})
    one = back | F.coalesce(tags["oneway"].isin("yes", "true", "1"), F.lit(False)) | (tags["oneway"].isNull() & F.coalesce(tags["highway"].isin("motorway", "motorway_link"), F.lit(False)))
    speed, source = speed_kmh(tags)
    pieces = F.expr("transform(sequence(0, size(nodes) - 2), i -> struct(i AS seg_index, nodes[i] AS a, nodes[i + 1] AS b, geometry[i].lat AS a_lat, geometry[i].lon AS a_lon, geometry[i + 1].lat AS b_lat, geometry[i + 1].lon AS b_lon))")
    out = turned.filter(F.size("nodes") > 1).select(
        F.col("id").alias("way_id"), F.inline(pieces), tags["highway"].alias("highway"), tags["name"].alias("name"), tags["ref"].alias("ref"), lanes(tags["lanes"]).alias("lanes"),
        lanes(tags["lanes:forward"]).alias("lanes_forward"), lanes(tags["lanes:backward"]).alias("lanes_backward"), speed.alias("maxspeed_kmh"), source.alias("maxspeed_source"), (~one).alias("two_way"))
    out = out.withColumn("length_m", haversine_m(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")))
    return out.withColumn("tt_s", F.col("length_m") / (F.col("maxspeed_kmh") / 3.6))


def road_edges(segments: DataFrame) -> DataFrame:
    """Directed edges, both ways where traffic runs both ways."""
    cols = ["length_m", "tt_s", "highway", "way_id", "seg_index"]
    fwd = segments.select(F.col("a").alias("src"), F.col("b").alias("dst"), *cols)
    return fwd.unionByName(segments.filter("two_way").select(F.col("b").alias("src"), F.col("a").alias("dst"), *cols))


def road_background(way: DataFrame) -> DataFrame:
    """Polylines by road class at five decimals, one row a way."""
    line = F.transform("geometry", lambda p: F.struct(F.bround(p["lat"], 5).alias("lat"), F.bround(p["lon"], 5).alias("lon")))
    return way.filter(F.col("tags")["highway"].isNotNull() & (F.size("geometry") > 0)).select(F.col("tags")["highway"].alias("highway"), F.col("id").alias("way_id"), line.alias("line"))


def background_by_class(way: DataFrame, block: int = 5000) -> DataFrame:
    """Polylines grouped by road class, in the order of their ways, so many ways a group at most."""
    part = F.struct("way_id", "line")
    lines = road_background(way).withColumn("block", F.floor(F.col("way_id") / block))
    return lines.groupBy("highway", "block").agg(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["line"]).alias("lines"))
