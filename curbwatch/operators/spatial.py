"""Radius joins on a latitude-longitude grid.

Catalyst has no spatial join, so both sides get a grid cell and meet in an equi
join; the exact distance is a filter on top. One side is spread over every cell
its search box touches, so no pair within the radius is missed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_km, haversine_m
from .scale import top_per

KM_PER_DEG = 111.0
ARC_KM = 111.19508
"""Kilometers in a degree of arc on the mean sphere."""
FINE = 16
"""Finer cells along each side of a cell."""


def _row(lat: Column, width: float) -> Column:
    return F.floor(lat / width)


def _lon_width(row: Column, width: float) -> Column:
    """Longitude width of a grid row, set by its equator-most latitude so that cells are never too narrow."""
    nearest = F.when(row >= 0, row * width).otherwise((row + 1) * width)
    return width / F.greatest(F.lit(0.1), F.cos(F.radians(nearest)))


def cell(lat: Column, lon: Column, width: float) -> Column:
    row = _row(lat, width)
    return F.struct(row.alias("r"), F.floor(lon / _lon_width(row, width)).alias("c"))


def covering(lat_lo: Column, lat_hi: Column, lon_lo: Column, lon_hi: Column, width: float) -> Column:
    """Every cell a box touches."""
    rows = F.sequence(_row(lat_lo, width), _row(lat_hi, width))
    return F.flatten(F.transform(rows, lambda r: F.transform(
        F.sequence(F.floor(lon_lo / _lon_width(r, width)), F.floor(lon_hi / _lon_width(r, width))),
        lambda c: F.struct(r.alias("r"), c.alias("c")))))


def box(lat: Column, lon: Column, radius_km: float) -> tuple[Column, Column, Column, Column]:
    pad = radius_km / KM_PER_DEG * 1.01
    wide = pad / F.greatest(F.lit(0.1), F.cos(F.radians(F.abs(lat) + pad)))
    return lat - pad, lat + pad, lon - wide, lon + wide


def nearest_within(points: DataFrame, point_id: str, targets: DataFrame, target_id: str, radius_km: float, k: int) -> DataFrame:
    """The k nearest targets of every point within a radius, ties by target id.

    Returns (point_id, target_id, km, rank). Only a bounded number of candidates is
    paired: of targets at one position only the k lowest ids can ever be among the
    k nearest, and cells that cannot hold one of the k nearest, judged by the
    counts and extents of all cells around, are dropped before targets are joined.
    Points at one position are asked once.
    """
    width = radius_km / KM_PER_DEG / 2.0
    t = top_per(targets.select(F.col(target_id).alias("t_id"), F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon")),
                ["t_lat", "t_lon"], [F.col("t_id")], k)
    t = t.withColumns({"g": cell(F.col("t_lat"), F.col("t_lon"), width), "f": cell(F.col("t_lat"), F.col("t_lon"), width / FINE)})
    extent = [F.count(F.lit(1)).alias("n"), F.min("t_lat").alias("s"), F.max("t_lat").alias("t"),
              F.min("t_lon").alias("w"), F.max("t_lon").alias("e")]
    coarse = t.groupBy("g").agg(*extent)
    fine = t.groupBy("g", "f").agg(*extent)

    asked = points.select(F.col(point_id).alias("id"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    p = asked.groupBy("p_lat", "p_lon").agg(F.min("id").alias("p_id"))
    spread = p.withColumn("g", F.explode(covering(*box(F.col("p_lat"), F.col("p_lon"), radius_km), width)))
    cand = _prune(spread.join(coarse, "g"), radius_km, k).drop("n", "s", "t", "w", "e")
    cand = _prune(cand.join(fine, "g"), radius_km, k)
    near = (cand.select("p_id", "p_lat", "p_lon", "g", "f").alias("c")
            .join(t.alias("t"), (F.col("c.g") == F.col("t.g")) & (F.col("c.f") == F.col("t.f")))
            .withColumn("km", haversine_km(F.col("p_lat"), F.col("p_lon"), F.col("t_lat"), F.col("t_lon")))
            .filter(F.col("km") <= radius_km))
    near = top_per(near, ["p_id"], [F.round("km", 9), F.col("t_id")], k, "rank").select("p_lat", "p_lon", "t_id", "km", "rank")
    return asked.join(near, ["p_lat", "p_lon"]).select(F.col("id").alias(point_id), F.col("t_id").alias(target_id), "km", "rank")


def _prune(cand: DataFrame, radius_km: float, k: int) -> DataFrame:
    """Drop cells of a point that lie farther than the k-th nearest target can be."""
    lat, lon, pad = F.col("p_lat"), F.col("p_lon"), radius_km / KM_PER_DEG * 1.01
    # Bounds on the sphere by the widest and the narrowest degree of longitude in reach.
    wide = F.cos(F.radians(F.greatest(F.lit(0.0), F.abs(lat) - pad))) * ARC_KM
    slim = F.cos(F.radians(F.abs(lat) + pad)) * ARC_KM
    far = 1.001 * F.hypot(F.greatest(F.abs(lat - F.col("s")), F.abs(lat - F.col("t"))) * ARC_KM,
                          F.greatest(F.abs(lon - F.col("w")), F.abs(lon - F.col("e"))) * wide)
    near = 0.999 * F.hypot(F.greatest(F.lit(0.0), F.col("s") - lat, lat - F.col("t")) * ARC_KM,
                           F.greatest(F.lit(0.0), F.col("w") - lon, lon - F.col("e")) * slim)
    cand = cand.withColumns({"far": far, "near": near}).filter(F.col("near") <= radius_km)
    # At most the cells around one point are in this window, not the targets in them.
    by = Window.partitionBy("p_id")
    held = F.sum("n").over(by.orderBy("far").rowsBetween(Window.unboundedPreceding, 0))
    cand = cand.withColumn("held", held)
    limit = F.min(F.when(F.col("held") >= k, F.col("far"))).over(by)
    return (cand.withColumn("limit", limit).filter(F.col("limit").isNull() | (F.col("near") <= F.col("limit")))
            .drop("far", "near", "held", "limit"))


def pairs_within(df: DataFrame, key: str, radius_m: float, keep: Sequence[str] = ()) -> DataFrame:
    """Every pair a < b of rows within a radius, with the named columns of both sides.

    The pairs are the result here; callers that only need one representative per
    position reduce before calling.
    """
    km = radius_m / 1000.0
    width = km / KM_PER_DEG * 2.0
    side = lambda p: [F.col(c).alias(f"{p}_{c}") for c in dict.fromkeys([key, "lat", "lon", *keep])]
    left = df.select(*side("a")).withColumn("g", F.explode(covering(*box(F.col("a_lat"), F.col("a_lon"), km), width)))
    right = df.select(*side("b")).withColumn("g", cell(F.col("b_lat"), F.col("b_lon"), width))
    return (left.join(right, "g").filter(F.col(f"a_{key}") < F.col(f"b_{key}")).drop("g")
            .withColumn("metres", haversine_m(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")))
            .filter(F.col("metres") <= radius_m))


def line_cells(a_lat: Column, a_lon: Column, b_lat: Column, b_lon: Column, radius_km: float, width: float) -> Column:
    """Every cell that holds a place within a radius of a straight line: row by row the stretch of the line beside it.

    A long slanting line touches as many cells as it is long, not those of its whole extent.
    """
    pad = radius_km / KM_PER_DEG * 1.01
    wide = pad / F.greatest(F.lit(0.1), F.cos(F.radians(F.greatest(F.abs(a_lat), F.abs(b_lat)) + pad)))
    rise = b_lat - a_lat

    def stretch(r: Column) -> Column:
        at = lambda lat, level: F.when(rise == 0, level).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (lat - a_lat) / rise)))
        u, v = at(r * width - pad, 0.0), at((r + 1) * width + pad, 1.0)
        x, y = a_lon + u * (b_lon - a_lon), a_lon + v * (b_lon - a_lon)
        lon_width = _lon_width(r, width)
        return F.sequence(F.floor((F.least(x, y) - wide) / lon_width), F.floor((F.greatest(x, y) + wide) / lon_width))

    rows = F.sequence(_row(F.least(a_lat, b_lat) - pad, width), _row(F.greatest(a_lat, b_lat) + pad, width))
    return F.flatten(F.transform(rows, lambda r: F.transform(stretch(r), lambda c: F.struct(r.alias("r"), c.alias("c")))))


def points_and_lines(points: DataFrame, lines: DataFrame, radius_m: float, width_m: float = 400.0) -> DataFrame:
    """Pair points with straight lines (a_lat, a_lon, b_lat, b_lon) that may pass within a radius.

    A pair can appear once only: the point has a single cell and the line lists its cells without repeats.
    """
    width = width_m / 1000.0 / KM_PER_DEG
    spread = lines.withColumn("g", F.explode(line_cells(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"), radius_m / 1000.0, width)))
    return points.withColumn("g", cell(F.col("lat"), F.col("lon"), width)).join(spread, "g").drop("g")


def ray_crossings(rings: Column, x: Column, y: Column) -> Column:
    """Edges of all rings a ray east of the point crosses, counted with the even-odd rule."""

    def crossings(ring: Column) -> Column:
        following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
        hits = F.zip_with(ring, following, lambda a, b: F.when(
            ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(b["y"] != a["y"], b["y"] - a["y"]).otherwise(1.0) + a["x"]),
            1).otherwise(0))
        return F.aggregate(hits, F.lit(0), lambda s, v: s + v)

    return F.aggregate(F.transform(rings, crossings), F.lit(0), lambda s, v: s + v)


