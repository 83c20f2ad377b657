"""Where cameras cluster, which state they stand in, and where they fall on a map."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import CONICS, albers
from .spatial import ray_crossings

CELL_DEG = 0.2


def metro_cells(cameras: DataFrame, min_cell: int = 12) -> DataFrame:
    """Cameras per fifth of a degree and source, half-even cell edges, dense cells only."""
    cells = cameras.groupBy("source_id", F.rint(F.col("lat") / CELL_DEG).cast("bigint").alias("cy"), F.rint(F.col("lon") / CELL_DEG).cast("bigint").alias("cx"))
    return cells.agg(F.count(F.lit(1)).alias("cameras"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon")).filter(F.col("cameras") >= min_cell)


def metros(cells: DataFrame, merge_km: float = 30.0, min_cameras: int = 40) -> DataFrame:
    """Cells merged greedily, largest first, into metros around a running center.

    Order matters, so one source is one group. A source's cells number at most the
    fifth-degree squares of a country, a few tens of thousands, however many cameras
    it has.
    """
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np
        rows = pdf.sort_values(["cameras", "lat", "lon"], ascending=False)
        n, lat, lon = [], [], []
        for c in rows.itertuples():
            if n:
                p1, p2 = np.radians(np.array(lat)), np.radians(c.lat)
                h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(c.lon - np.array(lon)) / 2) ** 2
                near = np.flatnonzero(2 * 6371.0088 * np.arcsin(np.sqrt(h)) <= merge_km)
                if len(near):
                    i = near[0]
                    total = n[i] + c.cameras
                    lat[i] = (lat[i] * n[i] + c.lat * c.cameras) / total
                    lon[i] = (lon[i] * n[i] + c.lon * c.cameras) / total
                    n[i] = total
                    continue
            n.append(int(c.cameras)), lat.append(c.lat), lon.append(c.lon)
        return pd.DataFrame({"source_id": rows["source_id"].iloc[0], "cameras": n, "lat": lat, "lon": lon})

    kind = cells.schema["source_id"].dataType.simpleString()
    merged = cells.groupBy("source_id").applyInPandas(merge, f"source_id {kind}, cameras bigint, lat double, lon double")
    return merged.filter(F.col("cameras") >= min_cameras)


def covered_metros(metro: DataFrame, regions: DataFrame, reach: float = 0.3) -> DataFrame:
    """Metros some region of the same source already covers."""
    r = regions.select("source_id", F.bround("lat", 1).alias("r_lat"), F.bround("lon", 1).alias("r_lon")).withColumn("band", F.floor(F.col("r_lat")))
    m = metro.withColumn("band", F.explode(F.sequence(F.floor(F.col("lat") - reach), F.floor(F.col("lat") + reach))))
    near = (F.abs(F.col("r_lat") - F.col("lat")) < reach) & (F.abs(F.col("r_lon") - F.col("lon")) < reach)
    hit = m.join(r, ["source_id", "band"]).filter(near).drop("r_lat", "r_lon", "band")
    return hit.distinct()


def indexed_in_box(regions: DataFrame, cameras: DataFrame) -> DataFrame:
    """Cataloged cameras of a region's source inside its box."""
    r = regions.select("region_id", "source_id", "south", "north", "west", "east")
    g = (r.withColumn("gy", F.explode(F.sequence(F.floor(F.col("south") * 10), F.floor(F.col("north") * 10))))
         .withColumn("gx", F.explode(F.sequence(F.floor(F.col("west") * 10), F.floor(F.col("east") * 10)))))
    # Cameras at one position are counted before the join.
    c = cameras.groupBy("source_id", "lat", "lon").agg(F.count(F.lit(1)).alias("n")).withColumns({"gy": F.floor(F.col("lat") * 10), "gx": F.floor(F.col("lon") * 10)})
    inside = F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("west"), F.col("east"))
    counts = c.join(g, ["source_id", "gy", "gx"]).filter(inside).groupBy("region_id").agg(F.sum("n").alias("indexed"))
    return regions.select("region_id").join(counts, "region_id", "left").fillna(0, ["indexed"])


def camera_state(cameras: DataFrame, states: DataFrame) -> DataFrame:
    """State polygon each camera stands in; offshore cameras go to the nearest box center.

    A source covers a handful of states, so a camera meets only that handful. State
    outlines are a fixed, published set and are broadcast.
    """
    pairs = cameras.select("camera_id", "source_id", "lat", "lon").join(F.broadcast(states), "source_id")
    inside = ray_crossings(F.col("rings"), F.col("lon"), F.col("lat")) % 2 == 1
    d = F.pow(F.col("lon") - F.col("center_x"), 2) + F.pow(F.col("lat") - F.col("center_y"), 2)
    scored = pairs.select("camera_id", "state_id", inside.alias("inside"), F.round(d, 12).alias("d"))
    best = F.min(F.struct((~F.col("inside")).alias("out"), F.when(F.col("inside"), 0.0).otherwise(F.col("d")).alias("d"), "state_id"))
    return scored.groupBy("camera_id").agg(best.alias("b")).select("camera_id", F.col("b.state_id").alias("state_id"), (~F.col("b.out")).alias("inside"))


def project_usa(points: DataFrame) -> DataFrame:
    """Conic map positions with Alaska and Hawaii set below the south-west corner.

    `points` has lat, lon and inset; placement follows the extent of the data.
    """
    x = F.when(F.lit(False), 0.0)
    y = F.when(F.lit(False), 0.0)
    for name, params in CONICS.items():
        px, py = albers(F.col("lat"), F.col("lon"), *params)
        x, y = x.when(F.col("inset") == name, px), y.when(F.col("inset") == name, py)
    raw = points.withColumns({"rx": x, "ry": y})
    box = raw.groupBy("inset").agg(F.min("rx").alias("x0"), F.max("rx").alias("x1"), F.min("ry").alias("y0"), F.max("ry").alias("y1"))
    land = box.filter(F.col("inset") == "conus").select(F.col("x0").alias("cx0"), (F.col("x1") - F.col("x0")).alias("cw"), F.col("y1").alias("cy1"), (F.col("y1") - F.col("y0")).alias("ch"))
    # Share of the width, offset along it, and gap below it.
    share = F.when(F.col("inset") == "alaska", 0.3).when(F.col("inset") == "hawaii", 0.1)
    left = F.when(F.col("inset") == "alaska", 0.0).when(F.col("inset") == "hawaii", 0.38)
    gap = F.when(F.col("inset") == "alaska", 0.03).when(F.col("inset") == "hawaii", 0.06)
    # Three boxes meet one.
    place = box.join(F.broadcast(land), F.lit(True))
    scale = F.coalesce(F.col("cw") * share / F.greatest(F.col("x1") - F.col("x0"), F.lit(1e-9)), F.lit(1.0))
    place = place.withColumn("scale", scale).select(
        "inset", "scale", F.coalesce(F.col("cx0") + F.col("cw") * left - F.col("x0") * F.col("scale"), F.lit(0.0)).alias("dx"),
        F.coalesce(F.col("cy1") + F.col("ch") * gap - F.col("y0") * F.col("scale"), F.lit(0.0)).alias("dy"))
    return (raw.join(F.broadcast(place), "inset").withColumns({"x": F.col("rx") * F.col("scale") + F.col("dx"), "y": F.col("ry") * F.col("scale") + F.col("dy")})
            .drop("rx", "ry", "scale", "dx", "dy"))
