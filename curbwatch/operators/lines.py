"""Linear referencing: places along polylines, measured in metres from their first point."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..config import ROADS
from ..functions.geo import axis_offset, to_xy
from ..functions.text import route_tokens
from .scale import durable

PIECES = """transform(sequence(1, size({0}) - 1), i -> struct(i AS piece, {0}[i - 1].lat AS a_lat, {0}[i - 1].lon AS a_lon, {0}[i].lat AS b_lat, {0}[i].lon AS b_lon))"""


def two_point_pieces(lines: DataFrame, coords: str = "coords") -> DataFrame:
    """Every line cut at its points: all other columns, piece (from 1) and the ends a and b. Lines of fewer than two points have none."""
    rest = [c for c in lines.columns if c != coords]
    return lines.filter(F.size(coords) > 1).select(*rest, F.expr(f"inline({PIECES.format(coords)})"))


def legs(coords: Column, lat0: Column, lon0: Column) -> Column:
    """The pieces of a line in the metre frame of a place: x, y of both ends and the length."""
    flat = F.transform(coords, lambda p: F.struct(*[c.alias(n) for n, c in zip("xy", to_xy(p["lat"], p["lon"], lat0, lon0))]))
    pairs = F.arrays_zip(F.slice(flat, 1, F.size(flat) - 1).alias("a"), F.slice(flat, 2, F.size(flat) - 1).alias("b"))
    return F.transform(pairs, lambda p: F.struct(p["a"]["x"].alias("ax"), p["a"]["y"].alias("ay"), p["b"]["x"].alias("bx"), p["b"]["y"].alias("by"),
                                                 F.hypot(p["b"]["x"] - p["a"]["x"], p["b"]["y"] - p["a"]["y"]).alias("m")))


def length(pieces: Column) -> Column:
    return F.aggregate(pieces, F.lit(0.0), lambda s, p: s + p["m"])


def point_at(pieces: Column, metres: Column) -> Column:
    """x and y at a distance along the pieces; before the first point and beyond the last it is that point."""
    start = F.struct(F.greatest(metres, F.lit(0.0)).alias("left"), pieces[0]["ax"].alias("x"), pieces[0]["ay"].alias("y"))

    def walk(s: Column, p: Column) -> Column:
        share = F.when(p["m"] > 0, F.least(F.lit(1.0), s["left"] / p["m"])).otherwise(1.0)
        return F.when(s["left"] < 0, s).otherwise(F.struct(
            F.when(s["left"] > p["m"], s["left"] - p["m"]).otherwise(F.lit(-1.0)).alias("left"),
            (p["ax"] + share * (p["bx"] - p["ax"])).alias("x"), (p["ay"] + share * (p["by"] - p["ay"])).alias("y")))

    return F.aggregate(pieces, start, walk)


def heading_at(pieces: Column, metres: Column, reach_m: float = 25.0) -> Column:
    """Direction of a line where it is passed: from the point `reach_m` before to the one as far after, within the line."""
    a, b = point_at(pieces, metres - reach_m), point_at(pieces, F.least(length(pieces), metres + reach_m))
    return F.pmod(F.degrees(F.atan2(b["x"] - a["x"], b["y"] - a["y"])) + 360.0, F.lit(360.0))


def nearest_on_lines(points: DataFrame, lines: DataFrame, point_id: str, line_id: str, radius_m: float) -> DataFrame:
    """Of every point and line within a radius: distance_m, t (metres along the line) and heading there.

    `points`: point_id, lat, lon and its frame lat0, lon0. `lines`: line_id and
    coords (lat, lon). Points meet two-point pieces on the grid, the nearest piece of
    a line is kept, and only then is the whole line read, for pairs that are near.
    """
    from .roads import snap_candidates
    near = snap_candidates(points.select(point_id, "lat", "lon", "lat0", "lon0"), two_point_pieces(lines.select(line_id, "coords")), radius_m)
    best = near.groupBy(point_id, line_id).agg(F.min(F.struct(F.round("distance_m", 6).alias("distance_m"), "piece", "t", "lat0", "lon0")).alias("n"))
    whole = best.join(lines.select(line_id, "coords"), line_id).withColumn("_legs", legs(F.col("coords"), F.col("n.lat0"), F.col("n.lon0")))
    t = length(F.slice("_legs", 1, F.col("n.piece") - 1)) + F.col("n.t")
    return whole.withColumn("t", t).select(point_id, line_id, F.col("n.distance_m").alias("distance_m"), "t", heading_at(F.col("_legs"), F.col("t")).alias("heading"))


def match_counts(cameras: DataFrame, counted: DataFrame) -> DataFrame:
    """Nearest counted line of each camera within 150 m, one along its own road first.

    A camera that names a route takes only lines of that route. `counted`: count_id,
    coords, roadway, aadt, as the count reader gives them. `cameras`: camera_id, lat,
    lon, lat0, lon0, refs and `want`, the bearing of its carriageway. A place and a
    line's points meet once, whatever cameras stand there and lines are drawn so.
    """
    place, same = ["lat", "lon", "lat0", "lon0"], ["lat", "lon", "lat0", "lon0", "refs", "want"]
    spots = cameras.groupBy(*same).agg(F.min("camera_id").alias("spot"))
    places = spots.groupBy(*place).agg(F.min("spot").alias("place"))
    # Of lines drawn alike with the same roadway only the lowest can win; lines drawn alike meet a place once.
    kinds = durable(counted.groupBy("coords", "roadway").agg(F.min("count_id").alias("count_id"), F.min_by("aadt", "count_id").alias("aadt")))
    shapes = durable(kinds.groupBy("coords").agg(F.min("count_id").alias("shape")))
    near = nearest_on_lines(places, shapes, "place", "shape", ROADS.count_max_m)
    kinds = kinds.join(shapes, "coords").select("shape", "count_id", "aadt", route_tokens(F.col("roadway")).alias("routes"))
    near = near.join(kinds, "shape").join(spots.join(places, place).select("place", "spot", "refs", "want"), "place")
    near = near.filter((F.size("refs") == 0) | F.arrays_overlap("refs", "routes"))
    aligned = F.col("want").isNull() | (axis_offset(F.col("heading"), F.col("want")) <= ROADS.same_road_deg)
    best = near.groupBy("spot").agg(F.min(F.struct((~aligned).alias("across"), "distance_m", "count_id", "aadt", "t", "heading")).alias("m"))
    return _of_spots(cameras, spots, same, best).select("camera_id", F.col("m.count_id").alias("count_id"), F.col("m.aadt").alias("aadt"), F.col("m.distance_m").alias("distance_m"),
                                                       (~F.col("m.across")).alias("aligned"), F.col("m.t").alias("t"), F.col("m.heading").alias("heading"))


def _of_spots(cameras: DataFrame, spots: DataFrame, same: list[str], best: DataFrame) -> DataFrame:
    """What was found for a spot, for every camera there."""
    c, s = cameras.select("camera_id", *same).alias("c"), spots.join(best, "spot").alias("s")
    on = [F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}")) for k in same]
    return c.join(s, on).select("c.camera_id", "s.m")


def road_paths(pairs: DataFrame, links: DataFrame, max_hops: int = 8) -> DataFrame:
    """Road between two sites walking links either way, fewest hops first, at most eight, as one line.

    `pairs`: pair_id, from_site, to_site. `links`: src, dst, length_m, points (lat, lon
    from src to dst). Returns pair_id, hops, length_m, path (sites) and line (points).
    Read from its end, a path takes the lowest site that is one hop nearer. Both ends
    grow a hop a round, so eight hops are met in four rounds and an end lists what lies
    within four. A row holds the way to its own end, so nothing is looked up backwards.
    A pair that has met goes no further: ways that meet first are shortest, and ways
    that wander cannot meet before, so sites need not be held against those of earlier
    hops. Pieces drawn the other way are turned; legs after the first leave out the
    site they share. Of parallel links the shortest is taken.
    """
    turned = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "length_m", F.reverse("points").alias("points"))
    both = links.select("src", "dst", "length_m", "points").unionByName(turned).filter("src <> dst")
    step = durable(both.groupBy("src", "dst").agg(F.min(F.struct("length_m", "points")).alias("l")).select("src", "dst", "l.length_m", "l.points"))
    road = step.select(F.col("src").alias("node"), "dst")
    none = F.lit(None).cast(ArrayType(pairs.schema["from_site"].dataType))
    # `back` leads from the node to from_site, `ahead` from to_site to the node.
    ends = [F.struct(F.col("from_site").alias("node"), F.array("from_site").alias("back"), none.alias("ahead")),
            F.struct(F.col("to_site").alias("node"), none.alias("back"), F.array("to_site").alias("ahead"))]
    front, met = durable(pairs.filter("from_site <> to_site").select("pair_id", F.inline(F.array(*ends)))), []
    for hop in range(1, max_hops + 1, 2):
        fresh = lambda way, longer: F.when(~F.array_contains(way, F.col("dst")), longer)
        grown = front.join(road, "node").select("pair_id", F.col("dst").alias("node"), fresh(F.col("back"), F.concat(F.array("dst"), "back")).alias("back"),
                                                fresh(F.col("ahead"), F.concat("ahead", F.array("dst"))).alias("ahead"), none.alias("held"))
        held = front.filter(F.col("ahead").isNotNull()).select("pair_id", "node", none.alias("back"), none.alias("ahead"), F.col("ahead").alias("held"))
        # One shuffle by pair serves the sites of a hop, the meeting and the end of pairs that met.
        sites = (grown.filter("back IS NOT NULL OR ahead IS NOT NULL").unionByName(held).repartition("pair_id").groupBy("pair_id", "node")
                 .agg(*[F.min(c).alias(c) for c in ("back", "ahead", "held")]))
        rest = F.slice("back", 2, hop)
        meets = F.when(F.col("held").isNotNull(), F.struct(F.lit(hop).alias("hops"), F.concat("held", rest).alias("way")))
        if hop < max_hops:
            meets = F.coalesce(meets, F.when(F.col("ahead").isNotNull(), F.struct(F.lit(hop + 1).alias("hops"), F.concat("ahead", rest).alias("way"))))
        sites = sites.withColumn("here", F.when(F.col("back").isNotNull(), meets)).withColumn("best", F.min("here").over(Window.partitionBy("pair_id")))
        sites = durable(sites.filter((F.col("here") == F.col("best")) | (F.col("best").isNull() & (F.col("back").isNotNull() | F.col("ahead").isNotNull()))).drop("held", "here"))
        met.append(sites.filter(F.col("best").isNotNull()).select("pair_id", "best.hops", F.reverse("best.way").alias("path")))
        front = sites.filter(F.col("best").isNull()).drop("best")
    leg = F.transform(F.sequence(F.lit(1), F.col("hops")), lambda i: F.struct(i.alias("leg"), F.get("path", i - 1).alias("src"), F.get("path", i).alias("dst")))
    way = reduce(DataFrame.unionByName, met).select("pair_id", "hops", F.inline(leg)).join(step, ["src", "dst"])
    whole = way.groupBy("pair_id", "hops").agg(F.sum("length_m").alias("length_m"), F.array_sort(F.collect_list(F.struct("leg", "src", "dst", "points"))).alias("l"))  # at most max_hops legs
    first = F.col("l")[0]
    drawn = F.flatten(F.transform("l", lambda x, i: F.when(i == 0, x["points"]).otherwise(F.slice(x["points"], 2, F.greatest(F.size(x["points"]) - 1, F.lit(0))))))
    return whole.select("pair_id", "hops", "length_m", F.concat(F.array(first["src"]), F.transform("l", lambda x: x["dst"])).alias("path"), drawn.alias("line"))
