"""Cameras on roads: snapping, mirrors, counts, sites and the camera graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ROADS
from ..functions.geo import along, axis_offset, bearing_deg, bearing_diff, direction_bearing, haversine_m, to_latlon, to_xy
from ..functions.text import route_tokens
from .scale import chunk_rank, durable
from .spatial import pairs_within, points_and_lines

FREEWAY = "motorway"


def snap_candidates(points: DataFrame, segments: DataFrame, radius_m: float) -> DataFrame:
    """Point-segment pairs within a radius with distance, position and bearing.

    Distances are taken in the metre frame of each region (lat0, lon0 on the point).
    """
    near = points_and_lines(points, segments, radius_m)
    px, py = to_xy(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0"))
    ax, ay = to_xy(F.col("a_lat"), F.col("a_lon"), F.col("lat0"), F.col("lon0"))
    bx, by = to_xy(F.col("b_lat"), F.col("b_lon"), F.col("lat0"), F.col("lon0"))
    near = near.withColumns({"px": px, "py": py, "ax": ax, "ay": ay, "bx": bx, "by": by})
    near = near.withColumn("share", along(*[F.col(c) for c in ("px", "py", "ax", "ay", "bx", "by")]))
    near = near.withColumns({"qx": F.col("ax") + F.col("share") * (F.col("bx") - F.col("ax")),
                             "qy": F.col("ay") + F.col("share") * (F.col("by") - F.col("ay"))})
    near = near.withColumn("distance_m", F.hypot(F.col("px") - F.col("qx"), F.col("py") - F.col("qy"))).filter(F.col("distance_m") <= radius_m)
    near = near.withColumn("t", F.col("share") * F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))
    q_lat, q_lon = to_latlon(F.col("qx"), F.col("qy"), F.col("lat0"), F.col("lon0"))
    return near.withColumns({"snap_lat": q_lat, "snap_lon": q_lon,
                             "seg_bearing": bearing_deg(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))}).drop(
        "px", "py", "ax", "ay", "bx", "by", "qx", "qy", "share")


def snap_score(distance: Column, refs: Column, seg_refs: Column, at_intersection: Column, highway: Column, two_way: Column,
               seg_bearing: Column, direction: Column) -> Column:
    """Distance with the route, intersection and direction evidence added; the lowest wins."""
    route = (F.when(F.size(refs) == 0, 0.0).when(F.arrays_overlap(seg_refs, refs), -ROADS.ref_match_bonus)
             .when(F.size(seg_refs) > 0, ROADS.ref_conflict_penalty).otherwise(ROADS.ref_missing_penalty))
    main = F.when(at_intersection & (highway == FREEWAY), ROADS.mainline_penalty).otherwise(0.0)
    off = bearing_diff(seg_bearing, direction_bearing(direction))
    wrong = F.when(~two_way & off.isNotNull(), ROADS.direction_penalty * off / 180.0).otherwise(0.0)
    return distance + route + main + wrong


SNAP = ["way_id", "seg_index", "t", "snap_lat", "snap_lon", "seg_bearing", "two_way", "distance_m", "highway", "ref"]


def snap_cameras(cameras: DataFrame, segments: DataFrame) -> DataFrame:
    """Best segment of every camera within 80 m; null where there is none.

    `cameras`: camera_id, lat, lon, lat0, lon0, refs, direction, at_intersection.
    `segments`: way_id, seg_index, a_lat, a_lon, b_lat, b_lon, highway, ref, two_way.
    Cameras of one spot with the same evidence are snapped once, and of segments
    drawn alike only the lowest meets them, so a crowded spot makes no pairs.
    """
    alike = ["a_lat", "a_lon", "b_lat", "b_lon", "highway", "ref", "two_way"]
    segs = segments.groupBy(*alike).agg(F.min(F.struct("way_id", "seg_index")).alias("w")).select("w.way_id", "w.seg_index", *alike, route_tokens(F.col("ref")).alias("seg_refs"))
    same = ["lat", "lon", "lat0", "lon0", "refs", "direction", "at_intersection"]
    spots = cameras.groupBy(*same).agg(F.min("camera_id").alias("spot"))
    cand = snap_candidates(spots, segs, ROADS.snap_max_m)
    score = snap_score(F.col("distance_m"), F.col("refs"), F.col("seg_refs"), F.col("at_intersection"), F.col("highway"),
                       F.col("two_way"), F.col("seg_bearing"), F.col("direction"))
    best = cand.withColumn("score", F.round(score, 6)).groupBy("spot").agg(F.min(F.struct("score", *SNAP)).alias("b"))
    c, s = cameras.select("camera_id", *same).alias("c"), spots.join(best, "spot").alias("s")
    return c.join(s, [F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}")) for k in same], "left").select("c.camera_id", "s.b.*")


def mirror_snaps(sites: DataFrame, segments: DataFrame) -> DataFrame:
    """The opposing carriageway of each one-way mainline snap, snapped again at its nearest point.

    `sites`: site_id, lat0, lon0 and the first snap's columns, of freeway sites without a direction.
    """
    one_way = sites.filter(~F.col("two_way")).select(
        "site_id", "lat0", "lon0", F.col("snap_lat").alias("lat"), F.col("snap_lon").alias("lon"), F.col("seg_bearing").alias("own_bearing"),
        F.col("way_id").alias("own_way"), F.col("highway").alias("own_class"), route_tokens(F.col("ref")).alias("own_refs"))
    cand = snap_candidates(one_way, segments.filter(~F.col("two_way")), ROADS.mirror_max_m)
    refs = route_tokens(F.col("ref"))
    same_refs = (F.size("own_refs") == 0) | ((F.size(F.array_except(refs, F.col("own_refs"))) == 0) & (F.size(F.array_except(F.col("own_refs"), refs)) == 0))
    ok = (F.col("way_id") != F.col("own_way")) & (F.col("highway") == F.col("own_class")) & same_refs & (
        bearing_diff(F.col("seg_bearing"), F.col("own_bearing")) >= ROADS.opposite_deg)
    across = (cand.filter(ok).groupBy("site_id", "lat0", "lon0").agg(F.min(F.struct("distance_m", "way_id", "seg_index", "snap_lat", "snap_lon")).alias("m"))
              .select(F.col("site_id").alias("camera_id"), "lat0", "lon0", F.col("m.snap_lat").alias("lat"), F.col("m.snap_lon").alias("lon"),
                      F.array().cast("array<string>").alias("refs"), F.lit(None).cast("string").alias("direction"), F.lit(False).alias("at_intersection")))
    again = snap_cameras(across, segments).filter(F.col("highway") == FREEWAY)
    return again.withColumnRenamed("camera_id", "site_id").drop("score")


def compatible_pairs(snaps: DataFrame) -> DataFrame:
    """Pairs of snaps that may share a site, thinned without losing connectivity.

    Snaps with the same position, class and bearing are interchangeable: each is
    linked to the lowest id among them and only that one meets other positions.
    """
    s = snaps.select("camera_id", "snap_lat", "snap_lon", "two_way", "seg_bearing", (F.col("highway") == FREEWAY).alias("main"))
    same = ["snap_lat", "snap_lon", "two_way", "seg_bearing", "main"]
    head = s.groupBy(*same).agg(F.min("camera_id").alias("head"))
    star = s.join(head, same).filter(F.col("camera_id") != F.col("head")).select(F.col("head").alias("a"), F.col("camera_id").alias("b"))
    h = head.select(F.col("head").alias("id"), F.col("snap_lat").alias("lat"), F.col("snap_lon").alias("lon"), "two_way", "seg_bearing", "main")
    pairs = pairs_within(h, "id", ROADS.site_merge_m, ["two_way", "seg_bearing", "main"])
    close = bearing_diff(F.col("a_seg_bearing"), F.col("b_seg_bearing")) < ROADS.same_carriageway_deg
    ok = (F.col("a_main") == F.col("b_main")) & (F.col("a_two_way") | F.col("b_two_way") | close)
    return pairs.filter(ok).select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).unionByName(star)


def components(nodes: DataFrame, pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components labelled by their lowest id (G1).

    Alternating large-star and small-star rounds; every round is a partial
    aggregation, links of a large component shrink to stars, and the number of
    rounds grows with the logarithm of the longest chain. Lineage is cut each round.
    """
    links = durable(pairs.select("a", "b").distinct())
    before = _fingerprint(links)
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.filter(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
                 .filter(F.col("a") != F.col("b")).distinct())
        links = durable(small)
        after = _fingerprint(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(links.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")), "id", "left").select("id", F.coalesce("m", "id").alias("component"))


def _fingerprint(links: DataFrame) -> tuple:
    """Row count and order-free checksum of a link table, to see that a round changed nothing."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def build_sites(cameras: DataFrame, snaps: DataFrame) -> DataFrame:
    """Site of every placed camera, numbered per region by its lowest camera (G1).

    `cameras`: camera_id, region_id. Returns camera_id, region_id, site_id.
    """
    placed = snaps.filter(F.col("way_id").isNotNull())
    label = components(placed.select(F.col("camera_id").alias("id")), compatible_pairs(placed)).withColumnRenamed("id", "camera_id")
    out = cameras.select("camera_id", "region_id").join(label, "camera_id")
    sites = out.select("region_id", "component").distinct()
    ranked = chunk_rank(sites, ["region_id"], [("_b", F.floor(F.col("component") / 100_000), False)], [F.col("component")], "n")
    name = F.concat(F.col("region_id").cast("string"), F.lit(":S"), F.lpad((F.col("n") - 1).cast("string"), 3, "0"))
    name = F.when(F.col("n") > 1000, F.concat(F.col("region_id").cast("string"), F.lit(":S"), (F.col("n") - 1).cast("string"))).otherwise(name)
    return out.join(ranked.select("region_id", "component", name.alias("site_id")), ["region_id", "component"]).select("camera_id", "region_id", "site_id")


def site_table(members: DataFrame, cameras: DataFrame, snaps: DataFrame) -> DataFrame:
    """Position, roadway, mile marker, bearing and class of every site."""
    m = (members.select("camera_id", "site_id").join(cameras.select("camera_id", "lat", "lon", "roadway", "mile_marker"), "camera_id")
         .join(snaps.select("camera_id", "two_way", "seg_bearing", "highway"), "camera_id"))
    ways = m.groupBy("site_id", "roadway").agg(F.count(F.lit(1)).alias("n"), F.min("camera_id").alias("first"))
    mode = ways.groupBy("site_id").agg(F.max(F.struct("n", (-F.col("first")).alias("o"), "roadway")).alias("m")).select("site_id", F.col("m.roadway").alias("roadway"))
    agg = m.groupBy("site_id").agg(
        F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count(F.lit(1)).alias("cameras"), F.avg("mile_marker").alias("mile_marker"),
        F.min_by(F.col("highway") == FREEWAY, "camera_id").alias("is_freeway"),
        F.min(F.when(~F.col("two_way"), F.struct("camera_id", "seg_bearing"))).alias("b"))
    return agg.join(mode, "site_id").withColumn("bearing", F.col("b.seg_bearing")).drop("b")


def nearby_pairs(sites: DataFrame, edges: DataFrame) -> DataFrame:
    """Sites within 150 m with no edge either way."""
    pairs = pairs_within(sites, "site_id", ROADS.nearby_max_m).select(F.col("a_site_id").alias("src"), F.col("b_site_id").alias("dst"), "metres")
    joined = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return pairs.join(joined, ["src", "dst"], "left_anti")


def splice(segments: DataFrame, hubs: DataFrame) -> DataFrame:
    """Directed road edges with a hub node spliced in wherever a site sits on a segment.

    `segments`: way_id, seg_index, a, b (node ids), length_m, tt_s, highway, two_way.
    `hubs`: site_id, way_id, seg_index, t. A site's points closer than half a metre
    on one segment are one. Hubs of one segment are few; a segment is one short road.
    """
    # A point counts when it is far enough from the last one kept, not from the one before.
    far = lambda held, t: F.when((F.size(held) == 0) | (t - F.element_at(held, -1) > 0.5), F.concat(held, F.array(t))).otherwise(held)
    spots = hubs.groupBy("way_id", "seg_index", "site_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    kept = spots.select("way_id", "seg_index", "site_id", F.explode(F.when(F.size("ts") == 1, F.col("ts")).otherwise(
        F.aggregate("ts", F.array().cast("array<double>"), far))).alias("t"))
    hub = kept.select("way_id", "seg_index", "t", F.concat(F.lit("site:"), "site_id").alias("node"))
    touched = hub.select("way_id", "seg_index").distinct()
    base = segments.join(touched, ["way_id", "seg_index"])
    ends = base.select("way_id", "seg_index", F.lit(0.0).alias("t"), F.col("a").alias("node"), F.lit(0).alias("o")).unionByName(
        base.select("way_id", "seg_index", F.col("length_m").alias("t"), F.col("b").alias("node"), F.lit(2).alias("o")))
    chain = hub.withColumn("o", F.lit(1)).unionByName(ends)
    w = Window.partitionBy("way_id", "seg_index").orderBy("o", "t", "node")
    pieces = (chain.withColumns({"to": F.lead("node").over(w), "t2": F.lead("t").over(w)}).filter(F.col("to").isNotNull() & (F.col("to") != F.col("node")))
              .join(base.select("way_id", "seg_index", "length_m", "tt_s", "highway", "two_way"), ["way_id", "seg_index"])
              .withColumn("piece", F.greatest(F.col("t2") - F.col("t"), F.lit(0.01))))
    pieces = pieces.select(F.col("node").alias("src"), F.col("to").alias("dst"), F.col("piece").alias("length_m"),
                           (F.col("piece") * F.col("tt_s") / F.col("length_m")).alias("tt_s"), "highway", "two_way")
    whole = segments.join(touched, ["way_id", "seg_index"], "left_anti").select(F.col("a").alias("src"), F.col("b").alias("dst"), "length_m", "tt_s", "highway", "two_way")
    fwd = whole.unionByName(pieces)
    back = fwd.filter("two_way").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "length_m", "tt_s", "highway", "two_way")
    return fwd.unionByName(back).drop("two_way")


def edge_kind(src_freeway: Column, dst_freeway: Column, src_refs: Column, dst_refs: Column, classes: Column) -> Column:
    """freeway, ramp, street, or null for a relation that should not exist."""
    all_main = F.forall(classes, lambda c: c == FREEWAY)
    interchange = (F.size(src_refs) > 0) & (F.size(dst_refs) > 0) & ~F.arrays_overlap(src_refs, dst_refs)
    return (F.when(src_freeway & dst_freeway, F.when(all_main, "freeway").when(interchange, "ramp"))
            .when((src_freeway != dst_freeway) | F.array_contains(classes, "motorway_link"), "ramp").otherwise("street"))


def adjacency(paths: DataFrame, sites: DataFrame, nodes: DataFrame, snaps: DataFrame, road_class: DataFrame) -> DataFrame:
    """Site edges: paths without long detours that pass no other site's snap on the same flow.

    `sites`: site_id, lat, lon, is_freeway, refs. `nodes`: node, lat, lon of road and hub nodes.
    `snaps`: site_id, lat, lon, seg_bearing, two_way, is_freeway. `road_class`: src, dst, highway.
    """
    a = sites.select(F.col("site_id").alias("src"), F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"), F.col("is_freeway").alias("s_main"), F.col("refs").alias("s_refs"))
    b = sites.select(F.col("site_id").alias("dst"), F.col("lat").alias("d_lat"), F.col("lon").alias("d_lon"), F.col("is_freeway").alias("d_main"), F.col("refs").alias("d_refs"))
    p = paths.join(a, "src").join(b, "dst")
    straight = haversine_m(F.col("s_lat"), F.col("s_lon"), F.col("d_lat"), F.col("d_lon"))
    p = p.withColumn("straight", straight).filter((F.col("straight") <= 50) | (F.col("length_m") / F.greatest("straight", F.lit(1e-9)) <= ROADS.max_detour_ratio))
    p = p.withColumn("kind", edge_kind(F.col("s_main"), F.col("d_main"), F.col("s_refs"), F.col("d_refs"), F.col("classes"))).filter(F.col("kind").isNotNull())
    p = durable(p)
    # Every step of every path as a short segment; a snap beside one of them may block the path.
    steps = p.select("src", "dst", F.posexplode(F.expr("transform(sequence(1, size(path) - 1), i -> struct(path[i - 1] AS u, path[i] AS v))")).alias("i", "s"))
    n = lambda x, q: nodes.select(F.col("node").alias(x), F.col("lat").alias(f"{q}_lat"), F.col("lon").alias(f"{q}_lon"))
    steps = steps.select("src", "dst", "i", F.col("s.u").alias("u"), F.col("s.v").alias("v")).join(n("u", "a"), "u").join(n("v", "b"), "v")
    steps = durable(steps.join(road_class.select(F.col("src").alias("u"), F.col("dst").alias("v"), "highway").dropDuplicates(["u", "v"]), ["u", "v"]).drop("u", "v"))
    # Steps drawn alike meet snaps once, and snaps alike are one: it passes a path's ends unless all its sites are ends.
    drawn = ["a_lat", "a_lon", "b_lat", "b_lon"]
    alike = ["lat", "lon", "snap_bearing", "snap_two_way", "is_freeway"]
    pts = snaps.select("site_id", "lat", "lon", F.col("seg_bearing").alias("snap_bearing"), F.col("two_way").alias("snap_two_way"), "is_freeway").distinct()
    pts = pts.groupBy(*alike).agg(F.min("site_id").alias("low"), F.max("site_id").alias("high"), F.count(F.lit(1)).alias("sites")).withColumns({"lat0": F.col("lat"), "lon0": F.col("lon")})
    near = snap_candidates(pts, steps.select(*drawn).distinct(), ROADS.passby_m).select(*drawn, *alike, "low", "high", "sites", F.round("distance_m", 6).alias("distance_m"), "seg_bearing")
    near = steps.join(near, drawn).filter((F.col("sites") > 2) | ~F.col("low").isin(F.col("src"), F.col("dst")) | ~F.col("high").isin(F.col("src"), F.col("dst")))
    # The path is judged where the snap is closest to it.
    at = near.groupBy("src", "dst", *alike).agg(F.min(F.struct("distance_m", "i", "seg_bearing", "highway")).alias("m"))
    blocks = ((F.col("m.highway") == FREEWAY) == F.col("is_freeway")) & (
        F.col("snap_two_way") | (bearing_diff(F.col("snap_bearing"), F.col("m.seg_bearing")) <= 135.0))
    blocked = at.filter(blocks).select("src", "dst").distinct()
    return p.join(blocked, ["src", "dst"], "left_anti").select("src", "dst", "kind", "length_m", "tt_s", F.col("classes").alias("highways"), "path")


def graph_report(edges: DataFrame, sites: DataFrame) -> DataFrame:
    """Edge kinds, site sizes, freeway and isolated sites, one measure a row."""
    kinds = edges.groupBy(F.concat(F.lit("edges "), "kind").alias("measure")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    sizes = sites.groupBy(F.concat(F.lit("sites of "), F.col("cameras").cast("string")).alias("measure")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    flow = edges.filter(F.col("kind") != "nearby")
    linked = flow.select(F.col("src").alias("site_id")).unionByName(flow.select(F.col("dst").alias("site_id"))).distinct()
    totals = sites.agg(F.count_if("is_freeway").cast("double").alias("value")).select(F.lit("freeway sites").alias("measure"), "value")
    alone = sites.join(linked, "site_id", "left_anti").agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("isolated sites").alias("measure"), "value")
    return kinds.unionByName(sizes).unionByName(totals).unionByName(alone)


def snap_report(cameras: DataFrame, snaps: DataFrame) -> DataFrame:
    """Snap distances, direction offsets and reversals, and route agreement in one row."""
    c = cameras.select("camera_id", "direction", "refs").join(snaps.filter(F.col("way_id").isNotNull()), "camera_id")
    off = F.when(~F.col("two_way") & (F.col("highway") == FREEWAY), bearing_diff(F.col("seg_bearing"), direction_bearing(F.col("direction"))))
    seg = route_tokens(F.col("ref"))
    named = F.size("refs") > 0
    return c.withColumns({"off": off, "seg": seg}).agg(
        F.round(F.max("distance_m"), 1).alias("max_m"), F.round(F.avg("distance_m"), 1).alias("mean_m"), F.count("off").alias("direction_checked"),
        F.count_if(F.col("off") > ROADS.opposite_deg).alias("reversed"), F.round(F.max("off"), 1).alias("max_offset"),
        # The upper of two middle offsets; a tenth of a degree bounds how many values are counted.
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY round(off, 1) DESC)").alias("median_offset"),
        F.count_if(named & (F.size("seg") == 0)).alias("unnumbered"), F.count_if(named & F.arrays_overlap("refs", "seg")).alias("matched"),
        F.count_if(named & (F.size("seg") > 0) & ~F.arrays_overlap("refs", "seg")).alias("mismatched"))


def direction_mismatches(cameras: DataFrame, snaps: DataFrame) -> DataFrame:
    """Cameras on a one-way mainline that runs nearly opposite to their direction code."""
    c = cameras.select("camera_id", "direction").join(snaps.filter(F.col("way_id").isNotNull() & ~F.col("two_way") & (F.col("highway") == FREEWAY)), "camera_id")
    off = bearing_diff(F.col("seg_bearing"), direction_bearing(F.col("direction")))
    return c.filter(off > ROADS.opposite_deg).select("camera_id", "direction", F.round("seg_bearing", 1).alias("bearing"), F.round(off, 1).alias("off_by_deg"))


def route_mismatches(cameras: DataFrame, snaps: DataFrame) -> DataFrame:
    """Cameras whose named routes and whose road's routes have nothing in common, both being known."""
    c = cameras.select("camera_id", "refs").join(snaps.filter(F.col("way_id").isNotNull()).select("camera_id", route_tokens(F.col("ref")).alias("road_refs")), "camera_id")
    return c.filter((F.size("refs") > 0) & (F.size("road_refs") > 0) & ~F.arrays_overlap("refs", "road_refs"))


def mile_marker_checks(edges: DataFrame, sites: DataFrame) -> DataFrame:
    """Freeway edges whose mile markers run the wrong way or disagree in length (A10)."""
    s = lambda k, q: sites.select(F.col("site_id").alias(k), F.col("mile_marker").alias(f"{q}_mm"), F.col("bearing").alias(f"{q}_b"))
    e = edges.filter(F.col("kind") == "freeway").join(s("src", "a"), "src").join(s("dst", "b"), "dst")
    d = F.col("b_mm") - F.col("a_mm")
    east = bearing_diff(F.coalesce("a_b", F.lit(90.0)), F.lit(90.0)) < 90.0
    e = e.filter(d.isNotNull() & (d != 0)).withColumns({"d": d, "eastbound": east})
    ratio = F.col("length_m") / (F.abs("d") * 1609.344)
    return e.select("src", "dst", "eastbound", ((F.col("d") > 0) == F.col("eastbound")).alias("order_ok"), ratio.alias("length_ratio"),
                    (~ratio.between(0.8, 1.25)).alias("length_outlier"))


def trip_steps(edges: DataFrame, sites: DataFrame) -> DataFrame:
    """Candidate moves along a route, directly or through one site off it.

    `sites`: site_id, region_id, route. Returns src, dst, route, length_m, tt_s.
    """
    flow = edges.filter(F.col("kind").isin("freeway", "ramp", "street")).select("src", "dst", "length_m", "tt_s")
    on = sites.select("site_id", "region_id", "route")
    first = (flow.join(on.select(F.col("site_id").alias("src"), F.col("region_id").alias("r0"), F.col("route").alias("route0")), "src")
             .join(on.select(F.col("site_id").alias("dst"), F.col("region_id").alias("r1"), F.col("route").alias("route1")), "dst")
             .filter(F.col("route0").isNotNull() & (F.col("r0") == F.col("r1"))))
    direct = first.filter(F.col("route0").eqNullSafe(F.col("route1"))).select("src", "dst", F.col("route0").alias("route"), "length_m", "tt_s")
    via = first.filter(~F.col("route0").eqNullSafe(F.col("route1"))).select("src", F.col("dst").alias("mid"), "route0", F.col("length_m").alias("m1"), F.col("tt_s").alias("t1"))
    second = (via.join(flow.select(F.col("src").alias("mid"), F.col("dst"), F.col("length_m").alias("m2"), F.col("tt_s").alias("t2")), "mid")
              .join(on.select(F.col("site_id").alias("dst"), F.col("route").alias("route2")), "dst")
              .filter((F.col("route0") == F.col("route2")) & (F.col("src") != F.col("dst")))
              .select("src", "dst", F.col("route0").alias("route"), (F.col("m1") + F.col("m2")).alias("length_m"), (F.col("t1") + F.col("t2")).alias("tt_s")))
    return direct.unionByName(second).groupBy("src", "dst", "route").agg(F.min(F.struct("length_m", "tt_s")).alias("s")).select("src", "dst", "route", "s.length_m", "s.tt_s")


def plan_trips(edges: DataFrame, sites: DataFrame, min_stops: int = 3) -> DataFrame:
    """The longest drive along each route of a city and the longest the other way, one row a stop.

    Every start grows its chain one stop a round, taking the nearest unvisited
    candidate; all chains of all cities grow together, and a round that adds nothing
    ends the walk. `sites` also needs lat and lon.
    """
    steps = durable(trip_steps(edges, sites))
    members = sites.filter(F.col("route").isNotNull()).select("region_id", "route", F.col("site_id"))
    enough = members.groupBy("region_id", "route").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_stops).drop("n")
    members = members.join(enough, ["region_id", "route"])
    nearest = steps.groupBy("src", "route").agg(F.min(F.struct("length_m", "dst")).alias("s"))
    reached = nearest.select(F.col("s.dst").alias("site_id"), "route").distinct()
    chains = members.join(reached, ["site_id", "route"], "left_anti").select(
        "region_id", "route", F.col("site_id").alias("start"), F.col("site_id").alias("head"),
        F.array(F.struct(F.col("site_id").alias("site"), F.lit(0.0).alias("distance_m"), F.lit(0.0).alias("leg_m"), F.lit(0.0).alias("leg_s"))).alias("stops"))
    chains = durable(chains)
    ended = None
    while True:
        move = chains.join(steps.select(F.col("src").alias("head"), "route", F.col("dst"), F.col("length_m").alias("m"), F.col("tt_s").alias("t")), ["head", "route"])
        move = move.filter(~F.exists("stops", lambda x: x["site"] == F.col("dst")))
        best = move.groupBy("region_id", "route", "start").agg(F.min(F.struct("m", "dst", "t")).alias("b"))
        joined = chains.join(best, ["region_id", "route", "start"], "left")
        stop = durable(joined.filter(F.col("b").isNull()).select("region_id", "route", "start", "stops"))
        ended = stop if ended is None else ended.unionByName(stop)
        so_far = F.element_at("stops", -1)["distance_m"]
        added = F.struct(F.col("b.dst").alias("site"), (so_far + F.col("b.m")).alias("distance_m"), F.col("b.m").alias("leg_m"), F.col("b.t").alias("leg_s"))
        chains = durable(joined.filter(F.col("b").isNotNull()).select("region_id", "route", "start", F.col("b.dst").alias("head"), F.concat("stops", F.array(added)).alias("stops")))
        if chains.limit(1).count() == 0:
            break
    ended = ended.filter(F.size("stops") >= min_stops)
    pos = lambda k, q: sites.select(F.col("site_id").alias(k), F.col("lat").alias(f"{q}_lat"), F.col("lon").alias(f"{q}_lon"))
    ended = (ended.withColumns({"last": F.element_at("stops", -1)["site"], "length_m": F.element_at("stops", -1)["distance_m"], "n": F.size("stops")})
             .join(pos("start", "s"), "start").join(pos("last", "e"), "last"))
    dx = (F.col("e_lon") - F.col("s_lon")) * F.cos(F.radians("s_lat"))
    ended = ended.withColumn("way", F.pmod(F.degrees(F.atan2(dx, F.col("e_lat") - F.col("s_lat"))) + 360.0, F.lit(360.0)))
    order = F.struct((-F.col("n")).alias("n"), (-F.col("length_m")).alias("l"), "start")
    first = ended.groupBy("region_id", "route").agg(F.min(F.struct(order.alias("o"), "way")).alias("f"))
    back = (ended.join(first, ["region_id", "route"]).filter(bearing_diff(F.col("way"), F.col("f.way")) > 120.0)
            .groupBy("region_id", "route").agg(F.min(order).alias("b")))
    chosen = first.select("region_id", "route", F.col("f.o.start").alias("start")).unionByName(back.select("region_id", "route", F.col("b.start").alias("start")))
    heading = F.element_at(F.array(*[F.lit(x) for x in ("northbound", "eastbound", "southbound", "westbound")]), (F.floor(F.col("way") / 90.0 + 0.5) % 4 + 1).cast("int"))
    out = ended.join(chosen, ["region_id", "route", "start"]).withColumn("heading", heading)
    out = out.select("region_id", F.concat("route", F.lit(":"), "heading", F.lit(":"), F.col("start").cast("string")).alias("trip_id"), "route", "heading", F.posexplode("stops").alias("stop", "s"))
    return out.select("region_id", "trip_id", "route", "heading", "stop", F.col("s.site").alias("site_id"), F.col("s.distance_m").alias("distance_m"), F.col("s.leg_m").alias("leg_m"), F.col("s.leg_s").alias("leg_s"))
