"""Queries that join by position."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions.text import camera_tokens
from ..operators import metros as M
from ..operators import ranking as R
from ..operators import roads as D
from ..operators.lines import match_counts
from ..sources import feeds
from .oracle_base import bdiff, bearing, cte, hav_km, hav_m, r
from .registry import query, rounded

K = "6371008.8E0*3.141592653589793E0/180E0"
TOKENS = ("CASE camera_id%4 WHEN 0 THEN [concat('I', CAST((camera_id%9)*10+5 AS VARCHAR)), 'US51'] WHEN 1 THEN ['US12','US18'] WHEN 2 THEN ['SR5'] ELSE [] END")
cte("fx_segment", """SELECT camera_id*2 AS way_id, region_id, lat-0.0012E0 AS a_lat, lon+((camera_id%7)-3)*0.0001E0 AS a_lon, lat+0.0012E0 AS b_lat, lon+((camera_id%7)-3)*0.0001E0 AS b_lon, highway,
  CASE WHEN camera_id%3<>0 THEN concat('US ', CASE WHEN camera_id%2=0 THEN '12' ELSE '51' END) END AS ref, camera_id%2=0 AS two_way FROM fx_camera
  UNION ALL SELECT camera_id*2+1, region_id, lat+((camera_id%5)-2)*0.0001E0, lon-0.001E0, lat+((camera_id%5)-2)*0.0001E0, lon+0.001E0, 'residential', CASE WHEN camera_id%4=0 THEN 'IA 5' END, TRUE FROM fx_camera""")
cte("fx_snapper", f"""SELECT c.camera_id, c.region_id, c.lat, c.lon, g.lat AS lat0, g.lon AS lon0, c.roadway, CASE WHEN c.camera_id%9=0 THEN [] ELSE {TOKENS} END AS refs,
  CASE c.camera_id%5 WHEN 0 THEN 'N' WHEN 1 THEN 'E' WHEN 2 THEN 'S' WHEN 3 THEN 'W' END AS direction, c.camera_id%9=0 AS crossing FROM fx_camera c JOIN fx_region g USING (region_id)""")
cte("near_seg_a", f"""SELECT c.*, s.way_id, s.a_lat, s.a_lon, s.b_lat, s.b_lon, s.highway, s.ref, s.two_way, (c.lon-c.lon0)*cos(radians(c.lat0))*{K} AS px, (c.lat-c.lat0)*{K} AS py,
  (s.a_lon-c.lon0)*cos(radians(c.lat0))*{K} AS ax, (s.a_lat-c.lat0)*{K} AS ay, (s.b_lon-c.lon0)*cos(radians(c.lat0))*{K} AS bx, (s.b_lat-c.lat0)*{K} AS by_
  FROM fx_snapper c JOIN fx_segment s ON s.region_id=c.region_id AND abs(s.a_lat-c.lat)<0.01E0 AND abs(s.a_lon-c.lon)<0.01E0""")
cte("near_seg_b", "SELECT *, greatest(0E0, least(1E0, ((px-ax)*(bx-ax)+(py-ay)*(by_-ay))/((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)))) AS share FROM near_seg_a")
cte("near_seg", f"""SELECT *, sqrt(pow(px-(ax+share*(bx-ax)),2)+pow(py-(ay+share*(by_-ay)),2)) AS distance_m, share*sqrt(pow(bx-ax,2)+pow(by_-ay,2)) AS t,
  (ay+share*(by_-ay))/({K})+lat0 AS snap_lat, (ax+share*(bx-ax))/(cos(radians(lat0))*{K})+lon0 AS snap_lon, {bearing('a_lat', 'a_lon', 'b_lat', 'b_lon')} AS seg_bearing,
  CASE ref WHEN 'US 12' THEN ['US12'] WHEN 'US 51' THEN ['US51'] WHEN 'IA 5' THEN ['SR5'] ELSE [] END AS seg_refs FROM near_seg_b""")
OFF = bdiff("seg_bearing", "CASE direction WHEN 'N' THEN 0E0 WHEN 'E' THEN 90E0 WHEN 'S' THEN 180E0 WHEN 'W' THEN 270E0 END")
cte("snap_scored", f"""SELECT *, round(distance_m + CASE WHEN len(refs)=0 THEN 0E0 WHEN list_has_any(seg_refs, refs) THEN -60E0 WHEN len(seg_refs)>0 THEN 40E0 ELSE 10E0 END
  + CASE WHEN crossing AND highway='motorway' THEN 80E0 ELSE 0E0 END + CASE WHEN NOT two_way AND direction IS NOT NULL THEN 50E0*{OFF}/180E0 ELSE 0E0 END, 6) AS score FROM near_seg WHERE distance_m<=80E0""")
cte("snapped", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY score, way_id) AS rn FROM snap_scored) WHERE rn=1")


def snappers(fx):
    k = F.col("camera_id")
    reg = F.broadcast(fx.region.select("region_id", F.col("lat").alias("lat0"), F.col("lon").alias("lon0")))
    direction = F.when(k % 5 == 0, "N").when(k % 5 == 1, "E").when(k % 5 == 2, "S").when(k % 5 == 3, "W")
    at = k % 9 == 0
    c = fx.camera.join(reg, "region_id").withColumn("spot", F.when(at, "1st St & Main").otherwise("US 12 at Main"))
    return c.select("camera_id", "region_id", "lat", "lon", "lat0", "lon0", "roadway", camera_tokens(F.col("roadway"), F.col("spot")).alias("refs"),
                    direction.alias("direction"), at.alias("at_intersection"))


def snaps(fx):
    segs = fx.segment.withColumn("seg_index", F.lit(0)).drop("region_id")
    return fx.kept("snaps", lambda: D.snap_cameras(snappers(fx), segs))


@query("j1_snap_cameras", f"SELECT c.camera_id, s.way_id, {r('s.distance_m', 4)} AS distance_m, {r('s.t', 4)} AS t, {r('s.snap_lat')} AS snap_lat, {r('s.snap_lon')} AS snap_lon, {r('s.seg_bearing', 4)} AS seg_bearing, s.two_way FROM fx_camera c LEFT JOIN snapped s USING (camera_id)")
def j1(fx):
    segs = fx.segment.withColumn("seg_index", F.lit(0)).drop("region_id")
    out = D.snap_cameras(snappers(fx), segs)
    return out.select("camera_id", "way_id", *[F.round(c, 4).alias(c) for c in ("distance_m", "t")], F.round("snap_lat", 6).alias("snap_lat"),
                      F.round("snap_lon", 6).alias("snap_lon"), F.round("seg_bearing", 4).alias("seg_bearing"), "two_way")


# Counted roads as an agency draws them: lines of 3 to 50 points that run past every counted camera.
LINE_N = "(3+camera_id%48)"
cte("count_point", f"""SELECT camera_id AS count_id, aadt, camera_id%4 AS q, region_id, i, lat+0.0004E0+((i*7+camera_id)%5-2)*0.0001E0 AS y, lon+(i-floor({LINE_N}/2E0))*0.0002E0 AS x
  FROM fx_camera, LATERAL (SELECT unnest(range({LINE_N})) AS i) WHERE aadt IS NOT NULL AND roadway<>'Main St'""")
cte("count_leg", f"""SELECT *, sqrt(pow(bx-ax, 2)+pow(by_-ay, 2)) AS m FROM (SELECT count_id, aadt, q, p.region_id, i, (x-g.lon)*cos(radians(g.lat))*{K} AS ax, (y-g.lat)*{K} AS ay,
  lead((x-g.lon)*cos(radians(g.lat))*{K}) OVER w AS bx, lead((y-g.lat)*{K}) OVER w AS by_ FROM count_point p JOIN fx_region g USING (region_id) WINDOW w AS (PARTITION BY count_id ORDER BY i)) WHERE bx IS NOT NULL""")
cte("count_line", "SELECT *, coalesce(sum(m) OVER (PARTITION BY count_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0E0) AS base, sum(m) OVER (PARTITION BY count_id) AS total FROM count_leg")
cte("count_near", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY camera_id, count_id ORDER BY round(distance_m, 6), i) AS rn FROM (SELECT *, sqrt(pow(px-(ax+share*(bx-ax)), 2)+pow(py-(ay+share*(by_-ay)), 2)) AS distance_m, base+share*m AS t FROM (
  SELECT *, greatest(0E0, least(1E0, ((px-ax)*(bx-ax)+(py-ay)*(by_-ay))/(m*m))) AS share FROM (
  SELECT c.camera_id, c.refs, CASE WHEN c.camera_id%6<>0 THEN (c.camera_id%4)*90E0 END AS want, (c.lon-c.lon0)*cos(radians(c.lat0))*{K} AS px, (c.lat-c.lat0)*{K} AS py, l.* FROM fx_snapper c JOIN count_line l USING (region_id)))) WHERE distance_m<=150E0) WHERE rn=1""")
AT = "(SELECT {{'x': ax+({s}-base)/m*(bx-ax), 'y': ay+({s}-base)/m*(by_-ay)}} FROM count_line l WHERE l.count_id=n.count_id AND l.base<={s} AND l.base+l.m>={s} ORDER BY l.i LIMIT 1)"
cte("count_heading", f"""SELECT n.camera_id, n.count_id, n.aadt, n.distance_m, n.t, n.want, (degrees(atan2(b.x-a.x, b.y-a.y))+360E0)%360E0 AS heading FROM (
  SELECT n.*, {AT.format(s='greatest(0E0, n.t-25E0)')} AS a, {AT.format(s='least(n.total-1E-9, n.t+25E0)')} AS b FROM count_near n
  WHERE len(refs)=0 OR list_has_any(refs, {TOKENS.replace('camera_id%4', 'n.q').replace('(camera_id%9)', '(n.count_id%9)')})) n""")


@query("j3_match_counts", f"""SELECT camera_id, count_id, aadt, {r('distance_m', 4)} AS distance_m, {r('t', 3)} AS t, {r('heading', 3)} AS heading, aligned FROM (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY NOT aligned, round(distance_m, 6), count_id) AS rn FROM (
  SELECT *, want IS NULL OR least({bdiff('heading', 'want')}, 180E0-{bdiff('heading', 'want')})<=40E0 AS aligned FROM count_heading)) WHERE rn=1""")
def j3(fx):
    k = F.col("camera_id")
    cams = snappers(fx).withColumn("want", F.when(k % 6 != 0, (k % 4) * 90.0))
    return rounded(match_counts(cams, counted(fx)).select("camera_id", "count_id", "aadt", F.round("distance_m", 4).alias("distance_m"), F.round("t", 3).alias("t"),
                                                          F.round("heading", 3).alias("heading"), "aligned"))


def counted(fx):
    """Counted lines, read from the agency's documents."""
    k = F.col("camera_id")
    attrs = F.struct(F.col("aadt").alias("AADT"), F.col("roadway").alias("NAME"), k.cast("string").alias("COUNTY"))
    n = (3 + k % 48).cast("int")
    path = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array(F.col("lon") + (i - F.floor(n / 2.0)) * 0.0002, F.col("lat") + 0.0004 + ((i * 7 + k) % 5 - 2) * 0.0001))
    feature = F.struct(attrs.alias("attributes"), F.struct(F.array(path).alias("paths")).alias("geometry"))
    # Few bytes of a camera make a long document, so they are spread by rows and not by the size of what is read.
    cameras = fx.camera.repartition(4 * fx.spark.sparkContext.defaultParallelism, "camera_id")
    read = feeds.traffic_counts(cameras.select(F.to_json(F.struct(F.array(feature).alias("features"))).alias("body")), {"aadt": "AADT", "roadway": "NAME", "county": "COUNTY"}, "MAIN ST")
    return read.select(F.col("county").cast("bigint").alias("count_id"), "coords", "roadway", "aadt")


@query("j15_nearby_pairs", f"""SELECT a.camera_id AS src, b.camera_id AS dst, {r(hav_m('a.lat', 'a.lon', 'b.lat', 'b.lon'), 3)} AS metres FROM fx_camera a JOIN fx_camera b ON a.camera_id<b.camera_id AND abs(a.lat-b.lat)<0.002E0 AND abs(a.lon-b.lon)<0.003E0
  WHERE {hav_m('a.lat', 'a.lon', 'b.lat', 'b.lon')}<=150E0 AND NOT EXISTS (SELECT 1 FROM fx_edge e WHERE (e.src=a.camera_id AND e.dst=b.camera_id) OR (e.src=b.camera_id AND e.dst=a.camera_id))""")
def j15(fx):
    sites = fx.camera.select(F.col("camera_id").alias("site_id"), "lat", "lon")
    return D.nearby_pairs(sites, fx.edge).withColumn("metres", F.round("metres", 3))


@query("j18_camera_state", """SELECT c.camera_id, coalesce((SELECT min(g.region_id) FROM fx_region g WHERE g.source_id=c.source_id AND ((abs(c.lon-g.lon)<0.04E0 AND abs(c.lat-g.lat)<0.04E0) AND NOT (abs(c.lon-g.lon)<0.01E0 AND abs(c.lat-g.lat)<0.01E0))),
  (SELECT g.region_id FROM fx_region g WHERE g.source_id=c.source_id ORDER BY pow(c.lon-g.lon,2)+pow(c.lat-g.lat,2), g.region_id LIMIT 1)) AS state_id FROM (SELECT * REPLACE (lat+0.00013E0 AS lat, lon+0.00017E0 AS lon) FROM fx_camera) c""")
def j18(fx):
    cams = fx.camera.withColumns({"lat": F.col("lat") + 0.00013, "lon": F.col("lon") + 0.00017})
    return M.camera_state(cams, fx.state_polygon).select("camera_id", F.col("state_id").cast("int").alias("state_id"))


@query("j19_indexed_in_box", """SELECT g.region_id, count(c.camera_id) AS indexed FROM fx_region g LEFT JOIN fx_camera c ON c.source_id=g.source_id AND c.lat BETWEEN g.lat-0.02E0 AND g.lat+0.02E0 AND c.lon BETWEEN g.lon-0.02E0 AND g.lon+0.02E0 GROUP BY g.region_id""")
def j19(fx):
    from .queries_scoring import region_boxes
    return M.indexed_in_box(region_boxes(fx), fx.camera)


@query("a6_metro_cells", f"""SELECT source_id, CAST(round_even(lat/0.2E0, 0) AS BIGINT) AS cy, CAST(round_even(lon/0.2E0, 0) AS BIGINT) AS cx, count(*) AS cameras, {r('avg(lat)')} AS lat, {r('avg(lon)')} AS lon FROM fx_camera
  GROUP BY source_id, round_even(lat/0.2E0, 0), round_even(lon/0.2E0, 0) HAVING count(*)>=12""")
def a6(fx):
    return rounded(M.metro_cells(fx.camera)).withColumn("source_id", F.col("source_id").cast("int"))


@query("a7_metros")
def a7(fx):
    return rounded(M.metros(M.metro_cells(fx.camera)))


@query("j21_metro_covered", """SELECT m.source_id, m.region_id FROM fx_region m WHERE EXISTS (SELECT 1 FROM fx_region g WHERE g.source_id=m.source_id AND g.region_id%2=0 AND abs(round(g.lat,1)-(m.lat+0.1E0))<0.3E0 AND abs(round(g.lon,1)-(m.lon+0.1E0))<0.3E0)""")
def j21(fx):
    metros = fx.region.withColumns({"lat": F.col("lat") + 0.1, "lon": F.col("lon") + 0.1})
    return M.covered_metros(metros, fx.region.filter(F.col("region_id") % 2 == 0)).select("source_id", "region_id")


@query("k1_region_catalog", f"""SELECT region_id, camera_id, CAST(place AS BIGINT) AS place FROM (SELECT g.region_id, c.camera_id, row_number() OVER (PARTITION BY g.region_id ORDER BY {hav_km('g.lat', 'g.lon', 'c.lat', 'c.lon')}, c.camera_id) AS place
  FROM fx_region g JOIN (SELECT * REPLACE (lat+(camera_id%997)*1E-7 AS lat) FROM fx_camera) c ON c.lat BETWEEN g.lat-0.04E0 AND g.lat+0.04E0 AND c.lon BETWEEN g.lon-0.04E0 AND g.lon+0.04E0 WHERE {hav_km('g.lat', 'g.lon', 'c.lat', 'c.lon')}<=4E0) WHERE place<=20""")
def k1(fx):
    k = F.col("camera_id")
    pts = fx.camera.select("camera_id", (F.col("lat") + (k % 997) * 1e-7).alias("lat"), "lon", k.alias("ordinal"))
    reg = fx.region.select("region_id", (F.col("lat") - 0.04).alias("south"), (F.col("lat") + 0.04).alias("north"), (F.col("lon") - 0.04).alias("west"), (F.col("lon") + 0.04).alias("east"),
                           F.col("lat").alias("center_lat"), F.col("lon").alias("center_lon"), F.lit(4.0).alias("radius_km"), F.lit(20).alias("keep"))
    return R.catalog_of(reg, pts).select("region_id", "camera_id", "place")


@query("p13_bearings", f"""SELECT camera_id, {r(bearing('r.lat', 'r.lon', 'c.lat', 'c.lon'), 4)} AS bearing, round({bdiff(bearing('r.lat', 'r.lon', 'c.lat', 'c.lon'), '90E0')}, 4)+0E0 AS off_east
  FROM fx_camera c JOIN fx_region r USING (region_id)""")
def p13(fx):
    reg = F.broadcast(fx.region.select("region_id", F.col("lat").alias("y"), F.col("lon").alias("x")))
    c = fx.camera.join(reg, "region_id")
    b = G.bearing_deg(F.col("y"), F.col("x"), F.col("lat"), F.col("lon"))
    return rounded(c.select("camera_id", b.alias("bearing"), G.bearing_diff(b, F.lit(90.0)).alias("off_east")), 4)
