"""Queries over documents, audits and records: graph sections, road background, local time, load, series, work lists."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.geo import CONICS
from ..operators import city as C
from ..operators import events as E
from ..operators import floors as L
from ..operators import metros as M
from ..operators import ranking as R
from ..sources import osm
from ..sources import tables as T
from . import api
from .oracle_base import cte, r, sun
from .queries_events import TIER_SQL, tiers
from .queries_scoring import full_scores, plain_scores
from .queries_sources import way_docs
from .registry import query, rounded


@query("s10_road_background", """SELECT highway, CAST(floor(camera_id/50E0) AS BIGINT) AS block, count(*) AS lines, string_agg(concat(printf('%.5f', round_even(lat, 5)), ' ', printf('%.5f', round_even(lon, 5)), ',',
  printf('%.5f', round_even(lat+0.001E0, 5)), ' ', printf('%.5f', round_even(lon, 5)), ',', printf('%.5f', round_even(lat+0.001E0, 5)), ' ', printf('%.5f', round_even(lon+0.002E0, 5))), ';' ORDER BY camera_id) AS drawn FROM fx_camera GROUP BY 1, 2""")
def s10(fx):
    grouped = osm.background_by_class(osm.ways(way_docs(fx)), 50)
    line = lambda w: F.array_join(F.transform(w, lambda p: F.concat(F.format_string("%.5f", p["lat"]), F.lit(" "), F.format_string("%.5f", p["lon"]))), ",")
    return grouped.select("highway", "block", F.size("lines").cast("bigint").alias("lines"), F.array_join(F.transform("lines", line), ";").alias("drawn"))


def graph_sections(fx, size: int = 20):
    """Documents of all cities, in sections of a few rows each so that most parts have several."""
    sites = fx.camera.join(fx.site_camera.select("camera_id", "site_id", "is_freeway", "has_video"), "camera_id")
    edges = fx.edge.select("region_id", "src", "dst", "kind", F.round("length_m", 1).alias("length_m"), F.round("tt_s", 1).alias("tt_s"))
    n = sites.groupBy("region_id").agg(F.count(F.lit(1)).alias("sites")).withColumn("cameras", F.col("sites"))
    meta = fx.region.join(n, "region_id").join(edges.groupBy("region_id").agg(F.count(F.lit(1)).alias("edges")), "region_id", "left")
    return T.graph_sections({
        "meta": meta.select("region_id", "name", F.col("source_id").cast("string").alias("source"), "sites", "cameras", F.coalesce("edges", F.lit(0)).alias("edges")),
        "sites": sites.select("region_id", F.col("site_id").alias("id"), "lat", "lon", "is_freeway", F.array("camera_id").alias("cameras")),
        "cameras": sites.select("region_id", F.col("camera_id").alias("id"), "roadway", "location", "lat", "lon", F.col("site_id").alias("site"), "is_freeway", "has_video"),
        "edges": edges}, size)


@query("s12_graph_meta", """SELECT g.region_id, g.name, CAST(g.source_id AS VARCHAR) AS source, n.sites, n.sites AS cameras, coalesce(e.edges, 0) AS edges FROM fx_region g JOIN (SELECT region_id, count(*) AS sites FROM fx_camera GROUP BY 1) n USING (region_id)
  LEFT JOIN (SELECT region_id, count(*) AS edges FROM fx_edge GROUP BY 1) e USING (region_id)""")
def s12_meta(fx):
    return T.graph_part(graph_sections(fx), "meta")


@query("s12_graph_sites", f"SELECT region_id, camera_id AS id, {r('lat')} AS lat, {r('lon')} AS lon, highway='motorway' AS is_freeway, CAST(camera_id AS VARCHAR) AS cameras FROM fx_camera")
def s12_sites(fx):
    return rounded(T.graph_part(graph_sections(fx), "sites").withColumn("cameras", F.array_join("cameras", ","))).withColumn("region_id", F.col("region_id").cast("int"))


@query("s12_graph_cameras", f"SELECT region_id, camera_id AS id, roadway, location, {r('lat')} AS lat, {r('lon')} AS lon, camera_id AS site, highway='motorway' AS is_freeway, camera_id%3=0 AS has_video FROM fx_camera")
def s12_cameras(fx):
    return rounded(T.graph_part(graph_sections(fx), "cameras")).withColumn("region_id", F.col("region_id").cast("int"))


@query("s12_graph_edges", "SELECT region_id, src, dst, kind, length_m, tt_s FROM fx_edge")
def s12_edges(fx):
    return T.graph_part(graph_sections(fx), "edges")


# Polls spread over a year, so that both changes of the clock are among them.
YEAR_AT = "(at+(poll_id%366)*86400E0)"
ZONES = ["America/Los_Angeles", "America/Denver", "America/Chicago", "America/New_York", "America/Phoenix"]


@query("p38_night_shift", f"""SELECT poll_id, zone, strftime(timezone(zone, to_timestamp({YEAR_AT})), '%Y-%m-%d %H:%M') AS local_time FROM (SELECT poll_id, at, lat, lon,
  CASE source_id {' '.join(f"WHEN {i} THEN '{z}'" for i, z in enumerate(ZONES))} END AS zone FROM fx_fresh JOIN fx_camera USING (camera_id)) WHERE {sun('lat', 'lon', YEAR_AT)}<0""")
def p38(fx):
    zone = F.element_at(F.array(*map(F.lit, ZONES)), F.col("source_id") + 1)
    p = fx.fresh.join(fx.camera.select("camera_id", "lat", "lon", "source_id"), "camera_id").withColumn("at", F.col("at") + (F.col("poll_id") % 366) * 86400.0)
    return E.local_night(p.withColumn("zone", zone)).select("poll_id", "zone", "local_time")


@query("j13_vehicle_count", """SELECT s.camera_id, s.at AS frame_at, CASE WHEN s.camera_id%5=0 THEN 'off' WHEN v.vehicles IS NULL THEN 'none' ELSE 'counted' END AS status, CASE WHEN s.camera_id%5<>0 THEN v.vehicles END AS vehicles FROM newest s
  LEFT JOIN (SELECT camera_id, at AS frame_at, poll_id%5+poll_id%3+poll_id%2 AS vehicles FROM fx_fresh WHERE poll_id%3=0) v ON v.camera_id=s.camera_id AND v.frame_at=s.at""")
def j13(fx):
    newest = fx.fresh.groupBy("camera_id").agg(F.max("at").alias("frame_at"))
    return C.vehicle_status(newest, fx.vehicle_count, F.col("camera_id") % 5 != 0)


@query("a17_load_audit", f"""SELECT minute, {r('n/60E0')} AS requests_per_s, CAST(floor(b/60E0*3600E0/1E6) AS BIGINT) AS mb_per_h, fast, slow, radar, idle FROM (
  SELECT CAST(floor(at/60E0) AS BIGINT) AS minute, count(*) AS n, sum(poll_id%50000)*1E0 AS b FROM fx_poll GROUP BY 1),
  (SELECT count(*) FILTER (WHERE tier='fast') AS fast, count(*) FILTER (WHERE tier='slow') AS slow, count(*) FILTER (WHERE tier='radar') AS radar, count(*) FILTER (WHERE tier='idle') AS idle FROM ({TIER_SQL}))""")
def a17_audit(fx):
    return rounded(C.load_audit(fx.poll.withColumn("bytes", F.col("poll_id") % 50_000), tiers(fx)))


@query("a21_answer_series", f"""SELECT incident_id, max({r('at')}) AS latest_at, string_agg(concat(CAST(CAST(floor(at) AS BIGINT) AS VARCHAR), ':', CAST(CAST(round(standstill*100) AS BIGINT) AS VARCHAR)), ',' ORDER BY at DESC) AS series FROM (
  SELECT camera_id%8 AS incident_id, read_at AS at, standstill, row_number() OVER (PARTITION BY camera_id%8 ORDER BY read_at DESC) AS rn FROM fx_reading) WHERE rn<=40 GROUP BY incident_id""")
def a21_series(fx):
    v = fx.reading.select((F.col("camera_id") % 8).alias("incident_id"), F.col("read_at").alias("at"), "standstill")
    point = lambda p: F.concat(F.floor(p["at"]).cast("string"), F.lit(":"), F.round(p["standstill"] * 100).cast("bigint").cast("string"))
    out = L.answer_series(v, "incident_id", "standstill").orderBy(F.col("latest_at").desc())
    return rounded(out.withColumn("series", F.array_join(F.transform("series", point), ",")))


@query("j24_counts_missing", "SELECT region_id FROM fx_region WHERE source_id%2=0 AND region_id%3<>0")
def j24_counts(fx):
    sources = fx.region.select("source_id", (F.col("source_id") % 2 == 0).alias("has_counts")).distinct()
    return T.counts_missing(fx.region, sources, fx.region.filter(F.col("region_id") % 3 == 0))


@query("a13_sources", "SELECT r.r_regionkey AS source_id, r.r_name AS name, (SELECT count(*) FROM fx_camera c WHERE c.source_id=r.r_regionkey) AS cameras FROM region r")
def a13_sources(fx):
    return api.sources(fx.table("region").select(F.col("r_regionkey").alias("source_id"), F.col("r_name").alias("name")), fx.camera)


@query("a12_index_summary", "SELECT source_id AS source, count(*) AS cameras, count(DISTINCT floor(camera_id/100E0)) AS blocks FROM fx_camera GROUP BY 1")
def a12_index(fx):
    cams = fx.camera.select(F.col("source_id").alias("source"), F.col("camera_id").alias("id"), "lat", "lon")
    return api.index_summary(T.pack_index(cams, 100))


cte("review_seen", """SELECT region_id, count(*) AS leaders, string_agg(concat(CAST(camera_id AS VARCHAR), ':', CAST(CAST(floor(at+0.5E0) AS BIGINT) AS VARCHAR)), ',' ORDER BY rn) AS evidence FROM (
  SELECT s.region_id, s.camera_id, n.at, row_number() OVER (PARTITION BY s.region_id ORDER BY s.attention DESC, s.camera_id) AS rn FROM scored_plain s JOIN newest n USING (camera_id)) WHERE rn<=8 GROUP BY region_id""")


@query("t10_review_questions", """SELECT region_id, leaders, evidence FROM review_seen WHERE leaders>=2 AND (region_id%5=4 OR ((region_id%4)*60E0>=120E0 AND region_id%3<>0))""")
def t10_review(fx):
    leaders = R.top_per(plain_scores(fx).filter(F.col("attention").isNotNull()), ["region_id"], R.score_order(), 8, "rank")
    seen = fx.fresh.groupBy("camera_id").agg(F.max("at").alias("last_at"))
    leaders = leaders.select("region_id", "camera_id", "rank").join(seen, "camera_id")
    region = F.col("region_id")
    first = E.review_questions(leaders, fx.region.select("region_id", F.lit(0.0).alias("at"), F.lit("").alias("evidence")).limit(0), fx.now)
    last = fx.region.filter(region % 5 != 4).join(first.select("region_id", F.col("evidence").alias("e")), "region_id", "left").select(
        "region_id", (fx.now - (region % 4) * 60.0).alias("at"), F.when(region % 3 == 0, F.col("e")).otherwise("old").alias("evidence"))
    return E.review_questions(leaders, last, fx.now)


def zoned(fx):
    return F.element_at(F.array(*map(F.lit, ZONES)), F.col("source_id") + 1)


@query("t11_gate_evidence")
def t11_gate(fx):
    state = plain_scores(fx).withColumns({"baseline": F.col("mu"), "zone": zoned(fx)})
    asked = state.filter(F.col("camera_id") % 3 == 0).select("camera_id")
    return E.gate_evidence(asked, state, fx.camera, fx.corridor, fx.links, fx.vehicle_count, fx.now)


@query("t11_review_evidence")
def t11_review(fx):
    ranked = R.top_per(full_scores(fx).filter(F.col("attention").isNotNull()), ["region_id"], R.score_order(), 8, "rank")
    leaders = ranked.withColumns({"baseline": F.col("mu"), "incident": F.when(F.col("incident_floor") > 0, "a record")})
    return E.review_evidence(fx.region, leaders, fx.camera, fx.region.withColumn("zone", zoned(fx)), fx.now)


def _conic(name: str) -> tuple[str, str]:
    """x and y of a position in one inset, with the inset's constants worked out."""
    lat0, lon0, lat1, lat2 = CONICS[name]
    rad = math.pi / 180
    n = (math.sin(lat1 * rad) + math.sin(lat2 * rad)) / 2
    c = math.cos(lat1 * rad) ** 2 + 2 * n * math.sin(lat1 * rad)
    origin = math.sqrt(c - 2 * n * math.sin(lat0 * rad)) / n
    rho, theta = f"(sqrt(greatest(0E0, {c!r}E0-2E0*{n!r}E0*sin(radians(lat))))/{n!r}E0)", f"({n!r}E0*radians(lon-({lon0!r}E0)))"
    return f"{rho}*sin({theta})", f"{rho}*cos({theta})-{origin!r}E0"


cte("conic_raw", "SELECT camera_id, inset, CASE inset " + " ".join(f"WHEN '{n}' THEN {_conic(n)[0]}" for n in CONICS) + " END AS rx, CASE inset " + " ".join(f"WHEN '{n}' THEN {_conic(n)[1]}" for n in CONICS)
    + " END AS ry FROM (SELECT *, CASE region_id WHEN 3 THEN 'alaska' WHEN 5 THEN 'hawaii' ELSE 'conus' END AS inset FROM fx_camera)")
cte("conic_box", """SELECT b.*, l.cx0, l.cw, l.cy1, l.ch, CASE inset WHEN 'alaska' THEN cw*0.3E0/greatest(x1-x0, 1E-9) WHEN 'hawaii' THEN cw*0.1E0/greatest(x1-x0, 1E-9) ELSE 1E0 END AS scale FROM (
  SELECT inset, min(rx) AS x0, max(rx) AS x1, min(ry) AS y0, max(ry) AS y1 FROM conic_raw GROUP BY inset) b, (SELECT min(rx) AS cx0, max(rx)-min(rx) AS cw, max(ry) AS cy1, max(ry)-min(ry) AS ch FROM conic_raw WHERE inset='conus') l""")


@query("p39_map_projection", f"""SELECT camera_id, {r("rx*scale+CASE inset WHEN 'alaska' THEN cx0-x0*scale WHEN 'hawaii' THEN cx0+cw*0.38E0-x0*scale ELSE 0E0 END")} AS x,
  {r("ry*scale+CASE inset WHEN 'alaska' THEN cy1+ch*0.03E0-y0*scale WHEN 'hawaii' THEN cy1+ch*0.06E0-y0*scale ELSE 0E0 END")} AS y FROM conic_raw JOIN conic_box USING (inset)""")
def p39(fx):
    group = F.when(F.col("region_id") == 3, "alaska").when(F.col("region_id") == 5, "hawaii").otherwise("conus")
    return rounded(M.project_usa(fx.camera.withColumn("inset", group)).select("camera_id", "x", "y"), 6)
