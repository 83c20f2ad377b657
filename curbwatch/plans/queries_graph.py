"""Queries over the camera graph: corridors, sites, splicing, adjacency, paths, trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import bearing_deg
from ..functions.text import route_label, route_tokens
from ..operators import corridor as C
from ..operators import lines
from ..operators import roads as D
from ..operators.hubpaths import shortest_between_hubs
from ..sources import tables as T
from .oracle_base import bdiff, bearing, cte, hav_m, r
from .queries_spatial import K, snappers, snaps
from .registry import query, rounded


@query("g4_corridor", f"SELECT camera_id, neighbor_id, side, length_m, CAST(hops AS BIGINT) AS hops, tt_s, {r('wave_s')} AS wave_s FROM corr")
def g4(fx):
    return rounded(C.corridor(fx.edge, fx.site_camera.select("site_id", "camera_id")))


@query("g4_promotion_corridor", "SELECT camera_id, neighbor_id, side, length_m, CAST(hops AS BIGINT) AS hops, tt_s FROM promo")
def g4b(fx):
    return rounded(C.corridor(fx.edge, fx.site_camera.select("site_id", "camera_id"), promotion=True).drop("wave_s"))


@query("j23_corridor_options", f"""SELECT incident_id, camera_id, CAST(option AS BIGINT) AS option, side, {r('length_m', 3)} AS length_m FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY g, pick) AS option FROM (
  SELECT incident_id, camera_id, 0 AS g, rank AS pick, 'named' AS side, km*1000E0 AS length_m FROM links
  UNION ALL SELECT incident_id, camera_id, 1, pick, side, length_m FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY sr, length_m, camera_id) AS pick FROM (
    SELECT *, row_number() OVER (PARTITION BY incident_id, camera_id ORDER BY length_m, sr) AS rn FROM (SELECT l.incident_id, c.neighbor_id AS camera_id, c.side, c.length_m, CASE c.side WHEN 'upstream' THEN 0 WHEN 'downstream' THEN 1 ELSE 2 END AS sr
    FROM links l JOIN corr c ON c.camera_id=l.camera_id WHERE NOT EXISTS (SELECT 1 FROM links x WHERE x.incident_id=l.incident_id AND x.camera_id=c.neighbor_id))) WHERE rn=1) WHERE pick<=4)) WHERE option<=10""")
def j23(fx):
    return rounded(C.corridor_options(fx.links, fx.corridor, 4, 10), 3).select("incident_id", "camera_id", "option", "side", "length_m")


@query("g7_next_hop", """SELECT site_id, next_site, kind FROM (SELECT e.src AS site_id, e.dst AS next_site, e.kind, row_number() OVER (PARTITION BY e.src ORDER BY e.kind<>CASE WHEN c.highway='motorway' THEN 'freeway' ELSE 'street' END, e.ord) AS rn FROM (
  SELECT src, dst, kind, src AS ord FROM fx_edge UNION ALL SELECT src, src+25, CASE WHEN src%2=0 THEN 'freeway' ELSE 'street' END, src+1000000000 FROM fx_edge) e JOIN fx_camera c ON c.camera_id=e.src WHERE e.kind<>'nearby') WHERE rn=1""")
def g7(fx):
    k = F.col("src")
    more = fx.edge.select("src", (k + 25).alias("dst"), F.when(k % 2 == 0, "freeway").otherwise("street").alias("kind"), "length_m", "tt_s", (k + 1_000_000_000).alias("ordinal"))
    edges = fx.edge.select("src", "dst", "kind", "length_m", "tt_s", k.alias("ordinal")).unionByName(more)
    return C.next_hop(edges, fx.site_camera.select("site_id", "is_freeway"), "down").select("site_id", "next_site", "kind")


@query("g8_tour_dwell", f"SELECT src, dst, {r('greatest(4.5E0, least(11E0, tt_s/11E0))')} AS dwell_s FROM fx_edge WHERE kind<>'nearby'")
def g8(fx):
    return rounded(C.tour_dwell(fx.edge.filter(F.col("kind") != "nearby")).select("src", "dst", "dwell_s"))


@query("j14_camera_site", "SELECT c.camera_id, c.camera_id%700 AS site_id, m.camera_id AS shown_camera FROM fx_camera c JOIN (SELECT camera_id%700 AS s, arg_min(camera_id, CASE WHEN camera_id%3=0 THEN camera_id ELSE camera_id+1000000000 END) AS camera_id FROM fx_camera GROUP BY 1) m ON m.s=c.camera_id%700")
def j14(fx):
    sc = fx.site_camera.withColumn("site_id", F.col("camera_id") % 700)
    shown = C.site_camera(sc).select("site_id", F.col("camera_id").alias("shown_camera"))
    return sc.select("camera_id", "site_id").join(shown, "site_id")


cte("snap_pairs", f"""SELECT a.camera_id AS a, b.camera_id AS b FROM snapped a JOIN snapped b ON a.camera_id<b.camera_id AND abs(a.snap_lat-b.snap_lat)<0.001E0 AND abs(a.snap_lon-b.snap_lon)<0.001E0
  WHERE (a.highway='motorway')=(b.highway='motorway') AND 2E0*6371008.8E0*asin(sqrt(pow(sin(radians(b.snap_lat-a.snap_lat)/2E0),2)+cos(radians(a.snap_lat))*cos(radians(b.snap_lat))*pow(sin(radians(b.snap_lon-a.snap_lon)/2E0),2)))<=40E0
  AND (a.two_way OR b.two_way OR {bdiff('a.seg_bearing', 'b.seg_bearing')}<45E0)""")
cte("snap_comp", """SELECT id, min(m) AS component FROM (WITH RECURSIVE walk(id, m) AS (SELECT camera_id, camera_id FROM snapped
  UNION SELECT p.other, w.m FROM walk w JOIN (SELECT a AS node, b AS other FROM snap_pairs UNION SELECT b, a FROM snap_pairs) p ON p.node=w.id) SELECT id, m FROM walk) GROUP BY id""")


def site_members(fx):
    return fx.kept("site_members", lambda: D.build_sites(fx.camera, snaps(fx)))


@query("g1_site_clusters", """SELECT s.camera_id, concat(CAST(s.region_id AS VARCHAR), ':S', lpad(CAST(n-1 AS VARCHAR), 3, '0')) AS site_id FROM (
  SELECT c.id AS camera_id, k.region_id, dense_rank() OVER (PARTITION BY k.region_id ORDER BY c.component) AS n FROM snap_comp c JOIN fx_camera k ON k.camera_id=c.id) s""")
def g1(fx):
    return site_members(fx).select("camera_id", "site_id")


# Snaps drawn alike are one: the lowest camera stands for them and alone meets other places.
cte("snap_head", "SELECT *, min(camera_id) OVER (PARTITION BY snap_lat, snap_lon, two_way, seg_bearing, highway='motorway') AS head FROM snapped")


@query("j16_site_pairs", """SELECT head AS a, camera_id AS b FROM snap_head WHERE camera_id<>head UNION ALL SELECT p.a, p.b FROM snap_pairs p JOIN snap_head x ON x.camera_id=p.a AND x.head=p.a JOIN snap_head y ON y.camera_id=p.b AND y.head=p.b""")
def j16(fx):
    return D.compatible_pairs(snaps(fx).filter(F.col("way_id").isNotNull()))


@query("a8_site_table", f"""SELECT m.component AS site, {r('avg(c.lat)')} AS lat, {r('avg(c.lon)')} AS lon, count(*) AS cameras, {r('avg(CASE WHEN c.camera_id%3=0 THEN c.camera_id/10E0 END)', 4)} AS mile_marker,
  arg_min(s.highway='motorway', c.camera_id) AS is_freeway, {r('arg_min(CASE WHEN NOT s.two_way THEN s.seg_bearing END, CASE WHEN NOT s.two_way THEN c.camera_id END)', 4)} AS bearing, any_value(w.roadway) AS roadway
  FROM snap_comp m JOIN fx_camera c ON c.camera_id=m.id JOIN snapped s ON s.camera_id=m.id
  JOIN (SELECT component, roadway FROM (SELECT component, roadway, row_number() OVER (PARTITION BY component ORDER BY count(*) DESC, min(id)) AS rn FROM snap_comp JOIN fx_camera ON camera_id=id GROUP BY component, roadway) WHERE rn=1) w ON w.component=m.component GROUP BY m.component""")
def a8(fx):
    cams = fx.camera.withColumn("mile_marker", F.when(F.col("camera_id") % 3 == 0, F.col("camera_id") / 10.0))
    members = site_members(fx)
    out = D.site_table(members, cams, snaps(fx))
    first = members.groupBy("site_id").agg(F.min("camera_id").alias("site"))
    out = out.join(first, "site_id").drop("site_id")
    return out.select("site", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "cameras", F.round("mile_marker", 4).alias("mile_marker"), "is_freeway",
                      (F.round("bearing", 4) + 0.0).alias("bearing"), "roadway")


@query("j2_mirror_snaps")
def j2(fx):
    s = snaps(fx).filter((F.col("highway") == "motorway") & ~F.col("two_way")).join(snappers(fx).select("camera_id", "lat0", "lon0"), "camera_id")
    segs = fx.segment.withColumn("seg_index", F.lit(0)).drop("region_id")
    # The opposing carriageway of every one-way motorway, sixty metres east and drawn the other way.
    other = segs.filter((F.col("highway") == "motorway") & ~F.col("two_way")).select(
        (F.col("way_id") + 5_000_000_000).alias("way_id"), F.col("b_lat").alias("a_lat"), (F.col("b_lon") + 0.0006).alias("a_lon"), F.col("a_lat").alias("b_lat"),
        (F.col("a_lon") + 0.0006).alias("b_lon"), "highway", "ref", "two_way", "seg_index")
    out = D.mirror_snaps(s.withColumnRenamed("camera_id", "site_id"), segs.unionByName(other))
    return rounded(out.select("site_id", "way_id", "distance_m"), 4)


@query("a9_graph_report", """SELECT concat('edges ', kind) AS measure, CAST(count(*) AS DOUBLE) AS value FROM fx_edge GROUP BY kind UNION ALL SELECT 'sites of 1', CAST(count(*) AS DOUBLE) FROM fx_camera
  UNION ALL SELECT 'freeway sites', CAST(count(*) FILTER (WHERE highway='motorway') AS DOUBLE) FROM fx_camera
  UNION ALL SELECT 'isolated sites', CAST(count(*) AS DOUBLE) FROM fx_camera c WHERE NOT EXISTS (SELECT 1 FROM fx_edge e WHERE e.kind<>'nearby' AND (e.src=c.camera_id OR e.dst=c.camera_id))""")
def a9(fx):
    return D.graph_report(fx.edge, fx.site_camera.select("site_id", "is_freeway", F.lit(1).alias("cameras")))


@query("a11_snap_report", f"""SELECT {r('max(distance_m)', 1)} AS max_m, {r('avg(distance_m)', 1)} AS mean_m, count(off) AS direction_checked, count(*) FILTER (WHERE off>135E0) AS reversed, {r('max(off)', 1)} AS max_offset, quantile_disc(-round(off, 1), 0.5)*-1 AS median_offset,
  count(*) FILTER (WHERE len(refs)>0 AND len(seg_refs)=0) AS unnumbered, count(*) FILTER (WHERE list_has_any(refs, seg_refs)) AS matched, count(*) FILTER (WHERE len(refs)>0 AND len(seg_refs)>0 AND NOT list_has_any(refs, seg_refs)) AS mismatched
  FROM (SELECT *, CASE WHEN NOT two_way AND highway='motorway' THEN {bdiff('seg_bearing', "CASE direction WHEN 'N' THEN 0E0 WHEN 'E' THEN 90E0 WHEN 'S' THEN 180E0 WHEN 'W' THEN 270E0 END")} * CASE WHEN direction IS NULL THEN NULL ELSE 1 END END AS off FROM snapped)""")
def a11(fx):
    return D.snap_report(snappers(fx), snaps(fx))


@query("a9_direction_mismatches", f"""SELECT camera_id, direction, {r('seg_bearing', 1)} AS bearing, {r('off', 1)} AS off_by_deg FROM (SELECT *, {bdiff('seg_bearing', "CASE direction WHEN 'N' THEN 0E0 WHEN 'E' THEN 90E0 WHEN 'S' THEN 180E0 WHEN 'W' THEN 270E0 END")} AS off
  FROM snapped WHERE NOT two_way AND highway='motorway' AND direction IS NOT NULL) WHERE off>135E0""")
def a9_directions(fx):
    return rounded(D.direction_mismatches(snappers(fx), snaps(fx)), 1)


@query("a9_route_mismatches", "SELECT camera_id, array_to_string(list_sort(refs), ' ') AS refs, array_to_string(list_sort(seg_refs), ' ') AS road_refs FROM snapped WHERE len(refs)>0 AND len(seg_refs)>0 AND NOT list_has_any(refs, seg_refs)")
def a9_mismatches(fx):
    text = lambda c: F.array_join(F.array_sort(c), " ").alias(c)
    return D.route_mismatches(snappers(fx), snaps(fx)).select("camera_id", text("refs"), text("road_refs"))


@query("a10_mile_marker_checks", f"""SELECT src, dst, east AS eastbound, (d>0)=east AS order_ok, {r('length_m/(abs(d)*1609.344E0)', 4)} AS length_ratio, NOT length_m/(abs(d)*1609.344E0) BETWEEN 0.8E0 AND 1.25E0 AS length_outlier FROM (
  SELECT e.src, e.dst, e.length_m, CASE WHEN e.dst%5<>0 OR e.dst%3=0 THEN (e.dst%97)/10E0 END-(e.src%97)/10E0 AS d, CASE WHEN e.src%4=0 THEN TRUE ELSE least(abs((e.src%360)-90E0), 360E0-abs((e.src%360)-90E0))<90E0 END AS east FROM fx_edge e WHERE kind='freeway') WHERE d<>0""")
def a10(fx):
    k = F.col("site_id")
    sites = fx.site_camera.select("site_id", F.when((k % 5 != 0) | (k % 3 == 0), (k % 97) / 10.0).alias("mile_marker"), F.when(k % 4 != 0, (k % 360).cast("double")).alias("bearing"))
    return D.mile_marker_checks(fx.edge, sites).withColumn("length_ratio", F.round("length_ratio", 4))


def spliced(fx):
    """Road of every chain edge, with a hub in the middle of every second one."""
    e = fx.edge.filter(F.col("kind") != "nearby")
    node = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    segs = e.select(F.col("src").alias("way_id"), F.lit(0).alias("seg_index"), node("src").alias("a"), node("dst").alias("b"), "length_m", "tt_s",
                    F.when(F.col("kind") == "freeway", "motorway").when(F.col("kind") == "ramp", "motorway_link").otherwise("primary").alias("highway"),
                    (F.col("src") % 5 == 0).alias("two_way"))
    hubs = e.filter(F.col("src") % 2 == 0).select(F.col("src").cast("string").alias("site_id"), F.col("src").alias("way_id"), F.lit(0).alias("seg_index"), (F.col("length_m") / 2).alias("t"))
    return D.splice(segs, hubs)


cte("splice_e", """SELECT *, concat('n', CAST(src AS VARCHAR)) AS a, concat('n', CAST(dst AS VARCHAR)) AS b, concat('site:', CAST(src AS VARCHAR)) AS h FROM fx_edge WHERE kind<>'nearby'""")
cte("splice_p", """SELECT a AS s, b AS t, length_m AS m, tt_s AS x, src%5=0 AS twoway FROM splice_e WHERE src%2<>0 UNION ALL SELECT a, h, length_m/2, tt_s/2, src%5=0 FROM splice_e WHERE src%2=0 UNION ALL SELECT h, b, length_m/2, tt_s/2, src%5=0 FROM splice_e WHERE src%2=0""")


@query("g2_spliced_road", f"""SELECT s AS src, t AS dst, {r('m')} AS length_m, {r('x')} AS tt_s FROM splice_p UNION ALL SELECT t, s, {r('m')}, {r('x')} FROM splice_p WHERE twoway""")
def g2(fx):
    return rounded(spliced(fx).select("src", "dst", "length_m", "tt_s"))


# Every way from a hub that meets no node twice; on these chains the shortest is one of them.
cte("road_step", """SELECT s, t, m, x, cls FROM (SELECT a AS s, b AS t, length_m AS m, tt_s AS x, src%5=0 AS tw, kind FROM splice_e WHERE src%2<>0 UNION ALL SELECT a, h, length_m/2, tt_s/2, src%5=0, kind FROM splice_e WHERE src%2=0
  UNION ALL SELECT h, b, length_m/2, tt_s/2, src%5=0, kind FROM splice_e WHERE src%2=0), LATERAL (SELECT CASE kind WHEN 'freeway' THEN 'motorway' WHEN 'ramp' THEN 'motorway_link' ELSE 'primary' END AS cls)
  UNION ALL SELECT t, s, m, x, cls FROM (SELECT a AS s, b AS t, length_m AS m, tt_s AS x, kind FROM splice_e WHERE src%2<>0 AND src%5=0 UNION ALL SELECT a, h, length_m/2, tt_s/2, kind FROM splice_e WHERE src%2=0 AND src%5=0
  UNION ALL SELECT h, b, length_m/2, tt_s/2, kind FROM splice_e WHERE src%2=0 AND src%5=0), LATERAL (SELECT CASE kind WHEN 'freeway' THEN 'motorway' WHEN 'ramp' THEN 'motorway_link' ELSE 'primary' END AS cls)""")
cte("hub_walk", """SELECT * FROM (WITH RECURSIVE walk AS (SELECT s AS start, t AS node, m, x, FALSE AS via, [s, t] AS path, [cls] AS classes FROM road_step WHERE s LIKE 'site:%' AND m<=8000E0
  UNION ALL SELECT w.start, r.t, w.m+r.m, w.x+r.x, w.via OR r.s LIKE 'site:%', list_append(w.path, r.t), CASE WHEN w.classes[-1]=r.cls THEN w.classes ELSE list_append(w.classes, r.cls) END
    FROM walk w JOIN road_step r ON r.s=w.node WHERE NOT list_contains(w.path, r.t) AND w.m+r.m<=8000E0) SELECT * FROM walk)""")
cte("hub_paths", """SELECT substr(start, 6) AS src, substr(node, 6) AS dst, m AS length_m, x AS tt_s, classes, path FROM (SELECT *, row_number() OVER (PARTITION BY start, node ORDER BY round(m, 6), via, x) AS rn FROM hub_walk) WHERE rn=1 AND node LIKE 'site:%' AND NOT via""")


@query("g3_hub_paths", f"SELECT src, dst, {r('length_m')} AS length_m, {r('tt_s')} AS tt_s, array_to_string(classes, ',') AS classes FROM hub_paths")
def g3(fx):
    return rounded(shortest_between_hubs(spliced(fx)).select("src", "dst", "length_m", "tt_s", F.array_join("classes", ",").alias("classes")))


cte("chain_order", "SELECT camera_id, region_id, row_number() OVER (PARTITION BY region_id ORDER BY camera_id) AS n FROM fx_camera")


cte("mid_site", f"""SELECT CAST(e.src AS VARCHAR) AS site_id, (a.lat+b.lat)/2 AS lat, (a.lon+b.lon)/2 AS lon, e.kind='freeway' AS main, e.src%5=0 AS two_way, {bearing('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS heading
  FROM fx_edge e JOIN fx_camera a ON a.camera_id=e.src JOIN fx_camera b ON b.camera_id=e.dst WHERE e.kind<>'nearby' AND e.src%2=0""")
cte("road_node", "SELECT concat('n', CAST(camera_id AS VARCHAR)) AS node, lat, lon FROM fx_camera UNION ALL SELECT concat('site:', site_id), lat, lon FROM mid_site")
cte("hub_links", f"""SELECT * FROM (SELECT *, CASE WHEN s_main AND d_main THEN CASE WHEN len(list_filter(classes, lambda c: c<>'motorway'))=0 THEN 'freeway' END WHEN s_main<>d_main OR list_contains(classes, 'motorway_link') THEN 'ramp' ELSE 'street' END AS kind FROM (
  SELECT p.*, s.main AS s_main, d.main AS d_main, {hav_m('s.lat', 's.lon', 'd.lat', 'd.lon')} AS straight FROM hub_paths p JOIN mid_site s ON s.site_id=p.src JOIN mid_site d ON d.site_id=p.dst)
  WHERE straight<=50E0 OR length_m/greatest(straight, 1E-9)<=2.5E0) WHERE kind IS NOT NULL""")
cte("hub_steps", f"""SELECT q.src, q.dst, q.i, u.lat AS u_lat, u.lon AS u_lon, v.lat AS v_lat, v.lon AS v_lon, c.cls, {bearing('u.lat', 'u.lon', 'v.lat', 'v.lon')} AS step_heading FROM (
  SELECT src, dst, i, path[i] AS un, path[i+1] AS vn FROM (SELECT src, dst, path, unnest(range(1, len(path))) AS i FROM hub_links)) q
  JOIN road_node u ON u.node=q.un JOIN road_node v ON v.node=q.vn JOIN (SELECT s, t, any_value(cls) AS cls FROM road_step GROUP BY s, t) c ON c.s=q.un AND c.t=q.vn""")
cte("hub_passers", f"""SELECT src, dst, site_id, main, two_way, heading, i, cls, step_heading, sqrt(pow(ax+share*(bx-ax), 2)+pow(ay+share*(by_-ay), 2)) AS metres FROM (
  SELECT *, greatest(0E0, least(1E0, ((0E0-ax)*(bx-ax)+(0E0-ay)*(by_-ay))/((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)))) AS share FROM (
  SELECT h.*, m.site_id, m.main, m.two_way, m.heading, (h.u_lon-m.lon)*cos(radians(m.lat))*{K} AS ax, (h.u_lat-m.lat)*{K} AS ay, (h.v_lon-m.lon)*cos(radians(m.lat))*{K} AS bx, (h.v_lat-m.lat)*{K} AS by_
  FROM hub_steps h JOIN mid_site m ON m.site_id<>h.src AND m.site_id<>h.dst AND m.lat BETWEEN least(h.u_lat, h.v_lat)-0.001E0 AND greatest(h.u_lat, h.v_lat)+0.001E0
    AND m.lon BETWEEN least(h.u_lon, h.v_lon)-0.001E0 AND greatest(h.u_lon, h.v_lon)+0.001E0))""")


@query("j17_site_adjacency", f"""SELECT src, dst, kind, {r('length_m')} AS length_m, {r('tt_s')} AS tt_s FROM hub_links l WHERE NOT EXISTS (SELECT 1 FROM (
  SELECT *, row_number() OVER (PARTITION BY src, dst, site_id ORDER BY round(metres, 6), i) AS rn FROM hub_passers WHERE metres<=60E0) b
  WHERE b.rn=1 AND b.src=l.src AND b.dst=l.dst AND (b.cls='motorway')=b.main AND (b.two_way OR {bdiff('b.heading', 'b.step_heading')}<=135E0))""")
def j17(fx):
    road = fx.kept("spliced", lambda: spliced(fx))
    e = fx.edge.filter((F.col("kind") != "nearby") & (F.col("src") % 2 == 0))
    pos = fx.camera.select("camera_id", "lat", "lon")
    a = pos.withColumnsRenamed({"camera_id": "src", "lat": "a_lat", "lon": "a_lon"})
    b = pos.withColumnsRenamed({"camera_id": "dst", "lat": "b_lat", "lon": "b_lon"})
    mid = e.join(a, "src").join(b, "dst").select(
        F.col("src").cast("string").alias("site_id"), ((F.col("a_lat") + F.col("b_lat")) / 2).alias("lat"), ((F.col("a_lon") + F.col("b_lon")) / 2).alias("lon"),
        (F.col("kind") == "freeway").alias("is_freeway"), (F.col("src") % 5 == 0).alias("two_way"), F.array().cast("array<string>").alias("refs"),
        bearing_deg(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")).alias("seg_bearing"))
    nodes = pos.select(F.concat(F.lit("n"), F.col("camera_id").cast("string")).alias("node"), "lat", "lon").unionByName(
        mid.select(F.concat(F.lit("site:"), "site_id").alias("node"), "lat", "lon"))
    out = D.adjacency(shortest_between_hubs(road), mid, nodes, mid, road)
    return rounded(out.select("src", "dst", "kind", "length_m", "tt_s"))


# Roads between neighbors with one bend each; those that leave an odd camera are drawn the other way.
cte("road_pair", "SELECT a.camera_id AS pair_id, a.region_id, a.n AS n0, b.n AS n1 FROM chain_order a JOIN chain_order b ON b.region_id=a.region_id AND b.n=a.n+a.camera_id%12 WHERE a.camera_id%12 BETWEEN 1 AND 8")
cte("road_spot", """SELECT p.pair_id, 2*(x.n-p.n0)+u AS i, CASE WHEN u=0 THEN c.lat ELSE (c.lat+d.lat)/2+0.0003E0 END AS lat, CASE WHEN u=0 THEN c.lon ELSE (c.lon+d.lon)/2-0.0002E0 END AS lon
  FROM road_pair p JOIN chain_order x ON x.region_id=p.region_id AND x.n>=p.n0 AND x.n<=p.n1 JOIN fx_camera c ON c.camera_id=x.camera_id LEFT JOIN fx_edge e ON e.src=x.camera_id LEFT JOIN fx_camera d ON d.camera_id=e.dst, (VALUES (0), (1)) v(u) WHERE u=0 OR x.n<p.n1""")
cte("road_leg", f"""SELECT *, sqrt(pow(bx-ax, 2)+pow(by_-ay, 2)) AS m FROM (SELECT s.pair_id, s.i, (s.lon-o.lon)*cos(radians(o.lat))*{K} AS ax, (s.lat-o.lat)*{K} AS ay, lead((s.lon-o.lon)*cos(radians(o.lat))*{K}) OVER w AS bx, lead((s.lat-o.lat)*{K}) OVER w AS by_
  FROM road_spot s JOIN fx_camera o ON o.camera_id=s.pair_id WINDOW w AS (PARTITION BY s.pair_id ORDER BY s.i)) WHERE bx IS NOT NULL""")
cte("road_line", "SELECT *, coalesce(sum(m) OVER (PARTITION BY pair_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0E0) AS base, sum(m) OVER (PARTITION BY pair_id) AS total, count(*) OVER (PARTITION BY pair_id)+1 AS points FROM road_leg")


@query("g5_road_paths", f"""SELECT p.pair_id, CAST(p.n1-p.n0 AS BIGINT) AS hops, w.length_m, l.points, {r('l.total', 4)} AS metres, {r('l.ax+(0.4E0*l.total-l.base)/l.m*(l.bx-l.ax)', 4)} AS x, {r('l.ay+(0.4E0*l.total-l.base)/l.m*(l.by_-l.ay)', 4)} AS y FROM road_pair p
  JOIN (SELECT p.pair_id, sum(e.length_m) AS length_m FROM road_pair p JOIN chain_order x ON x.region_id=p.region_id AND x.n>=p.n0 AND x.n<p.n1 JOIN fx_edge e ON e.src=x.camera_id GROUP BY p.pair_id) w USING (pair_id)
  JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY i) AS rn FROM road_line WHERE base<=0.4E0*total AND base+m>=0.4E0*total) WHERE rn=1) l USING (pair_id)""")
def g5(fx):
    from ..operators.scale import chunk_rank
    n = chunk_rank(fx.camera.select("camera_id", "region_id"), ["region_id"], [("_b", F.floor(F.col("camera_id") / 100_000), False)], [F.col("camera_id")], "n")
    a = n.select(F.col("camera_id").alias("pair_id"), "region_id", (F.col("n") + F.col("camera_id") % 12).alias("n"))
    pairs = a.join(n, ["region_id", "n"]).select("pair_id", F.col("pair_id").alias("from_site"), F.col("camera_id").alias("to_site"))
    at = lambda k: fx.camera.select(F.col("camera_id").alias(k), F.struct("lat", "lon").alias(f"{k}_at"))
    mid = F.struct(((F.col("src_at.lat") + F.col("dst_at.lat")) / 2 + 0.0003).alias("lat"), ((F.col("src_at.lon") + F.col("dst_at.lon")) / 2 - 0.0002).alias("lon"))
    drawn = fx.edge.join(at("src"), "src").join(at("dst"), "dst").select("src", "dst", "length_m", F.array("src_at", mid, "dst_at").alias("points"))
    odd = F.col("src") % 2 == 1
    links = drawn.select(F.when(odd, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(odd, F.col("src")).otherwise(F.col("dst")).alias("dst"), "length_m",
                         F.when(odd, F.reverse("points")).otherwise(F.col("points")).alias("points"))
    out = lines.road_paths(pairs, links).withColumn("legs", lines.legs(F.col("line"), F.col("line")[0]["lat"], F.col("line")[0]["lon"]))
    out = out.withColumn("metres", lines.length(F.col("legs")))
    out = out.withColumn("spot", lines.point_at(F.col("legs"), 0.4 * F.col("metres")))
    return rounded(out.select("pair_id", "hops", "length_m", F.size("line").cast("bigint").alias("points"), F.round("metres", 4).alias("metres"),
                              (F.round("spot.x", 4) + 0.0).alias("x"), (F.round("spot.y", 4) + 0.0).alias("y")))


@query("g6_trips")
def g6(fx):
    sites = fx.camera.select(F.col("camera_id").alias("site_id"), "region_id", "lat", "lon", route_label(F.col("roadway")).alias("route"))
    trips = D.plan_trips(fx.edge, sites)
    stops = trips.join(fx.site_camera.select("site_id", "has_video"), "site_id")
    return rounded(C.trip_dwell(stops).select("region_id", "trip_id", "stop", "site_id", "distance_m", "dwell_s"))


@query("p7_route_label", """SELECT camera_id, CASE camera_id%4 WHEN 0 THEN concat('I-', CAST((camera_id%9)*10+5 AS VARCHAR)) WHEN 1 THEN 'US-12' WHEN 2 THEN 'IA-5' END AS route FROM fx_camera""")
def p7(fx):
    return fx.camera.select("camera_id", route_label(F.col("roadway")).alias("route"))


@query("p6_route_tokens", """SELECT camera_id, CASE camera_id%4 WHEN 0 THEN concat('I', CAST((camera_id%9)*10+5 AS VARCHAR), ',US51') WHEN 1 THEN 'US12,US18' WHEN 2 THEN 'SR5' ELSE '' END AS tokens FROM fx_camera""")
def p6(fx):
    return fx.camera.select("camera_id", F.array_join(route_tokens(F.col("roadway")), ",").alias("tokens"))


@query("p44_camera_selection", "SELECT camera_id FROM fx_camera WHERE highway='motorway'")
def p44(fx):
    return T.select_cameras(fx.site_camera, "freeway").select("camera_id")


@query("j24_build_work_list", """SELECT region_id FROM fx_region r WHERE EXISTS (SELECT 1 FROM fx_camera c WHERE c.region_id=r.region_id) AND NOT EXISTS (SELECT 1 FROM fx_edge e WHERE e.region_id=r.region_id AND e.region_id%3=0)""")
def j24(fx):
    return T.build_work_list(fx.region, fx.camera, fx.edge.filter(F.col("region_id") % 3 == 0))
