"""Queries that read landed documents. The documents are built from the camera table in the agencies' shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import direction_letter, host_path, stable_id
from ..functions.geo import plausible_us
from ..operators.baseline import frame_metrics
from ..sources import feeds, osm
from ..sources import tables as T
from . import api
from .oracle_base import fixed, hav_m, r
from .registry import query, rounded



def docs(df: DataFrame, body, *keep: str) -> DataFrame:
    """One small landed page a row."""
    return df.select(*keep, body.alias("body"))



@query("s1_caltrans_feed", """SELECT concat('https://cam/', CAST(camera_id AS VARCHAR), '.jpg') AS image_url, round(lat, 6)+0E0 AS lat, CASE WHEN camera_id%2=0 THEN 'http://v' END AS video_url,
  concat(CAST(camera_id%99 AS VARCHAR), 'A') AS roadway, CASE camera_id%3 WHEN 0 THEN 'N' WHEN 1 THEN 'W' END AS direction, CASE WHEN camera_id%4=0 THEN 'Near' ELSE location END AS location,
  CASE WHEN camera_id%5<>0 THEN camera_id/10E0 END AS mile_marker, concat('Caltrans District ', CAST(region_id AS VARCHAR)) AS system FROM fx_camera WHERE camera_id%7<>0""")
def s1(fx):
    k = F.col("camera_id")
    loc = F.struct(F.col("lat").cast("string").alias("latitude"), F.col("lon").cast("string").alias("longitude"), (k % 99).cast("string").alias("route"), F.lit("A").alias("routeSuffix"),
                   F.when(k % 3 == 0, "North").when(k % 3 == 1, " wb ").otherwise("sideways").alias("direction"), F.when(k % 4 == 0, "").otherwise(F.col("location")).alias("locationName"),
                   F.lit("Near").alias("nearbyPlace"), F.when(k % 5 == 0, "none").otherwise((k / 10.0).cast("string")).alias("milepost"))
    image = F.struct(F.when(k % 2 == 0, "http://v").otherwise("Not Reported").alias("streamingVideoURL"),
                     F.struct(F.concat(F.lit("https://cam/"), k.cast("string"), F.lit(".jpg")).alias("currentImageURL")).alias("static"))
    cctv = F.struct(F.when(k % 7 == 0, "false").otherwise("true").alias("inService"), loc.alias("location"), image.alias("imageData"))
    d = docs(fx.camera, F.to_json(F.struct(F.array(F.struct(cctv.alias("cctv"))).alias("data"))), F.col("region_id").alias("district"))
    return rounded(feeds.caltrans(d).drop("id", "lon"))


@query("s2_arcgis_feed", """SELECT concat('http://img.host/', CAST(camera_id AS VARCHAR)) AS image_url, CASE WHEN camera_id%3=0 THEN 'I-80' ELSE roadway END AS roadway, CASE WHEN camera_id%2=0 THEN 'S' END AS direction, round(lon, 6)+0E0 AS lon FROM fx_camera WHERE camera_id%5<>0""")
def s2(fx):
    k = F.col("camera_id")
    host = F.when(k % 5 == 0, "http://other/").otherwise("http://img.host/")
    attrs = F.struct(F.concat(host, k.cast("string")).alias("IMG"), F.when(k % 3 == 0, "").otherwise(F.col("roadway")).alias("RT"), F.when(k % 2 == 0, "Southbound").alias("DIR"), F.lit("I-80 at 9th St").alias("DESCR"))
    feature = F.struct(attrs.alias("attributes"), F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")).alias("geometry"))
    d = docs(fx.camera, F.to_json(F.struct(F.array(feature).alias("features"))))
    return rounded(feeds.arcgis(d, {"image": "IMG", "roadway": "RT", "direction": "DIR", "location": "DESCR"}, "Layer", ("https://img.host/",)).select("image_url", "roadway", "direction", "lon"))


@query("s3_ohgo_feed", """SELECT concat('https://o/', CAST(camera_id AS VARCHAR), v) AS image_url, CASE v WHEN '/a' THEN 'I-70 at Main (North)' ELSE 'I-70 at Main' END AS location, CASE v WHEN '/a' THEN 'N' END AS direction, 'I-70' AS roadway FROM fx_camera, (VALUES ('/a'), ('/b')) t(v)""")
def s3(fx):
    k = F.col("camera_id").cast("string")
    views = F.array(F.struct(F.concat(F.lit("https://o:443/"), k, F.lit("/a")).alias("largeUrl"), F.lit("x").alias("smallUrl"), F.lit("North").alias("direction"), F.lit("I-70").alias("mainRoute")),
                    F.struct(F.lit("").alias("largeUrl"), F.concat(F.lit("https://o/"), k, F.lit("/b")).alias("smallUrl"), F.lit("View").alias("direction"), F.lit("I-70").alias("mainRoute")))
    cam = F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.lit("I-70 at Main").alias("location"), views.alias("cameraViews"))
    return feeds.ohgo(docs(fx.camera, F.to_json(F.struct(F.array(cam).alias("results")))), "OH").select("image_url", "location", "direction", "roadway")


@query("s4_tripcheck_feed", """SELECT concat('https://t/', CAST(camera_id AS VARCHAR)) AS image_url, roadway, CASE WHEN camera_id%2=0 THEN 'other' ELSE 'device' END AS location, CAST(camera_id%300 AS DOUBLE) AS mile_marker FROM fx_camera""")
def s4(fx):
    k = F.col("camera_id")
    cam = F.struct(F.concat(F.lit("http://t/"), k.cast("string")).alias("cctv-url"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.col("roadway").alias("route-id"),
                   F.when(k % 2 == 0, "other").alias("cctv-other"), F.lit("device").alias("device-name"), (k % 300).cast("string").alias("milepoint"))
    return feeds.tripcheck(docs(fx.camera, F.to_json(F.struct(F.array(cam).alias("CCTVInventoryRequest")))), "OR").select("image_url", "roadway", "location", "mile_marker")


@query("s5_c2c_status_feed", """SELECT concat('compass:NH/dev%20', CAST(camera_id AS VARCHAR)) AS image_url, CAST(floor(lat*1E6) AS BIGINT)/1E6 AS lat, roadway, CASE WHEN camera_id%2=0 THEN 'E' END AS direction, concat('dev ', CAST(camera_id AS VARCHAR)) AS location FROM fx_camera""")
def s5(fx):
    k = F.col("camera_id").cast("string")
    xml = F.concat(F.lit('<doc><cctvStatus id="dev '), k, F.lit('"><lat>'), F.floor(F.col("lat") * 1e6).cast("string"), F.lit("</lat><lon>"), F.floor(F.col("lon") * 1e6).cast("string"),
                   F.lit("</lon><equipLoc><roadway>"), F.col("roadway"), F.lit("</roadway><direction>"), F.when(F.col("camera_id") % 2 == 0, "EB").otherwise("?"), F.lit("</direction></equipLoc></cctvStatus></doc>"))
    return feeds.c2c_status(docs(fx.camera.withColumn("network", F.lit("NH")), xml, "network"), "NE").select("image_url", "lat", "roadway", "direction", "location")


@query("s6_dev511_feed", """SELECT concat('https://d/', CAST(camera_id AS VARCHAR), v) AS image_url, concat('Spot', CASE WHEN camera_id%2=0 THEN CASE v WHEN '/1' THEN ' (East)' ELSE ' (West)' END ELSE '' END) AS location, roadway FROM fx_camera, (VALUES ('/1'), ('/2')) t(v) WHERE v='/1' OR camera_id%2=0""")
def s6(fx):
    k = F.col("camera_id")
    view = lambda n, d, s: F.struct(F.concat(F.lit("https://d/"), k.cast("string"), F.lit(n)).alias("Url"), s.alias("Status"), F.lit(d).alias("Description"), F.lit("").alias("VideoUrl"))
    views = F.array(view("/1", "East", F.lit("Enabled")), view("/2", "West", F.when(k % 2 == 0, "Enabled").otherwise("Disabled")))
    cam = F.struct(F.col("lat").alias("Latitude"), F.col("lon").alias("Longitude"), F.lit(" Spot ").alias("Location"), F.col("roadway").alias("Roadway"), F.lit("N").alias("Direction"), views.alias("Views"))
    return feeds.dev511(docs(fx.camera, F.to_json(F.array(cam))), "511").select("image_url", "location", "roadway")


@query("s7_c2c_snapshots", "SELECT concat('d', CAST(camera_id AS VARCHAR)) AS device, concat('jpg', CAST(camera_id AS VARCHAR)) AS picture FROM fx_camera WHERE camera_id%3<>0")
def s7(fx):
    k = F.col("camera_id")
    data = F.when(k % 3 == 0, " ").otherwise(F.base64(F.concat(F.lit("jpg"), k.cast("string")).cast("binary")))
    xml = F.concat(F.lit('<doc><cctvSnapshot id="d'), k.cast("string"), F.lit('"><snippet>'), data, F.lit("</snippet></cctvSnapshot></doc>"))
    return feeds.c2c_snapshots(docs(fx.camera, xml)).select("device", F.col("picture").cast("string").alias("picture"))


@query("s8_traffic_counts", """SELECT aadt, CAST(2020+camera_id%5 AS BIGINT) AS year, roadway, CASE WHEN aadt*0.1E0<>0 THEN 10E0 END AS truck_pct, CAST(2 AS BIGINT) AS points FROM fx_camera WHERE aadt IS NOT NULL AND roadway<>'Main St'""")
def s8(fx):
    k = F.col("camera_id")
    attrs = F.struct(F.col("aadt").alias("AADT"), (F.col("aadt") * 0.1).alias("TRUCKS"), F.col("roadway").alias("NAME"), (2020 + k % 5).alias("YR"))
    paths = F.array(F.array(F.array("lon", "lat"), F.array(F.col("lon") + 0.01, F.col("lat"))), F.array(F.array("lon", "lat")))
    feature = F.struct(attrs.alias("attributes"), F.struct(paths.alias("paths")).alias("geometry"))
    out = feeds.traffic_counts(docs(fx.camera, F.to_json(F.struct(F.array(feature).alias("features")))), {"aadt": "AADT", "trucks": "TRUCKS", "roadway": "NAME", "year": "YR"}, "MAIN ST")
    return rounded(out.select("aadt", "year", "roadway", "truck_pct", F.size("coords").alias("points")))


def way_docs(fx):
    k = F.col("camera_id")
    pt = lambda a, b: F.struct((F.col("lat") + a).alias("lat"), (F.col("lon") + b).alias("lon"))
    tags = F.map_filter(F.create_map(
        F.lit("highway"), F.col("highway"), F.lit("oneway"), F.when(k % 4 == 0, "-1").when(k % 4 == 1, "yes"),
        F.lit("maxspeed"), F.when(k % 3 == 0, "45 mph").when(k % 3 == 1, "80").otherwise("signals"), F.lit("lanes"), F.when(k % 2 == 0, "3").otherwise("2;3")), lambda a, v: v.isNotNull())
    nodes = F.when(k % 10 == 9, F.array(k * 3)).otherwise(F.array(k * 3, k * 3 + 1, k * 3 + 2))
    way = F.struct(F.lit("way").alias("type"), k.alias("id"), nodes.alias("nodes"), F.array(pt(0.0, 0.0), pt(0.001, 0.0), pt(0.001, 0.002)).alias("geometry"), tags.alias("tags"))
    return docs(fx.camera, F.to_json(F.struct(F.array(way).alias("elements"))))


@query("s9_road_segments", f"""SELECT camera_id AS way_id, CAST(i AS BIGINT) AS seg_index, CASE WHEN camera_id%4=0 THEN camera_id*3+2-i ELSE camera_id*3+i END AS a, NOT (camera_id%4<2 OR highway IN ('motorway','motorway_link')) AS two_way, round(spd, 4)+0E0 AS maxspeed_kmh,
  CASE WHEN camera_id%3=2 THEN 'default' ELSE 'tag' END AS maxspeed_source, CAST(CASE WHEN camera_id%2=0 THEN 3 END AS BIGINT) AS lanes, {r('len', 3)} AS length_m FROM (SELECT *, CASE camera_id%3 WHEN 0 THEN 45E0*1.609344E0 WHEN 1 THEN 80E0
  ELSE CASE highway WHEN 'motorway' THEN 70E0 WHEN 'motorway_link' THEN 45E0 WHEN 'primary' THEN 45E0 ELSE 30E0 END*1.609344E0 END AS spd,
  CASE WHEN (i=0)=(camera_id%4<>0) THEN {hav_m('lat', 'lon', '(lat+0.001E0)', 'lon')} ELSE {hav_m('(lat+0.001E0)', 'lon', '(lat+0.001E0)', '(lon+0.002E0)')} END AS len FROM fx_camera, (VALUES (0), (1)) t(i) WHERE camera_id%10<>9)""")
def s9(fx):
    out = osm.road_segments(osm.ways(way_docs(fx)))
    return rounded(out.select("way_id", "seg_index", "a", "two_way", F.round("maxspeed_kmh", 4).alias("maxspeed_kmh"), "maxspeed_source", "lanes", F.round("length_m", 3).alias("length_m")))


@query("s12_graph_document", "SELECT src, dst, kind, length_m FROM fx_edge")
def s12(fx):
    lines = T.graph_document(fx.site_camera.select("site_id", "is_freeway"), fx.site_camera, fx.edge)
    return T.read_graph(lines)[1].select("src", "dst", "kind", "length_m")


@query("s13_count_documents", "SELECT camera_id AS id, aadt FROM fx_camera WHERE aadt IS NOT NULL")
def s13(fx):
    counts = fx.camera.filter(F.col("aadt").isNotNull()).select(F.col("region_id").cast("string").alias("region"), F.col("camera_id").alias("id"), "aadt", F.lit(1.0).alias("distance_m"), F.lit(True).alias("aligned"))
    schema = "region string, cameras map<string, struct<aadt: bigint, distance_m: double, aligned: boolean>>"
    back = T.pack_counts(counts).select(F.from_json("document", schema).alias("d")).select("d.*")
    return T.count_rows(back).select("id", "aadt")


@query("s14_national_index", "SELECT camera_id AS id, round(lat, 5)+0E0 AS lat FROM fx_camera")
def s14(fx):
    cams = fx.camera.select(F.col("source_id").alias("source"), F.col("camera_id").alias("id"), "lat", "lon")
    return T.unpack_index(T.pack_index(cams)).select("id", "lat")


@query("s16_region_overlay", "SELECT CAST(n_nationkey AS BIGINT) AS key, CASE WHEN n_nationkey%4=0 THEN concat('local ', n_name) ELSE n_name END AS name FROM nation")
def s16(fx):
    base = fx.region.select(F.col("region_id").cast("bigint").alias("key"), "name")
    local = base.filter(F.col("key") % 4 == 0).withColumn("name", F.concat(F.lit("local "), "name"))
    return T.overlay_regions(base, local)


@query("s17_incident_feed", """SELECT CAST(incident_id AS VARCHAR) AS id, CASE incident_id%3 WHEN 0 THEN 'Crash' WHEN 1 THEN 'Road Work' ELSE 'Incident' END AS type, location, incident_id%3<>1 AS road_relevant, incident_id%3<>1 AND incident_id%2=0 AS implies_closure FROM fx_incident WHERE incident_id%8<>0""")
def s17(fx):
    i = F.col("incident_id")
    rec = F.struct(i.cast("string").alias("id"), F.when(i % 8 == 0, 0.0).otherwise(F.col("lat")).alias("latitude"), F.when(i % 8 == 0, 0.0).otherwise(F.col("lon")).alias("longitude"),
                   F.when(i % 3 == 0, "Crash").when(i % 3 == 1, "Road Work").alias("category"), F.when(i % 2 == 0, " Closed ").otherwise("Open").alias("roadStatus"), F.col("location").alias("location"))
    d = fx.incident.select(F.to_json(F.struct(F.array(rec).alias("results"))).alias("body"))
    return feeds.ohgo_incidents(d).select("id", "type", "location", "road_relevant", "implies_closure")


@query("s18_frame_metrics", f"""SELECT vec_id, {r('b')} AS brightness, {r('sqrt(greatest(0E0, list_sum(list_transform(g, lambda v: (v-b)*(v-b)))/64E0))', 5)} AS contrast, {r('w/64E0')} AS white FROM (SELECT *, list_sum(g)/64E0 AS b FROM (
  SELECT vec_id, list_transform(px, lambda p: (0.299E0*p+0.587E0*p+0.114E0*p)/255E0) AS g, len(list_filter(px, lambda p: p>=183.6E0)) AS w FROM (SELECT vec_id, list_transform(embedding, lambda v: CAST(least(255E0, greatest(0E0, floor(CAST(v AS DOUBLE)*400E0+128E0))) AS DOUBLE)) AS px FROM embeddings)))""")
def s18(fx):
    level = lambda v: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor(v.cast("double") * 400.0 + 128.0).cast("double")))
    px = F.transform("embedding", lambda v: F.struct(level(v).alias("r"), level(v).alias("g"), level(v).alias("b")))
    out = frame_metrics(fx.table("embeddings").select("vec_id", px.alias("pixels")))
    return rounded(out.select("vec_id", "brightness", F.round("contrast", 5).alias("contrast"), "white"))


@query("s20_log_lines", f"SELECT poll_id, {r('diff')} AS diff FROM fx_poll WHERE poll_id%7<>0 AND poll_id%11<>0")
def s20(fx):
    i = F.col("poll_id")
    line = F.to_json(F.struct(i, F.when(i % 11 != 0, F.col("diff")).alias("diff")))
    lines = fx.poll.select(F.when(i % 7 == 0, F.expr("substring(to_json(struct(poll_id, diff)), 1, 9)")).otherwise(line).alias("value"))
    return rounded(T.json_lines(lines, "poll_id bigint, diff double", ["poll_id", "diff"]))


@query("s21_vote_exports", "SELECT count(*) AS votes FROM (SELECT DISTINCT epoch_us(o_orderdate)/1E6, o_custkey, o_custkey+1+o_orderkey%13 FROM orders)")
def s21(fx):
    side = lambda p: F.struct(F.col(f"{p}_id").alias("id"), F.col(f"{p}_x").alias("x"))
    body = F.to_json(F.struct(F.array(F.struct("ts", side("a").alias("a"), side("b").alias("b"), "pick")).alias("votes")))
    d = fx.vote.select(body.alias("body"))
    return T.votes(d.unionByName(d)).agg(F.count(F.lit(1)).alias("votes"))


@query("s22_merged_graphs", """SELECT (SELECT string_agg(n_name, ',' ORDER BY n_name) FROM nation) AS regions, (SELECT CAST(count(*) AS BIGINT) FROM fx_camera) AS cameras,
  (SELECT string_agg(concat(kind, '=', CAST(n AS VARCHAR)), ',' ORDER BY kind) FROM (SELECT kind, count(*) AS n FROM fx_edge GROUP BY kind)) AS edge_kinds""")
def s22(fx):
    n = fx.camera.groupBy("region_id").agg(F.count(F.lit(1)).alias("cameras"))
    e = fx.edge.groupBy("region_id").agg(F.count(F.lit(1)).alias("edges"))
    meta = fx.region.join(n, "region_id", "left").join(e, "region_id", "left").select(F.col("name").alias("region"), F.col("source_id").cast("string").alias("source"), F.col("cameras").alias("sites"), "cameras", "edges")
    kinds = fx.edge.groupBy("region_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    return T.merge_graphs(meta, kinds).select("regions", "cameras", "edge_kinds")


STEP = "list_reduce([{x}, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: xor(c >> 1, CAST(3988292384 AS BIGINT) * (c & 1)))"


@query("p1_stable_id", f"""SELECT camera_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(location, ''), lambda s: CAST(ascii(s) AS BIGINT))),
  lambda crc, b: {STEP.format(x='xor(crc, b)')}), CAST(4294967295 AS BIGINT)) % 9999991 AS id FROM fx_camera""")
def p1(fx):
    return fx.camera.select("camera_id", stable_id(F.col("location"), 9_999_991).alias("id"))


@query("p4_direction_letter", "SELECT poll_id, CASE poll_id%5 WHEN 0 THEN 'N' WHEN 1 THEN 'W' WHEN 2 THEN 'E' WHEN 3 THEN 'S' END AS letter, concat('h/', CAST(poll_id AS VARCHAR)) AS path FROM fx_poll")
def p4(fx):
    i = F.col("poll_id")
    word = F.when(i % 5 == 0, " North").when(i % 5 == 1, "WB").when(i % 5 == 2, "eastbound").when(i % 5 == 3, "sb ").otherwise("up")
    url = F.concat(F.when(i % 2 == 0, "http://h/").otherwise("https://h:443/"), i.cast("string"))
    return fx.poll.select("poll_id", direction_letter(word).alias("letter"), host_path(url).alias("path"))


@query("p9_plausible", "SELECT count(*) FILTER (WHERE lon>-170 AND lon<-60 AND lat>18 AND lat<72) AS kept, count(*) AS total FROM (SELECT CASE WHEN camera_id%9=0 THEN -lon ELSE lon END AS lon, CASE WHEN camera_id%13=0 THEN 0E0 ELSE lat END AS lat FROM fx_camera)")
def p9(fx):
    k = F.col("camera_id")
    c = fx.camera.select(F.when(k % 9 == 0, -F.col("lon")).otherwise(F.col("lon")).alias("lon"), F.when(k % 13 == 0, 0.0).otherwise(F.col("lat")).alias("lat"))
    return c.agg(F.count_if(plausible_us(F.col("lat"), F.col("lon"))).alias("kept"), F.count(F.lit(1)).alias("total"))


@query("p11_region_box", f"""SELECT region_id, {fixed('(lat-d)', 4)} AS south, {fixed('(lat+d)', 4)} AS north, {fixed('(lon-w)', 4)} AS west, {fixed('(lon+w)', 4)} AS east, regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g') AS slug FROM (
  SELECT *, 15E0/110.574E0 AS d, 15E0/(110.574E0*greatest(cos(radians(lat)), 0.01E0)) AS w FROM fx_region)""")
def p11(fx):
    return T.region_around(fx.region, 15.0).select("region_id", "south", "north", "west", "east", "slug")


@query("p46_city_regions", """SELECT g.region_id, CASE WHEN s.st IS NOT NULL THEN s.source END AS source FROM (SELECT region_id, concat('S', CAST(region_id%7 AS VARCHAR)) AS st FROM fx_region) g LEFT JOIN (VALUES ('a','S0'),('a','S1'),('b','S2'),('c','S4')) s(source, st) ON s.st=g.st""")
def p46(fx):
    places = fx.region.select("region_id", "name", F.concat(F.lit("S"), (F.col("region_id") % 7).cast("string")).alias("state"), "lat", "lon")
    sources = fx.spark.createDataFrame([("a", ["S0", "S1"]), ("b", ["S2"]), ("c", ["S4"])], "source string, states array<string>")
    return T.regions_for_places(places, sources, 15.0).select("region_id", "source")


@query("a12_catalog_summary", "SELECT count(*) AS cameras, count(CASE WHEN camera_id%3=0 THEN 1 END) AS with_video, count(CASE WHEN camera_id%5<>4 THEN 1 END) AS with_direction, count(CASE WHEN camera_id%7=0 THEN 1 END) AS with_mile_marker FROM fx_camera")
def a12(fx):
    k = F.col("camera_id")
    cams = fx.camera.select(F.when(k % 3 == 0, "v").alias("video_url"), F.when(k % 5 != 4, "N").alias("direction"), F.when(k % 7 == 0, 1.0).alias("mile_marker"))
    return api.catalog_summary(cams)


@query("a12_count_summary", """SELECT region_id, count(*) AS matched, min(aadt) AS least, max(aadt) AS most, count(*) FILTER (WHERE camera_id%2=0) AS aligned, max(CASE WHEN rn=n//2+1 THEN aadt END) AS median FROM (
  SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY aadt, camera_id) AS rn, count(*) OVER (PARTITION BY region_id) AS n FROM fx_camera WHERE aadt IS NOT NULL) GROUP BY region_id""")
def a12b(fx):
    counted = fx.camera.filter(F.col("aadt").isNotNull()).select("camera_id", "region_id", "aadt", (F.col("camera_id") % 2 == 0).alias("aligned"))
    return api.count_summary(counted)


@query("a13_region_coverage", """SELECT g.region_id, (SELECT count(*) FROM fx_camera c WHERE c.region_id=g.region_id) AS cameras, g.region_id%3=0 AND EXISTS (SELECT 1 FROM fx_edge e WHERE e.region_id=g.region_id) AS built, r.r_name AS source_name FROM fx_region g JOIN region r ON r.r_regionkey=g.source_id""")
def a13(fx):
    src = fx.table("region").select(F.col("r_regionkey").alias("source_id"), F.col("r_name").alias("source_name"))
    return api.regions(fx.region, src, fx.camera, fx.edge.filter(F.col("region_id") % 3 == 0)).select("region_id", "cameras", "built", "source_name")
