"""Typed tables in and out: catalogs, graphs, counts, national index, sources, regions, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import with_fixed
from ..functions.text import slug

CATALOG_SCHEMA = ("id bigint, region string, source string, image_path string, roadway string, direction string, location string, lat double, lon double, "
                  "video_url string, video_auth boolean, link_id string, source_system string, mile_marker double")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Camera catalogs as written, one JSON list a file; a wrong type fails the read."""
    return spark.read.schema(CATALOG_SCHEMA).option("mode", "FAILFAST").option("multiLine", True).json(path)


def select_cameras(cameras: DataFrame, choice: str) -> DataFrame:
    """all, freeway, or explicit ids; an id that is not there is an error when the plan runs."""
    if choice == "all":
        return cameras
    if choice == "freeway":
        return cameras.filter("is_freeway")
    wanted = sorted({int(x) for x in choice.split(",") if x.strip().lstrip("-").isdigit()})
    ids = cameras.sparkSession.createDataFrame([(i,) for i in wanted], "camera_id bigint")
    found = ids.join(cameras.withColumn("_there", F.lit(True)), "camera_id", "left")
    missing = F.assert_true(F.col("_there").isNotNull(), F.concat(F.lit("camera not in the selected regions: "), F.col("camera_id").cast("string")))
    return found.filter(missing.isNull()).drop("_there")


def build_work_list(regions: DataFrame, catalogs: DataFrame, graphs: DataFrame) -> DataFrame:
    """Regions with a catalog and no graph yet."""
    return (regions.select("region_id").join(catalogs.select("region_id").distinct(), "region_id", "left_semi")
            .join(graphs.select("region_id").distinct(), "region_id", "left_anti"))


def counts_missing(regions: DataFrame, sources: DataFrame, counted: DataFrame) -> DataFrame:
    """Regions whose source publishes counts that have not been joined yet."""
    able = regions.join(sources.filter("has_counts").select("source_id"), "source_id", "left_semi")
    return able.join(counted.select("region_id").distinct(), "region_id", "left_anti").select("region_id")


def pack_index(cameras: DataFrame, block: int = 50_000) -> DataFrame:
    """Positions as parallel arrays per source, cut in blocks so that no row grows with a source."""
    part = F.struct("id", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"))
    packed = cameras.groupBy("source", F.floor(F.col("id") / block).alias("block")).agg(F.array_sort(F.collect_list(part)).alias("p"))
    return packed.select("source", "block", F.col("p.id").alias("ids"), F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"))


def unpack_index(index: DataFrame) -> DataFrame:
    """Positions from parallel arrays; arrays of unequal length are an error."""
    equal = (F.size("ids") == F.size("lat")) & (F.size("ids") == F.size("lon"))
    check = F.assert_true(equal, F.lit("index arrays differ in length"))
    zipped = F.arrays_zip("ids", "lat", "lon")
    return index.filter(check.isNull()).select("source", F.inline(zipped)).withColumnRenamed("ids", "id")


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """Traffic counts keyed by camera id, one row a camera."""
    schema = "region string, source string, cameras map<string, struct<aadt: bigint, year: int, county: string, truck_pct: double, distance_m: double, aligned: boolean>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    return count_rows(raw)


def count_rows(raw: DataFrame) -> DataFrame:
    return raw.select("region", F.explode("cameras").alias("id", "c")).select("region", F.col("id").cast("bigint").alias("id"), "c.*")


def pack_counts(counts: DataFrame, buckets: int = 64) -> DataFrame:
    """Counts back to documents keyed by id, several a region."""
    entry = F.struct(F.col("id").cast("string").alias("key"), F.struct("aadt", "distance_m", "aligned").alias("value"))
    packed = counts.groupBy("region", F.pmod(F.col("id"), F.lit(buckets)).alias("bucket")).agg(F.map_from_entries(F.collect_list(entry)).alias("cameras"))
    return packed.select("region", F.to_json(F.struct("region", "cameras")).alias("document"))


def overlay(published: DataFrame, local: DataFrame, key: str) -> DataFrame:
    """Published rows with local ones beside them; a key in both is an error when the plan runs."""
    flagged = published.withColumn("local", F.lit(False)).unionByName(local.withColumn("local", F.lit(True)))
    clash = flagged.join(published.select(key).join(local.select(key), key).withColumn("_clash", F.lit(True)), key, "left")
    ok = F.assert_true(F.col("_clash").isNull(), F.concat(F.lit("local rows redefine "), F.col(key).cast("string")))
    return clash.filter(ok.isNull()).drop("_clash")


def overlay_regions(published: DataFrame, local: DataFrame) -> DataFrame:
    """Regions where a later file's row replaces an earlier one's."""
    cols = [c for c in published.columns if c != "key"]
    both = published.withColumn("_p", F.lit(0)).unionByName(local.withColumn("_p", F.lit(1)))
    return both.groupBy("key").agg(F.max_by(F.struct(*cols), "_p").alias("r")).select("key", "r.*")


def merge_graphs(meta: DataFrame, kinds: DataFrame) -> DataFrame:
    """One summary of several region graphs (S22). `meta`: a row a region, a short list."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    total = meta.agg(joined("region").alias("regions"), joined("source").alias("sources"), F.sum("sites").alias("sites"), F.sum("cameras").alias("cameras"), F.sum("edges").alias("edges"))
    counted = kinds.groupBy("kind").agg(F.sum("n").alias("n"))
    packed = counted.agg(F.array_join(F.array_sort(F.collect_list(F.concat("kind", F.lit("="), F.col("n").cast("string")))), ",").alias("edge_kinds"))
    return total.join(F.broadcast(packed), F.lit(True))


def graph_document(sites: DataFrame, site_cameras: DataFrame, edges: DataFrame) -> DataFrame:
    """A graph as JSON lines: a line a site with its cameras and a line an edge."""
    held = site_cameras.groupBy("site_id").agg(F.array_sort(F.collect_list("camera_id")).alias("cameras"))
    s = sites.join(held, "site_id").select(F.lit("site").alias("part"), F.to_json(F.struct(*[c for c in sites.columns], "cameras")).alias("line"))
    e = edges.select(F.lit("edge").alias("part"), F.to_json(F.struct("src", "dst", "kind", F.round("length_m", 1).alias("length_m"), F.round("tt_s", 1).alias("tt_s"))).alias("line"))
    return s.unionByName(e)


def read_graph(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sites with their cameras, and edges, from the JSON lines of a graph."""
    s = lines.filter(F.col("part") == "site").select(F.from_json("line", "site_id bigint, is_freeway boolean, cameras array<bigint>").alias("d")).select("d.*")
    e = lines.filter(F.col("part") == "edge").select(F.from_json("line", "src bigint, dst bigint, kind string, length_m double, tt_s double").alias("d")).select("d.*")
    return s, e


GRAPH_VERSION = 1
#: Rows of the parts of a graph document.
GRAPH_ROWS = {
    "meta": "name: string, source: string, sites: bigint, cameras: bigint, edges: bigint",
    "sites": "id: bigint, lat: double, lon: double, is_freeway: boolean, cameras: array<bigint>",
    "cameras": "id: bigint, roadway: string, location: string, lat: double, lon: double, site: bigint, is_freeway: boolean, has_video: boolean",
    "edges": "src: bigint, dst: bigint, kind: string, length_m: double, tt_s: double",
}


def graph_sections(region_parts: dict[str, DataFrame], size: int = 5000) -> DataFrame:
    """A region's graph as sections of a document: region, part, section and one JSON line.

    `region_parts` holds meta, sites, cameras and edges, each with `region_id` and the
    columns of GRAPH_ROWS. A part of more than `size` rows is cut into several
    sections by a hash of its rows, so no line grows with its region.
    """
    out = None
    for part, ddl in GRAPH_ROWS.items():
        row = F.struct(*[F.col(c.split(":")[0].strip()) for c in ddl.replace("array<bigint>", "array").split(", ")])
        df = region_parts[part].select("region_id", row.alias("row"))
        n = df.groupBy("region_id").agg(F.ceil(F.count(F.lit(1)) / size).alias("_n"))
        cut = df.join(n, "region_id").withColumn("section", F.pmod(F.xxhash64("row"), F.col("_n")))
        rows = cut.groupBy("region_id", "section").agg(F.collect_list("row").alias("rows"))
        lines = rows.select("region_id", F.lit(part).alias("part"), "section", F.to_json(F.struct(F.lit(GRAPH_VERSION).alias("version"), "rows")).alias("line"))
        out = lines if out is None else out.unionByName(lines)
    return out


def graph_part(sections: DataFrame, part: str) -> DataFrame:
    """The rows of one part of graph documents; a section that is damaged or of another version fails with its place."""
    told = F.from_json("line", f"version int, rows array<struct<{GRAPH_ROWS[part]}>>")
    place = F.concat_ws("/", F.lit("damaged graph section"), F.col("region_id").cast("string"), "part", F.col("section").cast("string"))
    read = sections.filter(F.col("part") == part).withColumn("_told", told)
    fine = (F.col("_told.version") == GRAPH_VERSION) & F.col("_told.rows").isNotNull() & ~F.exists("_told.rows", lambda r: r.isNull())
    check = F.assert_true(F.coalesce(fine, F.lit(False)), place)
    return read.filter(check.isNull()).select("region_id", F.inline("_told.rows"))


def json_lines(lines: DataFrame, schema: str, required: list[str]) -> DataFrame:
    """Log lines; a line cut short or without a required field is skipped."""
    parsed = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    keep = F.lit(True)
    for c in required:
        keep = keep & F.col(c).isNotNull()
    return parsed.filter(keep)


def write_log(rows: DataFrame, at: Column, path: str) -> None:
    """Append a decision log, one folder a day."""
    rows.withColumn("day", F.to_date(F.timestamp_seconds(at))).write.mode("append").partitionBy("day").json(path)


VOTE_SIDE = "struct<id: bigint, attention: double, equation: double, look: struct<level: double, levels: int, confidence: double, at: double>, x: array<double>>"
VOTE_SCHEMA = f"votes array<struct<ts: double, a: {VOTE_SIDE}, b: {VOTE_SIDE}, pick: string, mode: string, stratum: string>>"


def votes(documents: DataFrame) -> DataFrame:
    """Choices from export documents; the same choice exported twice counts once."""
    v = documents.select(F.explode(F.from_json("body", VOTE_SCHEMA)["votes"]).alias("v")).select("v.*")
    return v.withColumns({"a_id": F.col("a.id"), "b_id": F.col("b.id")}).dropDuplicates(["ts", "a_id", "b_id"])


def region_around(places: DataFrame, radius_km: float) -> DataFrame:
    """Box, key and center of a region around each place."""
    d = F.lit(radius_km / 110.574)
    w = radius_km / (110.574 * F.greatest(F.cos(F.radians("lat")), F.lit(0.01)))
    out = with_fixed(places, 4, south=F.col("lat") - d, north=F.col("lat") + d, west=F.col("lon") - w, east=F.col("lon") + w)
    return with_fixed(out.withColumn("slug", slug(F.col("name"))), 6, center_lat=F.col("lat"), center_lon=F.col("lon")).withColumn("radius_km", F.lit(radius_km))


def covered_regions(places: DataFrame, sources: DataFrame, radius_km: float) -> DataFrame:
    """regions_for_places, refused with the place's name where no source covers its state."""
    found = regions_for_places(places, sources, radius_km)
    refused = F.assert_true(F.col("source").isNotNull(), F.concat(F.lit("no source covers "), F.col("name")))
    return found.filter(refused.isNull())


def regions_for_places(places: DataFrame, sources: DataFrame, radius_km: float) -> DataFrame:
    """Regions for geocoded places, on the source that covers their state; null where none does.

    Sources are a short hand-written table.
    """
    cover = sources.select("source", F.explode("states").alias("state")).groupBy("state").agg(F.max("source").alias("source"))
    return region_around(places, radius_km).join(F.broadcast(cover), "state", "left")


def state_outlines(documents: DataFrame) -> DataFrame:
    """State polygons with their rings as (x, y) points and the center of their box."""
    schema = "states array<struct<code: string, name: string, rings: array<array<array<double>>>>>"
    s = documents.select(F.explode(F.from_json("body", schema)["states"]).alias("s")).select("s.*")
    rings = F.transform("rings", lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    s = s.withColumn("rings", rings).withColumn("points", F.flatten("rings"))
    mid = lambda c: (F.array_min(F.transform("points", lambda p: p[c])) + F.array_max(F.transform("points", lambda p: p[c]))) / 2.0
    return s.withColumns({"center_x": mid("x"), "center_y": mid("y")}).drop("points")
