"""Landed agency documents to camera rows.

Every reader takes a DataFrame with a `body` column, one landed page or document a
row, and returns the same flat columns. Pages are bounded by the agency's page
size, so a row never grows with the feed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ID_MODULUS
from ..functions.text import direction_letter, host_path, leading_route, number, stable_id

COLUMNS = ["id", "lat", "lon", "image_url", "video_url", "roadway", "direction", "location", "mile_marker", "system"]


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _or(*cs: Column) -> Column:
    """The first text that is neither null nor empty, else an empty string."""
    return F.coalesce(*[F.when(c != "", c) for c in cs], F.lit(""))


def _none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _flat(df: DataFrame, **cols: Column) -> DataFrame:
    out = df.select(*[cols[c].alias(c) for c in COLUMNS])
    return out.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull() & (F.col("image_url") != ""))


def caltrans(documents: DataFrame) -> DataFrame:
    """District documents (S1). Needs a `district` column."""
    loc = "struct<latitude: string, longitude: string, route: string, routeSuffix: string, direction: string, locationName: string, nearbyPlace: string, milepost: string>"
    schema = f"data array<struct<cctv: struct<inService: string, location: {loc}, imageData: struct<streamingVideoURL: string, static: struct<currentImageURL: string>>>>>"
    c = documents.select("district", F.explode(F.from_json("body", schema)["data"]).alias("d")).select("district", "d.cctv.*").filter(F.col("inService") == "true")
    image, video = _text(F.col("imageData.static.currentImageURL")), F.col("imageData.streamingVideoURL")
    route = F.trim(F.concat(_text(F.col("location.route")), _text(F.col("location.routeSuffix"))))
    return _flat(c, id=stable_id(image, ID_MODULUS), lat=number(F.col("location.latitude")), lon=number(F.col("location.longitude")), image_url=image,
                 video_url=F.when(video.startswith("http"), video), roadway=route, direction=direction_letter(F.col("location.direction")),
                 location=_or(F.col("location.locationName"), F.col("location.nearbyPlace"), route), mile_marker=number(F.col("location.milepost")),
                 system=F.concat(F.lit("Caltrans District "), F.col("district").cast("string")))


def arcgis(documents: DataFrame, fields: dict[str, str], source_name: str, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Layer pages with field names from a table."""
    schema = "features array<struct<attributes: map<string, string>, geometry: struct<x: string, y: string>>>"
    f = documents.select(F.explode(F.from_json("body", schema)["features"]).alias("f")).select("f.*")
    attr = lambda k: F.col("attributes")[fields[k]] if k in fields else _none()
    image, video, place = _text(attr("image")), attr("video"), _text(attr("location"))
    out = _flat(f, id=stable_id(image, ID_MODULUS), lat=number(F.col("geometry.y")), lon=number(F.col("geometry.x")), image_url=image,
                video_url=F.when(video.startswith("http"), video), roadway=_or(attr("roadway"), leading_route(place)), direction=direction_letter(attr("direction")),
                location=place, mile_marker=number(attr("mile_marker")), system=_or(attr("system"), F.lit(source_name)))
    if prefixes:
        secure = F.regexp_replace("image_url", "^http://", "https://")
        keep = F.lit(False)
        for p in prefixes:
            keep = keep | secure.startswith(p)
        out = out.filter(keep)
    return out


def ohgo(documents: DataFrame, source_name: str) -> DataFrame:
    """Camera pages, one row a view (S3)."""
    view = "struct<largeUrl: string, smallUrl: string, direction: string, mainRoute: string>"
    schema = f"results array<struct<latitude: string, longitude: string, location: string, cameraViews: array<{view}>>>"
    c = documents.select(F.explode(F.from_json("body", schema)["results"]).alias("c")).select("c.*").withColumn("v", F.explode("cameraViews"))
    image = _or(F.col("v.largeUrl"), F.col("v.smallUrl"))
    place, facing = _or(F.col("location"), F.col("v.mainRoute")), _text(F.col("v.direction"))
    named = (facing != "") & ~facing.isin("View", "PTZ")
    return _flat(c, id=stable_id(host_path(image), ID_MODULUS), lat=number(F.col("latitude")), lon=number(F.col("longitude")),
                 image_url=F.regexp_replace(image, r"^(.*?):443/", "$1/"), video_url=_none(), roadway=leading_route(_or(F.col("v.mainRoute"), place)),
                 direction=direction_letter(facing), location=F.when(named, F.concat(place, F.lit(" ("), facing, F.lit(")"))).otherwise(place),
                 mile_marker=_none("double"), system=F.lit(source_name))


def tripcheck(documents: DataFrame, source_name: str) -> DataFrame:
    """Inventory document."""
    cam = "struct<`cctv-url`: string, latitude: string, longitude: string, `route-id`: string, `cctv-other`: string, `device-name`: string, milepoint: string>"
    c = documents.select(F.explode(F.from_json("body", f"CCTVInventoryRequest array<{cam}>")["CCTVInventoryRequest"]).alias("c")).select("c.*")
    image, route = _text(F.col("`cctv-url`")), _text(F.col("`route-id`"))
    return _flat(c, id=stable_id(host_path(image), ID_MODULUS), lat=number(F.col("latitude")), lon=number(F.col("longitude")),
                 image_url=F.regexp_replace(image, "^http://", "https://"), video_url=_none(), roadway=route, direction=_none(),
                 location=_or(F.col("`cctv-other`"), F.col("`device-name`"), route), mile_marker=number(F.col("milepoint")), system=F.lit(source_name))


def c2c_status(documents: DataFrame, source_name: str) -> DataFrame:
    """Status XML, one element a camera, coordinates in microdegrees (S5). Needs a `network` column."""
    schema = "cctvStatus array<struct<_id: string, lat: string, lon: string, name: string, equipLoc: struct<roadway: string, direction: string>>>"
    c = documents.select("network", F.explode(F.from_xml("body", schema)["cctvStatus"]).alias("c")).select("network", "c.*").filter(_text(F.col("_id")) != "")
    path = F.concat(F.lit("compass:"), "network", F.lit("/"), F.regexp_replace(F.url_encode("_id"), r"\+", "%20"))
    return _flat(c, id=stable_id(path, ID_MODULUS), lat=number(F.col("lat")) / 1e6, lon=number(F.col("lon")) / 1e6, image_url=path, video_url=_none(),
                 roadway=_text(F.col("equipLoc.roadway")), direction=direction_letter(F.col("equipLoc.direction")), location=F.trim(_or(F.col("name"), F.col("_id"))),
                 mile_marker=_none("double"), system=F.concat(F.lit(f"{source_name} "), "network"))


def c2c_snapshots(documents: DataFrame) -> DataFrame:
    """Pictures by device id; empty ones are dropped."""
    schema = "cctvSnapshot array<struct<_id: string, snippet: string>>"
    s = documents.select(F.explode(F.from_xml("body", schema)["cctvSnapshot"]).alias("s")).select("s.*")
    return s.filter(F.trim(_text(F.col("snippet"))) != "").select(F.col("_id").alias("device"), F.unbase64(F.trim("snippet")).alias("picture"))


def dev511(documents: DataFrame, source_name: str) -> DataFrame:
    """511 developer list, one row an enabled view."""
    view = "struct<Url: string, Status: string, Description: string, VideoUrl: string>"
    schema = f"array<struct<Latitude: string, Longitude: string, Location: string, Roadway: string, Direction: string, Views: array<{view}>>>"
    c = documents.select(F.explode(F.from_json("body", schema)).alias("c")).select("c.*")
    enabled = F.filter("Views", lambda v: (F.coalesce(v["Url"], F.lit("")) != "") & (F.coalesce(v["Status"], F.lit("Enabled")) == "Enabled"))
    c = c.withColumn("live", enabled).withColumns({"v": F.explode("live"), "n": F.size("live")})
    place, label = F.trim(_text(F.col("Location"))), F.trim(_text(F.col("v.Description")))
    return _flat(c, id=stable_id(host_path(F.col("v.Url")), ID_MODULUS), lat=number(F.col("Latitude")), lon=number(F.col("Longitude")), image_url=F.col("v.Url"),
                 video_url=F.when(F.col("v.VideoUrl") != "", F.col("v.VideoUrl")), roadway=_or(F.trim(_text(F.col("Roadway"))), leading_route(place)),
                 direction=direction_letter(F.col("Direction")), location=F.when((label != "") & (F.col("n") > 1), F.concat(place, F.lit(" ("), label, F.lit(")"))).otherwise(place),
                 mile_marker=_none("double"), system=F.lit(source_name))


READERS: dict[str, Callable[..., DataFrame]] = {
    "caltrans": caltrans, "arcgis": arcgis, "ohgo": ohgo, "tripcheck": tripcheck, "compass": c2c_status, "dev511": dev511}


def traffic_counts(documents: DataFrame, fields: dict[str, str], exclude: str | None = None) -> DataFrame:
    """Counted segments, one row a path; ramps, empty counts and single points are dropped."""
    schema = "features array<struct<attributes: map<string, string>, geometry: struct<paths: array<array<array<double>>>>>>"
    f = documents.select(F.explode(F.from_json("body", schema)["features"]).alias("f")).select("f.*")
    attr = lambda k: F.col("attributes")[fields[k]] if k in fields else _none()
    split = F.trim(F.concat(_text(attr("route_prefix")), F.lit(" "), _text(attr("route_number"))))
    aadt = number(attr("aadt"))
    f = f.filter(F.coalesce(aadt, F.lit(0.0)) != 0)
    if exclude:
        f = f.filter(~F.contains(F.upper(_text(attr("roadway"))), F.lit(exclude)))
    trucks = number(attr("trucks"))
    out = f.select(aadt.cast("bigint").alias("aadt"), number(attr("year")).cast("int").alias("year"), (F.trim(_text(attr("roadway"))) if "roadway" in fields else split).alias("roadway"),
                   F.trim(attr("county")).alias("county"), F.when(trucks != 0, F.bround(100.0 * trucks / aadt, 1)).alias("truck_pct"), F.explode("geometry.paths").alias("path"))
    return out.filter(F.size("path") >= 2).withColumn("coords", F.transform("path", lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))).drop("path")


def ohgo_incidents(documents: DataFrame) -> DataFrame:
    """Incident records; planned work is listed but neither road-relevant nor a closure."""
    rec = "struct<id: string, latitude: string, longitude: string, category: string, roadStatus: string, routeName: string, direction: string, location: string, description: string>"
    r = documents.select(F.explode(F.from_json("body", f"results array<{rec}>")["results"]).alias("r")).select("r.*")
    t = lambda c: F.when(F.trim(F.col(c)) != "", F.trim(F.col(c)))
    lat, lon, category = number(F.col("latitude")), number(F.col("longitude")), t("category")
    # Words that mark planned work.
    planned = F.coalesce(category.rlike(r"(?i)\b(repairs?|maintenance|construction|road ?work|work ?zone)\b"), F.lit(False))
    place = F.concat_ws(" ", t("routeName"), t("direction"), t("location"))
    out = r.select(F.coalesce(t("id"), F.concat_ws(",", lat, lon)).alias("id"), F.coalesce(category, F.lit("Incident")).alias("type"),
                   F.when(place != "", place).otherwise("Ohio").alias("location"), lat.alias("lat"), lon.alias("lon"), F.lit(None).cast("double").alias("reported_at"),
                   t("description").alias("remarks"), category.alias("label"), (~planned).alias("road_relevant"),
                   (~planned & (F.lower(F.coalesce(t("roadStatus"), F.lit(""))) == "closed")).alias("implies_closure"))
    return out.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon") & ~((F.col("lat") == 0) & (F.col("lon") == 0)))
