"""The endpoints of the domain as DataFrame functions, each a short composition of operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RANKING
from ..operators import city as C
from ..operators import floors as L
from ..operators import ranking as R


def regions(region: DataFrame, source: DataFrame, cameras: DataFrame, graphs: DataFrame) -> DataFrame:
    """Served regions with their source's terms, cameras and whether a graph is built."""
    n = cameras.groupBy("region_id").agg(F.count(F.lit(1)).alias("cameras"))
    built = graphs.select("region_id", F.lit(True).alias("built")).distinct()
    return (region.join(F.broadcast(source), "source_id", "left").join(n, "region_id", "left").join(built, "region_id", "left")
            .fillna(0, ["cameras"]).fillna(False, ["built"]))


def sources(source: DataFrame, cameras: DataFrame) -> DataFrame:
    """Sources with how many cameras each publishes."""
    n = cameras.groupBy("source_id").agg(F.count(F.lit(1)).alias("cameras"))
    return source.join(n, "source_id", "left").fillna(0, ["cameras"])


def catalog_summary(cameras: DataFrame) -> DataFrame:
    """Totals of a catalog: video, direction and mile marker fill."""
    filled = lambda c: F.count(F.col(c))
    return cameras.agg(F.count(F.lit(1)).alias("cameras"), filled("video_url").alias("with_video"), filled("direction").alias("with_direction"), filled("mile_marker").alias("with_mile_marker"))


def count_summary(counted: DataFrame) -> DataFrame:
    """Matched counts per region: least, upper median, most, and how many are aligned."""
    from ..operators.scale import chunk_rank
    ranked = chunk_rank(counted, ["region_id"], [("_b", F.floor(F.log10(1.0 + F.col("aadt")) * 50.0), False)], [F.col("aadt"), F.col("camera_id")], "place")
    n = counted.groupBy("region_id").agg(F.count(F.lit(1)).alias("matched"), F.min("aadt").alias("least"), F.max("aadt").alias("most"), F.count_if("aligned").alias("aligned"))
    middle = ranked.join(n.select("region_id", "matched"), "region_id").filter(F.col("place") == F.floor(F.col("matched") / 2) + 1)
    return n.join(middle.select("region_id", F.col("aadt").alias("median")), "region_id")


def index_summary(index: DataFrame) -> DataFrame:
    """Cameras and blocks of each source in the national index."""
    return index.groupBy("source").agg(F.sum(F.size("ids")).alias("cameras"), F.count(F.lit(1)).alias("blocks"))


def incidents(feed: DataFrame, region: DataFrame, key: int) -> DataFrame:
    """Incidents near one city."""
    return L.incidents_near_regions(feed, region.filter(F.col("region_id") == key))


def scores(scored: DataFrame, region: DataFrame, watched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Region summaries and the first fifteen cameras of each watched region (A4, K3)."""
    live = scored.join(watched.select("region_id"), "region_id", "left_semi")
    return C.region_summary(region.join(watched.select("region_id"), "region_id", "left_semi"), live), R.top_regions(live)


def board(scored: DataFrame, now: Column, region: int | None = None, source: int | None = None) -> DataFrame:
    """The national board under a filter (K2)."""
    return R.board(scored, now, region, source, RANKING.board_max_age_s)


def frames(ring: DataFrame, camera_id: int) -> DataFrame:
    """The kept frames of one camera, oldest first."""
    return ring.filter(F.col("camera_id") == camera_id).orderBy("k")


def frame(ring: DataFrame, camera_id: int, k: int = -1) -> DataFrame:
    """Frame k of one camera; a negative k counts from the newest."""
    return ring.filter((F.col("camera_id") == camera_id) & (F.col("negative_k" if k < 0 else "k") == k))
