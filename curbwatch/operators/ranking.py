"""Rankings, caps, tiers and selections. Every order has a full tie-break."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import RANKING, SCORE
from ..functions.geo import haversine_km, plausible_us
from ..functions.scoring import is_held
from .scale import chunk_rank, top_per

def score_order(score: str = "attention", key: str = "camera_id") -> list[Column]:
    return [F.col(score).desc(), F.col(key).asc()]


def rank_scores(df: DataFrame, keys: Sequence[str], score: str = "attention", rank: str = "rank") -> DataFrame:
    """Exact rank by score, then id, for keys of any size."""
    coarse = [("_score", F.col(score), True), ("_ids", F.floor(F.col("camera_id") / 100_000), False)]
    return chunk_rank(df, keys, coarse, score_order(score), rank)


def cap_held(df: DataFrame, keys: Sequence[str], limit: int | Column) -> DataFrame:
    """Held cameras beyond the limit compete on movement alone.

    Adds `capped` and `rank_score`; `attention` keeps the original.
    """
    held = df.filter(is_held(F.col("attention"))).select(*keys, "camera_id", "attention")
    if isinstance(limit, int):
        # Only the first few matter, and Spark keeps no more than that per task before the shuffle.
        first = top_per(held, keys, score_order(), limit) if keys else held.orderBy(*score_order()).limit(limit)
        out = df.join(first.select("camera_id", F.lit(True).alias("_kept")), "camera_id", "left")
        capped = is_held(F.col("attention")) & F.col("_kept").isNull()
    else:
        coarse = [("_score", F.col("attention"), True), ("_ids", F.floor(F.col("camera_id") / 100_000), False)]
        rank = chunk_rank(held, keys, coarse, score_order(), "_kept")
        out = df.join(rank.select("camera_id", "_kept"), "camera_id", "left")
        capped = F.coalesce(F.col("_kept") > limit, F.lit(False))
    fallback = SCORE.band * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("movement", F.lit(0.0))))
    return out.withColumns({"capped": capped, "rank_score": F.when(capped, fallback).otherwise(F.col("attention"))}).drop("_kept")


def wall_tiers(scored: DataFrame, keys: Sequence[str], previous: DataFrame, capped: bool = True) -> DataFrame:
    """Tile size of every scored camera, with hysteresis against its last size."""
    n = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    big = F.greatest(F.lit(2), F.floor(F.col("n") / 26.0 + 0.5))
    wide = F.greatest(F.lit(4), F.floor(F.col("n") / 9.0 + 0.5))
    sized = n.withColumns({"big": big, "wide": wide}).drop("n")
    df = scored.join(sized, list(keys)) if keys else scored.crossJoin(sized)
    if capped:
        df = cap_held(df, keys, F.floor((F.col("big") + F.col("wide")) / 2.0))
    else:
        df = df.withColumn("rank_score", F.col("attention"))
    coarse = [("_score", F.col("rank_score"), True), ("_att", F.col("attention"), True), ("_ids", F.floor(F.col("camera_id") / 100_000), False)]
    df = chunk_rank(df, keys, coarse, [F.col("rank_score").desc(), F.col("attention").desc(), F.col("camera_id")], "position")
    df = df.withColumn("position", F.col("position") - 1)
    df = df.join(previous.select("camera_id", F.col("tier").alias("was")), "camera_id", "left")
    was = F.coalesce("was", F.lit("unit"))
    h = RANKING.hysteresis
    big_edge = F.col("big") + F.when(was == "big", h).otherwise(0)
    wide_edge = F.col("big") + F.col("wide") + F.when(was == "unit", 0).otherwise(h)
    tier = F.when(F.col("position") < big_edge, "big").when(F.col("position") < wide_edge, "wide").otherwise("unit")
    return df.withColumns({"tier": tier, "top": F.col("position") < F.col("big")}).drop("was", "big", "wide")


def top_regions(scored: DataFrame, k: int = RANKING.scores_per_region) -> DataFrame:
    """The first k cameras of every region (K3)."""
    return top_per(scored.filter(F.col("attention").isNotNull()), ["region_id"], score_order(), k, "rank")


def board(scored: DataFrame, now: Column, region: int | None = None, source: int | None = None,
          max_age_s: float = RANKING.board_max_age_s) -> DataFrame:
    """The national board: recent, scored, filtered, held places capped, thirty tiles (K2).

    The row keeps its own attention even where the cap moved it down.
    """
    live = scored.filter(F.col("attention").isNotNull() & F.col("last_at").isNotNull() & (now - F.col("last_at") <= max_age_s))
    if region is not None:
        live = live.filter(F.col("region_id") == region)
    if source is not None:
        live = live.filter(F.col("source_id") == source)
    capped = cap_held(live, [], RANKING.board_size // 2)
    return capped.orderBy(F.col("rank_score").desc(), F.col("attention").desc(), F.col("camera_id")).limit(RANKING.board_size)


def board_filters(scored: DataFrame, now: Column, max_age_s: float = RANKING.board_max_age_s) -> DataFrame:
    """Regions and sources that have any scored camera, whatever the filter in force (K2)."""
    live = scored.filter(F.col("attention").isNotNull() & (now - F.col("last_at") <= max_age_s))
    return live.select("source_id", "region_id").distinct()


def decision_log(scored: DataFrame, top: int = RANKING.log_top) -> DataFrame:
    """The top thirty of one ranking, ranked from zero."""
    first = scored.filter(F.col("attention").isNotNull()).orderBy(*score_order()).limit(top)
    return top_per(first.withColumn("_all", F.lit(0)), ["_all"], score_order(), top, "rank").withColumn("rank", F.col("rank") - 1).drop("_all")


def radar_anchors(priors: DataFrame, watched: DataFrame, elapsed_s: float, per_region: int = RANKING.radar_per_region) -> DataFrame:
    """A rotating sample of each unwatched region's cameras, biggest roads first (K4)."""
    idle = priors.join(watched.select("region_id"), "region_id", "left_anti")
    coarse = [("_prior", F.col("scale_prior"), True), ("_ids", F.floor(F.col("camera_id") / 100_000), False)]
    ranked = chunk_rank(idle, ["region_id"], coarse, [F.col("scale_prior").desc(), F.col("camera_id")], "place")
    size = ranked.groupBy("region_id").agg(F.count(F.lit(1)).alias("n"))
    offset = int(max(0.0, elapsed_s) // RANKING.radar_rotate_s) * per_region
    turn = F.pmod(F.col("place") - 1 - (F.lit(offset) % F.col("n")), F.col("n"))
    return ranked.join(size, "region_id").withColumn("turn", turn).filter(F.col("turn") < per_region).drop("n", "place")


def review_leaders(scored: DataFrame, now: Column, period: Column, k: int) -> DataFrame:
    """Each region's leaders by the plain equation among cameras with a recent picture (K8)."""
    live = scored.filter(F.col("attention").isNotNull() & F.col("diff").isNotNull() & (now - F.col("last_at") <= 3.0 * period))
    return top_per(live, ["region_id"], score_order("equation"), k, "rank")


def relay_cameras(scored: DataFrame, k: int = RANKING.relay_cameras) -> DataFrame:
    """The five most interesting cameras of each city."""
    return top_per(scored.withColumn("shown", F.coalesce("attention", F.lit(0.0))), ["region_id"], score_order("shown"), k, "rank").drop("shown")


def tile_flags(scored: DataFrame, now: Column, period: Column) -> DataFrame:
    """Stale after three periods, hot above .72."""
    return scored.withColumns({
        "stale": F.coalesce(now - F.col("last_at") > SCORE.stale_periods * period, F.lit(False)),
        "hot": F.coalesce(F.col("activity") > SCORE.hot_activity, F.lit(False))})


def flow_union(queues: DataFrame, promoted: DataFrame) -> DataFrame:
    """Attention flows between cameras; a queue wins over a promotion of the same pair (D3)."""
    return queues.unionByName(promoted.join(queues.select("from_id", "to_id"), ["from_id", "to_id"], "left_anti"))


def priority_claims(claims: DataFrame, now: Column) -> DataFrame:
    """Cameras some unexpired claim holds."""
    return claims.filter(now < F.col("expires")).select("camera_id").distinct()


def latest_records(records: DataFrame) -> DataFrame:
    """One row per id, the last by ordinal."""
    cols = [c for c in records.columns if c not in ("id", "ordinal")]
    return records.groupBy("id").agg(F.max(F.struct("ordinal", *cols)).alias("r")).select("id", "r.*")


def one_per_id(cameras: DataFrame) -> DataFrame:
    """One row per camera id, the first listed; a second image under one id is a collision."""
    cols = [c for c in cameras.columns if c not in ("id", "ordinal")]
    return cameras.groupBy("id").agg(F.min(F.struct("ordinal", *cols)).alias("r")).select("id", "r.*")


def id_collisions(cameras: DataFrame) -> DataFrame:
    """Ids under which different images were listed."""
    out = cameras.groupBy("id").agg(F.min("image_url").alias("first_url"), F.max("image_url").alias("other_url"), F.count(F.lit(1)).alias("listed"))
    return out.filter(F.col("first_url") != F.col("other_url"))


def renumber(cameras: DataFrame, sources: DataFrame, block: int) -> DataFrame:
    """Ids in the global space: published sources in alphabetical order, then local ones.

    The source table is a short hand-written list.
    """
    ordered = sources.select("source", (F.row_number().over(Window.orderBy(F.col("local"), F.col("source"))) - 1).alias("block"))
    return cameras.join(F.broadcast(ordered), "source").withColumn("uid", F.col("block").cast("bigint") * block + F.col("id"))


def catalog_of(regions: DataFrame, points: DataFrame) -> DataFrame:
    """Cameras of each region: plausible, contained, nearest the center first, up to its limit (K1, P10).

    `regions` has south, west, north, east and nullable center_lat, center_lon, radius_km, keep.
    """
    r = regions.select("region_id", "south", "west", "north", "east", "center_lat", "center_lon", "radius_km", "keep")
    r = (r.withColumn("gy", F.explode(F.sequence(F.floor("south"), F.floor("north"))))
         .withColumn("gx", F.explode(F.sequence(F.floor("west"), F.floor("east")))))
    p = points.filter(plausible_us(F.col("lat"), F.col("lon"))).withColumns({"gy": F.floor("lat"), "gx": F.floor("lon")})
    km = haversine_km(F.col("center_lat"), F.col("center_lon"), F.col("lat"), F.col("lon"))
    near = (p.join(r, ["gy", "gx"])
            .filter(F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("west"), F.col("east")))
            .withColumn("km", km).filter(F.col("center_lat").isNull() | F.col("radius_km").isNull() | (F.col("km") <= F.col("radius_km"))))
    # Nearest first; without a center the feed's own order stands. Rings of 50 m, then blocks of feed order.
    near = near.withColumn("far", F.coalesce("km", F.lit(0.0)))
    coarse = [("_ring", F.when(F.col("km").isNull(), F.floor(F.col("ordinal") / 100_000)).otherwise(F.floor(F.col("far") * 20.0)), False)]
    by = [F.col("far"), F.col("ordinal")]
    ranked = chunk_rank(near, ["region_id"], coarse, by, "place")
    limit = F.when(F.coalesce("keep", F.lit(0)) > 0, F.col("keep"))
    return ranked.filter(limit.isNull() | (F.col("place") <= limit)).drop("gy", "gx", "south", "west", "north", "east", "far")

