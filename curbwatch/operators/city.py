"""City aggregates: score summaries, pulse, sky, diary, counts, density, load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CITY
from ..functions.geo import haversine_km, solar_elevation
from ..functions.numeric import array_median, with_fixed
from .ranking import score_order
from .scale import group_median, running, top_per, with_halo


def region_summary(regions: DataFrame, scored: DataFrame) -> DataFrame:
    """Scored count, leader, mean of the top five, floored and ambiguously still cameras per region; empty regions stay (A4)."""
    live = scored.filter(F.col("attention").isNotNull())
    five = top_per(live, ["region_id"], score_order(), 5, "rank").groupBy("region_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("camera_id"))).alias("top_camera"),
        F.max(F.when(F.col("rank") == 1, F.col("attention"))).alias("top_attention"), F.avg("attention").alias("top5_mean"))
    counts = live.groupBy("region_id").agg(F.count(F.lit(1)).alias("scored"), F.count_if(F.col("incident_floor") > 0).alias("incident_floored"), F.count_if("ambiguous").alias("still"))
    out = regions.select("region_id").join(counts, "region_id", "left").join(five, "region_id", "left")
    return out.fillna(0, ["scored", "incident_floored", "still"]).fillna(0.0, ["top5_mean"])


def newest_per_minute(frames: DataFrame, recent_s: float) -> DataFrame:
    """For every minute, each camera's newest frame not older than `recent_s` (state a once-a-minute look sees).

    A frame counts from the minute it arrives until the camera's next frame or its
    age limit, so each frame is spread over a bounded number of minutes. When a
    minute holds two frames of a camera, the later one wins.
    """
    first = F.ceil(F.col("at") / 60.0)
    last = F.floor((F.col("at") + recent_s) / 60.0)
    cols = [c for c in frames.columns if c not in ("camera_id", "at")]
    # Of the frames that arrive in one minute only the newest can win a minute, so the others are dropped before the spread.
    arrived = frames.groupBy("camera_id", first.alias("_minute")).agg(F.max(F.struct("at", *cols)).alias("f")).select("camera_id", "f.*")
    spread = arrived.withColumn("minute", F.explode(F.when(first <= last, F.sequence(first, last))))
    newest = spread.groupBy("camera_id", "minute").agg(F.max(F.struct("at", *cols)).alias("f"))
    return newest.select("camera_id", "minute", "f.*")


def pulse(frames: DataFrame, cameras: DataFrame) -> DataFrame:
    """Median frame difference per city and minute over cameras seen in five minutes, two cameras at least (A2, T4)."""
    seen = newest_per_minute(frames.select("camera_id", "at", "poll_id", "diff"), CITY.pulse_recent_s)
    placed = seen.join(cameras.select("camera_id", "region_id"), "camera_id").filter(F.col("diff").isNotNull())
    med = group_median(placed, ["region_id", "minute"], "diff", "median", 1e-3)
    med = med.filter(F.col("median_n") >= CITY.pulse_min_cameras)
    out = with_fixed(med, 5, diff=F.col("median"))
    return out.select("region_id", (F.col("minute") * 60.0).alias("at"), "diff", F.col("median_n").alias("cameras"))


def sky(regions: DataFrame, frames: DataFrame, cameras: DataFrame, now: Column, recent_s: float = CITY.sky_recent_s) -> DataFrame:
    """Brightness, murk and snow per city from recent pictures (A3).

    `frames` has contrast and white beside brightness. Histories are the newest 24
    values a camera holds; the newest itself is judged, not part of its own median.
    """
    recent = top_per(frames, ["camera_id"], [F.col("at").desc(), F.col("poll_id").desc()], 24, "age_rank")
    earlier = lambda c: array_median(F.collect_list(F.when(F.col("age_rank") > 1, F.col(c))))
    newest = lambda c: F.max(F.when(F.col("age_rank") == 1, F.col(c)))
    per = recent.groupBy("camera_id").agg(
        newest("at").alias("last_at"), newest("brightness").alias("brightness"), newest("contrast").alias("contrast"), newest("white").alias("white"),
        earlier("contrast").alias("usual_contrast"), earlier("white").alias("usual_white"),
        F.count(F.when(F.col("age_rank") > 1, F.col("contrast"))).alias("history"), F.count(F.when(F.col("age_rank") > 1, F.col("white"))).alias("white_history"))
    per = per.filter(now - F.col("last_at") <= recent_s).join(cameras.select("camera_id", "region_id"), "camera_id")
    known = F.col("contrast").isNotNull() & (F.col("history") >= CITY.sky_history_min)
    whitened = F.col("white").isNotNull() & (F.col("white_history") >= CITY.sky_history_min)
    counts = per.groupBy("region_id").agg(
        F.count(F.lit(1)).alias("cameras"), F.count_if(known).alias("contrast_known"),
        F.count_if(known & (F.col("contrast") < CITY.sky_low_ratio * F.col("usual_contrast"))).alias("contrast_low"),
        F.count_if(whitened).alias("snow_known"),
        F.count_if(whitened & (F.col("white") >= CITY.snow_white) & (F.col("white") - F.col("usual_white") >= CITY.snow_rise)).alias("snow_white"))
    light = group_median(per, ["region_id"], "brightness", "light", 1e-3).select("region_id", "light")
    out = regions.join(counts, "region_id", "left").join(light, "region_id", "left")
    out = out.fillna(0, ["cameras", "contrast_known", "contrast_low", "snow_known", "snow_white"])
    out = out.withColumn("sun", solar_elevation(F.col("lat"), F.col("lon"), now))
    day = F.col("sun") >= CITY.daylight_deg
    low_share = F.col("contrast_low") / F.greatest(F.col("contrast_known"), F.lit(1))
    snow_share = F.col("snow_white") / F.greatest(F.col("snow_known"), F.lit(1))
    murky = day & (F.col("contrast_known") >= CITY.sky_min_cameras) & (low_share >= CITY.sky_min_share)
    snow = day & (F.col("snow_white") >= CITY.snow_min_cameras) & (snow_share >= CITY.snow_min_share)
    out = with_fixed(out, 1, sun_elevation=F.col("sun"))
    out = with_fixed(out, 3, brightness=F.col("light"))
    return out.withColumn("weather", F.when(snow, "snow").when(murky, "murky")).drop("sun", "light")


def live_activity(regions: DataFrame, scored: DataFrame) -> DataFrame:
    """Cameras with a picture and their mean activity per region, zero where there are none."""
    s = scored.groupBy("region_id").agg(F.count_if(F.col("last_at").isNotNull()).alias("live"), F.avg("activity").alias("activity"))
    return regions.select("region_id").join(s, "region_id", "left").fillna(0, ["live"]).fillna(0.0, ["activity"])


def density(points: DataFrame, cell: float) -> DataFrame:
    """Points per map cell with a log brightness against the densest cell, capped at 24."""
    cells = points.groupBy(F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy")).agg(F.count(F.lit(1)).alias("n"))
    peak = cells.select(F.greatest(F.lit(1), F.max("n"))).scalar()
    t = F.least(F.lit(1.0), F.log(1.0 + F.col("n")) / F.log(1.0 + F.least(peak, F.lit(24))))
    return cells.withColumn("brightness", t)


def request_load(requests: DataFrame, window_s: int, budget: float) -> DataFrame:
    """Requests per source in the window up to each request, against a budget.

    Requests are counted per second first, so the sliding window runs over at most
    one row per source and second, in chunks that carry their own lead-in.
    """
    per = requests.withColumn("second", F.floor("at")).groupBy("source_id", "second").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    chunk_s = 86400
    home = F.floor(F.col("second") / chunk_s)
    reach = F.floor((F.col("second") + window_s - 1) / chunk_s)
    spread = per.withColumn("chunk", F.explode(F.sequence(home, reach)))
    w = Window.partitionBy("source_id", "chunk").orderBy("second").rangeBetween(-(window_s - 1), 0)
    out = spread.withColumn("in_window", F.sum("n").over(w)).filter(home == F.col("chunk")).drop("chunk")
    return out.withColumn("over_budget", F.col("in_window") > budget)


def load_audit(requests: DataFrame, tiers: DataFrame) -> DataFrame:
    """What a run costs the agencies, a row a minute: requests a second, megabytes an hour, and cameras per tier.

    `requests`: at, bytes. `tiers`: camera_id, tier; its counts are one row.
    """
    per = requests.groupBy(F.floor(F.col("at") / 60.0).alias("minute")).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    counts = tiers.agg(*[F.count_if(F.col("tier") == t).alias(t) for t in ("fast", "slow", "radar", "idle")])
    return per.join(F.broadcast(counts), F.lit(True)).select("minute", (F.col("n") / 60.0).alias("requests_per_s"), F.floor(F.col("bytes") / 60.0 * 3600.0 / 1e6).alias("mb_per_h"), "fast", "slow", "radar", "idle")


def vehicle_status(newest: DataFrame, counts: DataFrame, enabled: Column) -> DataFrame:
    """The count of the very frame a camera shows: off without a detector, none where it has not counted that frame."""
    out = newest.join(counts.select("camera_id", "frame_at", "vehicles"), ["camera_id", "frame_at"], "left")
    status = F.when(~enabled, "off").when(F.col("vehicles").isNull(), "none").otherwise("counted")
    return out.select("camera_id", "frame_at", status.alias("status"), F.when(enabled, F.col("vehicles")).alias("vehicles"))


def tier_report(cameras: DataFrame, tiers: DataFrame, base: float, slow: float, on_screen: float, off_screen: float) -> DataFrame:
    """Effective period per camera from its tier and how many share the source's budget.

    `tiers` is (camera_id, tier, prioritized, in_panel, stretch).
    """
    df = cameras.select("camera_id", "source_id").join(tiers, "camera_id")
    shares = (df.filter(~F.col("in_panel") & F.col("tier").isin("fast", "slow")).groupBy("source_id", "tier").agg(F.count(F.lit(1)).alias("n")))
    fast = shares.filter(F.col("tier") == "fast").select("source_id", F.col("n").alias("n_fast"))
    slow_n = shares.filter(F.col("tier") == "slow").select("source_id", F.col("n").alias("n_slow"))
    df = df.join(fast, "source_id", "left").join(slow_n, "source_id", "left").fillna(1, ["n_fast", "n_slow"])
    fast_floor = F.greatest(F.lit(base), F.col("n_fast") * on_screen)
    slow_floor = F.greatest(F.lit(slow), F.col("n_slow") * off_screen)
    period = (F.when(F.col("in_panel"), base).when(F.col("tier") == "radar", 600.0).when(F.col("prioritized"), fast_floor)
              .otherwise(F.greatest(F.when(F.col("tier") == "fast", fast_floor).otherwise(slow_floor), base * F.col("stretch"))))
    return df.withColumn("period_s", period.cast("double")).drop("n_fast", "n_slow")


def camera_tier(cameras: DataFrame, claims: DataFrame, watched: DataFrame, visible: DataFrame, radar: DataFrame, now: Column, ttl_s: float) -> DataFrame:
    """fast, slow, radar or idle for every camera."""
    live = claims.filter(now < F.col("expires")).groupBy("camera_id").agg(
        F.lit(True).alias("prioritized"), F.max(F.col("kind") == "panel").alias("in_panel"))
    seen = visible.filter(now - F.col("seen_at") <= ttl_s).select("camera_id", F.lit(True).alias("seen")).distinct()
    df = (cameras.select("camera_id", "region_id").join(live, "camera_id", "left").join(seen, "camera_id", "left")
          .join(watched.select("region_id", F.lit(True).alias("watched")), "region_id", "left")
          .join(radar.select("camera_id", F.lit(True).alias("anchor")), "camera_id", "left")
          .fillna(False, ["prioritized", "in_panel", "seen", "watched", "anchor"]))
    tier = (F.when(F.col("prioritized"), "fast").when(~F.col("watched"), F.when(F.col("anchor"), "radar").otherwise("idle"))
            .when(F.col("seen"), "fast").otherwise("slow"))
    return df.select("camera_id", "region_id", tier.alias("tier"), "prioritized", "in_panel")


def nearest_cities(regions: DataFrame, current: int) -> DataFrame:
    """Other cities by distance from the current one, those without a center last."""
    here = regions.filter(F.col("region_id") == current)
    lat0, lon0 = here.select("lat").scalar(), here.select("lon").scalar()
    km = haversine_km(lat0, lon0, F.col("lat"), F.col("lon"))
    return regions.filter(F.col("region_id") != current).withColumn("km", km).orderBy(F.col("km").asc_nulls_last(), "region_id")


def _at_cities(starts: DataFrame, cities: DataFrame) -> DataFrame:
    """Every start with every city. Cities are a fixed list, held as an array of constants in each row."""
    rows = cities.select("region_id", "lat", "lon").collect()
    kind = cities.schema["region_id"].dataType
    listed = F.array(*[F.struct(F.lit(r["region_id"]).cast(kind).alias("region_id"), F.lit(r["lat"]).alias("lat"), F.lit(r["lon"]).alias("lon")) for r in rows])
    return starts.select("now", F.inline(listed))


def sun_crossings(cities: DataFrame, starts: DataFrame) -> DataFrame:
    """Next sunset and sunrise of every city from every start, at one-minute steps within a day.

    A step knows by itself whether the sun was up a minute before, so steps are
    reduced to two minima per start and city where they arise, before any shuffle.
    """
    steps = _at_cities(starts, cities).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(1440))))
    moment = F.col("now") + F.col("step") * 60.0
    steps = steps.withColumns({"t": moment, "before": solar_elevation(F.col("lat"), F.col("lon"), F.col("now") + (F.col("step") - 1) * 60.0) > 0,
                               "after": solar_elevation(F.col("lat"), F.col("lon"), moment) > 0})
    return steps.groupBy("region_id", "now").agg(F.min(F.when(F.col("before") & ~F.col("after"), F.col("t"))).alias("next_sunset"),
                                                 F.min(F.when(~F.col("before") & F.col("after"), F.col("t"))).alias("next_sunrise"))


def sun_relay(cities: DataFrame, starts: DataFrame) -> DataFrame:
    """The city to show at every start: setting sun, else rising, else lowest setting, else first light."""
    look = _at_cities(starts, cities).join(sun_crossings(cities, starts), ["region_id", "now"]).withColumns({"elevation": solar_elevation(F.col("lat"), F.col("lon"), F.col("now")),
                             "later": solar_elevation(F.col("lat"), F.col("lon"), F.col("now") + 600.0)})
    down = F.col("later") < F.col("elevation")
    near = F.abs("elevation") <= 6.0
    choice = (F.when(down & near, F.struct(F.lit(0).alias("p"), F.abs("elevation").alias("v")))
              .when(~down & near, F.struct(F.lit(1).alias("p"), F.abs("elevation").alias("v")))
              .when(down & (F.col("elevation") > 0), F.struct(F.lit(2).alias("p"), F.col("elevation").alias("v")))
              .otherwise(F.struct(F.lit(3).alias("p"), F.coalesce("next_sunrise", F.lit(1e18)).alias("v"))))
    look = look.withColumn("choice", choice)
    # A start gathers its cities, which are a fixed list.
    pick = look.groupBy("now").agg(F.min(F.struct("choice", "region_id", "elevation", "next_sunset", "next_sunrise")).alias("c"),
                                   F.collect_list(F.struct(F.col("next_sunset").alias("other_sunset"), F.col("region_id").alias("other"))).alias("others"))
    pick = pick.select("now", F.col("c.region_id").alias("region_id"), F.col("c.elevation").alias("elevation"), F.col("c.choice.p").alias("p"),
                       F.col("c.next_sunset").alias("own_sunset"), F.col("c.next_sunrise").alias("own_sunrise"), "others")
    pick = pick.withColumn("start", F.when(F.col("elevation") <= 0, F.col("now")).otherwise(F.coalesce("own_sunset", "now")))
    out = pick.withColumn("n", F.array_min(F.filter("others", lambda o: (o["other"] != F.col("region_id")) & (o["other_sunset"] > F.col("start")))))
    night = F.col("p") == 3
    phase = F.element_at(F.array(*[F.lit(x) for x in ("sunset", "sunrise", "waiting", "night")]), F.col("p") + 1)
    return out.select("now", "region_id", phase.alias("phase"), "elevation",
                      F.when(night, F.when(F.col("own_sunrise").isNotNull(), F.col("region_id"))).otherwise(F.col("n.other")).alias("next_region"),
                      F.when(night, F.col("own_sunrise")).otherwise(F.col("n.other_sunset")).alias("next_at"))


def sky_transitions(looks: DataFrame, chunk_s: float = 7 * 86400.0) -> DataFrame:
    """Sunset, sunrise, murk, clearing and snow between consecutive looks that saw cameras.

    A city's first look writes nothing. Looks come once a minute per city; a week of
    them is the largest group a task holds.
    """
    seen = looks.filter(F.col("cameras") > 0).select(
        "region_id", "at", (F.col("sun_elevation") > 0).alias("up"), F.coalesce(F.col("weather") == "murky", F.lit(False)).alias("murky"),
        F.coalesce(F.col("weather") == "snow", F.lit(False)).alias("snow")).withColumn("chunk", F.floor(F.col("at") / chunk_s))
    cut = with_halo(seen, ["region_id"], "chunk", ["at"], 1)
    w = Window.partitionBy("region_id", "chunk").orderBy("at")
    cut = cut.withColumn("b", F.lag(F.struct("up", "murky", "snow")).over(w)).filter(~F.col("_halo") & F.col("b").isNotNull())
    b = lambda c: F.col(f"b.{c}")
    kinds = F.array_compact(F.array(
        F.when(b("up") & ~F.col("up"), "sunset"), F.when(~b("up") & F.col("up"), "sunrise"),
        F.when(~b("murky") & F.col("murky"), "murky"), F.when(b("murky") & ~F.col("murky") & ~F.col("snow"), "clear"),
        F.when(~b("snow") & F.col("snow"), "snow")))
    out = cut.select("region_id", "at", F.explode(kinds).alias("kind"))
    season = F.year(F.timestamp_seconds("at")) - F.when(F.month(F.timestamp_seconds("at")) >= 7, 0).otherwise(1)
    snow = out.filter(F.col("kind") == "snow").groupBy("region_id", season.alias("season")).agg(F.min("at").alias("first_at"))
    return (out.withColumn("season", season).join(snow, ["region_id", "season"], "left")
            .withColumn("first_of_season", (F.col("kind") == "snow") & (F.col("at") == F.col("first_at"))).drop("first_at"))


def diary_days(entries: DataFrame) -> DataFrame:
    """Days with entries, newest first."""
    return entries.select("day").distinct().orderBy(F.col("day").desc())


def diary_of(entries: DataFrame, day: str) -> DataFrame:
    """One day's entries, oldest first; a day that is not a date is empty."""
    wanted = F.lit(day).rlike(r"^\d{4}-\d{2}-\d{2}$")
    return entries.filter(wanted & (F.col("day") == F.lit(day))).orderBy("at")


def first_seen(snapshots: DataFrame, chunk: Column) -> DataFrame:
    """Date undated records by the first fetch of their current unbroken stay in the feed.

    `snapshots` is (incident_id, fetch) with fetch numbers that grow by one.
    """
    s = snapshots.withColumn("chunk", chunk)
    s = running(s, ["incident_id"], "chunk", ["fetch"], inclusive=False, last_fetch=("max", F.col("fetch")))
    s = s.withColumn("returned", F.col("last_fetch").isNull() | (F.col("fetch") - F.col("last_fetch") > 1))
    return running(s, ["incident_id"], "chunk", ["fetch"], seen_from=("max", F.when(F.col("returned"), F.col("fetch")))).drop("chunk", "last_fetch", "returned")
