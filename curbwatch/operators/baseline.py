"""Per-camera history: rolling medians, hour-of-week cells, frame differences, polling runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CITY, POLLING, SCORE
from ..functions.geo import hour_of_week_at
from ..functions.numeric import fraction, with_fixed
from ..functions.scoring import relative_movement, shrunk_baseline
from .scale import group_median, running, time_chunk, top_per, with_halo

ORDER = ["at", "poll_id"]


def rolling_median(fresh: DataFrame, size: int = SCORE.history) -> DataFrame:
    """Median of the newest `size` differences up to and including every poll; null under three."""
    cut = fresh.filter(F.col("diff").isNotNull()).withColumn("chunk", time_chunk("at"))
    cut = with_halo(cut, ["camera_id"], "chunk", ORDER, size - 1)
    frame = Window.partitionBy("camera_id", "chunk").orderBy(*ORDER).rowsBetween(-(size - 1), 0)
    return (cut.withColumns({"samples": F.count("diff").over(frame), "_m": F.percentile("diff", 0.5).over(frame)})
            .withColumn("rolling", F.when(F.col("samples") >= SCORE.min_samples, F.col("_m")))
            .filter(~F.col("_halo")).drop("_m", "_halo", "chunk"))


def cell_before(fresh: DataFrame) -> DataFrame:
    """Count, mean and sample deviation of each poll's hour-of-week cell before that poll."""
    cut = fresh.withColumns({"cell": hour_of_week_at(F.col("at")), "chunk": time_chunk("at")})
    out = running(cut, ["camera_id", "cell"], "chunk", ORDER, inclusive=False,
                  _n=("sum", F.lit(1).cast("bigint")), _s=("sum", F.col("diff")), _q=("sum", F.col("diff") * F.col("diff")))
    return out.withColumns(cell_moments(F.col("_n"), F.col("_s"), F.col("_q"))).drop("_n", "_s", "_q", "chunk")


def cell_moments(n: Column, s: Column, q: Column) -> dict[str, Column]:
    spread = (q - s * s / F.when(n > 0, n)) / F.when(n > 1, n - 1)
    return {"cell_n": n.cast("bigint"), "cell_mean": F.when(n > 0, s / F.when(n > 0, n)),
            "cell_sd": F.when(n >= 2, F.sqrt(F.greatest(F.lit(0.0), spread)))}


def ambiguous_zero(fresh: DataFrame) -> DataFrame:
    """Flag a still picture in an hour whose cell says it moves."""
    known = (F.col("cell_n") >= SCORE.cell_samples) & (F.col("cell_mean") > SCORE.active_diff)
    return cell_before(fresh).withColumn("ambiguous", F.coalesce((F.col("diff") <= SCORE.activity_floor) & known, F.lit(False)))


def ambiguous_rates(fresh: DataFrame) -> DataFrame:
    """Polls, flags and their rate for every hour of the day; hours without polls stay, with a null rate (A5)."""
    flagged = ambiguous_zero(fresh).withColumn("hour", (F.col("cell") % 24).cast("int"))
    stats = flagged.groupBy("hour").agg(F.count(F.lit(1)).alias("polls"), F.count_if("ambiguous").alias("flagged"))
    hours = fresh.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    out = hours.join(stats, "hour", "left").fillna(0, ["polls", "flagged"])
    return with_fixed(out, 4, rate=fraction(F.col("flagged"), F.col("polls")))


def blended_baseline(fresh: DataFrame) -> DataFrame:
    """Cell mean shrunk toward the rolling median, at every poll."""
    cells = cell_before(fresh).select("poll_id", "cell_n", "cell_mean", "cell_sd")
    return rolling_median(fresh).join(cells, "poll_id").withColumn(
        "baseline", shrunk_baseline(F.col("cell_n"), F.col("cell_mean"), F.col("rolling")))


def recent_diffs(fresh: DataFrame, size: int = SCORE.history) -> DataFrame:
    """The newest differences of every camera, at most `size` a camera."""
    return top_per(fresh.filter(F.col("diff").isNotNull()), ["camera_id"], [F.col("at").desc(), F.col("poll_id").desc()], size, "age_rank")


def region_median(fresh: DataFrame, cameras: DataFrame) -> DataFrame:
    """Median of all cameras' recent differences per region, the stand-in for a camera without history (A1)."""
    recent = recent_diffs(fresh).select("camera_id", "diff")
    placed = recent.join(cameras.select("camera_id", "region_id"), "camera_id")
    return group_median(placed, ["region_id"], "diff", "region_diff", 1e-4)


def camera_state(fresh: DataFrame, now: Column) -> DataFrame:
    """One row per camera: newest picture, recent history, and its cell for the hour of `now`.

    The cell leaves out the newest poll only when that poll fell in the same cell.
    """
    cell = hour_of_week_at(F.col("at"))
    inside = cell == hour_of_week_at(now)
    d = F.col("diff")
    state = fresh.groupBy("camera_id").agg(
        F.max(F.struct("at", "poll_id", "diff", "brightness", inside.alias("inside"))).alias("newest"),
        F.count_if(inside).alias("_n"), F.sum(F.when(inside, d)).alias("_s"), F.sum(F.when(inside, d * d)).alias("_q"))
    out = F.col("newest.inside").cast("int")
    nd = F.col("newest.diff")
    state = state.select(
        "camera_id", F.col("newest.at").alias("last_at"), nd.alias("diff"), F.col("newest.brightness").alias("brightness"),
        (F.col("_n") - out).alias("_n"), (F.coalesce(F.col("_s"), F.lit(0.0)) - out * nd).alias("_s"),
        (F.coalesce(F.col("_q"), F.lit(0.0)) - out * nd * nd).alias("_q"))
    state = state.withColumns(cell_moments(F.col("_n"), F.col("_s"), F.col("_q"))).drop("_n", "_s", "_q")
    recent = recent_diffs(fresh).groupBy("camera_id").agg(F.count("diff").alias("samples"), F.percentile("diff", 0.5).alias("own_median"))
    return state.join(recent, "camera_id", "left")


def frame_difference(thumbs: DataFrame) -> DataFrame:
    """Mean absolute change of every picture against the one before it."""
    cut = thumbs.withColumn("chunk", F.floor(F.col("seq") / 10_000))
    cut = with_halo(cut, ["camera_id"], "chunk", ["seq"], 1)
    prev = F.lag("thumb").over(Window.partitionBy("camera_id", "chunk").orderBy("seq"))
    cut = cut.withColumn("prev", prev).filter(~F.col("_halo"))
    return cut.withColumn("diff", mean_abs_change(F.col("thumb"), F.col("prev"))).drop("prev", "_halo", "chunk")


def mean_abs_change(a: Column, b: Column) -> Column:
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, v: s + v)
    return F.when(b.isNotNull(), total / F.size(a))


def frame_metrics(pixels: DataFrame) -> DataFrame:
    """Brightness, contrast and white share of decoded pictures.

    `pixels` holds an array of (r, g, b) structs in 0..255 per picture.
    """
    n = F.size("pixels")
    gray = F.transform("pixels", lambda p: (0.299 * p["r"] + 0.587 * p["g"] + 0.114 * p["b"]) / 255.0)
    white = F.size(F.filter("pixels", lambda p: (F.least(p["r"], p["g"], p["b"]) >= 0.72 * 255)
                            & (F.greatest(p["r"], p["g"], p["b"]) - F.least(p["r"], p["g"], p["b"]) <= 0.12 * 255)))
    out = pixels.withColumns({"thumb": gray, "white": white / n})
    out = out.withColumn("brightness", F.aggregate("thumb", F.lit(0.0), lambda s, v: s + v) / n)
    spread = F.aggregate(F.transform("thumb", lambda v: (v - F.col("brightness")) * (v - F.col("brightness"))),
                         F.lit(0.0), lambda s, v: s + v)
    return out.withColumn("contrast", F.sqrt(spread / n)).drop("pixels")


def frame_ring(fresh: DataFrame, cameras: DataFrame, closed: Column, size: int = SCORE.ring) -> DataFrame:
    """The newest frames kept per camera, oldest first from k = 0; one frame where the city is closed."""
    newest = top_per(fresh, ["camera_id"], [F.col("at").desc(), F.col("poll_id").desc()], size, "age_rank")
    kept = newest.join(cameras.select("camera_id", "region_id"), "camera_id").filter((F.col("age_rank") == 1) | ~closed)
    count = F.count(F.lit(1)).over(Window.partitionBy("camera_id"))
    out = kept.withColumns({"k": (count - F.col("age_rank")).cast("int"), "negative_k": (-F.col("age_rank")).cast("int")})
    return out.select("camera_id", "k", "negative_k", "at", "brightness", "diff")


def poll_counts(polls: DataFrame) -> DataFrame:
    """Polls by outcome per camera."""
    r = F.col("result")
    return polls.groupBy("camera_id").agg(
        F.count(F.lit(1)).alias("polls"), F.count_if(r.isin("unchanged", "not_modified")).alias("unchanged"),
        F.count_if(r == "unavailable").alias("unavailable"), F.count_if(r == "error").alias("errors"),
        F.count_if(r == "fresh").alias("frames"))


def quiet_stretch(polls: DataFrame) -> DataFrame:
    """Period multiplier after every poll: +.5 per quiet poll up to 4, back to 1 on movement."""
    d = F.when(F.col("result") == "fresh", F.col("diff")).when(F.col("result") == "unchanged", 0.0)
    marked = polls.withColumns({
        "reset": F.coalesce(d > SCORE.active_diff, F.lit(False)),
        "quiet": F.coalesce(d <= SCORE.activity_floor, F.lit(False)).cast("bigint"),
        "chunk": time_chunk("at")})
    summed = running(marked, ["camera_id"], "chunk", ORDER, quiet_so_far=("sum", F.col("quiet")))
    summed = running(summed, ["camera_id"], "chunk", ORDER,
                     at_reset=("max", F.when(F.col("reset"), F.col("quiet_so_far"))))
    since = F.col("quiet_so_far") - F.coalesce(F.col("at_reset"), F.lit(0))
    return summed.select("poll_id", "camera_id", "result", "diff", since.alias("quiet_run"),
                         F.least(F.lit(POLLING.max_stretch), 1.0 + POLLING.stretch_step * since).alias("stretch"))


def next_delay(polls: DataFrame, period: Column, modified_at: Column) -> DataFrame:
    """Seconds until each camera's next poll."""
    full = period + POLLING.margin_s
    target = modified_at + full - F.col("at")
    timed = F.least(full, F.greatest(F.lit(POLLING.min_delay_s), target))
    delay = (F.when(F.col("result") == "unavailable", POLLING.unavailable_s)
             .when((F.col("result") == "not_modified") | modified_at.isNull() | (target < 0), full).otherwise(timed))
    return polls.withColumn("delay", delay)


def score_history(scores: DataFrame, now: Column, span_s: float = 600.0) -> DataFrame:
    """Scores of the last ten minutes, the newest per key and time kept in order."""
    return scores.filter((F.col("at") <= now) & (now - F.col("at") <= span_s)).withColumn("age_s", now - F.col("at"))


def pulse_segments(points: DataFrame) -> DataFrame:
    """Each city's day of pulse points scaled to its own peak and cut where a gap exceeds ten minutes."""
    day = F.floor(F.col("at") / 86400.0)
    # A city has at most 1440 minute points a day, so (region, day) is a bounded group.
    w = Window.partitionBy("region_id", "day").orderBy("at")
    peak = F.max("diff").over(Window.partitionBy("region_id", "day"))
    out = points.withColumn("day", day).withColumns({
        "points": F.count(F.lit(1)).over(Window.partitionBy("region_id", "day")),
        "height": F.col("diff") / F.when(peak > 0, peak).otherwise(1.0),
        "gap": F.coalesce((F.col("at") - F.lag("at").over(w)) > CITY.pulse_gap_s, F.lit(True))})
    out = out.withColumn("segment", F.sum(F.col("gap").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.filter(F.col("points") >= 2).drop("gap")


def activity(state: DataFrame, fallback: Column) -> Column:
    """Unrounded movement against the camera's own median, else the region's."""
    own = F.when(F.col("samples") >= SCORE.min_samples, F.col("own_median")).otherwise(fallback)
    return relative_movement(F.col("diff"), own, F.coalesce(F.col("samples"), F.lit(0)))


