"""Consequence: incident, queue and standstill floors, and what the arbiter's answers do to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CORRIDOR, FLOORS, VERDICTS
from ..functions.numeric import clamp, with_fixed
from ..functions.scoring import incident_floor, queue_floor, queue_reach, review_factor, verdict_effect
from .scale import running, top_per
from .spatial import nearest_within


def incident_cameras(incidents: DataFrame, cameras: DataFrame) -> DataFrame:
    """Up to six cameras that could show each incident, nearest first."""
    return nearest_within(incidents, "incident_id", cameras, "camera_id", FLOORS.radius_km, FLOORS.max_cameras)


def enrich_incidents(incidents: DataFrame, codes: DataFrame | None) -> DataFrame:
    """Label and flags from a code table; what the record itself says wins.

    `codes` is an agency's published code list: (type, label, road_relevant, implies_closure).
    """
    if codes is None:
        return incidents.withColumns({"road_relevant": F.coalesce("road_relevant", F.lit(True)),
                                      "implies_closure": F.coalesce("implies_closure", F.lit(False))})
    c = codes.select("type", F.col("label").alias("c_label"), F.col("road_relevant").alias("c_relevant"),
                     F.col("implies_closure").alias("c_closure"))
    return (incidents.join(c, "type", "left")
            .withColumns({"label": F.coalesce("label", "c_label"),
                          "road_relevant": F.coalesce("road_relevant", "c_relevant", F.lit(False)),
                          "implies_closure": F.coalesce("implies_closure", "c_closure", F.lit(False))})
            .drop("c_label", "c_relevant", "c_closure"))


def incidents_near_regions(incidents: DataFrame, regions: DataFrame, margin: float = FLOORS.region_margin_deg) -> DataFrame:
    """Incidents inside each region's box grown by a margin.

    Regions are a short list; a one-degree grid turns the range join into an equi join.
    """
    i = incidents.withColumns({"gy": F.floor("lat"), "gx": F.floor("lon")})
    r = regions.select("region_id", (F.col("south") - margin).alias("s"), (F.col("north") + margin).alias("n"),
                       (F.col("west") - margin).alias("w"), (F.col("east") + margin).alias("e"))
    r = (r.withColumn("gy", F.explode(F.sequence(F.floor("s"), F.floor("n"))))
         .withColumn("gx", F.explode(F.sequence(F.floor("w"), F.floor("e")))))
    inside = F.col("lat").between(F.col("s"), F.col("n")) & F.col("lon").between(F.col("w"), F.col("e"))
    i = i.drop("region_id")
    return i.join(r, ["gy", "gx"]).filter(inside).drop("gy", "gx", "s", "n", "w", "e")


def feed_status(regions: DataFrame, feeds: DataFrame) -> DataFrame:
    """What a city can say about its source's incident feed."""
    f = feeds.select("source_id", F.lit(True).alias("configured"), "fetched_at", "healthy")
    status = (F.when(F.col("configured").isNull(), "unconfigured")
              .when(F.col("fetched_at").isNull(), F.when(F.col("watched"), "unavailable").otherwise("idle"))
              .when(F.col("healthy"), "ok").otherwise("unavailable"))
    return regions.join(f, "source_id", "left").withColumn("status", status).drop("configured", "healthy")


def current_verdicts(incidents: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdicts formed from the record as it now stands; an edited record has none."""
    key = ["incident_id", "type", "reported_at", "location", "remarks"]
    v, i = verdicts.alias("v"), incidents.select(*key).alias("i")
    same = [F.col(f"v.{c}").eqNullSafe(F.col(f"i.{c}")) for c in key[1:]]
    cond = F.col("v.incident_id") == F.col("i.incident_id")
    for s in same:
        cond = cond & s
    return v.join(i, cond, "left_semi")


def verdict_for_cameras(named: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Multiplier of each current verdict for each camera its record names.

    `named` is (incident_id, camera_id, ...); `chosen` in verdicts is a camera id.
    """
    choice_named = (named.select("incident_id", "camera_id").alias("n")
                    .join(verdicts.select("incident_id", "chosen").alias("c"),
                          (F.col("n.incident_id") == F.col("c.incident_id")) & (F.col("n.camera_id") == F.col("c.chosen")))
                    .select(F.col("n.incident_id").alias("incident_id"), F.lit(True).alias("choice_named")).distinct())
    v = verdicts.select("incident_id", "cleared", "score", "levels", "score_confidence", "supported", "chosen", "chosen_confidence")
    out = named.join(v, "incident_id", "left").join(choice_named, "incident_id", "left")
    multiplier, gated = verdict_effect(F.col("cleared"), F.col("score"), F.col("levels"), F.col("score_confidence"),
                                       F.col("supported"), F.col("chosen"), F.col("chosen_confidence"),
                                       F.col("camera_id"), F.coalesce("choice_named", F.lit(False)))
    judged = F.col("cleared").isNotNull()
    return (out.withColumns({"multiplier": F.when(judged, multiplier), "gated": F.when(judged, gated)})
            .drop("choice_named", "cleared", "score", "levels", "score_confidence", "supported", "chosen_confidence"))


def floors_by_record(links: DataFrame, incidents: DataFrame, now: Column, verdicts: DataFrame | None = None) -> DataFrame:
    """The floor every record puts under every camera it names, plain and as adjusted."""
    i = incidents.select("incident_id", "type", "location", "reported_at", "road_relevant", "implies_closure")
    out = links.join(i, "incident_id").withColumn("plain", incident_floor(
        F.col("implies_closure"), F.col("road_relevant"), F.col("reported_at"), F.col("km"), now))
    if verdicts is None:
        return out.withColumn("value", F.col("plain"))
    out = verdict_for_cameras(out, verdicts)
    out = with_fixed(out, 3, adjusted=clamp(F.col("plain") * F.col("multiplier")))
    act = F.col("multiplier").isNotNull() & (F.col("plain") > 0)
    return out.withColumn("value", F.when(act, F.col("adjusted")).otherwise(F.col("plain"))).drop("adjusted")


def strongest_floor(by_record: DataFrame) -> DataFrame:
    """The highest floor under each camera; base and record travel with it."""
    best = F.struct("value", (-F.col("incident_id")).alias("order"), "plain", "incident_id",
                    F.concat("type", F.lit(" at "), "location").alias("incident"))
    top = by_record.filter(F.col("value") > 0).groupBy("camera_id").agg(F.max(best).alias("b"))
    return top.select("camera_id", F.col("b.value").alias("incident_floor"), F.col("b.plain").alias("incident_base"),
                      F.col("b.incident_id").alias("incident_id"), F.col("b.incident").alias("incident"))


def latest_reading(readings: DataFrame, now: Column, hold_s: float) -> DataFrame:
    """The newest answer per camera as of `now`, within its hold."""
    live = readings.filter((F.col("read_at") <= now) & (now - F.col("read_at") <= hold_s))
    cols = ["read_at", "reading_id", *[c for c in readings.columns if c not in ("camera_id", "read_at", "reading_id")]]
    return (live.groupBy("camera_id").agg(F.max(F.struct(*cols)).alias("r"))
            .select("camera_id", "r.*"))


def reading_as_of(polls: DataFrame, readings: DataFrame, hold_s: float, chunk_s: float = 7 * 86400.0) -> DataFrame:
    """For every poll, the newest reading at or before it and within the hold (J11, as-of join).

    Readings and polls are merged into one ordered stream per camera and the last
    reading is carried forward, so a camera's history never meets itself in a join.
    """
    carried = F.struct("read_at", "reading_id", "standstill")
    r = readings.select("camera_id", F.col("read_at").alias("at"), F.lit(0).alias("side"), F.col("reading_id").alias("row_id"),
                        carried.alias("held"))
    p = polls.select("camera_id", "at", F.lit(1).alias("side"), F.col("poll_id").alias("row_id"),
                     F.lit(None).cast(r.schema["held"].dataType).alias("held"))
    both = r.unionByName(p).withColumn("chunk", F.floor(F.col("at") / chunk_s))
    out = running(both, ["camera_id"], "chunk", ["at", "side", "row_id"], last=("max", F.col("held")))
    fresh = (F.col("at") - F.col("last.read_at")) <= hold_s
    return out.filter(F.col("side") == 1).select(
        F.col("row_id").alias("poll_id"), "camera_id",
        F.when(fresh, F.col("last.reading_id")).alias("reading_id"), F.when(fresh, F.col("last.standstill")).alias("standstill"))


def gate_floor(gates: DataFrame) -> DataFrame:
    """Floor under a camera whose stillness was judged to be stopped traffic."""
    return gates.withColumn("gate_floor", F.when(F.col("standstill") >= VERDICTS.noul, VERDICTS.gridlock_floor).otherwise(0.0))


def review_effect(reviews: DataFrame) -> DataFrame:
    """Factor a second look puts on movement; answers on a scale of fewer than two levels do not count."""
    usable = reviews.filter(F.col("levels") >= 2)
    out = with_fixed(usable, 3, factor=review_factor(F.col("level"), F.col("levels"), F.col("confidence")))
    return out.withColumn("acted", F.col("confidence") >= VERDICTS.act_confidence)


def queue_floors(links: DataFrame, incidents: DataFrame, corridor: DataFrame, gates: DataFrame | None, now: Column,
                 verdicts: DataFrame | None = None) -> DataFrame:
    """Highest inferred queue floor under each camera.

    Queues start at cameras an incident names and at cameras with confirmed stopped
    traffic, and reach upstream neighbors only. A camera an incident names is never
    in its own queue. A confident choice of a neighbor adds a floor on any side.
    """
    i = incidents.select("incident_id", "type", "location", "reported_at", "road_relevant", "implies_closure")
    anchors = links.join(i, "incident_id").withColumn("anchor_floor", incident_floor(
        F.col("implies_closure"), F.col("road_relevant"), F.col("reported_at"), F.col("km"), now))
    anchors = anchors.filter(F.col("anchor_floor") > 0)
    # Without a verdict only upstream neighbors can hold a floor.
    beside = corridor if verdicts is not None else corridor.filter(F.col("side") == "upstream")
    reach = anchors.join(beside.select(F.col("camera_id").alias("anchor"), F.col("neighbor_id"), "side", "length_m", "wave_s"),
                         F.col("camera_id") == F.col("anchor")).drop("camera_id", "rank", "km")
    own = links.select("incident_id", F.col("camera_id").alias("neighbor_id"))
    reach = reach.join(own, ["incident_id", "neighbor_id"], "left_anti")
    age = F.greatest(F.lit(0.0), now - F.col("reported_at"))
    inferred = F.when(F.col("side") == "upstream", queue_floor(
        F.col("anchor_floor"), F.col("length_m"), queue_reach(age, F.col("wave_s")), CORRIDOR.max_upstream_m)).otherwise(0.0)
    reach = reach.withColumn("inferred", inferred)
    if verdicts is not None:
        record = anchors.groupBy("incident_id").agg(F.max("anchor_floor").alias("record_floor"))
        v = verdicts.filter(F.col("chosen_confidence") >= VERDICTS.act_confidence)
        multiplier, _ = verdict_effect(F.col("cleared"), F.col("score"), F.col("levels"), F.col("score_confidence"),
                                       F.col("supported"), F.col("chosen"), F.col("chosen_confidence"), F.col("chosen"), F.lit(True))
        picks = v.join(record, "incident_id").select("incident_id", F.col("chosen").alias("neighbor_id"),
                                                     (F.col("record_floor") * multiplier).alias("picked"))
        reach = reach.join(picks, ["incident_id", "neighbor_id"], "left")
    else:
        reach = reach.withColumn("picked", F.lit(None).cast("double"))
    rows = reach.select(F.col("neighbor_id").alias("camera_id"),
                        F.greatest("inferred", F.coalesce("picked", F.lit(0.0))).alias("value"), F.lit("incident").alias("source"),
                        F.concat("type", F.lit(" at "), "location").alias("cause"), "anchor", "length_m",
                        F.col("picked").isNotNull().alias("chosen"))
    if gates is not None:
        still = gates.filter(F.col("gate_floor") > 0).select(F.col("camera_id").alias("anchor"), "gate_floor", "read_at")
        up = corridor.filter((F.col("side") == "upstream") & (F.col("neighbor_id") != F.col("camera_id")))
        s = still.join(up.withColumnRenamed("camera_id", "anchor"), "anchor")
        s_age = F.greatest(F.lit(0.0), now - F.col("read_at"))
        rows = rows.unionByName(s.select(
            F.col("neighbor_id").alias("camera_id"),
            queue_floor(F.col("gate_floor"), F.col("length_m"), queue_reach(s_age, F.col("wave_s")), CORRIDOR.max_upstream_m).alias("value"),
            F.lit("standstill").alias("source"), F.concat(F.lit("camera "), F.col("anchor").cast("string")).alias("cause"),
            "anchor", "length_m", F.lit(False).alias("chosen")))
    best = F.struct("value", (-F.col("anchor")).alias("o"), F.when(F.col("source") == "incident", 1).otherwise(0).alias("p"),
                    (-F.col("length_m")).alias("l"), "cause", "source", "anchor", "length_m", "chosen")
    top = rows.filter(F.col("value") > 0).groupBy("camera_id").agg(F.max(best).alias("b"))
    return top.select("camera_id", F.col("b.value").alias("queue_floor"), F.col("b.source").alias("queue_source"),
                      F.col("b.cause").alias("queue_cause"), F.col("b.anchor").alias("queue_anchor"),
                      F.col("b.length_m").alias("queue_length_m"), F.col("b.chosen").alias("queue_chosen"))


def arbiter_funnel(incidents: DataFrame, links: DataFrame, servable: DataFrame, pictured: DataFrame) -> DataFrame:
    """How many records are live, linked, relevant, servable and ready, each within the one before."""
    flags = (links.join(servable.select("camera_id", F.lit(1).alias("s")), "camera_id", "left")
             .join(pictured.select("camera_id", F.lit(1).alias("p")), "camera_id", "left")
             .groupBy("incident_id").agg(F.max("s").alias("s"), F.max("p").alias("p")))
    i = incidents.join(flags.withColumn("linked", F.lit(True)), "incident_id", "left")
    linked = F.coalesce("linked", F.lit(False))
    relevant = linked & (F.col("road_relevant") | F.col("implies_closure"))
    serv = relevant & F.coalesce(F.col("s") == 1, F.lit(False))
    ready = serv & F.coalesce(F.col("p") == 1, F.lit(False))
    return i.agg(F.count(F.lit(1)).alias("live"), F.count_if(linked).alias("linked"), F.count_if(relevant).alias("relevant"),
                 F.count_if(serv).alias("servable"), F.count_if(ready).alias("ready"))


def answer_history(verdicts: DataFrame, key: str, size: int = VERDICTS.history_points) -> DataFrame:
    """The newest answers per subject, at most forty, with the newest marked."""
    return top_per(verdicts, [key], [F.col("at").desc()], size, "age_rank").withColumn("is_latest", F.col("age_rank") == 1)


def answer_series(verdicts: DataFrame, key: str, value: str, size: int = VERDICTS.history_points) -> DataFrame:
    """Per subject its newest answers as one series, newest first, and the time of the latest, by which a list of them is ordered."""
    kept = answer_history(verdicts, key, size)
    point = F.struct("age_rank", F.col("at"), F.col(value))
    series = kept.groupBy(key).agg(F.max("at").alias("latest_at"), F.array_sort(F.collect_list(point)).alias("series"))  # at most `size` points
    return series.withColumn("series", F.transform("series", lambda p: F.struct(p["at"].alias("at"), p[value].alias(value))))


def awake_cameras(links: DataFrame, incidents: DataFrame, servable: DataFrame, per_incident: int, limit: int) -> DataFrame:
    """Cameras worth keeping awake: the nearest servable two of each relevant record, distinct, 24 in all (K7)."""
    live = incidents.filter(F.col("road_relevant") | F.col("implies_closure")).select("incident_id")
    able = links.join(live, "incident_id", "left_semi").join(servable.select("camera_id"), "camera_id", "left_semi")
    first = top_per(able, ["incident_id"], [F.col("rank")], per_incident, "pick")
    once = first.groupBy("camera_id").agg(F.min(F.struct("incident_id", "pick")).alias("o"))
    return once.select("camera_id", F.col("o.incident_id").alias("incident_id"), F.col("o.pick").alias("pick")).orderBy("incident_id", "pick").limit(limit)
