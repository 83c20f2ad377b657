"""Highlights and the sentences that describe them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RANKING, VERDICTS
from ..functions.geo import solar_elevation
from ..functions.numeric import to_fixed
from ..functions.text import ago, dispatch_place, inside_sentence, picture, sentence_label, without_device_number
from .scale import top_per


def highlights(scored: DataFrame, by_record: DataFrame, incidents: DataFrame, corridor: DataFrame, verdicts: DataFrame | None, now: Column) -> DataFrame:
    """The five events most worth telling, as candidates with their facts (K5).

    `by_record` holds the plain floor of every record under every camera it names.
    """
    live = scored.filter(F.col("attention").isNotNull())
    cols = ["camera_id", "region_id", "camera_name", "attention", "diff", "baseline", "last_at"]
    named = by_record.select("incident_id", "camera_id", "plain").join(live.select(*cols, "incident_floor"), "camera_id")
    earns = F.max((F.col("incident_floor") > 0) & (F.col("plain") > 0)).alias("earns")
    best = F.max(F.struct("attention", (-F.col("camera_id")).alias("o"), *[c for c in cols if c != "attention"])).alias("b")
    lead = named.groupBy("incident_id").agg(earns, best).filter("earns").select("incident_id", *[F.col(f"b.{c}").alias(c) for c in cols])
    up = corridor.filter(F.col("side") == "upstream").select(F.col("camera_id").alias("queue_anchor"), F.col("neighbor_id").alias("camera_id"))
    tails = (scored.filter((F.col("queue_source") == "incident") & (F.col("queue_floor") >= RANKING.queue_mention_min))
             .join(up, ["queue_anchor", "camera_id"], "left_semi")
             .groupBy(F.col("queue_cause").alias("cause")).agg(F.max(F.struct("queue_length_m", "camera_name")).alias("q")))
    facts = incidents.select("incident_id", "type", "location", "label", "reported_at", F.concat("type", F.lit(" at "), "location").alias("cause"))
    inc = lead.join(facts, "incident_id").join(tails, "cause", "left")
    if verdicts is not None:
        inc = inc.join(verdicts.select("incident_id", "cleared", "supported"), "incident_id", "left")
    else:
        inc = inc.withColumns({"cleared": F.lit(None).cast("double"), "supported": F.lit(None).cast("double")})
    inc = inc.select(F.lit("incident").alias("kind"), *cols, F.coalesce("reported_at", "last_at", now).alias("at"), "incident_id", "type", "location",
                     "label", "reported_at", "cleared", "supported", F.col("q.camera_name").alias("queue_at"), F.col("q.queue_length_m").alias("queue_m"))
    stopped = F.col("still_floor") > 0
    moving = (F.col("incident_floor") == 0) & (F.col("trigger") == "movement") & F.col("last_at").isNotNull()
    kind = F.when(stopped, F.when(F.col("gate_at").isNotNull(), "stopped")).when(moving, "movement")
    own = live.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select(
        "kind", *cols, F.when(F.col("kind") == "stopped", F.col("gate_at")).otherwise(F.col("last_at")).alias("at"))
    events = inc.unionByName(own, allowMissingColumns=True).filter(F.col("attention") >= RANKING.highlight_min)
    return events.orderBy(F.col("attention").desc(), "camera_id", "kind", "incident_id").limit(RANKING.highlights)


def brief(now: Column) -> Column:
    """One sentence or two about an event row."""
    view = picture(F.col("diff"), F.col("baseline"))
    where = inside_sentence(without_device_number(F.col("camera_name")))
    ratio = F.col("diff") / F.when(F.col("baseline") > 0, F.col("baseline"))
    age = lambda at: ago(F.greatest(F.lit(0.0), now - at))
    stopped = F.concat(F.lit("Traffic stopped near "), where, F.lit(", where this hour usually moves. Confirmed from the picture "), age(F.col("at")), F.lit("."))
    shown = F.when(ratio.isNull(), F.concat(F.lit("The picture is "), view)).otherwise(F.concat(
        F.lit("The picture shows about "), F.format_string("%.1f", to_fixed(to_fixed(ratio, 2), 1)), F.lit(" times its usual movement for this hour")))
    moving = F.concat(F.lit("Unusual movement near "), where, F.lit(". "), shown, F.lit("."))
    seen = F.when(F.col("diff").isNull(), "no camera picture yet").otherwise(F.concat(F.lit("the camera picture is "), view))
    answers = F.array_join(F.array_compact(F.array(F.when(F.col("cleared") >= VERDICTS.noul, "Likely already cleared"),
                                                   F.when(F.col("supported") >= VERDICTS.noul, "Cameras support the report"))), " and ")
    evidence = F.when(F.length(answers) > 0, F.concat(answers, F.lit(" and "), seen)).otherwise(
        F.concat(F.upper(F.substring(seen, 1, 1)), F.substr(seen, F.lit(2))))
    queue = F.when(F.col("queue_at").isNotNull(), F.concat(F.lit(" A queue could now reach "), inside_sentence(without_device_number(F.col("queue_at"))), F.lit(", "),
                                                           F.format_string("%.1f", to_fixed(F.col("queue_m") / 1000.0, 1)), F.lit(" km back."))).otherwise("")
    reported = F.when(F.col("reported_at").isNull(), "").otherwise(F.concat(F.lit(", reported "), age(F.col("reported_at"))))
    about = F.when(F.coalesce("label", F.lit("")) != "", F.col("label")).otherwise(F.col("type"))
    incident = F.concat(inside_sentence(sentence_label(about)), F.lit(" on "), inside_sentence(dispatch_place(F.col("location"))), reported, F.lit(". "), evidence, F.lit("."), queue)
    return F.when(F.col("kind") == "stopped", stopped).when(F.col("kind") == "movement", moving).otherwise(incident)


def local_night(polls: DataFrame) -> DataFrame:
    """Polls at places where the sun is down, with the time on a clock there (P38). `polls`: at, lat, lon and `zone`, a time zone per row."""
    dark = polls.filter(solar_elevation(F.col("lat"), F.col("lon"), F.col("at")) < 0)
    local = F.from_utc_timestamp(F.timestamp_micros((F.col("at") * 1e6).cast("bigint")), F.col("zone"))
    return dark.withColumn("local_time", F.date_format(local, "yyyy-MM-dd HH:mm"))


def gate_questions(flagged: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """Still cameras worth asking about: flagged, measured, and not asked in five minutes."""
    recent = asked.filter(now - F.col("asked_at") < VERDICTS.gate_reask_s).select("camera_id")
    ready = flagged.filter(F.col("ambiguous") & F.col("diff").isNotNull() & F.col("baseline").isNotNull())
    return ready.join(recent, "camera_id", "left_anti")


def incident_questions(incidents: DataFrame, links: DataFrame, state: DataFrame, verdicts: DataFrame, now: Column) -> DataFrame:
    """Records worth asking an arbiter about, with the fingerprint of what their cameras show.

    A record names at most six cameras, so its fingerprint is a short list.
    """
    stamp = F.when(F.col("last_at").isNull(), "-").otherwise(F.floor(F.col("last_at") + 0.5).cast("bigint").cast("string"))
    part = F.struct("rank", F.concat(F.col("camera_id").cast("string"), F.lit(":"), stamp).alias("t"))
    shown = (links.join(state.select("camera_id", "last_at", "diff"), "camera_id").groupBy("incident_id")
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["t"]), ",").alias("evidence"),
                  F.count("diff").alias("pictures")))
    live = incidents.filter(F.col("road_relevant") | F.col("implies_closure")).select("incident_id")
    last = verdicts.select("incident_id", F.col("at").alias("asked_at"), F.col("evidence").alias("asked_on"))
    out = live.join(shown, "incident_id").filter(F.col("pictures") > 0).join(last, "incident_id", "left")
    due = F.col("asked_at").isNull() | ((now - F.col("asked_at") >= VERDICTS.reask_s) & (F.col("asked_on") != F.col("evidence")))
    return out.filter(due).select("incident_id", "evidence", "pictures")


def _told(now: Column) -> list[Column]:
    """What every document says of a camera's picture. A camera without a usual value has no ratio."""
    usual = F.when(F.col("baseline") > 0, F.col("baseline"))
    return [picture(F.col("diff"), F.col("baseline")).alias("picture"), to_fixed(F.col("diff"), 4).alias("frame_difference"), to_fixed(usual, 4).alias("usual_frame_difference_this_hour"),
            to_fixed(F.col("diff") / usual, 2).alias("times_its_usual"),
            F.when(F.col("last_at").isNull(), "none yet").otherwise(ago(F.greatest(F.lit(0.0), now - F.col("last_at")))).alias("newest_frame")]


def _whole(value: Column, unit: str) -> Column:
    return F.concat(F.floor(value + 0.5).cast("bigint").cast("string"), F.lit(f" {unit}"))


def _beside(place: str) -> Column:
    """Where a corridor camera lies. `place` is what the corridor is of."""
    return F.when(F.col("side") == "upstream", f"on the approach to {place}").when(F.col("side") == "downstream", f"past {place}").otherwise("nearby, off the corridor")


def _or_null(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def evidence_records(questions: DataFrame, incidents: DataFrame, links: DataFrame, state: DataFrame, cameras: DataFrame, now: Column, corridor: DataFrame | None = None,
                     per_record: int = VERDICTS.max_neighbors) -> DataFrame:
    """The document an incident question is answered from: the record, its cameras and those along their corridor.

    `corridor`: camera_id, neighbor_id, side, length_m, hops, tt_s, wave_s; of the
    neighbors of a record's cameras the first `per_record` upstream, then downstream,
    nearest first, each by its shortest way. Lists are as short as a record's cameras.
    """
    told = state.select("camera_id", "diff", "baseline", "cell_n", "last_at", _or_null(state, "ambiguous", "boolean").alias("ambiguous"))
    view = cameras.select("camera_id", F.col("roadway").alias("road"), F.col("location").alias("view"))
    asked = links.join(questions.select("incident_id"), "incident_id", "left_semi")
    one = F.struct("rank", F.col("camera_id").cast("string").alias("camera_id"), "road", "view", _whole(F.col("km") * 1000.0, "m").alias("distance_from_the_reported_location"),
                   *_told(now), F.col("cell_n").alias("frames_behind_this_hour"), F.col("ambiguous").alias("still_although_this_hour_usually_moves"))
    named = asked.join(view, "camera_id").join(told, "camera_id").groupBy("incident_id").agg(F.array_sort(F.collect_list(one)).alias("cameras_the_record_names"))
    record = F.struct(F.col("type").alias("agency_code"), _or_null(incidents, "label", "string").alias("agency_code_meaning"), F.col("road_relevant").alias("code_is_about_the_road"),
                      F.col("implies_closure").alias("code_implies_the_road_is_blocked"), F.col("location").alias("reported_location"), _or_null(incidents, "city", "string").alias("city"),
                      _or_null(incidents, "county", "string").alias("county"),
                      F.when(F.col("reported_at").isNull(), "at a time the feed did not give").otherwise(ago(F.greatest(F.lit(0.0), now - F.col("reported_at")))).alias("reported"),
                      _or_null(incidents, "remarks", "string").alias("dispatcher_remarks"))
    out = incidents.join(named, "incident_id").withColumn("dispatch_record", record).select("incident_id", "dispatch_record", "cameras_the_record_names")
    parts = ["dispatch_record", "cameras_the_record_names"]
    if corridor is not None:
        reach = (asked.select("incident_id", "camera_id").join(corridor, "camera_id").select("incident_id", F.col("neighbor_id").alias("camera_id"), "side", "length_m", "hops", "tt_s", "wave_s")
                 .join(asked.select("incident_id", "camera_id"), ["incident_id", "camera_id"], "left_anti"))
        side = F.when(F.col("side") == "upstream", 0).when(F.col("side") == "downstream", 1).otherwise(2)
        short = reach.groupBy("incident_id", "camera_id").agg(F.min(F.struct("length_m", side.alias("o"), "side", "hops", "tt_s", "wave_s")).alias("n")).select("incident_id", "camera_id", "n.*")
        near = top_per(short, ["incident_id"], [F.col("o"), F.col("length_m"), F.col("camera_id")], per_record, "pick")
        other = F.struct("pick", *_told(now), F.col("camera_id").cast("string").alias("camera_id"), "road", "view", _beside("the reported location").alias("side"),
                         _whole(F.col("length_m"), "m").alias("road_distance"), _whole(F.col("tt_s"), "seconds").alias("driving_time"), F.col("hops").alias("junctions_away"),
                         F.regexp_replace(ago(F.col("wave_s")), " ago$", "").alias("a_queue_at_the_incident_would_reach_here_in"))
        along = near.join(view, "camera_id").join(told, "camera_id", "left").groupBy("incident_id").agg(F.array_sort(F.collect_list(other)).alias("nearby_cameras_on_the_same_corridor"))
        out, parts = out.join(along, "incident_id", "left"), [*parts, "nearby_cameras_on_the_same_corridor"]
        out = out.withColumn(parts[-1], F.coalesce(parts[-1], F.array().cast(along.schema[parts[-1]].dataType)))
    return out.select("incident_id", F.to_json(F.struct(*parts)).alias("document"))


def gate_evidence(questions: DataFrame, state: DataFrame, cameras: DataFrame, corridor: DataFrame, linked: DataFrame, counts: DataFrame, now: Column, per_camera: int = VERDICTS.max_neighbors) -> DataFrame:
    """The document a question about one still camera is answered from.

    `state` also has `zone`, the camera's time zone; `linked` the cameras some record
    names; `counts` camera_id, frame_at, vehicles, by_class of the newest pictures.
    """
    view = cameras.select("camera_id", F.col("roadway").alias("road"), F.col("location").alias("view"))
    side = F.when(F.col("side") == "upstream", 0).when(F.col("side") == "downstream", 1).otherwise(2)
    short = corridor.groupBy("camera_id", "neighbor_id").agg(F.min(F.struct("length_m", side.alias("o"), "side", "hops")).alias("n")).select("camera_id", "neighbor_id", "n.*")
    near = top_per(short.join(questions.select("camera_id").distinct(), "camera_id", "left_semi"), ["camera_id"], [F.col("o"), F.col("length_m"), F.col("neighbor_id")], per_camera, "pick")
    beside = F.struct("pick", F.col("neighbor_id").cast("string").alias("camera_id"), "road", "view", _beside("this camera").alias("side"), _whole(F.col("length_m"), "m").alias("road_distance"), F.col("hops").alias("junctions_away"))
    along = near.join(view.withColumnRenamed("camera_id", "neighbor_id"), "neighbor_id").groupBy("camera_id").agg(F.array_sort(F.collect_list(beside)).alias("cameras_on_the_same_corridor"))
    hour = F.date_format(F.from_utc_timestamp(F.timestamp_micros((now * 1e6).cast("bigint")), F.col("zone")), "EEEE h a")
    counted = counts.select("camera_id", F.col("frame_at").alias("last_at"), "vehicles", "by_class")
    one = F.struct(F.col("camera_id").cast("string").alias("camera_id"), "road", "view", F.lit("updating, the newest picture differs from the one before it, so this is not a frozen feed").alias("feed"),
                   *_told(now), F.col("cell_n").alias("frames_behind_this_hour"), hour.alias("time_of_day"), F.coalesce("_named", F.lit(False)).alias("a_dispatch_record_already_names_this_camera"),
                   F.coalesce(F.col("vehicles").cast("string"), F.lit("not counted")).alias("vehicles_a_detector_counted_in_this_picture"), F.col("by_class").alias("vehicle_types_counted"))
    rows = (questions.select("camera_id").distinct().join(view, "camera_id").join(state.select("camera_id", "diff", "baseline", "cell_n", "last_at", "zone"), "camera_id")
            .join(linked.select("camera_id").distinct().withColumn("_named", F.lit(True)), "camera_id", "left").join(counted, ["camera_id", "last_at"], "left").join(along, "camera_id", "left"))
    none = F.array().cast(along.schema["cameras_on_the_same_corridor"].dataType)
    return rows.select("camera_id", F.to_json(F.struct(one.alias("camera"), F.coalesce("cameras_on_the_same_corridor", none).alias("cameras_on_the_same_corridor"))).alias("document"))


def review_evidence(questions: DataFrame, leaders: DataFrame, cameras: DataFrame, regions: DataFrame, now: Column) -> DataFrame:
    """The document the leading cameras of a city are judged from together, without the equation's own score.

    `leaders`: region_id, camera_id, rank, diff, baseline, cell_n, last_at, highway,
    scale_prior, incident (its label, null for none), queue_floor, still_floor.
    `regions`: region_id, name, zone.
    """
    size = F.concat(F.regexp_replace(F.format_string("%.2f", to_fixed(F.col("scale_prior"), 2)), r"\.?0+$", ""), F.lit(" on a scale from 0, a quiet street, to 1, an urban interstate"))
    one = F.struct("rank", F.col("camera_id").cast("string").alias("camera_id"), "road", "view", (F.col("highway") == "motorway").alias("on_a_freeway"), size.alias("how_much_traffic_the_road_carries"),
                   *_told(now), F.col("cell_n").alias("frames_behind_this_hour"), F.coalesce("incident", F.lit("none")).alias("incident_reported_here"),
                   (F.coalesce("queue_floor", F.lit(0.0)) > 0).alias("queue_expected_from_an_incident_ahead"), (F.coalesce("still_floor", F.lit(0.0)) > 0).alias("stopped_traffic_confirmed"))
    view = cameras.select("camera_id", F.col("roadway").alias("road"), F.col("location").alias("view"))
    seen = leaders.join(questions.select("region_id"), "region_id", "left_semi").join(view, "camera_id").groupBy("region_id").agg(F.array_sort(F.collect_list(one)).alias("cameras"))
    hour = F.date_format(F.from_utc_timestamp(F.timestamp_micros((now * 1e6).cast("bigint")), F.col("zone")), "EEEE h a")
    rows = seen.join(regions.select("region_id", F.col("name").alias("city"), hour.alias("time_of_day")), "region_id")
    return rows.select("region_id", F.to_json(F.struct("city", "time_of_day", "cameras")).alias("document"))


def review_questions(leaders: DataFrame, last: DataFrame, now: Column) -> DataFrame:
    """Cities whose leaders are worth a second look: two at least, two minutes on, and a changed picture."""
    part = F.struct("rank", F.concat(F.col("camera_id").cast("string"), F.lit(":"), F.floor(F.col("last_at") + 0.5).cast("bigint").cast("string")).alias("t"))
    seen = leaders.groupBy("region_id").agg(F.count(F.lit(1)).alias("leaders"), F.array_join(
        F.transform(F.array_sort(F.collect_list(part)), lambda p: p["t"]), ",").alias("evidence"))
    out = seen.filter(F.col("leaders") >= 2).join(last.select("region_id", F.col("at").alias("looked_at"), F.col("evidence").alias("looked_on")), "region_id", "left")
    due = F.col("looked_at").isNull() | ((now - F.col("looked_at") >= VERDICTS.review_every_s) & (F.col("looked_on") != F.col("evidence")))
    return out.filter(due).select("region_id", "leaders", "evidence")
