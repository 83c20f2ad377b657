"""One plan from polls and incidents to a score per camera."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CORRIDOR, PRIOR, SCORE
from ..functions.numeric import clamp, to_fixed, with_fixed
from ..functions.scoring import (
    aadt_prior, amplifier, capacity_prior, class_prior, combine, driver, relative_movement, shrunk_baseline,
    shown_driver, trigger_reason, warmup_cap,
)
from ..operators.baseline import camera_state, region_median
from ..operators.floors import floors_by_record, incident_cameras, queue_floors, strongest_floor


def scale_priors(cameras: DataFrame) -> DataFrame:
    """Road size of each camera and where it came from: count, capacity, class, default."""
    raw = cameras.withColumns({
        "_a": F.when(F.col("aadt").isNotNull(), aadt_prior(F.col("aadt"))),
        "_c": capacity_prior(F.col("lanes"), F.col("speed_kmh"), F.col("two_way")),
        "_k": class_prior(F.col("highway"))})
    source = (F.when(F.col("_a").isNotNull(), "aadt").when(F.col("_c").isNotNull(), "capacity")
              .when(F.col("_k").isNotNull(), "class").otherwise("default"))
    out = raw.withColumns({"scale_prior_source": source,
                           "scale_prior": F.coalesce(to_fixed(F.col("_a"), 3), to_fixed(F.col("_c"), 3), F.col("_k"), F.lit(PRIOR.default))})
    return out.withColumn("amplifier", amplifier(F.col("scale_prior"))).drop("_a", "_c", "_k")


@dataclass
class Inputs:
    """Tables one scoring pass reads. Optional tables left out mean the plain equation."""
    fresh: DataFrame
    cameras: DataFrame
    incidents: DataFrame
    now: Column
    corridor: DataFrame | None = None
    gates: DataFrame | None = None
    reviews: DataFrame | None = None
    verdicts: DataFrame | None = None
    baselines: DataFrame | None = None
    links: DataFrame | None = None


def score_cameras(x: Inputs) -> DataFrame:
    """Attention and its parts for every polled camera; no score where nothing is known."""
    state = camera_state(x.fresh, x.now)
    priors = scale_priors(x.cameras)
    medians = region_median(x.fresh, x.cameras).select("region_id", "region_diff")
    links = x.links if x.links is not None else incident_cameras(x.incidents, x.cameras)
    floors = strongest_floor(floors_by_record(links, x.incidents, x.now, x.verdicts))
    df = state.join(priors, "camera_id").join(medians, "region_id", "left").join(floors, "camera_id", "left")
    if x.corridor is not None:
        df = df.join(queue_floors(links, x.incidents, x.corridor, x.gates, x.now, x.verdicts), "camera_id", "left")
    else:
        df = df.withColumns({"queue_floor": F.lit(None).cast("double"), "queue_source": F.lit(None).cast("string"),
                             "queue_cause": F.lit(None).cast("string"), "queue_anchor": F.lit(None).cast("bigint"),
                             "queue_length_m": F.lit(None).cast("double"), "queue_chosen": F.lit(None).cast("boolean")})
    if x.gates is not None:
        df = df.join(x.gates.select("camera_id", "gate_floor", F.col("read_at").alias("gate_at")), "camera_id", "left")
    else:
        df = df.withColumns({"gate_floor": F.lit(None).cast("double"), "gate_at": F.lit(None).cast("double")})
    if x.reviews is not None:
        df = df.join(x.reviews.select("camera_id", "factor", "acted"), "camera_id", "left")
    else:
        df = df.withColumns({"factor": F.lit(None).cast("double"), "acted": F.lit(None).cast("boolean")})
    if x.baselines is not None:
        learned = x.baselines.select("camera_id", F.col("cell_n").alias("l_n"), F.col("cell_mean").alias("l_mean"), F.col("cell_sd").alias("l_sd"))
        df = (df.drop("cell_n", "cell_mean", "cell_sd").join(learned, "camera_id", "left")
              .withColumns({"cell_n": F.coalesce("l_n", F.lit(0)), "cell_mean": F.col("l_mean"), "cell_sd": F.col("l_sd")})
              .drop("l_n", "l_mean", "l_sd"))
    return attention_columns(df)


def attention_columns(df: DataFrame) -> DataFrame:
    """The projection from known parts to a score."""
    samples = F.coalesce("samples", F.lit(0))
    df = df.withColumns({
        "samples": samples,
        "rolling": F.when(samples >= SCORE.min_samples, F.col("own_median")).otherwise(F.col("region_diff")),
        "incident_floor": F.coalesce("incident_floor", F.lit(0.0)),
        "incident_base": F.coalesce("incident_base", F.lit(0.0)),
        "queue_floor": F.coalesce("queue_floor", F.lit(0.0)),
        "still_floor": F.coalesce("gate_floor", F.lit(0.0)),
        "look": F.when(F.col("acted"), F.col("factor")).otherwise(1.0)})
    df = df.withColumns({
        "activity_raw": relative_movement(F.col("diff"), F.col("rolling"), F.col("samples")),
        "mu": shrunk_baseline(F.col("cell_n"), F.col("cell_mean"), F.col("rolling"))})
    df = df.withColumn("anomaly_raw", relative_movement(F.col("diff"), F.col("mu"), F.col("samples")))
    df = df.withColumns({"activity": to_fixed(F.col("activity_raw"), 3), "anomaly": to_fixed(F.col("anomaly_raw"), 3)})
    # Spectacle equals anomaly while no absolute volume measure exists, so the two weights act on one value.
    visual = (SCORE.weight_anomaly + SCORE.weight_spectacle) * F.coalesce("anomaly", F.lit(0.0))
    df = df.withColumns({"plain_movement": F.col("amplifier") * visual,
                         "strongest": F.greatest("incident_floor", "queue_floor", "still_floor")})
    df = df.withColumn("looked", F.col("plain_movement") * F.col("look"))
    unknown = F.col("anomaly").isNull() & (F.col("strongest") == 0)
    df = with_fixed(df, 3, equation=F.when(~unknown, combine(F.col("plain_movement"), F.col("strongest"))),
                    movement=F.when(~unknown, clamp(F.col("looked"))),
                    attention=F.when(~unknown, combine(F.col("looked"), F.col("strongest"))),
                    incident_floor_r=F.col("incident_floor"), queue_floor_r=F.col("queue_floor"), base_r=F.col("incident_base"))
    df = df.withColumns({
        "incident_floor_raw": F.col("incident_floor"), "incident_floor": F.col("incident_floor_r"),
        "queue_floor": F.col("queue_floor_r"), "incident_base": F.col("base_r"),
        "driver": driver(F.col("looked"), F.col("incident_floor_r"), F.col("queue_floor_r"), F.col("still_floor"))})
    df = df.withColumns({
        "shown_driver": F.when(F.col("attention").isNotNull(), shown_driver(
            F.coalesce("movement", F.lit(0.0)), F.col("incident_floor"), F.col("queue_floor"), F.col("still_floor"))),
        "trigger": trigger_reason(F.col("driver"), F.col("incident_floor"), F.col("still_floor"), F.col("anomaly"),
                                  F.col("cell_n"), CORRIDOR.promote_anomaly)})
    strength = (F.when(F.col("trigger") == "incident", F.col("incident_floor")).when(F.col("trigger") == "still", F.col("still_floor"))
                .when(F.col("trigger") == "movement", F.col("anomaly")))
    # A still picture in an hour whose cell says it moves: the camera may be stuck, or traffic stopped.
    expects = (F.col("cell_n") >= SCORE.cell_samples) & (F.col("cell_mean") > SCORE.active_diff)
    flag = F.coalesce((F.col("diff") <= SCORE.activity_floor) & expects, F.lit(False))
    return df.withColumns({"trigger_strength": strength, "ambiguous": flag}).drop(
        "activity_raw", "anomaly_raw", "looked", "plain_movement", "incident_floor_r", "queue_floor_r", "base_r",
        "gate_floor", "look", "region_diff", "own_median")


__all__ = ["Inputs", "attention_columns", "scale_priors", "score_cameras", "warmup_cap"]
