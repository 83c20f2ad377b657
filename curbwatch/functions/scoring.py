"""The attention equation, one column expression per part."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import FLOORS, PRIOR, SCORE, VERDICTS
from .numeric import clamp


def aadt_prior(aadt: Column) -> Column:
    span = PRIOR.aadt_log_max - PRIOR.aadt_log_min
    return clamp((F.log10(1.0 + F.greatest(F.lit(0.0), aadt.cast("double"))) - PRIOR.aadt_log_min) / span)


def capacity_prior(lanes: Column, speed_kmh: Column, two_way: Column) -> Column:
    """Lanes per direction times speed, on a log scale; null when either is unknown."""
    per_direction = F.when(two_way, F.ceil(lanes / 2.0)).otherwise(lanes).cast("double")
    low = F.log(F.lit(PRIOR.capacity_min))
    scaled = (F.log(per_direction * speed_kmh) - low) / (F.log(F.lit(PRIOR.capacity_max)) - low)
    return F.when((lanes > 0) & (speed_kmh > 0), clamp(scaled))


def class_prior(highway: Column) -> Column:
    table = {k: v for k, v in PRIOR.classes.items()}
    table.update({f"{k}_link": round(v * PRIOR.link_factor, 3) for k, v in PRIOR.classes.items()})
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.element_at(F.create_map(*pairs), highway)


def amplifier(prior: Column) -> Column:
    return SCORE.amplifier_min + (SCORE.amplifier_max - SCORE.amplifier_min) * clamp(prior)


def warmup_cap(samples: Column) -> Column:
    return 0.5 + 0.5 * F.least(F.lit(1.0), samples / float(SCORE.warmup_samples))


def relative_movement(diff: Column, baseline: Column, samples: Column) -> Column:
    """Movement against a baseline: .5 at the baseline, capped while history is short. Null when either is unknown."""
    value = SCORE.anomaly_at_baseline * diff / F.greatest(baseline, F.lit(SCORE.activity_floor))
    return F.when(diff.isNotNull() & baseline.isNotNull(), F.least(warmup_cap(samples), value))


def shrunk_baseline(cell_n: Column, cell_mean: Column, rolling: Column) -> Column:
    n = cell_n.cast("double")
    weight = n / (n + SCORE.shrink_k)
    rest = SCORE.shrink_k / (n + SCORE.shrink_k)
    blended = weight * F.coalesce(cell_mean, F.lit(0.0)) + rest * rolling
    return F.when(rolling.isNull(), F.when(cell_n > 0, cell_mean)).otherwise(blended)


def combine(movement: Column, floor: Column) -> Column:
    """Lexicographic bands: any floor of at least .2 puts the camera in the upper half."""
    level = F.least(F.lit(1.0), F.greatest(F.lit(0.0), movement, floor))
    return F.when(floor >= SCORE.hold_min, SCORE.band + (1.0 - SCORE.band) * level).otherwise(SCORE.band * level)


def is_held(attention: Column) -> Column:
    return F.coalesce(attention > SCORE.band, F.lit(False))


def driver(movement: Column, incident: Column, queue: Column, still: Column) -> Column:
    """What set the score; floors win ties in the order incident, queue, still."""
    return (F.when((incident >= movement) & (incident >= still) & (incident >= queue), "incident")
            .when((queue >= movement) & (queue >= still), "queue")
            .when(still >= movement, "still").otherwise("movement"))


def shown_driver(movement: Column, incident: Column, queue: Column, still: Column) -> Column:
    """The interface's word for the driver: the first largest floor, with a small slack against movement."""
    best = F.greatest(incident, queue, still)
    floor = F.when(incident == best, "incident").when(queue == best, "queue").otherwise("still")
    return F.when((best > 0) & (best >= movement - 1e-6), floor).otherwise("movement")


def distance_factor(km: Column) -> Column:
    span = FLOORS.radius_km - FLOORS.near_km
    tapered = 1.0 - (1.0 - FLOORS.far_factor) * ((km - FLOORS.near_km) / span)
    return F.when(km <= FLOORS.near_km, 1.0).when(km >= FLOORS.radius_km, FLOORS.far_factor).otherwise(tapered)


def incident_level(closure: Column, relevant: Column) -> Column:
    return F.when(closure, FLOORS.closure).when(relevant, FLOORS.relevant).otherwise(0.0)


def age_factor(age_s: Column) -> Column:
    return F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age_s - FLOORS.full_s) / FLOORS.half_life_s)


def incident_floor(closure: Column, relevant: Column, reported_at: Column, km: Column, now: Column) -> Column:
    """The floor one record puts under one camera; an undated record puts none."""
    age = F.greatest(F.lit(0.0), now - reported_at)
    return F.when(reported_at.isNotNull(), incident_level(closure, relevant) * distance_factor(km) * age_factor(age)).otherwise(0.0)


def queue_reach(age_s: Column, wave_s: Column) -> Column:
    """How much of a queue could have arrived: 0 to 1, ramping over the wave's travel time."""
    safe = F.when(wave_s > 0, wave_s).otherwise(1.0)
    return (F.when(wave_s.isNull(), 0.0).when(wave_s <= 0, F.when(age_s > 0, 1.0).otherwise(0.0))
            .otherwise(clamp(age_s / safe)))


def queue_floor(anchor_floor: Column, length_m: Column, reach: Column, max_m: float) -> Column:
    return anchor_floor * FLOORS.upstream_share * clamp(1.0 - length_m / max_m) * reach


def verdict_effect(cleared: Column, score: Column, levels: Column, score_confidence: Column, supported: Column,
                   chosen: Column, chosen_confidence: Column, camera: Column, named_choice: Column) -> tuple[Column, Column]:
    """(multiplier, answers not acted on) of one verdict for one camera."""
    v = VERDICTS
    acts_clear = cleared >= v.noul
    acts_screen = (score_confidence >= v.act_confidence) & (levels > 1)
    acts_support = supported >= v.noul
    acts_choice = F.coalesce(chosen.isNotNull() & (chosen_confidence >= v.act_confidence), F.lit(False))
    swing = 1.0 + v.score_swing * (2.0 * score / F.greatest(levels - 1, F.lit(1)).cast("double") - 1.0)
    choice = F.when(chosen == camera, v.chosen_gain).when(named_choice, v.chosen_others).otherwise(1.0)
    multiplier = (F.when(acts_clear, v.cleared_residue).otherwise(1.0)
                  * F.when(acts_screen, swing).otherwise(1.0)
                  * F.when(acts_support, v.supported_lift).otherwise(1.0)
                  * F.when(acts_choice, choice).otherwise(1.0))
    gated = F.array_compact(F.array(F.when(~acts_clear, "cleared"), F.when(~acts_screen, "screen"),
                                    F.when(~acts_support, "supported"), F.when(~acts_choice, "camera")))
    return multiplier, gated


def review_factor(level: Column, levels: Column, confidence: Column) -> Column:
    """Unrounded factor of a second look; 1 when it is not confident."""
    normal = level / F.greatest(levels - 1, F.lit(1)).cast("double")
    return F.when(confidence >= VERDICTS.act_confidence, 1.0 + VERDICTS.review_swing * (2.0 * normal - 1.0)).otherwise(1.0)


def trigger_reason(cause: Column, incident: Column, still: Column, anomaly: Column, baseline_n: Column,
                   min_anomaly: float) -> Column:
    return (F.when((cause == "incident") & (incident > 0), "incident")
            .when((cause == "still") & (still > 0), "still")
            .when((cause != "queue") & (anomaly >= min_anomaly) & (baseline_n >= SCORE.cell_samples), "movement"))
