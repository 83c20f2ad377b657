"""Every number the library depends on, one frozen group per topic.

The values are fixed: results are only comparable when they are kept. A table
of alternative tunings is passed as a replaced instance.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Score:
    anomaly_at_baseline: float = 0.5
    amplifier_min: float = 0.5
    amplifier_max: float = 1.5
    hold_min: float = 0.2
    band: float = 0.5
    weight_anomaly: float = 0.5
    weight_spectacle: float = 0.5
    activity_floor: float = 0.004
    active_diff: float = 0.008
    min_samples: int = 3
    warmup_samples: int = 10
    history: int = 24
    ring: int = 10
    shrink_k: float = 5.0
    cell_samples: int = 5
    learn_skip_ratio: float = 2.0
    learn_resume_s: float = 10800.0
    hot_activity: float = 0.72
    stale_periods: float = 3.0


@dataclass(frozen=True)
class Prior:
    aadt_log_min: float = math.log10(1001.0)
    aadt_log_max: float = math.log10(200001.0)
    capacity_min: float = 40.0
    capacity_max: float = 440.0
    link_factor: float = 0.7
    default: float = 0.3
    # Road class to prior.
    classes: dict = field(default_factory=lambda: {
        "motorway": 1.0, "trunk": 0.8, "primary": 0.6, "secondary": 0.45,
        "tertiary": 0.3, "unclassified": 0.2, "residential": 0.2, "service": 0.15,
    })


@dataclass(frozen=True)
class Floors:
    closure: float = 0.9
    relevant: float = 0.6
    upstream_share: float = 0.6
    full_s: float = 3600.0
    half_life_s: float = 1800.0
    near_km: float = 0.25
    far_factor: float = 0.25
    radius_km: float = 1.5
    max_cameras: int = 6
    region_margin_deg: float = 0.05


@dataclass(frozen=True)
class Corridor:
    promote_hops: int = 2
    promote_max: int = 30
    promote_hold_s: float = 300.0
    promote_anomaly: float = 0.9
    upstream_hops: int = 3
    wave_kmh: float = 15.0
    max_upstream_m: float = 5000.0


@dataclass(frozen=True)
class Verdicts:
    act_confidence: float = 0.5
    score_swing: float = 0.5
    noul: float = 0.8
    cleared_residue: float = 0.1
    supported_lift: float = 1.2
    chosen_gain: float = 1.25
    chosen_others: float = 0.75
    gridlock_floor: float = 0.6
    gate_hold_s: float = 600.0
    gate_reask_s: float = 300.0
    reask_s: float = 60.0
    review_hold_s: float = 600.0
    review_swing: float = 0.25
    review_every_s: float = 120.0
    review_top_k: int = 8
    max_neighbors: int = 4
    max_options: int = 10
    history_points: int = 40


@dataclass(frozen=True)
class City:
    pulse_recent_s: float = 300.0
    pulse_min_cameras: int = 2
    sky_recent_s: float = 1200.0
    sky_history_min: int = 4
    sky_low_ratio: float = 0.7
    sky_min_cameras: int = 4
    sky_min_share: float = 0.5
    daylight_deg: float = 10.0
    snow_white: float = 0.25
    snow_rise: float = 0.15
    snow_min_cameras: int = 3
    snow_min_share: float = 1.0 / 3.0
    diary_repeat_s: float = 1800.0
    pulse_gap_s: float = 600.0


@dataclass(frozen=True)
class Ranking:
    board_size: int = 30
    board_max_age_s: float = 1200.0
    highlights: int = 5
    highlight_min: float = 0.25
    queue_mention_min: float = 0.1
    scores_per_region: int = 15
    log_top: int = 30
    log_interval_s: float = 10.0
    hysteresis: int = 4
    radar_per_region: int = 10
    radar_period_s: float = 600.0
    radar_rotate_s: float = 3600.0
    watch_per_incident: int = 2
    watch_max: int = 24
    relay_cameras: int = 5


@dataclass(frozen=True)
class Polling:
    margin_s: float = 4.0
    min_delay_s: float = 10.0
    unavailable_s: float = 300.0
    max_stretch: float = 4.0
    stretch_step: float = 0.5
    slow_period_s: float = 600.0
    on_screen_s: float = 5.0
    off_screen_s: float = 10.0
    visible_ttl_s: float = 30.0


@dataclass(frozen=True)
class Roads:
    snap_max_m: float = 80.0
    ref_match_bonus: float = 60.0
    ref_conflict_penalty: float = 40.0
    ref_missing_penalty: float = 10.0
    mainline_penalty: float = 80.0
    direction_penalty: float = 50.0
    site_merge_m: float = 40.0
    same_carriageway_deg: float = 45.0
    mirror_max_m: float = 90.0
    opposite_deg: float = 135.0
    nearby_max_m: float = 150.0
    adjacency_cutoff_m: float = 8000.0
    max_detour_ratio: float = 2.5
    passby_m: float = 60.0
    count_max_m: float = 150.0
    same_road_deg: float = 40.0
    mph_to_kmh: float = 0.44704 * 3.6
    # Free-flow speed in mph where no limit is tagged.
    default_mph: dict = field(default_factory=lambda: {
        "motorway": 70.0, "motorway_link": 45.0, "trunk": 55.0, "trunk_link": 35.0,
        "primary": 45.0, "primary_link": 35.0, "secondary": 35.0, "secondary_link": 30.0,
    })
    default_mph_other: float = 30.0


@dataclass(frozen=True)
class Preference:
    l2: float = 0.02
    rate: float = 0.5
    steps: int = 400
    folds: int = 10
    bootstrap: int = 2000
    seed: int = 511
    min_votes: int = 10
    asked_at_random: int = 5
    max_votes: int = 2000
    disagree_equation: float = 0.02
    disagree_look: float = 0.25
    # The eight features, in order.
    factors: tuple = ("movement", "road", "incident", "queue", "stopped", "dark", "bright", "freeway")


SCORE = Score()
PRIOR = Prior()
FLOORS = Floors()
CORRIDOR = Corridor()
VERDICTS = Verdicts()
CITY = City()
RANKING = Ranking()
POLLING = Polling()
ROADS = Roads()
PREFERENCE = Preference()
EARTH_M = 6371008.8
UID_BLOCK = 10_000_000
ID_MODULUS = 9_999_991
