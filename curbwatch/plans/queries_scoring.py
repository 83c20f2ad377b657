"""Queries over polls: baselines, floors, scores and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import VERDICTS
from ..operators import baseline as B
from ..operators import corridor as C
from ..operators import floors as L
from ..operators import ranking as R
from .fixtures import Fixtures
from .oracle_base import fixed, hav_km, r
from .registry import query, rounded
from .scoring import Inputs, scale_priors, score_cameras

HOLD_S = 86400.0


def plain_scores(fx: Fixtures) -> DataFrame:
    """One scoring pass kept as a table; boards, tiers and city summaries are views of it."""
    return fx.kept("plain_scores", lambda: score_plain(fx))


def score_plain(fx: Fixtures) -> DataFrame:
    return score_cameras(Inputs(fx.fresh, fx.camera, fx.incident, fx.now, corridor=fx.corridor, links=fx.links))


def gates_now(fx: Fixtures) -> DataFrame:
    return L.gate_floor(L.latest_reading(fx.reading, fx.now, HOLD_S))


def full_scores(fx: Fixtures) -> DataFrame:
    return fx.kept("full_scores", lambda: score_full(fx))


def score_full(fx: Fixtures) -> DataFrame:
    gates = gates_now(fx)
    return score_cameras(Inputs(fx.fresh, fx.camera, fx.incident, fx.now, corridor=fx.corridor, links=fx.links, gates=gates,
                                reviews=L.review_effect(gates), verdicts=L.current_verdicts(fx.incident, fx.verdict)))


@query("a1_region_median", f"SELECT region_id, {r('region_diff')} AS region_diff, region_diff_n FROM regmed")
def a1(fx):
    return rounded(B.region_median(fx.fresh, fx.camera)).withColumn("region_id", F.col("region_id").cast("int"))


@query("w1_rolling_median", f"""SELECT poll_id, camera_id, samples, {r('CASE WHEN samples>=3 THEN m END')} AS rolling FROM (
  SELECT poll_id, camera_id, count(*) OVER w AS samples, median(diff) OVER w AS m FROM fx_fresh
  WINDOW w AS (PARTITION BY camera_id ORDER BY at, poll_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))""")
def w1(fx):
    return rounded(B.rolling_median(fx.fresh).select("poll_id", "camera_id", "samples", "rolling"))


@query("w2_hour_of_week_cell", f"""SELECT poll_id, camera_id, CAST(cell AS BIGINT) AS cell, cell_n, {r('cell_mean', 12)} AS cell_mean,
  CASE WHEN cell_n>=2 THEN {r('cell_sd', 5)} END AS cell_sd FROM hist_dense""")
def w2(fx):
    out = B.cell_before(fx.fresh_dense).select("poll_id", "camera_id", "cell", "cell_n", "cell_mean", "cell_sd")
    return rounded(out.withColumn("cell_sd", F.round("cell_sd", 5)), 12)


@query("w3_blended_baseline", f"""SELECT poll_id, cell_n, {r('CASE WHEN rolling IS NULL THEN (CASE WHEN cell_n>0 THEN cell_mean END) ELSE cell_n/(cell_n+5E0)*coalesce(cell_mean,0E0)+5E0/(cell_n+5E0)*rolling END', 12)} AS baseline
  FROM (SELECT poll_id, CASE WHEN count(*) OVER w>=3 THEN median(diff) OVER w END AS rolling FROM fx_fresh_dense
  WINDOW w AS (PARTITION BY camera_id ORDER BY at, poll_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)) JOIN hist_dense USING (poll_id)""")
def w3(fx):
    return rounded(B.blended_baseline(fx.fresh_dense).select("poll_id", "cell_n", "baseline"), 12)


@query("w4_frame_difference", """SELECT camera_id, seq, round(diff, 5)+0E0 AS diff FROM (SELECT camera_id, seq,
  list_sum(list_transform(list_zip(thumb, prev), lambda z: abs(z[1]-z[2])))/len(thumb) AS diff FROM (
  SELECT camera_id, seq, thumb, lag(thumb) OVER (PARTITION BY camera_id ORDER BY seq) AS prev FROM (
  SELECT CAST(label AS BIGINT) AS camera_id, vec_id AS seq, list_transform(embedding, lambda v: least(1E0, greatest(0E0, CAST(v AS DOUBLE)*0.5E0+0.5E0))) AS thumb FROM embeddings)))""")
def w4(fx):
    return rounded(B.frame_difference(fx.thumb).select("camera_id", "seq", "diff"), 5)


@query("w5_frame_ring", f"""SELECT camera_id, CAST(n-age_rank AS BIGINT) AS k, CAST(-age_rank AS BIGINT) AS negative_k, {r('at')} AS at, {r('brightness')} AS brightness, {r('diff')} AS diff FROM (
  SELECT q.*, count(*) OVER (PARTITION BY camera_id) AS n FROM recent q JOIN fx_camera USING (camera_id) WHERE age_rank<=10 AND (age_rank=1 OR region_id%2=0))""")
def w5(fx):
    return rounded(B.frame_ring(fx.fresh, fx.camera, F.col("region_id") % 2 != 0))


@query("w10_score_history", f"""SELECT camera_id, {r('act')} AS value, {r('now-at')} AS age_s FROM (SELECT camera_id, at, diff/3E-1 AS act FROM fx_fresh), clock WHERE at<=now AND now-at<=86400E0""")
def w10(fx):
    scores = fx.fresh.select("camera_id", "at", (F.col("diff") / 0.3).alias("value"))
    return rounded(B.score_history(scores, fx.now, 86400.0).select("camera_id", "value", "age_s"))


@query("a5_ambiguous_zero_rates", f"""SELECT CAST(h.range AS BIGINT) AS hour, coalesce(polls, 0) AS polls, coalesce(flagged, 0) AS flagged, {fixed('rate0', 4)} AS rate FROM (
  SELECT range, polls, flagged, CASE WHEN polls>0 THEN flagged/CAST(polls AS DOUBLE) END AS rate0 FROM range(24) LEFT JOIN (
  SELECT cell%24 AS hour, count(*) AS polls, CAST(count(*) FILTER (WHERE diff<=0.004E0 AND cell_n>=5 AND cell_mean>0.008E0) AS BIGINT) AS flagged FROM hist_dense GROUP BY 1) ON hour=range) h""")
def a5(fx):
    return B.ambiguous_rates(fx.fresh_dense).select(F.col("hour").cast("bigint").alias("hour"), "polls", "flagged", "rate")


@query("p45_ambiguous_zero", """SELECT poll_id, camera_id, cell_n, coalesce(diff<=0.004E0 AND cell_n>=5 AND cell_mean>0.008E0, FALSE) AS ambiguous FROM hist_dense""")
def p45(fx):
    return B.ambiguous_zero(fx.fresh_dense).select("poll_id", "camera_id", "cell_n", "ambiguous")


@query("a16_poll_counts", """SELECT camera_id, count(*) AS polls, count(*) FILTER (WHERE result IN ('unchanged','not_modified')) AS unchanged,
  count(*) FILTER (WHERE result='unavailable') AS unavailable, count(*) FILTER (WHERE result='error') AS errors, count(*) FILTER (WHERE result='fresh') AS frames FROM fx_poll GROUP BY camera_id""")
def a16(fx):
    return B.poll_counts(fx.poll)


@query("t7_quiet_stretch", """SELECT poll_id, quiet_run, least(4E0, 1E0+0.5E0*quiet_run) AS stretch FROM (
  SELECT poll_id, CAST(sum(q) OVER (PARTITION BY camera_id, grp ORDER BY at, poll_id) AS BIGINT) AS quiet_run FROM (
  SELECT *, CASE WHEN d<=0.004E0 THEN 1 ELSE 0 END AS q, sum(CASE WHEN d>0.008E0 THEN 1 ELSE 0 END) OVER (PARTITION BY camera_id ORDER BY at, poll_id) AS grp FROM (
  SELECT *, CASE result WHEN 'fresh' THEN diff WHEN 'unchanged' THEN 0E0 END AS d FROM fx_poll_dense)))""")
def t7(fx):
    return B.quiet_stretch(fx.poll_dense).select("poll_id", "quiet_run", "stretch")


@query("t8_next_poll_delay", f"""SELECT poll_id, {r('CASE WHEN result=$$unavailable$$ THEN 300E0 WHEN result=$$not_modified$$ OR m IS NULL OR m+64E0-at<0 THEN 64E0 ELSE least(64E0, greatest(10E0, m+64E0-at)) END')} AS delay
  FROM (SELECT *, CASE WHEN poll_id%6<>0 THEN at-(poll_id*13)%90 END AS m FROM fx_poll)""")
def t8(fx):
    modified = F.when(F.col("poll_id") % 6 != 0, F.col("at") - (F.col("poll_id") * 13) % 90)
    return rounded(B.next_delay(fx.poll, F.lit(60.0), modified).select("poll_id", "delay"))


@query("p21_scale_prior", f"SELECT camera_id, scale_prior, scale_prior_source, {r('amplifier')} AS amplifier FROM prior")
def p21(fx):
    return rounded(scale_priors(fx.camera).select("camera_id", "scale_prior", "scale_prior_source", "amplifier"))


@query("j4_incident_cameras", f"SELECT incident_id, camera_id, {r('km')} AS km, CAST(rank AS BIGINT) AS rank FROM links")
def j4(fx):
    return rounded(L.incident_cameras(fx.incident, fx.camera))


CODES_SQL = "(VALUES ('T1','Crash',TRUE,FALSE),('T2','Road blocked',TRUE,TRUE),('T3','Traffic stop',FALSE,FALSE)) AS codes(type, c_label, c_rel, c_clo)"


@query("j5_incident_codes", f"""SELECT incident_id, coalesce(label, c_label) AS label, coalesce(road_relevant, c_rel, FALSE) AS road_relevant, coalesce(implies_closure, c_clo, FALSE) AS implies_closure
  FROM (SELECT incident_id, type, CASE WHEN incident_id%5=0 THEN 'own label' END AS label, CASE WHEN incident_id%2=0 THEN road_relevant END AS road_relevant,
  CASE WHEN incident_id%4=0 THEN implies_closure END AS implies_closure FROM fx_incident) LEFT JOIN {CODES_SQL} USING (type)""")
def j5(fx):
    i = F.col("incident_id")
    raw = fx.incident.withColumns({"label": F.when(i % 5 == 0, "own label"), "road_relevant": F.when(i % 2 == 0, F.col("road_relevant")),
                                   "implies_closure": F.when(i % 4 == 0, F.col("implies_closure"))})
    codes = fx.spark.createDataFrame([("T1", "Crash", True, False), ("T2", "Road blocked", True, True), ("T3", "Traffic stop", False, False)],
                                     "type string, label string, road_relevant boolean, implies_closure boolean")
    return L.enrich_incidents(raw, F.broadcast(codes)).select("incident_id", "label", "road_relevant", "implies_closure")


@query("j6_incidents_near_region", """SELECT r.region_id, i.incident_id FROM fx_incident i JOIN fx_region r
  ON i.lat BETWEEN r.lat-0.02E0-0.01E0 AND r.lat+0.02E0+0.01E0 AND i.lon BETWEEN r.lon-0.02E0-0.01E0 AND r.lon+0.02E0+0.01E0""")
def j6(fx):
    return L.incidents_near_regions(fx.incident, region_boxes(fx), 0.01).select("region_id", "incident_id")


def region_boxes(fx: Fixtures) -> DataFrame:
    return fx.region.select("region_id", "source_id", "name", (F.col("lat") - 0.02).alias("south"), (F.col("lat") + 0.02).alias("north"),
                            (F.col("lon") - 0.02).alias("west"), (F.col("lon") + 0.02).alias("east"))


@query("j6_feed_status", """SELECT r.region_id, CASE WHEN f.source_id IS NULL THEN 'unconfigured' WHEN f.fetched IS NULL THEN (CASE WHEN r.region_id%2=0 THEN 'unavailable' ELSE 'idle' END)
  WHEN f.healthy THEN 'ok' ELSE 'unavailable' END AS status FROM fx_region r LEFT JOIN (SELECT source_id, CASE WHEN source_id<>2 THEN max(reported_at) END AS fetched, source_id<>3 AS healthy
  FROM fx_incident JOIN fx_region USING (region_id) WHERE source_id<>4 GROUP BY source_id) f ON f.source_id=r.source_id""")
def j6b(fx):
    by_source = fx.incident.join(fx.region.select("region_id", "source_id"), "region_id").filter(F.col("source_id") != 4)
    feeds = by_source.groupBy("source_id").agg(F.max("reported_at").alias("m")).select(
        "source_id", F.when(F.col("source_id") != 2, F.col("m")).alias("fetched_at"), (F.col("source_id") != 3).alias("healthy"))
    return L.feed_status(fx.region.withColumn("watched", F.col("region_id") % 2 == 0), feeds).select("region_id", "status")


@query("j7_incident_floor", f"SELECT camera_id, {r('incident_floor')} AS incident_floor, incident_id, incident FROM floor_plain")
def j7(fx):
    out = L.strongest_floor(L.floors_by_record(fx.links, fx.incident, fx.now))
    return rounded(out.select("camera_id", "incident_floor", "incident_id", "incident"))


@query("j8_queue_floor", f"SELECT camera_id, {r('queue_floor')} AS queue_floor, queue_source, queue_cause, queue_anchor, queue_length_m FROM queue_plain")
def j8(fx):
    out = L.queue_floors(fx.links, fx.incident, fx.corridor, None, fx.now)
    return rounded(out.drop("queue_chosen"))


@query("j9_chosen_queue", f"SELECT camera_id, {r('queue_floor')} AS queue_floor, queue_source, queue_cause, queue_anchor, queue_length_m, queue_chosen FROM queue_full")
def j9(fx):
    return rounded(L.queue_floors(fx.links, fx.incident, fx.corridor, gates_now(fx), fx.now, L.current_verdicts(fx.incident, fx.verdict)))


@query("j10_current_verdict", "SELECT incident_id, chosen FROM verdict_now")
def j10(fx):
    return L.current_verdicts(fx.incident, fx.verdict).select("incident_id", "chosen")


@query("j11_latest_reading", f"SELECT camera_id, reading_id, {r('standstill')} AS standstill, {r('gate_floor')} AS gate_floor FROM gate_now")
def j11(fx):
    return rounded(gates_now(fx).select("camera_id", "reading_id", "standstill", "gate_floor"))


@query("j11_reading_as_of_poll", f"""SELECT p.poll_id, q.reading_id, {r('q.standstill')} AS standstill FROM (SELECT poll_id, camera_id, at FROM fx_poll_dense) p
  ASOF LEFT JOIN (SELECT reading_id, camera_id%8 AS camera_id, read_at, standstill FROM fx_reading) q ON p.camera_id=q.camera_id AND p.at>=q.read_at AND TRUE
  WHERE q.reading_id IS NULL OR p.at-q.read_at<=3600E0
  UNION ALL SELECT p.poll_id, NULL, NULL FROM (SELECT poll_id, camera_id, at FROM fx_poll_dense) p
  ASOF LEFT JOIN (SELECT reading_id, camera_id%8 AS camera_id, read_at, standstill FROM fx_reading) q ON p.camera_id=q.camera_id AND p.at>=q.read_at
  WHERE q.reading_id IS NOT NULL AND p.at-q.read_at>3600E0""".replace(" AND TRUE", ""))
def j11b(fx):
    readings = fx.reading.withColumn("camera_id", F.col("camera_id") % 8)
    out = L.reading_as_of(fx.poll_dense, readings, 3600.0)
    return rounded(out.select("poll_id", "reading_id", "standstill"))


@query("p40_verdict_effect", f"""SELECT incident_id, camera_id, {r('multiplier')} AS multiplier,
  concat_ws('+', CASE WHEN cleared>=0.8E0 THEN NULL ELSE 'cleared' END, CASE WHEN score_confidence>=0.5E0 THEN NULL ELSE 'screen' END,
  CASE WHEN supported>=0.8E0 THEN NULL ELSE 'supported' END, CASE WHEN chosen IS NOT NULL AND chosen_confidence>=0.5E0 THEN NULL ELSE 'camera' END) AS gated FROM judged_floor WHERE judged""")
def p40(fx):
    v = L.current_verdicts(fx.incident, fx.verdict)
    out = L.verdict_for_cameras(fx.links, v).filter(F.col("multiplier").isNotNull())
    return rounded(out.select("incident_id", "camera_id", "multiplier", F.array_join("gated", "+").alias("gated")))


@query("p41_review_factor", f"SELECT camera_id, {r('factor')} AS factor, acted FROM look_now")
def p41(fx):
    return L.review_effect(gates_now(fx)).select("camera_id", "factor", "acted")


FLAGSHIP_SQL = f"""SELECT region_id, CAST(rank AS BIGINT) AS rank, camera_id, attention, movement, activity, anomaly, incident_floor, queue_floor, scale_prior, scale_prior_source,
  {r('amplifier')} AS amplifier, {fixed('mu', 5)} AS baseline, cell_n AS baseline_n, driver FROM (
  SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY attention DESC, camera_id) AS rank FROM scored_plain) WHERE rank<=15"""
FLAGSHIP_COLUMNS = ["region_id", "rank", "camera_id", "attention", "movement", "activity", "anomaly", "incident_floor", "queue_floor",
                    "scale_prior", "scale_prior_source", "amplifier", "baseline", "baseline_n", "driver"]


@query("rank_cameras_per_city", FLAGSHIP_SQL)
def flagship(fx):
    top = R.top_regions(score_plain(fx))
    from ..functions.numeric import to_fixed
    out = top.withColumns({"baseline": to_fixed(F.col("mu"), 5), "baseline_n": F.col("cell_n"), "rank": F.col("rank").cast("bigint"),
                           "amplifier": F.round("amplifier", 6)})
    return out.select(*FLAGSHIP_COLUMNS)


@query("p28_attention_with_arbiter", """SELECT camera_id, attention, equation, movement, activity, anomaly, incident_floor, incident_base, queue_floor, still_floor,
  driver, shown_driver, reason AS trigger FROM scored_full""")
def p28(fx):
    return score_full(fx).select("camera_id", "attention", "equation", "movement", "activity", "anomaly", "incident_floor", "incident_base",
                                  "queue_floor", "still_floor", "driver", "shown_driver", "trigger")


@query("a4_region_summary", f"""SELECT r.region_id, count(s.camera_id) AS scored, max(CASE WHEN s.rn=1 THEN s.camera_id END) AS top_camera,
  max(CASE WHEN s.rn=1 THEN s.attention END) AS top_attention, {r('coalesce(avg(CASE WHEN s.rn<=5 THEN s.attention END), 0E0)')} AS top5_mean,
  count(*) FILTER (WHERE s.incident_floor>0) AS incident_floored, count(*) FILTER (WHERE s.ambiguous) AS still FROM fx_region r LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY attention DESC, camera_id) AS rn FROM scored_plain) s
  ON s.region_id=r.region_id GROUP BY r.region_id""")
def a4(fx):
    from ..operators.city import region_summary
    out = region_summary(fx.region, plain_scores(fx))
    return rounded(out).withColumn("region_id", F.col("region_id").cast("int"))


@query("k2_national_board", """SELECT camera_id, attention, capped FROM (SELECT *, row_number() OVER (ORDER BY rs DESC, attention DESC, camera_id) AS rn FROM (
  SELECT *, CASE WHEN capped THEN 0.5E0*movement ELSE attention END AS rs FROM (
  SELECT *, attention>0.5E0 AND row_number() OVER (PARTITION BY attention>0.5E0 ORDER BY attention DESC, camera_id)>15 AS capped FROM scored_plain, clock WHERE now-last_at<=86400E0))) WHERE rn<=30""")
def k2(fx):
    return R.board(plain_scores(fx), fx.now, max_age_s=86400.0).select("camera_id", "attention", "capped")


@query("k2_board_filters", "SELECT DISTINCT source_id, region_id FROM scored_plain, clock WHERE now-last_at<=1200E0")
def k2b(fx):
    return R.board_filters(plain_scores(fx), fx.now)


@query("w7_held_cap", """SELECT camera_id, region_id, capped, CASE WHEN capped THEN 0.5E0*movement ELSE attention END AS rank_score FROM (
  SELECT *, attention>0.5E0 AND row_number() OVER (PARTITION BY region_id, attention>0.5E0 ORDER BY attention DESC, camera_id)>2 AS capped FROM scored_plain)""")
def w7(fx):
    return R.cap_held(plain_scores(fx), ["region_id"], 2).select("camera_id", "region_id", "capped", "rank_score")


@query("w8_wall_tiers", """SELECT camera_id, CAST(pos AS BIGINT) AS position, CASE WHEN pos < big + CASE WHEN was='big' THEN 4 ELSE 0 END THEN 'big'
  WHEN pos < big + wide + CASE WHEN was='unit' THEN 0 ELSE 4 END THEN 'wide' ELSE 'unit' END AS tier, pos < big AS top FROM (
  SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY rs DESC, attention DESC, camera_id)-1 AS pos FROM (
  SELECT *, CASE WHEN attention>0.5E0 AND hr>floor((big+wide)/2E0) THEN 0.5E0*movement ELSE attention END AS rs FROM (
  SELECT *, greatest(2, floor(n/26E0+0.5E0)) AS big, greatest(4, floor(n/9E0+0.5E0)) AS wide FROM (
  SELECT *, row_number() OVER (PARTITION BY region_id, attention>0.5E0 ORDER BY attention DESC, camera_id) AS hr, count(*) OVER (PARTITION BY region_id) AS n,
  CASE camera_id%5 WHEN 0 THEN 'big' WHEN 1 THEN 'wide' ELSE 'unit' END AS was FROM scored_plain))))""")
def w8(fx):
    k = F.col("camera_id")
    previous = fx.camera.select("camera_id", F.when(k % 5 == 0, "big").when(k % 5 == 1, "wide").otherwise("unit").alias("tier"))
    return R.wall_tiers(plain_scores(fx), ["region_id"], previous).select("camera_id", "position", "tier", "top")


@query("k4_radar_anchors", """SELECT region_id, camera_id FROM (SELECT region_id, camera_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY region_id) AS n FROM prior WHERE region_id%3<>0
  WINDOW w AS (PARTITION BY region_id ORDER BY scale_prior DESC, camera_id)) WHERE ((place-1-(30%n))%n+n)%n<10""")
def k4(fx):
    watched = fx.region.filter(F.col("region_id") % 3 == 0)
    return R.radar_anchors(scale_priors(fx.camera), watched, 3 * 3600.0 + 5).select("region_id", "camera_id")


@query("k6_promotions", """SELECT uid, because, reason, CAST(hops AS BIGINT) AS hops, round(strength, 6)+0E0 AS strength FROM (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY hops, strength DESC, sr, length_m, because) AS rn FROM (
  SELECT c.neighbor_id AS uid, s.camera_id AS because, s.reason, c.hops, CASE s.reason WHEN 'incident' THEN s.incident_floor ELSE s.anomaly END AS strength,
  CASE c.side WHEN 'upstream' THEN 0 WHEN 'downstream' THEN 1 ELSE 2 END AS sr, c.length_m FROM scored_plain s JOIN promo c ON c.camera_id=s.camera_id, clock
  WHERE s.reason IS NOT NULL AND now-s.last_at<300E0*400)) WHERE rn=1 ORDER BY hops, strength DESC, sr, length_m, uid, because LIMIT 30)""")
def k6(fx):
    wide = C.corridor(fx.edge, fx.site_camera.select("site_id", "camera_id"), promotion=True)
    t = plain_scores(fx).filter(F.col("trigger").isNotNull()).select(
        "camera_id", F.col("trigger").alias("reason"), F.col("trigger_strength").alias("strength"), (fx.now - (fx.now - F.col("last_at")) / 400.0).alias("at"))
    return rounded(C.promotions(t, wide, fx.now).select("uid", "because", "reason", "hops", "strength"))


@query("k6_promotions_of_triggers", """SELECT uid, because, reason, CAST(hops AS BIGINT) AS hops, round(strength, 6)+0E0 AS strength FROM (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY hops, strength DESC, sr, length_m, because) AS rn FROM (
  SELECT c.neighbor_id AS uid, s.camera_id AS because, CASE WHEN s.camera_id%2=0 THEN 'incident' ELSE 'movement' END AS reason, c.hops, (s.camera_id*37%101)/100E0 AS strength,
  CASE c.side WHEN 'upstream' THEN 0 WHEN 'downstream' THEN 1 ELSE 2 END AS sr, c.length_m FROM newest s JOIN promo c ON c.camera_id=s.camera_id
  WHERE s.camera_id%3=0 AND s.camera_id*13%600+0.5E0<300E0)) WHERE rn=1 ORDER BY hops, strength DESC, sr, length_m, uid, because LIMIT 30)""")
def k6_triggers(fx):
    """Every third polled camera triggered, up to ten minutes ago; the hold of five minutes parts them."""
    k = F.col("camera_id")
    wide = C.corridor(fx.edge, fx.site_camera.select("site_id", "camera_id"), promotion=True)
    t = fx.fresh.select("camera_id").distinct().filter(k % 3 == 0).select(
        "camera_id", F.when(k % 2 == 0, "incident").otherwise("movement").alias("reason"), (k * 37 % 101 / 100.0).alias("strength"), (fx.now - (k * 13 % 600 + 0.5)).alias("at"))
    return rounded(C.promotions(t, wide, fx.now).select("uid", "because", "reason", "hops", "strength"))


@query("k7_awake_cameras", """SELECT camera_id, incident_id, CAST(pick AS BIGINT) AS pick FROM (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY incident_id, pick) AS rn FROM (
  SELECT l.incident_id, l.camera_id, row_number() OVER (PARTITION BY l.incident_id ORDER BY l.rank) AS pick FROM links l JOIN fx_incident i USING (incident_id)
  WHERE (i.road_relevant OR i.implies_closure) AND l.camera_id IN (SELECT camera_id FROM newest)) WHERE pick<=2) WHERE rn=1 ORDER BY incident_id, pick LIMIT 24""")
def k7(fx):
    return rounded(L.awake_cameras(fx.links, fx.incident, fx.fresh.select("camera_id").distinct(), 2, 24))


@query("k8_review_leaders", """SELECT region_id, camera_id, CAST(rank AS BIGINT) AS rank, equation FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY equation DESC, camera_id) AS rank
  FROM scored_full, clock WHERE now-last_at<=3E0*28800E0) WHERE rank<=8""")
def k8(fx):
    return rounded(R.review_leaders(full_scores(fx), fx.now, F.lit(28800.0), VERDICTS.review_top_k).select("region_id", "camera_id", "rank", "equation")).withColumn("region_id", F.col("region_id").cast("int"))


@query("k10_relay_cameras", "SELECT region_id, camera_id FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY coalesce(attention,0E0) DESC, camera_id) AS rank FROM scored_plain) WHERE rank<=5")
def k10(fx):
    return R.relay_cameras(plain_scores(fx)).select("region_id", "camera_id")


@query("p47_tile_flags", "SELECT camera_id, now-last_at>3E0*60E0*600E0 AS stale, activity>0.72E0 AS hot FROM scored_plain, clock")
def p47(fx):
    return R.tile_flags(plain_scores(fx), fx.now, F.lit(36000.0)).select("camera_id", "stale", "hot")


@query("s19_decision_log", """SELECT CAST(rank AS BIGINT) AS rank, camera_id, attention, anomaly, incident_floor, queue_floor FROM (
  SELECT *, row_number() OVER (ORDER BY attention DESC, camera_id)-1 AS rank FROM scored_plain) WHERE rank<30""")
def s19(fx):
    return rounded(R.decision_log(plain_scores(fx)).select("rank", "camera_id", "attention", "anomaly", "incident_floor", "queue_floor"))


@query("d3_flow_union", """SELECT queue_anchor AS from_id, camera_id AS to_id, CASE queue_source WHEN 'incident' THEN 'incident' ELSE 'still' END AS reason, queue_floor AS strength FROM scored_full WHERE queue_floor>0
  UNION ALL SELECT c.camera_id, c.neighbor_id, 'movement', 0.7E0 FROM corr c WHERE c.side='upstream' AND c.camera_id%10=0
  AND NOT EXISTS (SELECT 1 FROM scored_full q WHERE q.queue_floor>0 AND q.queue_anchor=c.camera_id AND q.camera_id=c.neighbor_id)""")
def d3(fx):
    q = full_scores(fx).filter(F.col("queue_floor") > 0).select(
        F.col("queue_anchor").alias("from_id"), F.col("camera_id").alias("to_id"),
        F.when(F.col("queue_source") == "incident", "incident").otherwise("still").alias("reason"), F.col("queue_floor").alias("strength"))
    p = fx.corridor.filter((F.col("side") == "upstream") & (F.col("camera_id") % 10 == 0)).select(
        F.col("camera_id").alias("from_id"), F.col("neighbor_id").alias("to_id"), F.lit("movement").alias("reason"), F.lit(0.7).alias("strength"))
    return R.flow_union(q, p)


@query("d4_priority_claims", "SELECT DISTINCT camera_id FROM fx_poll, clock WHERE now < at + CASE WHEN poll_id%2=0 THEN 86400E0 ELSE 43200E0 END")
def d4(fx):
    claims = fx.poll.select("camera_id", (F.col("at") + F.when(F.col("poll_id") % 2 == 0, 86400.0).otherwise(43200.0)).alias("expires"))
    return R.priority_claims(claims, fx.now)


@query("d5_latest_records", "SELECT id, ordinal, type FROM (SELECT incident_id%500 AS id, incident_id AS ordinal, type, row_number() OVER (PARTITION BY incident_id%500 ORDER BY incident_id DESC) AS rn FROM fx_incident) WHERE rn=1")
def d5(fx):
    i = F.col("incident_id")
    return R.latest_records(fx.incident.select((i % 500).alias("id"), i.alias("ordinal"), "type"))


@query("a18_arbiter_funnel", """SELECT count(*) AS live, count(*) FILTER (WHERE linked) AS linked, count(*) FILTER (WHERE linked AND rel) AS relevant,
  count(*) FILTER (WHERE linked AND rel AND serv) AS servable, count(*) FILTER (WHERE linked AND rel AND serv AND pic) AS ready FROM (
  SELECT i.incident_id, road_relevant OR implies_closure AS rel, EXISTS (SELECT 1 FROM links l WHERE l.incident_id=i.incident_id) AS linked,
  EXISTS (SELECT 1 FROM links l WHERE l.incident_id=i.incident_id AND l.camera_id%3<>0) AS serv,
  EXISTS (SELECT 1 FROM links l JOIN newest n USING (camera_id) WHERE l.incident_id=i.incident_id) AS pic FROM fx_incident i)""")
def a18(fx):
    return L.arbiter_funnel(fx.incident, fx.links, fx.camera.filter(F.col("camera_id") % 3 != 0), fx.fresh.select("camera_id").distinct())


@query("a21_answer_history", f"""SELECT incident_id, {r('at')} AS at, CAST(age_rank AS BIGINT) AS age_rank, age_rank=1 AS is_latest FROM (
  SELECT camera_id%8 AS incident_id, read_at AS at, row_number() OVER (PARTITION BY camera_id%8 ORDER BY read_at DESC) AS age_rank FROM fx_reading) WHERE age_rank<=40""")
def a21(fx):
    v = fx.reading.select((F.col("camera_id") % 8).alias("incident_id"), F.col("read_at").alias("at"))
    return rounded(L.answer_history(v, "incident_id"))


@query("p12_camera_distance", f"SELECT c.camera_id, {r(hav_km('r.lat', 'r.lon', 'c.lat', 'c.lon'))} AS km FROM fx_camera c JOIN fx_region r USING (region_id)")
def p12(fx):
    from ..functions.geo import haversine_km
    reg = F.broadcast(fx.region.select("region_id", F.col("lat").alias("rlat"), F.col("lon").alias("rlon")))
    return rounded(fx.camera.join(reg, "region_id").select("camera_id", haversine_km(F.col("rlat"), F.col("rlon"), F.col("lat"), F.col("lon")).alias("km")))
