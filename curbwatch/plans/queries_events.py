"""Queries over cities, days, words and the sequential folds."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..config import POLLING
from ..functions import text as X
from ..functions.geo import light_class, solar_elevation
from ..functions.numeric import to_fixed
from ..operators import baseline as B
from ..operators import city as C
from ..operators import events as E
from ..operators import floors as L
from ..operators import ranking as R
from ..operators.scale import work_folder
from ..streaming import folds, ordered, polls
from .oracle_base import cte, fixed, hav_km, r, sun
from .queries_scoring import full_scores, plain_scores
from .registry import query, rounded

cte("pulse_rows", """SELECT region_id, minute, diff FROM (SELECT f.camera_id, c.region_id, g.minute, f.diff, row_number() OVER (PARTITION BY f.camera_id, g.minute ORDER BY f.at DESC, f.poll_id DESC) AS rn
  FROM fx_fresh f JOIN fx_camera c USING (camera_id), LATERAL (SELECT unnest(range(CAST(ceil(f.at/60E0) AS BIGINT), CAST(floor((f.at+300E0)/60E0) AS BIGINT)+1)) AS minute) g) WHERE rn=1""")
cte("pulse_raw", "SELECT region_id, minute, median(diff) AS d, count(*) AS cameras FROM pulse_rows GROUP BY region_id, minute HAVING count(*)>=2")
cte("pulse_points", f"SELECT region_id, minute*60E0 AS at, {fixed('d', 5)} AS diff, cameras FROM pulse_raw")
# Looks at the sky: one an hour and region, read off the poll log.
cte("sky_looks", f"""SELECT *, {sun('lat', 'lon', 'at')} AS sun_elevation FROM (SELECT region_id, lat, lon, CAST(h*3600 AS DOUBLE) AS at, cameras, CASE WHEN m%7=0 THEN 'snow' WHEN m%5=0 THEN 'murky' END AS weather FROM (
  SELECT c.region_id, CAST(floor(p.at/3600E0) AS BIGINT) AS h, count(DISTINCT c.camera_id)%4 AS cameras, max(p.poll_id) AS m FROM fx_poll p JOIN fx_camera c USING (camera_id) GROUP BY 1, 2) JOIN fx_region USING (region_id))""")


def sky_looks(fx):
    p = fx.poll.join(fx.camera.select("camera_id", "region_id"), "camera_id").withColumn("h", F.floor(F.col("at") / 3600.0))
    looks = p.groupBy("region_id", "h").agg((F.countDistinct("camera_id") % 4).alias("cameras"), F.max("poll_id").alias("m"))
    looks = looks.join(F.broadcast(fx.region.select("region_id", "lat", "lon")), "region_id").withColumn("at", F.col("h") * 3600.0)
    weather = F.when(F.col("m") % 7 == 0, "snow").when(F.col("m") % 5 == 0, "murky")
    return looks.withColumns({"weather": weather, "sun_elevation": solar_elevation(F.col("lat"), F.col("lon"), F.col("at"))})


@query("a2_city_pulse", "SELECT region_id, at, diff, cameras FROM pulse_points")
def a2(fx):
    return C.pulse(fx.fresh, fx.camera).select("region_id", "at", "diff", "cameras")


@query("w9_pulse_segments", f"""SELECT region_id, at, {r('diff/CASE WHEN peak>0 THEN peak ELSE 1E0 END')} AS height, CAST(segment AS BIGINT) AS segment FROM (
  SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY region_id, day ORDER BY at) AS segment FROM (
  SELECT *, max(diff) OVER (PARTITION BY region_id, day) AS peak, count(*) OVER (PARTITION BY region_id, day) AS n,
  coalesce(at-lag(at) OVER (PARTITION BY region_id, day ORDER BY at)>600E0, TRUE) AS gap FROM (SELECT *, floor(at/86400E0) AS day FROM pulse_points))) WHERE n>=2""")
def w9(fx):
    return rounded(B.pulse_segments(C.pulse(fx.fresh, fx.camera)).select("region_id", "at", "height", "segment")).withColumn("region_id", F.col("region_id").cast("int"))


CONTRAST, WHITE = "(poll_id*37%211)/211E0", "(poll_id*53%97)/97E0"


@query("a3_city_sky", f"""SELECT region_id, cameras, contrast_known, contrast_low, snow_known, snow_white, {fixed('sun', 1)} AS sun_elevation, {fixed('light', 3)} AS brightness,
  CASE WHEN sun>=10E0 AND snow_white>=3 AND snow_white>=snow_known/3E0 THEN 'snow' WHEN sun>=10E0 AND contrast_known>=4 AND contrast_low>=0.5E0*contrast_known THEN 'murky' END AS weather FROM (
  SELECT r.region_id, {sun('r.lat', 'r.lon', 'k.now')} AS sun, coalesce(a.cameras,0) AS cameras, coalesce(contrast_known,0) AS contrast_known, coalesce(contrast_low,0) AS contrast_low,
  coalesce(snow_known,0) AS snow_known, coalesce(snow_white,0) AS snow_white, light FROM fx_region r CROSS JOIN clock k LEFT JOIN (
  SELECT c.region_id, count(*) AS cameras, count(*) FILTER (WHERE hist>=4) AS contrast_known, count(*) FILTER (WHERE hist>=4 AND contrast<0.7E0*uc) AS contrast_low,
  count(*) FILTER (WHERE hist>=4) AS snow_known, count(*) FILTER (WHERE hist>=4 AND white>=0.25E0 AND white-uw>=0.15E0) AS snow_white, median(brightness) AS light FROM (
  SELECT camera_id, max(CASE WHEN age_rank=1 THEN at END) AS last_at, max(CASE WHEN age_rank=1 THEN brightness END) AS brightness, max(CASE WHEN age_rank=1 THEN {CONTRAST} END) AS contrast,
  max(CASE WHEN age_rank=1 THEN {WHITE} END) AS white, median(CASE WHEN age_rank>1 THEN {CONTRAST} END) AS uc, median(CASE WHEN age_rank>1 THEN {WHITE} END) AS uw,
  count(*) FILTER (WHERE age_rank>1) AS hist FROM recent GROUP BY camera_id) JOIN fx_camera c USING (camera_id), clock WHERE now-last_at<=172800E0 GROUP BY c.region_id) a USING (region_id))""")
def a3(fx):
    frames = fx.fresh.withColumns({"contrast": (F.col("poll_id") * 37 % 211) / 211.0, "white": (F.col("poll_id") * 53 % 97) / 97.0})
    out = C.sky(fx.region.select("region_id", "lat", "lon"), frames, fx.camera, fx.now, 172800.0)
    return out.select("region_id", "cameras", "contrast_known", "contrast_low", "snow_known", "snow_white", "sun_elevation", "brightness", "weather")


@query("a14_live_activity", f"""SELECT r.region_id, count(s.camera_id) AS live, {r('coalesce(avg(s.activity), 0E0)')} AS activity FROM fx_region r LEFT JOIN scored_plain s ON s.region_id=r.region_id GROUP BY r.region_id""")
def a14(fx):
    return rounded(C.live_activity(fx.region, plain_scores(fx))).withColumn("region_id", F.col("region_id").cast("int"))


@query("a15_density_cells", f"""SELECT CAST(floor(lon/0.02E0) AS BIGINT) AS cx, CAST(floor(lat/0.02E0) AS BIGINT) AS cy, count(*) AS n,
  {r('least(1E0, ln(1E0+count(*))/ln(1E0+least(24, greatest(1, (SELECT max(n) FROM (SELECT count(*) AS n FROM fx_camera GROUP BY floor(lon/0.02E0), floor(lat/0.02E0)))))))')} AS brightness
  FROM fx_camera GROUP BY floor(lon/0.02E0), floor(lat/0.02E0)""")
def a15(fx):
    return rounded(C.density(fx.camera.select(F.col("lon").alias("x"), F.col("lat").alias("y")), 0.02))


@query("a17_request_load", """SELECT source_id, second, n, CAST(in_window AS BIGINT) AS in_window, in_window>2 AS over_budget FROM (
  SELECT *, sum(n) OVER (PARTITION BY source_id ORDER BY second RANGE BETWEEN 899 PRECEDING AND CURRENT ROW) AS in_window FROM (
  SELECT source_id, CAST(floor(at) AS BIGINT) AS second, count(*) AS n FROM fx_poll JOIN fx_camera USING (camera_id) GROUP BY 1, 2))""")
def a17(fx):
    req = fx.poll.join(fx.camera.select("camera_id", "source_id"), "camera_id").withColumn("bytes", F.col("poll_id"))
    return C.request_load(req, 900, 2).select("source_id", "second", "n", "in_window", "over_budget")


TIER_SQL = """SELECT c.camera_id, c.source_id, CASE WHEN c.camera_id%11=0 THEN 'fast' WHEN c.region_id%3=0 THEN (CASE WHEN c.camera_id%4=0 THEN 'radar' ELSE 'idle' END)
  WHEN c.camera_id%2=0 THEN 'fast' ELSE 'slow' END AS tier, c.camera_id%11=0 AS prioritized, c.camera_id%22=0 AS in_panel, 1E0+(c.camera_id%7)*0.5E0 AS stretch FROM fx_camera c"""


@query("t9_effective_period", f"""SELECT camera_id, tier, CAST(CASE WHEN in_panel THEN 60E0 WHEN tier='radar' THEN 600E0 WHEN prioritized THEN greatest(60E0, coalesce(nf,1)*5E0)
  ELSE greatest(CASE WHEN tier='fast' THEN greatest(60E0, coalesce(nf,1)*5E0) ELSE greatest(600E0, coalesce(ns,1)*10E0) END, 60E0*stretch) END AS DOUBLE) AS period_s FROM (
  SELECT t.*, sum(CASE WHEN tier='fast' AND NOT in_panel THEN 1 END) OVER (PARTITION BY source_id) AS nf, sum(CASE WHEN tier='slow' AND NOT in_panel THEN 1 END) OVER (PARTITION BY source_id) AS ns FROM ({TIER_SQL}) t)""")
def t9(fx):
    k = F.col("camera_id")
    out = C.tier_report(fx.camera, tiers(fx).withColumn("stretch", 1.0 + (k % 7) * 0.5).drop("region_id"), 60.0, POLLING.slow_period_s, POLLING.on_screen_s, POLLING.off_screen_s)
    return out.select("camera_id", "tier", "period_s")


def tiers(fx):
    k, now = F.col("camera_id"), F.lit(1000.0)
    claims = fx.camera.filter(k % 11 == 0).select("camera_id", F.lit(1001.0).alias("expires"), F.when(k % 22 == 0, "panel").otherwise("graph").alias("kind"))
    claims = claims.unionByName(fx.camera.filter(k % 13 == 0).select("camera_id", F.lit(999.0).alias("expires"), F.lit("graph").alias("kind")))
    seen = fx.camera.filter(k % 2 == 0).select("camera_id", F.lit(980.0).alias("seen_at"))
    return C.camera_tier(fx.camera, claims, fx.region.filter(F.col("region_id") % 3 != 0), seen, fx.camera.filter(k % 4 == 0), now, POLLING.visible_ttl_s)


@query("j20_nearest_cities", f"""SELECT region_id, {r(hav_km('(SELECT lat FROM fx_region WHERE region_id=7)', '(SELECT lon FROM fx_region WHERE region_id=7)', 'lat', 'lon'))} AS km FROM fx_region WHERE region_id<>7""")
def j20(fx):
    return rounded(C.nearest_cities(fx.region, 7).select("region_id", "km")).withColumn("region_id", F.col("region_id").cast("int"))


@query("p30_solar_elevation", f"""SELECT poll_id, round({sun('lat', 'lon', 'at')}, 4)+0E0 AS elevation, CASE WHEN {sun('lat', 'lon', 'at')}>6E0 THEN 'day' WHEN {sun('lat', 'lon', 'at')}>-6E0 THEN 'dusk' ELSE 'night' END AS light
  FROM fx_poll JOIN fx_camera USING (camera_id)""")
def p30(fx):
    p = fx.poll.join(fx.camera.select("camera_id", "lat", "lon"), "camera_id").withColumn("elevation", solar_elevation(F.col("lat"), F.col("lon"), F.col("at")))
    return rounded(p.select("poll_id", "elevation", light_class(F.col("elevation")).alias("light")), 4)


cte("relay_starts", "SELECT DISTINCT floor(at/21600E0)*21600E0 AS now FROM fx_poll")
cte("relay_steps", f"""SELECT region_id, now, step, now+step*60E0 AS t, {sun('lat', 'lon', '(now+step*60E0)')} AS up FROM fx_region, relay_starts, (SELECT unnest(range(0, 1441)) AS step)""")
cte("relay_cross", """SELECT region_id, now, min(CASE WHEN b>0 AND up<=0 THEN t END) AS next_sunset, min(CASE WHEN b<=0 AND up>0 THEN t END) AS next_sunrise FROM (
  SELECT *, lag(up) OVER (PARTITION BY region_id, now ORDER BY step) AS b FROM relay_steps) GROUP BY region_id, now""")


def relay_starts(fx):
    return fx.poll.select((F.floor(F.col("at") / 21600.0) * 21600.0).alias("now")).distinct()


@query("w11_sun_crossings", "SELECT region_id, now, next_sunset, next_sunrise FROM relay_cross")
def w11(fx):
    return C.sun_crossings(fx.region.select("region_id", "lat", "lon"), relay_starts(fx))


@query("w12_sun_relay", f"""SELECT now, region_id, phase, {r('elevation', 4)} AS elevation, CASE WHEN p=3 THEN (CASE WHEN next_sunrise IS NOT NULL THEN region_id END) ELSE nr END AS next_region, CASE WHEN p=3 THEN next_sunrise ELSE na END AS next_at FROM (
  SELECT c.*, CASE p WHEN 0 THEN 'sunset' WHEN 1 THEN 'sunrise' WHEN 2 THEN 'waiting' ELSE 'night' END AS phase,
  (SELECT arg_min(o.region_id, {{'a': o.next_sunset, 'b': o.region_id}}) FROM relay_cross o WHERE o.now=c.now AND o.region_id<>c.region_id AND o.next_sunset>CASE WHEN c.elevation<=0 THEN c.now ELSE coalesce(c.next_sunset, c.now) END) AS nr,
  (SELECT min(o.next_sunset) FROM relay_cross o WHERE o.now=c.now AND o.region_id<>c.region_id AND o.next_sunset>CASE WHEN c.elevation<=0 THEN c.now ELSE coalesce(c.next_sunset, c.now) END) AS na FROM (
  SELECT *, row_number() OVER (PARTITION BY now ORDER BY p, v, region_id) AS rn FROM (
  SELECT *, CASE p WHEN 0 THEN abs(elevation) WHEN 1 THEN abs(elevation) WHEN 2 THEN elevation ELSE coalesce(next_sunrise, 1E18) END AS v FROM (
  SELECT x.*, CASE WHEN later<elevation AND abs(elevation)<=6E0 THEN 0 WHEN NOT later<elevation AND abs(elevation)<=6E0 THEN 1 WHEN later<elevation AND elevation>0 THEN 2 ELSE 3 END AS p FROM (
  SELECT r.region_id, s.now, k.next_sunset, k.next_sunrise, {sun('r.lat', 'r.lon', 's.now')} AS elevation, {sun('r.lat', 'r.lon', '(s.now+600E0)')} AS later FROM fx_region r, relay_starts s, relay_cross k WHERE k.region_id=r.region_id AND k.now=s.now) x))) c WHERE rn=1)""")
def w12(fx):
    cities = fx.region.select("region_id", "lat", F.col("lon"))
    return rounded(C.sun_relay(cities, relay_starts(fx)), 4).withColumns({c: F.col(c).cast("int") for c in ("region_id", "next_region")})


@query("w13_sky_transitions", """SELECT region_id, at, kind, kind='snow' AND at=min(CASE WHEN kind='snow' THEN at END) OVER (PARTITION BY region_id) AS first_of_season FROM (
  SELECT region_id, at, unnest(list_filter([CASE WHEN bu AND NOT up THEN 'sunset' END, CASE WHEN NOT bu AND up THEN 'sunrise' END, CASE WHEN NOT bm AND murky THEN 'murky' END,
  CASE WHEN bm AND NOT murky AND NOT snow THEN 'clear' END, CASE WHEN NOT bs AND snow THEN 'snow' END], lambda x: x IS NOT NULL)) AS kind FROM (
  SELECT *, lag(up) OVER w AS bu, lag(murky) OVER w AS bm, lag(snow) OVER w AS bs FROM (
  SELECT region_id, at, sun_elevation>0 AS up, coalesce(weather='murky', FALSE) AS murky, coalesce(weather='snow', FALSE) AS snow FROM sky_looks WHERE cameras>0) WINDOW w AS (PARTITION BY region_id ORDER BY at)) WHERE bu IS NOT NULL)""")
def w13(fx):
    out = C.sky_transitions(sky_looks(fx))
    return out.select("region_id", "at", "kind", F.coalesce("first_of_season", F.lit(False)).alias("first_of_season"))


@query("a22_diary_days", "SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM fx_poll WHERE diff>0.1E0")
def a22(fx):
    return C.diary_days(fx.poll.filter(F.col("diff") > 0.1).select(F.date_format("ts", "yyyy-MM-dd").alias("day")))


@query("a22_diary_of_day", f"SELECT poll_id, {r('at')} AS at FROM fx_poll WHERE strftime(ts, '%Y-%m-%d')='2024-01-15'")
def a22b(fx):
    return rounded(C.diary_of(fx.poll.select("poll_id", "at", F.date_format("ts", "yyyy-MM-dd").alias("day")), "2024-01-15").select("poll_id", "at"))


FIRST_SEEN = """SELECT incident_id, fetch_no, max(CASE WHEN ret THEN fetch_no END) OVER (PARTITION BY incident_id ORDER BY fetch_no) AS seen_from FROM (
  SELECT *, coalesce(fetch_no-lag(fetch_no) OVER (PARTITION BY incident_id ORDER BY fetch_no)>1, TRUE) AS ret FROM (SELECT DISTINCT camera_id%40 AS incident_id, CAST(floor(at/21600E0) AS BIGINT) AS fetch_no FROM fx_poll))"""


@query("t3_first_seen", FIRST_SEEN)
def t3(fx):
    snaps = fx.poll.select((F.col("camera_id") % 40).alias("incident_id"), F.floor(F.col("at") / 21600.0).alias("fetch")).distinct()
    return C.first_seen(snaps, F.floor(F.col("fetch") / 28)).select("incident_id", F.col("fetch").alias("fetch_no"), "seen_from")


@query("t3_first_seen_stream", FIRST_SEEN)
def t3s(fx):
    work = work_folder(fx.spark, "first-seen")
    fetch = F.floor(F.col("at") / 21600.0)
    fetches = polls.poll_stream(fx.spark, fx.folder).select((F.col("camera_id") % 40).alias("incident_id"), fetch.alias("fetch_no"), (fetch * 21600.0).alias("at"))
    polls.run_once(polls.first_seen(fetches, 21600.0), f"{work}/out", f"{work}/checkpoint")
    return ordered.decisions(fx.spark, f"{work}/out", ["incident_id"], ordered.FirstSeen.out)[0].select("incident_id", "fetch_no", "seen_from")


# The learning rule poll by poll: a camera's cells are two lists that each step changes in one place.
cte("learn_in", "SELECT poll_id, camera_id, at, diff, cell+1 AS c, row_number() OVER (PARTITION BY camera_id ORDER BY at, poll_id) AS i FROM fx_fresh_dense WHERE diff IS NOT NULL")
LEARN = """SELECT camera_id, i, poll_id, cell_n, cell_mean, still AS ambiguous, learned, since,
  list_transform(ns, lambda x, j: CASE WHEN j=c AND learned THEN x+1 ELSE x END) AS ns,
  list_transform(means, lambda x, j: CASE WHEN j=c AND learned THEN x+(diff-x)/(cell_n+1) ELSE x END) AS means FROM (
  SELECT *, NOT unusual OR at-since>=10800E0 AS learned FROM (
  SELECT * EXCLUDE (since), CASE WHEN unusual THEN coalesce(since, at) END AS since FROM (
  SELECT *, still OR (cell_n>=5 AND diff>=2E0*cell_mean) AS unusual FROM (
  SELECT *, cell_n>=5 AND cell_mean>0.008E0 AND diff<=0.004E0 AS still FROM (
  SELECT p.camera_id, p.i, p.poll_id, p.at, p.diff, p.c, s.ns, s.means, s.since, s.ns[p.c] AS cell_n, s.means[p.c] AS cell_mean FROM {state})))))"""
FIRST = "learn_in p, (SELECT [CAST(0 AS BIGINT) FOR x IN range(168)] AS ns, [CAST(0 AS DOUBLE) FOR x IN range(168)] AS means, CAST(NULL AS DOUBLE) AS since) s WHERE p.i=1"


@query("t2_learned_baseline", f"""SELECT poll_id, camera_id, cell_n, {r('cell_mean', 9)} AS cell_mean, ambiguous, learned FROM (
  WITH RECURSIVE learn AS ({LEARN.format(state=FIRST)} UNION ALL {LEARN.format(state='learn s JOIN learn_in p ON p.camera_id=s.camera_id AND p.i=s.i+1')}) SELECT * FROM learn)""")
def t2(fx):
    out = folds.learned_baseline(fx.fresh_dense)
    return rounded(out.select("poll_id", "camera_id", "cell_n", "cell_mean", "ambiguous", "learned"), 9)


# The next entry kept is the first one half an hour after the last.
cte("diary_in", "SELECT poll_id AS entry_id, CASE WHEN poll_id%2=0 THEN 'movement' ELSE 'incident' END AS kind, camera_id%5 AS camera_id, at FROM fx_fresh WHERE diff>0.008E0")
SPACED = f"""SELECT kind, camera_id, entry_id, {r('at')} AS at FROM (WITH RECURSIVE kept AS (
  SELECT kind, camera_id, entry_id, at FROM (SELECT *, row_number() OVER (PARTITION BY kind, camera_id ORDER BY at, entry_id) AS rn FROM diary_in) WHERE rn=1
  UNION ALL SELECT kind, camera_id, entry_id, at FROM (SELECT e.*, row_number() OVER (PARTITION BY e.kind, e.camera_id ORDER BY e.at, e.entry_id) AS rn
    FROM kept k JOIN diary_in e ON e.kind=k.kind AND e.camera_id=k.camera_id AND e.at-k.at>=1800E0) WHERE rn=1) SELECT * FROM kept)"""


def diary_in(fresh):
    return fresh.filter(F.col("diff") > 0.008).select(
        F.col("poll_id").alias("entry_id"), F.when(F.col("poll_id") % 2 == 0, "movement").otherwise("incident").alias("kind"),
        (F.col("camera_id") % 5).alias("camera_id"), "at")


@query("t5_diary_spacing", SPACED)
def t5(fx):
    return rounded(folds.spaced_entries(diary_in(fx.fresh)))


@query("t5_diary_stream", SPACED)
def t5s(fx):
    work = work_folder(fx.spark, "diary")
    fresh = polls.poll_stream(fx.spark, fx.folder).filter(F.col("result") == "fresh")
    polls.run_once(polls.diary_entries(diary_in(fresh)), f"{work}/out", f"{work}/checkpoint")
    decided, _ = ordered.decisions(fx.spark, f"{work}/out", ["kind", "camera_id"], ordered.Spacing.out)
    return rounded(decided.filter("kept").select("kind", "camera_id", "entry_id", "at"))


HOLDS = f"SELECT camera_id, {r('max(at)')} AS at, arg_max(poll_id, at) AS poll_id FROM fx_fresh, clock WHERE diff>0.02E0 AND now-at<86400E0 GROUP BY camera_id"


@query("t6_trigger_hold", HOLDS)
def t6(fx):
    hot = fx.fresh.filter((F.col("diff") > 0.02) & (fx.now - F.col("at") < 86400.0))
    return rounded(hot.groupBy("camera_id").agg(F.max("at").alias("at"), F.max_by("poll_id", "at").alias("poll_id")))


@query("t6_trigger_hold_stream", HOLDS)
def t6s(fx):
    work = work_folder(fx.spark, "holds")
    hot = (F.col("result") == "fresh") & (F.col("diff") > 0.02)
    polls.run_once(polls.trigger_holds(polls.poll_stream(fx.spark, fx.folder), hot, 86400.0), f"{work}/out", f"{work}/checkpoint")
    return rounded(polls.read_holds(fx.spark, f"{work}/out").select("camera_id", "at", "poll_id"))


# Pictures one by one: the last accepted one and the changes so far go with a camera.
cte("motion_in", """SELECT CAST(label AS BIGINT) AS camera_id, vec_id AS seq, list_transform(embedding, lambda v: least(1E0, greatest(0E0, CAST(v AS DOUBLE)*0.5E0+0.5E0))) AS thumb,
  row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings""")
MOTION = f"""SELECT camera_id, seq, kind, {r('change')} AS change, {r('median')} AS median, {r('anomaly')} AS anomaly FROM (WITH RECURSIVE motion AS (
  SELECT camera_id, i, seq, thumb AS prev, CAST([] AS DOUBLE[]) AS recent, 'first' AS kind, CAST(NULL AS DOUBLE) AS change, CAST(NULL AS DOUBLE) AS median, CAST(NULL AS DOUBLE) AS anomaly FROM motion_in WHERE i=1
  UNION ALL SELECT camera_id, i, seq, CASE WHEN dup THEN prev ELSE thumb END, recent, CASE WHEN dup THEN 'duplicate' WHEN len(recent)<10 THEN 'warming' ELSE 'scored' END, d,
    CASE WHEN NOT dup THEN list_median(recent) END, CASE WHEN NOT dup AND len(recent)>=10 THEN least(1E0, 0.5E0*d/greatest(list_median(recent), 0.1E0/255E0)) END FROM (
    SELECT camera_id, i, seq, thumb, prev, d, dup, CASE WHEN dup THEN recent ELSE list_slice(list_append(recent, d), greatest(1, len(recent)-58), len(recent)+1) END AS recent FROM (
    SELECT *, d<0.01E0/255E0 AS dup FROM (
    SELECT p.camera_id, p.i, p.seq, p.thumb, m.prev, m.recent, list_sum(list_transform(list_zip(p.thumb, m.prev), lambda z: abs(z[1]-z[2])))/len(p.thumb) AS d
      FROM motion m JOIN motion_in p ON p.camera_id=m.camera_id AND p.i=m.i+1)))) SELECT * FROM motion)"""


@query("w6_live_motion", MOTION)
def w6(fx):
    pics = fx.thumb.withColumn("at", F.col("seq").cast("double") * 600.0)
    return rounded(folds.live_motion(pics))


@query("t1_poll_state_stream", f"""SELECT p.camera_id, p.polls, CAST(0 AS BIGINT) AS late, p.frames, p.unchanged, p.unavailable, coalesce(CAST(o.samples AS BIGINT), 0) AS samples, {r('CASE WHEN o.samples>=3 THEN o.own_median END')} AS rolling FROM (
  SELECT camera_id, count(*) AS polls, count(*) FILTER (WHERE result='fresh') AS frames, count(*) FILTER (WHERE result IN ('unchanged','not_modified')) AS unchanged,
  count(*) FILTER (WHERE result='unavailable') AS unavailable FROM fx_poll GROUP BY camera_id) p LEFT JOIN own o USING (camera_id)""")
def t1(fx):
    work = work_folder(fx.spark, "poll-state")
    polls.run_once(polls.camera_states(polls.poll_stream(fx.spark, fx.folder)), f"{work}/out", f"{work}/checkpoint")
    states, _ = polls.read_states(fx.spark, f"{work}/out")
    return rounded(states.select("camera_id", "polls", "late", "frames", "unchanged", "unavailable", "samples", "rolling"))


@query("t4_streamed_pulse", "SELECT region_id, at, diff, cameras FROM pulse_points")
def t4(fx):
    work = work_folder(fx.spark, "pulse")
    polls.run_pulse(polls.pulse_updates(polls.poll_stream(fx.spark, fx.folder)), fx.camera, f"{work}/out", f"{work}/checkpoint")
    return polls.read_pulse(fx.spark, f"{work}/out").select("region_id", "at", "diff", "cameras")


@query("j12_state_join", f"SELECT n.camera_id, c.region_id, g.name, c.roadway, {r('n.brightness')} AS brightness FROM newest n JOIN fx_camera c USING (camera_id) JOIN fx_region g ON g.region_id=c.region_id")
def j12(fx):
    newest = fx.fresh.groupBy("camera_id").agg(F.max(F.struct("at", "poll_id", "brightness")).alias("n"))
    out = newest.join(fx.camera.select("camera_id", "region_id", "roadway"), "camera_id").join(F.broadcast(fx.region.select("region_id", "name")), "region_id")
    return out.select("camera_id", "region_id", "name", "roadway", F.round("n.brightness", 6).alias("brightness"))


@query("k5_highlights", """SELECT kind, camera_id, attention FROM (
  SELECT 'incident' AS kind, incident_id, camera_id, attention FROM (SELECT r.incident_id, s.camera_id, s.attention, row_number() OVER (PARTITION BY r.incident_id ORDER BY s.attention DESC, s.camera_id) AS rn,
    max(CASE WHEN s.incident_floor>0 AND r.plain>0 THEN 1 ELSE 0 END) OVER (PARTITION BY r.incident_id) AS ok FROM record_floor r JOIN scored_full s USING (camera_id)) WHERE rn=1 AND ok=1
  UNION ALL SELECT 'stopped', NULL, camera_id, attention FROM scored_full WHERE still_floor>0 AND gate_at IS NOT NULL
  UNION ALL SELECT 'movement', NULL, camera_id, attention FROM scored_full WHERE NOT still_floor>0 AND incident_floor=0 AND reason='movement')
  WHERE attention>=0.25E0 ORDER BY attention DESC, camera_id, kind, incident_id LIMIT 5""")
def k5(fx):
    return highlight_rows(fx).select("kind", "camera_id", "attention")


def highlight_rows(fx):
    s = full_scores(fx).withColumns({"baseline": to_fixed(F.col("mu"), 5), "camera_name": F.col("location")})
    by_record = L.floors_by_record(fx.links, fx.incident, fx.now)
    inc = fx.incident.withColumn("label", F.lit(None).cast("string"))
    return E.highlights(s, by_record, inc, fx.corridor, L.current_verdicts(fx.incident, fx.verdict), fx.now)


@query("p36_highlight_briefs")
def p36(fx):
    return highlight_rows(fx).select("kind", "camera_id", E.brief(fx.now).alias("brief"))


WORD = """lambda w: CASE WHEN w='/' THEN w WHEN w='NB' THEN 'northbound' WHEN w='SB' THEN 'southbound' WHEN lower(w) IN ('at','and','of','the','to','on','in','near','by','from') THEN lower(w)
  WHEN regexp_matches(w, '^[0-9]+(ST|ND|RD|TH)$') THEN lower(w) WHEN regexp_matches(w, '[0-9]') OR w IN ('US','SR','CR','I','NW','NE','SW','SE') THEN w ELSE concat(upper(w[1]), lower(w[2:])) END"""


@query("p35_place_names", f"""SELECT incident_id, concat(array_to_string(list_transform(string_split(road, ' '), {WORD}), ' '), CASE d WHEN 'NB' THEN ' northbound' WHEN 'SB' THEN ' southbound' ELSE '' END,
  ' at ', array_to_string(list_transform(string_split(xs, ' '), {WORD}), ' ')) AS place, CASE WHEN incident_id%2=0 THEN 'Vehicle crash with injuries' ELSE 'Stalled Vehicle' END AS label FROM (
  SELECT incident_id, concat('SR-', CAST(incident_id%900 AS VARCHAR)) AS road, CASE incident_id%3 WHEN 0 THEN 'NB' WHEN 1 THEN 'SB' END AS d,
  concat('NW ', CAST(incident_id%99 AS VARCHAR), 'TH ST AND LAKE OF THE WOODS') AS xs FROM fx_incident)""")
def p35(fx):
    i = F.col("incident_id")
    raw = F.concat(F.lit("SR-"), (i % 900).cast("string"), F.when(i % 3 == 0, " NB").when(i % 3 == 1, " SB").otherwise(" "), F.lit(" x[NW "), (i % 99).cast("string"), F.lit("TH ST AND LAKE OF THE WOODS]"))
    label = F.when(i % 2 == 0, F.lit("VEHICLE CRASH W/INJURIES")).otherwise(F.lit(" Stalled Vehicle "))
    return fx.incident.select("incident_id", X.dispatch_place(raw).alias("place"), X.sentence_label(label).alias("label"))


AGE = "(now-at)"
MIN_, HRS = f"floor({AGE}/60E0+0.5E0)", f"floor(floor({AGE}/60E0+0.5E0)/60E0+0.5E0)"


@query("p34_age_phrase", f"""SELECT poll_id, CASE WHEN {AGE}<90 THEN 'less than two minutes ago' WHEN {MIN_}<60 THEN concat(CAST(CAST({MIN_} AS BIGINT) AS VARCHAR), ' minutes ago')
  WHEN {HRS}<36 THEN concat(CAST(CAST({HRS} AS BIGINT) AS VARCHAR), ' hours ago') ELSE concat(CAST(CAST(floor({HRS}/24E0+0.5E0) AS BIGINT) AS VARCHAR), ' days ago') END AS age FROM fx_poll, clock""")
def p34(fx):
    return fx.poll.select("poll_id", X.ago(fx.now - F.col("at")).alias("age"))


@query("p33_picture_phrase", """SELECT camera_id, CASE WHEN diff IS NULL THEN 'no picture yet' WHEN mu IS NULL OR mu<=0 THEN 'changing, with nothing to compare it against yet' WHEN diff/mu>=2 THEN 'changing far more than it usually does at this hour'
  WHEN diff/mu>=1.3E0 THEN 'changing more than usual' WHEN diff/mu>=0.7E0 THEN 'changing about as much as usual' WHEN diff/mu>=0.25E0 THEN 'quieter than usual' ELSE 'almost perfectly still, where it is usually moving' END AS summary FROM scored_plain_c""")
def p33(fx):
    return plain_scores(fx).select("camera_id", X.picture(F.col("diff"), F.col("mu")).alias("summary"))


@query("p37_vehicle_phrase", """SELECT poll_id, CASE WHEN car+truck+bus=0 THEN 'no vehicles' ELSE (SELECT string_agg(concat(CAST(n AS VARCHAR), ' ', CASE WHEN n=1 THEN k WHEN k='bus' THEN 'buses' ELSE concat(k, 's') END), ', ' ORDER BY n DESC, k)
  FROM (VALUES ('car', car), ('truck', truck), ('bus', bus)) v(k, n) WHERE n>0) END AS phrase FROM (SELECT poll_id, poll_id%5 AS car, poll_id%3 AS truck, poll_id%2 AS bus FROM fx_fresh)""")
def p37(fx):
    i = F.col("poll_id")
    by = F.create_map(F.lit("car"), i % 5, F.lit("truck"), i % 3, F.lit("bus"), i % 2)
    return fx.fresh.select("poll_id", X.vehicle_phrase(by).alias("phrase"))


@query("t10_incident_questions", """SELECT q.incident_id, q.evidence, q.pictures FROM (SELECT l.incident_id, string_agg(concat(CAST(l.camera_id AS VARCHAR), ':', CAST(CAST(floor(n.at+0.5E0) AS BIGINT) AS VARCHAR)), ',' ORDER BY l.rank) AS evidence, count(*) AS pictures
  FROM links l JOIN newest n USING (camera_id) GROUP BY l.incident_id) q JOIN fx_incident i USING (incident_id) LEFT JOIN fx_verdict v USING (incident_id), clock
  WHERE (i.road_relevant OR i.implies_closure) AND (v.at IS NULL OR (now-v.at>=60E0 AND CASE WHEN q.incident_id%3=0 THEN q.evidence ELSE 'old' END<>q.evidence))""")
def t10(fx):
    state = fx.fresh.groupBy("camera_id").agg(F.max(F.struct("at", "poll_id", "diff")).alias("n")).select("camera_id", F.col("n.at").alias("last_at"), F.col("n.diff").alias("diff"))
    every = E.incident_questions(fx.incident, fx.links, state, fx.verdict.select("incident_id", F.lit(None).cast("double").alias("at"), F.lit("").alias("evidence")).limit(0), fx.now)
    held = fx.verdict.select("incident_id", "at").join(every.select("incident_id", F.col("evidence").alias("e")), "incident_id", "left")
    held = held.select("incident_id", "at", F.when(F.col("incident_id") % 3 == 0, F.coalesce("e", F.lit("old"))).otherwise("old").alias("evidence"))
    return E.incident_questions(fx.incident, fx.links, state, held, fx.now)


@query("t10_gate_questions", """SELECT camera_id, poll_id FROM hist_dense WHERE diff<=0.004E0 AND cell_n>=5 AND cell_mean>0.008E0 AND camera_id NOT IN (SELECT camera_id%8 FROM fx_reading, clock WHERE now-read_at<300E0)""")
def t10b(fx):
    flagged = B.ambiguous_zero(fx.fresh_dense).withColumn("baseline", F.col("cell_mean"))
    asked = fx.reading.select((F.col("camera_id") % 8).alias("camera_id"), F.col("read_at").alias("asked_at"))
    return E.gate_questions(flagged, asked, fx.now).select("camera_id", "poll_id")


@query("t11_evidence_records")
def t11(fx):
    state = plain_scores(fx).withColumn("baseline", to_fixed(F.col("mu"), 5))
    q = fx.incident.filter(F.col("road_relevant") | F.col("implies_closure")).select("incident_id")
    return E.evidence_records(q, fx.incident, fx.links, state, fx.camera, fx.now, fx.corridor)


@query("d1_one_per_id", """SELECT id, ordinal, url FROM (SELECT camera_id%50 AS id, poll_id AS ordinal, concat('u', CAST(camera_id%150 AS VARCHAR)) AS url, row_number() OVER (PARTITION BY camera_id%50 ORDER BY poll_id) AS rn FROM fx_poll) WHERE rn=1""")
def d1(fx):
    k = F.col("camera_id")
    return R.one_per_id(fx.poll.select((k % 50).alias("id"), F.col("poll_id").alias("ordinal"), F.concat(F.lit("u"), (k % 150).cast("string")).alias("url")))


@query("d1_id_collisions", """SELECT id, min(u) AS first_url, max(u) AS other_url, count(*) AS listed FROM (SELECT camera_id%50 AS id, concat('u', CAST(camera_id%150 AS VARCHAR)) AS u FROM fx_poll) GROUP BY id HAVING min(u)<>max(u)""")
def d1b(fx):
    k = F.col("camera_id")
    return R.id_collisions(fx.poll.select((k % 50).alias("id"), F.concat(F.lit("u"), (k % 150).cast("string")).alias("image_url")))


@query("d2_global_ids", """SELECT camera_id, (dense_rank() OVER (ORDER BY source_id%2=1, concat('s', CAST(source_id AS VARCHAR)))-1)*10000000+camera_id AS uid FROM fx_camera""")
def d2(fx):
    src = fx.region.select(F.concat(F.lit("s"), F.col("source_id").cast("string")).alias("source"), (F.col("source_id") % 2 == 1).alias("local")).distinct()
    cams = fx.camera.select("camera_id", F.col("camera_id").alias("id"), F.concat(F.lit("s"), F.col("source_id").cast("string")).alias("source"))
    return R.renumber(cams, src, 10_000_000).select("camera_id", "uid")
