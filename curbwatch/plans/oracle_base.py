"""Shared pieces of the DuckDB statements the queries are checked against.

The statements restate each operator in plain SQL over the given tables, without
the chunking and grids the Spark side uses.
"""

from __future__ import annotations

import math
import re

CTE: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTE[name] = body


def sql(body: str) -> str:
    """Prefix a statement with every shared view it mentions, in dependency order."""
    order: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"\b[a-z_][a-z0-9_]*\b", text)):
            if word in CTE and word not in seen:
                seen.add(word)
                visit(CTE[word])
                order.append(word)

    visit(body)
    if order:
        body = "WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in order) + "\n" + body
    # AT is a keyword in DuckDB, so the column of that name is quoted outside of string literals.
    parts = re.split(r"('[^']*')", body)
    return "".join(p if p.startswith("'") else re.sub(r'(?<!")\bat\b(?!")', '"at"', p) for p in parts)


def fixed(x: str, n: int) -> str:
    """Round judging the exact binary value, true ties away from zero."""
    unit = f"{2 ** (n + 1)}E0"
    tie = f"abs({x})*{unit}=floor(abs({x})*{unit}) AND floor(abs({x})*{unit})%2E0=1E0"
    return f"(CAST(printf('%.{n}f', ({x})+CASE WHEN {tie} THEN sign({x})*1E-9 ELSE 0E0 END) AS DOUBLE)+0E0)"


def r(x: str, n: int = 6) -> str:
    return f"(round({x}, {n})+0E0)"


def hav_m(a: str, b: str, c: str, d: str, radius: str = "6371008.8E0") -> str:
    return (f"(2E0*{radius}*asin(sqrt(least(1E0, pow(sin((radians({c})-radians({a}))/2E0),2)"
            f"+cos(radians({a}))*cos(radians({c}))*pow(sin(radians(({d})-({b}))/2E0),2)))))")


def hav_km(a: str, b: str, c: str, d: str) -> str:
    return hav_m(a, b, c, d, "6371.0088E0")


def clamp(x: str) -> str:
    return f"greatest(0E0, least(1E0, {x}))"


def combine(movement: str, floor: str) -> str:
    level = f"least(1E0, greatest(0E0, {movement}, {floor}))"
    return f"(CASE WHEN ({floor})>=0.2E0 THEN 0.5E0+0.5E0*{level} ELSE 0.5E0*{level} END)"


def sun(lat: str, lon: str, at: str) -> str:
    rad = repr(math.pi / 180.0)
    d = f"(({at})/86400E0-10957.5E0)"
    g = f"((357.529E0+0.98560028E0*{d})*{rad}E0)"
    lam = f"((280.459E0+0.98564736E0*{d}+1.915E0*sin({g})+0.02E0*sin(2E0*{g}))*{rad}E0)"
    eps = f"((23.439E0-0.00000036E0*{d})*{rad}E0)"
    ra = f"atan2(cos({eps})*sin({lam}),cos({lam}))"
    dec = f"asin(sin({eps})*sin({lam}))"
    ha = f"(((18.697374558E0+24.06570982441908E0*{d})*15E0+({lon}))*{rad}E0-{ra})"
    return f"(asin(sin(({lat})*{rad}E0)*sin({dec})+cos(({lat})*{rad}E0)*cos({dec})*cos({ha}))/{rad}E0)"


def bearing(a: str, b: str, c: str, d: str) -> str:
    y = f"sin(radians(({d})-({b})))*cos(radians({c}))"
    x = f"cos(radians({a}))*sin(radians({c}))-sin(radians({a}))*cos(radians({c}))*cos(radians(({d})-({b})))"
    return f"((degrees(atan2({y},{x}))+360E0)%360E0)"


def bdiff(a: str, b: str) -> str:
    return f"least(abs(({a})-({b}))%360E0, 360E0-abs(({a})-({b}))%360E0)"


cte("clock", "SELECT max(epoch_us(ts))/1E6 AS now FROM events")
cte("fx_region", """SELECT n_nationkey AS region_id, n_name AS name, n_regionkey AS source_id,
  30E0+(n_nationkey%5)*3E0 AS lat, -120E0+floor(n_nationkey/5E0)*8E0 AS lon FROM nation""")
cte("fx_camera", """SELECT c.c_custkey AS camera_id, c.c_nationkey AS region_id, r.source_id,
  r.lat+((c.c_custkey*37)%100-50)*1E-3 AS lat, r.lon+((c.c_custkey*91)%100-50)*1E-3 AS lon,
  CASE c.c_custkey%4 WHEN 0 THEN concat('I-',CAST((c.c_custkey%9)*10+5 AS VARCHAR),'/US 51')
    WHEN 1 THEN 'US 12/18' WHEN 2 THEN 'IA 5' ELSE 'Main St' END AS roadway, c.c_name AS location,
  CASE c.c_mktsegment WHEN 'BUILDING' THEN 'motorway' WHEN 'AUTOMOBILE' THEN 'motorway_link'
    WHEN 'MACHINERY' THEN 'primary' WHEN 'HOUSEHOLD' THEN 'residential' ELSE 'tertiary' END AS highway,
  nullif(c.c_custkey%5,0) AS lanes, c.c_custkey%2=0 AS two_way, CAST(40+(c.c_custkey%8)*10 AS DOUBLE) AS speed_kmh,
  CASE WHEN c.c_acctbal>5000 THEN CAST(floor(c.c_acctbal*15E0) AS BIGINT) END AS aadt
  FROM customer c JOIN fx_region r ON c.c_nationkey=r.region_id""")
cte("fx_poll", """SELECT event_id AS poll_id, user_id AS camera_id, ts, epoch_us(ts)/1E6 AS at, value/3E3 AS diff,
  (event_id*7919%1000)/1E3 AS brightness,
  CASE event_id%10 WHEN 0 THEN 'unavailable' WHEN 1 THEN 'not_modified' WHEN 2 THEN 'unchanged' ELSE 'fresh' END AS result,
  CAST(dayofweek(ts)*24+hour(ts) AS INTEGER) AS cell FROM events""")
cte("fx_fresh", "SELECT * FROM fx_poll WHERE result='fresh'")
cte("fx_fresh_dense", "SELECT * REPLACE (camera_id%8 AS camera_id) FROM fx_fresh")
cte("fx_poll_dense", "SELECT * REPLACE (camera_id%8 AS camera_id) FROM fx_poll")
cte("fx_incident", """SELECT e.event_id AS incident_id, CAST(e.event_id%25 AS INTEGER) AS region_id,
  concat('T', CAST(e.event_id%6 AS VARCHAR)) AS type, concat('MILE ', CAST(e.event_id%200 AS VARCHAR)) AS location,
  CASE WHEN e.event_id%4<>3 THEN concat('NOTE ', CAST(e.event_id%11 AS VARCHAR)) END AS remarks,
  epoch_us(e.ts)/1E6 AS reported_at,
  r.lat+((e.event_id*53)%100-50)*1E-3 AS lat, r.lon+((e.event_id*71)%100-50)*1E-3 AS lon,
  e.event_id%3<>0 AS road_relevant, e.event_id%7=0 AS implies_closure
  FROM events e JOIN fx_region r ON e.event_id%25=r.region_id WHERE e.event_type='error'""")
cte("fx_edge", """SELECT * FROM (SELECT camera_id AS src,
  lead(camera_id) OVER (PARTITION BY region_id ORDER BY camera_id) AS dst, region_id,
  CASE WHEN camera_id%7=0 THEN 'nearby' WHEN camera_id%3=0 THEN 'freeway' WHEN camera_id%3=1 THEN 'street' ELSE 'ramp' END AS kind,
  CAST(200+(camera_id*53)%1800 AS DOUBLE) AS length_m, CAST(20+(camera_id*31)%90 AS DOUBLE) AS tt_s FROM fx_camera) WHERE dst IS NOT NULL""")
cte("links", f"""SELECT incident_id, camera_id, km, rank FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY round(km, 9), camera_id) AS rank FROM (
  SELECT i.incident_id, c.camera_id, {hav_km('i.lat', 'i.lon', 'c.lat', 'c.lon')} AS km
  FROM fx_incident i JOIN fx_camera c ON abs(c.lat-i.lat)<=0.02E0 AND abs(c.lon-i.lon)<=0.05E0) WHERE km<=1.5E0) WHERE rank<=6""")
cte("corr_up", """SELECT start, site, length_m, hops, tt_s FROM (SELECT *, row_number() OVER (PARTITION BY start, site ORDER BY length_m, hops, tt_s) AS rn FROM (
  SELECT a.dst AS start, a.src AS site, a.length_m, 1 AS hops, a.tt_s FROM fx_edge a WHERE a.kind<>'nearby'
  UNION ALL SELECT a.dst, b.src, a.length_m+b.length_m, 2, a.tt_s+b.tt_s FROM fx_edge a JOIN fx_edge b ON b.dst=a.src
    WHERE a.kind<>'nearby' AND b.kind<>'nearby'
  UNION ALL SELECT a.dst, c.src, a.length_m+b.length_m+c.length_m, 3, a.tt_s+b.tt_s+c.tt_s FROM fx_edge a JOIN fx_edge b ON b.dst=a.src JOIN fx_edge c ON c.dst=b.src
    WHERE a.kind<>'nearby' AND b.kind<>'nearby' AND c.kind<>'nearby') WHERE length_m<=5000E0 AND start<>site) WHERE rn=1""")
cte("corr", """SELECT start AS camera_id, site AS neighbor_id, 'upstream' AS side, length_m, hops, tt_s, length_m/(15E0*1000E0/3600E0) AS wave_s FROM corr_up
  UNION ALL SELECT src, dst, 'downstream', length_m, 1, tt_s, NULL FROM fx_edge WHERE kind<>'nearby'
  UNION ALL SELECT src, dst, 'nearby', length_m, 1, tt_s, NULL FROM fx_edge WHERE kind='nearby'
  UNION ALL SELECT dst, src, 'nearby', length_m, 1, tt_s, NULL FROM fx_edge WHERE kind='nearby'""")
cte("promo", """SELECT start AS camera_id, site AS neighbor_id, side, length_m, hops, tt_s FROM (SELECT *, row_number() OVER (PARTITION BY start, site, side ORDER BY length_m, hops, tt_s) AS rn FROM (
  WITH adj AS (SELECT dst AS s, src AS t, 'upstream' AS side, length_m, tt_s FROM fx_edge WHERE kind<>'nearby' UNION ALL SELECT src, dst, 'downstream', length_m, tt_s FROM fx_edge WHERE kind<>'nearby'
    UNION ALL SELECT src, dst, 'nearby', length_m, tt_s FROM fx_edge WHERE kind='nearby' UNION ALL SELECT dst, src, 'nearby', length_m, tt_s FROM fx_edge WHERE kind='nearby')
  SELECT s AS start, t AS site, side, length_m, 1 AS hops, tt_s FROM adj
  UNION ALL SELECT a.s, b.t, a.side, a.length_m+b.length_m, 2, a.tt_s+b.tt_s FROM adj a JOIN adj b ON b.s=a.t AND b.side=a.side)
  WHERE start<>site AND (side<>'upstream' OR length_m<=5000E0)) WHERE rn=1""")
cte("fx_verdict", """SELECT i.incident_id, CASE WHEN i.incident_id%9=0 THEN 'T9' ELSE i.type END AS type, i.reported_at, i.location, CASE WHEN i.incident_id%13=0 THEN 'NOTE OLD' ELSE i.remarks END AS remarks,
  i.reported_at+i.incident_id%600 AS at, (i.incident_id*7)%100/100E0 AS supported, (i.incident_id*11)%100/100E0 AS cleared,
  (i.incident_id*13)%41/10E0 AS score, 5 AS levels, (i.incident_id*17)%100/100E0 AS score_confidence,
  CASE WHEN i.incident_id%5=0 THEN NULL WHEN i.incident_id%5<3 THEN l.camera_id ELSE coalesce(e.src, l.camera_id) END AS chosen,
  (i.incident_id*19)%100/100E0 AS chosen_confidence
  FROM fx_incident i LEFT JOIN links l ON l.incident_id=i.incident_id AND l.rank=1 LEFT JOIN fx_edge e ON e.dst=l.camera_id
  WHERE i.incident_id%4<>0""")
cte("fx_reading", """SELECT camera_id, poll_id AS reading_id, at AS read_at, (poll_id*23)%100/100E0 AS standstill,
  (poll_id*29)%41/10E0 AS level, CASE WHEN poll_id%11=0 THEN 1 ELSE 5 END AS levels, (poll_id*31)%100/100E0 AS confidence
  FROM fx_poll WHERE poll_id%5=1""")

cte("recent", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY at DESC, poll_id DESC) AS age_rank FROM fx_fresh) WHERE age_rank<=24""")
cte("regmed", "SELECT region_id, median(diff) AS region_diff, count(*) AS region_diff_n FROM recent JOIN fx_camera USING (camera_id) GROUP BY region_id")
cte("hist", """SELECT *, count(*) OVER w AS cell_n, avg(diff) OVER w AS cell_mean, stddev_samp(diff) OVER w AS cell_sd FROM fx_fresh
  WINDOW w AS (PARTITION BY camera_id, cell ORDER BY at, poll_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
cte("hist_dense", """SELECT *, count(*) OVER w AS cell_n, avg(diff) OVER w AS cell_mean, stddev_samp(diff) OVER w AS cell_sd FROM fx_fresh_dense
  WINDOW w AS (PARTITION BY camera_id, cell ORDER BY at, poll_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
cte("newest", "SELECT * FROM recent WHERE age_rank=1")
cte("own", "SELECT camera_id, median(diff) AS own_median, count(*) AS samples FROM recent GROUP BY camera_id")
cte("nowcell", "SELECT CAST(dayofweek(ts)*24+hour(ts) AS INTEGER) AS cell FROM (SELECT max(ts) AS ts FROM events)")
cte("cellstat", """SELECT n.camera_id, count(f.poll_id) AS cell_n, avg(f.diff) AS cell_mean, stddev_samp(f.diff) AS cell_sd
  FROM newest n LEFT JOIN (SELECT x.* FROM fx_fresh x JOIN nowcell c ON x.cell=c.cell) f ON f.camera_id=n.camera_id AND f.poll_id<>n.poll_id GROUP BY n.camera_id""")
CLASSES = ("CASE highway WHEN 'motorway' THEN 1E0 WHEN 'trunk' THEN 0.8E0 WHEN 'primary' THEN 0.6E0 WHEN 'secondary' THEN 0.45E0 "
           "WHEN 'tertiary' THEN 0.3E0 WHEN 'unclassified' THEN 0.2E0 WHEN 'residential' THEN 0.2E0 WHEN 'service' THEN 0.15E0 "
           "WHEN 'motorway_link' THEN 0.7E0 WHEN 'trunk_link' THEN 0.56E0 WHEN 'primary_link' THEN 0.42E0 WHEN 'secondary_link' THEN 0.315E0 END")
cte("prior_raw", f"""SELECT *, {clamp('(log10(1E0+aadt)-log10(1001E0))/(log10(200001E0)-log10(1001E0))')} AS pa,
  {clamp('(ln(CASE WHEN two_way THEN ceil(lanes/2E0) ELSE lanes END*speed_kmh)-ln(40E0))/(ln(440E0)-ln(40E0))')} AS pc, {CLASSES} AS pk FROM fx_camera""")
cte("prior_fix", f"""SELECT *, CASE WHEN aadt IS NOT NULL THEN {fixed('pa', 3)} WHEN lanes IS NOT NULL THEN {fixed('pc', 3)} ELSE coalesce(pk, 0.3E0) END AS scale_prior,
  CASE WHEN aadt IS NOT NULL THEN 'aadt' WHEN lanes IS NOT NULL THEN 'capacity' WHEN pk IS NOT NULL THEN 'class' ELSE 'default' END AS scale_prior_source FROM prior_raw""")
cte("prior", "SELECT *, 0.5E0+scale_prior AS amplifier FROM prior_fix")
LEVEL = "CASE WHEN implies_closure THEN 0.9E0 WHEN road_relevant THEN 0.6E0 ELSE 0E0 END"
NEAR = "CASE WHEN km<=0.25E0 THEN 1E0 WHEN km>=1.5E0 THEN 0.25E0 ELSE 1E0-0.75E0*((km-0.25E0)/1.25E0) END"
DECAY = "pow(0.5E0, greatest(0E0, greatest(0E0, now-reported_at)-3600E0)/1800E0)"
cte("record_floor", f"""SELECT l.incident_id, l.camera_id, l.km, l.rank, i.type, i.location, i.reported_at, i.road_relevant, i.implies_closure, now,
  {LEVEL}*{NEAR}*{DECAY} AS plain FROM links l JOIN fx_incident i USING (incident_id), clock""")
cte("floor_plain", """SELECT camera_id, plain AS incident_floor, plain AS incident_base, incident_id, concat(type, ' at ', location) AS incident FROM (
  SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY plain DESC, incident_id) AS rn FROM record_floor WHERE plain>0) WHERE rn=1""")
REACH = "(CASE WHEN wave_s IS NULL THEN 0E0 WHEN wave_s<=0 THEN (CASE WHEN age>0 THEN 1E0 ELSE 0E0 END) ELSE greatest(0E0, least(1E0, age/wave_s)) END)"
cte("queue_rows", f"""SELECT c.neighbor_id AS camera_id, r.incident_id, r.camera_id AS anchor, c.length_m, c.side, r.plain, r.type, r.location,
  CASE WHEN c.side='upstream' THEN r.plain*0.6E0*greatest(0E0, least(1E0, 1E0-c.length_m/5000E0))*{REACH} ELSE 0E0 END AS inferred
  FROM (SELECT *, greatest(0E0, now-reported_at) AS age FROM record_floor WHERE plain>0) r JOIN corr c ON c.camera_id=r.camera_id
  WHERE NOT EXISTS (SELECT 1 FROM links x WHERE x.incident_id=r.incident_id AND x.camera_id=c.neighbor_id)""")
cte("gate_now", "SELECT * FROM (SELECT f.*, row_number() OVER (PARTITION BY camera_id ORDER BY read_at DESC, reading_id DESC) AS rn, CASE WHEN standstill>=0.8E0 THEN 0.6E0 ELSE 0E0 END AS gate_floor FROM fx_reading f, clock WHERE read_at<=now AND now-read_at<=86400E0) WHERE rn=1")
cte("look_raw", "SELECT *, CASE WHEN confidence>=0.5E0 THEN 1E0+0.25E0*(2E0*level/(levels-1)-1E0) ELSE 1E0 END AS f0, confidence>=0.5E0 AS acted FROM gate_now WHERE levels>=2")
cte("look_now", f"SELECT camera_id, {fixed('f0', 3)} AS factor, acted FROM look_raw")
cte("verdict_now", """SELECT v.* FROM fx_verdict v JOIN fx_incident i ON v.incident_id=i.incident_id AND v.type IS NOT DISTINCT FROM i.type
  AND v.reported_at IS NOT DISTINCT FROM i.reported_at AND v.location IS NOT DISTINCT FROM i.location AND v.remarks IS NOT DISTINCT FROM i.remarks""")


def effect(choice: str) -> str:
    return ("((CASE WHEN cleared>=0.8E0 THEN 0.1E0 ELSE 1E0 END)"
            "*(CASE WHEN score_confidence>=0.5E0 AND levels>1 THEN 1E0+0.5E0*(2E0*score/(levels-1)-1E0) ELSE 1E0 END)"
            "*(CASE WHEN supported>=0.8E0 THEN 1.2E0 ELSE 1E0 END)"
            f"*(CASE WHEN chosen IS NOT NULL AND chosen_confidence>=0.5E0 THEN {choice} ELSE 1E0 END))")


cte("judged_raw", f"""SELECT r.*, v.cleared, v.score, v.levels, v.score_confidence, v.supported, v.chosen, v.chosen_confidence, v.incident_id IS NOT NULL AS judged,
  {effect("CASE WHEN chosen=r.camera_id THEN 1.25E0 WHEN EXISTS (SELECT 1 FROM links x WHERE x.incident_id=r.incident_id AND x.camera_id=v.chosen) THEN 0.75E0 ELSE 1E0 END")} AS multiplier
  FROM record_floor r LEFT JOIN verdict_now v ON v.incident_id=r.incident_id""")
cte("judged_c", "SELECT *, greatest(0E0, least(1E0, plain*multiplier)) AS adj FROM judged_raw")
cte("judged_floor", f"SELECT *, CASE WHEN judged AND plain>0 THEN {fixed('adj', 3)} ELSE plain END AS value FROM judged_c")
cte("floor_judged", """SELECT camera_id, value AS incident_floor, plain AS incident_base, incident_id, concat(type, ' at ', location) AS incident FROM (
  SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY value DESC, incident_id) AS rn FROM judged_floor WHERE value>0) WHERE rn=1""")
cte("picks", f"""SELECT v.incident_id, v.chosen AS camera_id, m.record_floor*{effect('1.25E0')} AS picked FROM verdict_now v JOIN (
  SELECT incident_id, max(plain) AS record_floor FROM record_floor WHERE plain>0 GROUP BY incident_id) m USING (incident_id) WHERE v.chosen_confidence>=0.5E0 AND v.chosen IS NOT NULL""")


def queue(gates: bool, picks: bool) -> str:
    picked = "p.picked" if picks else "CAST(NULL AS DOUBLE)"
    join = "LEFT JOIN picks p ON p.incident_id=q.incident_id AND p.camera_id=q.camera_id" if picks else ""
    rows = (f"SELECT q.camera_id, greatest(q.inferred, coalesce({picked}, 0E0)) AS value, 'incident' AS source, concat(q.type, ' at ', q.location) AS cause, "
            f"q.anchor, q.length_m, {picked} IS NOT NULL AS chosen, 1 AS p FROM queue_rows q {join}")
    if gates:
        rows += (f" UNION ALL SELECT c.neighbor_id, g.gate_floor*0.6E0*greatest(0E0, least(1E0, 1E0-c.length_m/5000E0))*{REACH}, 'standstill', "
                 "concat('camera ', CAST(c.camera_id AS VARCHAR)), c.camera_id, c.length_m, FALSE, 0 FROM "
                 "(SELECT gate_now.*, greatest(0E0, now-read_at) AS age FROM gate_now, clock WHERE gate_floor>0) g JOIN corr c ON c.camera_id=g.camera_id WHERE c.side='upstream'")
    return (f"SELECT camera_id, value AS queue_floor, source AS queue_source, cause AS queue_cause, anchor AS queue_anchor, length_m AS queue_length_m, chosen AS queue_chosen FROM ("
            f"SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY value DESC, anchor, p DESC, length_m, cause DESC) AS rn FROM ({rows}) WHERE value>0) WHERE rn=1")


cte("queue_plain", queue(False, False))
cte("queue_full", queue(True, True))


def scored(prefix: str, floors: str, queues: str | None, gates: bool, looks: bool) -> None:
    """Define the chain of views from known parts to a score, ending in `<prefix>`."""
    q = f"LEFT JOIN {queues} q USING (camera_id)" if queues else ""
    qc = "coalesce(q.queue_floor, 0E0) AS queue_floor_raw, q.queue_anchor, q.queue_cause, q.queue_source, q.queue_length_m" if queues else \
        "0E0 AS queue_floor_raw, CAST(NULL AS BIGINT) AS queue_anchor, CAST(NULL AS VARCHAR) AS queue_cause, CAST(NULL AS VARCHAR) AS queue_source, CAST(NULL AS DOUBLE) AS queue_length_m"
    g = "LEFT JOIN gate_now g USING (camera_id)" if gates else ""
    gc = "coalesce(g.gate_floor, 0E0) AS still_floor, g.read_at AS gate_at" if gates else "0E0 AS still_floor, CAST(NULL AS DOUBLE) AS gate_at"
    lk = "LEFT JOIN look_now k USING (camera_id)" if looks else ""
    lc = "CASE WHEN k.acted THEN k.factor ELSE 1E0 END AS look, k.factor" if looks else "1E0 AS look, CAST(NULL AS DOUBLE) AS factor"
    cte(f"{prefix}_a", f"""SELECT n.camera_id, p.region_id, p.source_id, p.location AS camera_name, p.lat, p.lon, p.highway, n.at AS last_at, n.diff, n.brightness, o.samples,
      CASE WHEN o.samples>=3 THEN o.own_median ELSE m.region_diff END AS rolling, s.cell_n, s.cell_mean, s.cell_sd, p.scale_prior, p.scale_prior_source, p.amplifier,
      coalesce(f.incident_floor, 0E0) AS incident_raw, coalesce(f.incident_base, 0E0) AS base_raw, f.incident, f.incident_id, {qc}, {gc}, {lc}
      FROM newest n JOIN own o USING (camera_id) JOIN prior p USING (camera_id) JOIN cellstat s USING (camera_id)
      LEFT JOIN regmed m ON m.region_id=p.region_id LEFT JOIN {floors} f USING (camera_id) {q} {g} {lk}""")
    cap = "(0.5E0+0.5E0*least(1E0, samples/10E0))"
    cte(f"{prefix}_b", f"""SELECT *, CASE WHEN rolling IS NULL THEN (CASE WHEN cell_n>0 THEN cell_mean END)
      ELSE cell_n/(cell_n+5E0)*coalesce(cell_mean,0E0)+5E0/(cell_n+5E0)*rolling END AS mu, least({cap}, 0.5E0*diff/greatest(rolling, 0.004E0)) AS act0 FROM {prefix}_a""")
    cte(f"{prefix}_c", f"SELECT *, least({cap}, 0.5E0*diff/greatest(mu, 0.004E0)) AS an0 FROM {prefix}_b")
    cte(f"{prefix}_d", f"SELECT *, {fixed('act0', 3)} AS activity, {fixed('an0', 3)} AS anomaly, greatest(incident_raw, queue_floor_raw, still_floor) AS strongest FROM {prefix}_c")
    cte(f"{prefix}_e", f"SELECT *, amplifier*(0.5E0*anomaly+0.5E0*anomaly) AS mv, amplifier*(0.5E0*anomaly+0.5E0*anomaly)*look AS looked FROM {prefix}_d")
    cte(f"{prefix}_f", f"SELECT *, {combine('mv', 'strongest')} AS eq0, {combine('looked', 'strongest')} AS at0, {clamp('looked')} AS mo0 FROM {prefix}_e")
    cte(f"{prefix}_g", f"""SELECT *, {fixed('eq0', 3)} AS equation, {fixed('at0', 3)} AS attention, {fixed('mo0', 3)} AS movement,
      {fixed('incident_raw', 3)} AS incident_floor, {fixed('queue_floor_raw', 3)} AS queue_floor, {fixed('base_raw', 3)} AS incident_base FROM {prefix}_f""")
    cte(f"{prefix}_h", f"""SELECT *, CASE WHEN incident_floor>=looked AND incident_floor>=still_floor AND incident_floor>=queue_floor THEN 'incident'
      WHEN queue_floor>=looked AND queue_floor>=still_floor THEN 'queue' WHEN still_floor>=looked THEN 'still' ELSE 'movement' END AS driver,
      CASE WHEN greatest(incident_floor, queue_floor, still_floor)>0 AND greatest(incident_floor, queue_floor, still_floor)>=movement-1E-6 THEN
        (CASE WHEN incident_floor=greatest(incident_floor, queue_floor, still_floor) THEN 'incident' WHEN queue_floor=greatest(incident_floor, queue_floor, still_floor) THEN 'queue' ELSE 'still' END)
      ELSE 'movement' END AS shown_driver FROM {prefix}_g""")
    cte(prefix, f"""SELECT *, CASE WHEN driver='incident' AND incident_floor>0 THEN 'incident' WHEN driver='still' AND still_floor>0 THEN 'still'
      WHEN driver<>'queue' AND anomaly>=0.9E0 AND cell_n>=5 THEN 'movement' END AS reason, coalesce(diff<=0.004E0 AND cell_n>=5 AND cell_mean>0.008E0, FALSE) AS ambiguous FROM {prefix}_h""")


scored("scored_plain", "floor_plain", "queue_plain", False, False)
scored("scored_full", "floor_judged", "queue_full", True, True)
