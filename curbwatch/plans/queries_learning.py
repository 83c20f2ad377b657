"""Queries over choices: fits, rankers, evaluation, next pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learning as L
from .oracle_base import cte, fixed, r, sun
from .queries_scoring import plain_scores
from .registry import query, rounded

cte("fx_vote", """SELECT o_orderkey AS vote_id, epoch_us(o_orderdate)/1E6 AS ts, o_orderkey%40 AS voter, o_orderkey AS k, o_custkey AS a_id, o_custkey+1+o_orderkey%13 AS b_id,
  (o_orderkey*7)%101/100E0 AS a_attention, (o_orderkey*11+3)%101/100E0 AS b_attention, (o_orderkey*13)%101/100E0 AS a_equation, (o_orderkey*17+5)%101/100E0 AS b_equation,
  CASE WHEN o_orderkey%3<>0 THEN (o_orderkey*5%7)/2E0 END AS a_level, CASE WHEN o_orderkey%3<>0 THEN ((o_orderkey*3+1)%7)/2E0 END AS b_level,
  CASE WHEN o_orderkey%3<>0 THEN (o_orderkey%10)/10E0 END AS a_confidence, CASE WHEN o_orderkey%3<>0 THEN ((o_orderkey+4)%10)/10E0 END AS b_confidence,
  CASE WHEN o_orderkey%3<>0 THEN CAST(o_orderkey%50 AS DOUBLE) END AS a_look_at, CASE WHEN o_orderkey%3<>0 THEN CAST(CASE WHEN o_orderkey%4=0 THEN o_orderkey%49 ELSE o_orderkey%50 END AS DOUBLE) END AS b_look_at,
  ((o_orderkey*31+17)%101)/100E0 AS a_x0, ((o_orderkey*31+34)%101)/100E0 AS b_x0, CASE WHEN o_orderstatus='O' THEN 'a' ELSE 'b' END AS pick,
  CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH','3-MEDIUM') THEN 'evaluate' ELSE 'learn' END AS mode, CASE WHEN o_orderkey%2=0 THEN 'random' ELSE 'disagree' END AS stratum FROM orders""")
DIFF = lambda a, b: f"CASE WHEN abs({a}-{b})>=1E-9 THEN {a}-{b} END"
cte("voted", f"""SELECT *, {DIFF('a_equation', 'b_equation')} AS by_equation, CASE WHEN a_look_at=b_look_at THEN {DIFF('a_level', 'b_level')} END AS by_look,
  CASE WHEN a_look_at=b_look_at AND least(a_confidence, b_confidence)>=0.5E0 THEN {DIFF('a_level', 'b_level')} END AS by_confident_look, {DIFF('a_x0', 'b_x0')} AS by_movement FROM fx_vote""")
# The fixed schedule step by step: all groups descend together, 400 steps from zero.
X = lambda p, f: f"(((k*{31 + 2 * f}+{p * 17 + f * 7})%101)/100E0)"
cte("vote_row", f"""SELECT vote_id, voter, mode, {', '.join(f'{X(1, f)}-{X(2, f)} AS d{f}' for f in range(8))}, CASE WHEN pick='a' THEN 1E0 ELSE 0E0 END AS y,
  CASE WHEN mode='evaluate' THEN CAST(concat('0x', substr(md5(concat(CAST(vote_id AS VARCHAR), ':511')), 1, 8)) AS BIGINT)%10 ELSE -1 END AS fold, row_number() OVER (PARTITION BY voter ORDER BY ts DESC, vote_id DESC) AS rn FROM fx_vote""")


def descended(rows: str) -> str:
    """Weights w0 to w7 of each group g of `rows` (g, d0 to d7, y) after the last step."""
    w, d = [f"w{f}" for f in range(8)], [f"d{f}" for f in range(8)]
    p = f"1E0/(1E0+exp(-({'+'.join(f'{a}*{b}' for a, b in zip(w, d))})))"
    moved = ", ".join(f"{a}-0.5E0*(0.02E0*{a}+s{f}/n) AS {a}" for f, a in enumerate(w))
    sums = ", ".join(f"sum((p-y)*{b}) AS s{f}" for f, b in enumerate(d))
    return f"""SELECT * FROM (WITH RECURSIVE fit AS (SELECT DISTINCT g, 0 AS step, {', '.join(f'0E0 AS {a}' for a in w)} FROM {rows}
      UNION ALL SELECT g, step+1, {moved} FROM (SELECT g, step, {', '.join(w)}, count(*) AS n, {sums} FROM (SELECT f.g, f.step, {', '.join(f'f.{a}' for a in w)}, {', '.join(f'r.{b}' for b in d)}, r.y, {p} AS p
        FROM fit f JOIN {rows} r ON r.g=f.g WHERE f.step<400) GROUP BY g, step, {', '.join(w)})) SELECT * FROM fit) WHERE step=400"""


cte("voter_row", "SELECT voter AS g, * FROM vote_row WHERE rn<=2000")
cte("voter_fit", descended("voter_row"))
cte("fold_row", "SELECT r.voter*100+k.k AS g, r.* FROM vote_row r, (SELECT unnest(range(10)) AS k) k WHERE r.rn<=2000 AND r.fold<>k.k")
cte("fold_fit", descended("fold_row"))
cte("held_out", f"""SELECT vote_id, CASE WHEN abs(s)>=1E-9 THEN s END AS by_person FROM (SELECT r.vote_id, {'+'.join(f'f.w{i}*r.d{i}' for i in range(8))} AS s FROM vote_row r JOIN fold_fit f ON f.g=r.voter*100+r.fold WHERE r.mode='evaluate')""")
RANKERS = {"equation": "by_equation", "second look": "by_look", "second look, confident": "by_confident_look", "movement alone": "by_movement"}


@query("e3_rankers", f"SELECT vote_id, {r('by_equation')} AS by_equation, {r('by_look')} AS by_look, {r('by_confident_look')} AS by_confident_look, {r('by_movement')} AS by_movement FROM voted")
def e3(fx):
    return rounded(L.rankers(fx.vote).select("vote_id", *RANKERS.values()))


ALL_RANKERS = RANKERS | {"your model, held out": "by_person"}
cte("ranked_votes", "SELECT v.*, h.by_person FROM voted v LEFT JOIN held_out h USING (vote_id)")


def ranked_votes(fx):
    """Every ranking's preference, the voter's own model fitted without the choice's fold among them."""
    return L.rankers(fx.vote).join(L.held_out(fx.vote), "vote_id", "left")


HITS = " UNION ALL ".join(f"SELECT '{n}' AS ranker, stratum, CASE WHEN ({c}>0)=(pick='a') THEN 1E0 ELSE 0E0 END AS hit FROM ranked_votes WHERE mode='evaluate' AND by_equation IS NOT NULL AND by_look IS NOT NULL AND {c} IS NOT NULL" for n, c in ALL_RANKERS.items())


@query("e6_hit_rates", f"SELECT stratum, ranker, count(*) AS n, {r('avg(hit)')} AS rate FROM (SELECT stratum, ranker, hit FROM ({HITS}) UNION ALL SELECT 'all', ranker, hit FROM ({HITS})) GROUP BY stratum, ranker")
def e6(fx):
    return rounded(L.hit_rates(ranked_votes(fx), ALL_RANKERS).select("stratum", "ranker", "n", "rate"))


@query("e6_hit_rate_intervals")
def e6b(fx):
    return rounded(L.hit_rates(ranked_votes(fx), ALL_RANKERS))


@query("e1_voter_weights", f"""SELECT f.g AS voter, n.votes, CAST(x.i AS BIGINT) AS factor, {r('[w0, w1, w2, w3, w4, w5, w6, w7][x.i+1]')} AS weight FROM voter_fit f JOIN (SELECT g, count(*) AS votes FROM voter_row GROUP BY g) n USING (g), (SELECT unnest(range(8)) AS i) x""")
def e1(fx):
    w = L.fit_voters(fx.vote)
    return rounded(w.select("voter", "votes", F.posexplode("weights").alias("factor", "weight")))


@query("e1_common_weights")
def e1b(fx):
    w = L.fit_all(fx.vote)
    return fx.vote.select(F.count(F.lit(1)).alias("votes")).select("votes", *[F.lit(round(v, 4)).alias(f"w{i}") for i, v in enumerate(w)])


@query("e2_personal_ranking")
def e2(fx):
    pool = L.features(plain_scores(fx), fx.now).select("camera_id", "region_id", "x")
    views = fx.vote.select("voter", (F.col("voter") % 25).cast("int").alias("region_id")).distinct()
    return rounded(L.personal_ranking(pool, L.fit_voters(fx.vote), views))


@query("e4_held_out_model", f"SELECT vote_id, {r('by_person')} AS by_person FROM held_out")
def e4(fx):
    return rounded(L.held_out(fx.vote))


@query("e10_vote_retention", "SELECT vote_id FROM (SELECT *, row_number() OVER (PARTITION BY voter ORDER BY ts DESC, vote_id DESC) AS rn FROM fx_vote) WHERE rn<=100")
def e10(fx):
    return L.retained(fx.vote, 100).select("vote_id")


@query("a19_agreement", "SELECT count(*) FILTER (WHERE (pick='a')=(a_attention>b_attention)) AS agree, count(*) AS total FROM fx_vote WHERE abs(a_attention-b_attention)>1E-6")
def a19(fx):
    return L.agreement(fx.vote)


@query("a20_evaluation", """SELECT count(*) AS choices, count(*) FILTER (WHERE stratum='disagree') AS disagreements, count(*) FILTER (WHERE p) AS paired, count(*) FILTER (WHERE p AND (pick='a')=(a_equation>b_equation)) AS equation_agree,
  count(*) FILTER (WHERE p AND (pick='a')=(a_level>b_level)) AS look_agree FROM (SELECT *, abs(a_equation-b_equation)>1E-6 AND a_look_at=b_look_at AND abs(a_level-b_level)>1E-6 AS p FROM fx_vote WHERE mode='evaluate')""")
def a20(fx):
    return L.evaluation(fx.vote)


@query("k9_disagreements", f"SELECT vote_id, {r('gap')} AS gap FROM (SELECT vote_id, CASE WHEN pick='a' THEN b_attention-a_attention ELSE a_attention-b_attention END AS gap FROM fx_vote) WHERE gap>0 ORDER BY gap DESC, vote_id LIMIT 3")
def k9(fx):
    return rounded(L.disagreements(fx.vote).select("vote_id", "gap"))


# A look judges eight cameras: the camera list cut in eights, each with a hashed equation score and level.
cte("look_rows", "SELECT CAST(floor(camera_id/8E0) AS BIGINT) AS look_id, camera_id, (camera_id*37%101)/100E0 AS equation, CASE WHEN camera_id%11<>0 THEN (camera_id*53%9)/2E0 END AS level FROM fx_camera")


def looks(fx):
    k = F.col("camera_id")
    return fx.camera.select(F.floor(k / 8.0).alias("look_id"), "camera_id", (k * 37 % 101 / 100.0).alias("equation"), F.when(k % 11 != 0, (k * 53 % 9) / 2.0).alias("level"))


@query("j22_opposed_pairs", """SELECT a.look_id, a.camera_id AS a_id, b.camera_id AS b_id FROM look_rows a JOIN look_rows b ON a.look_id=b.look_id AND a.camera_id<b.camera_id
  WHERE abs(a.equation-b.equation)>0.02E0 AND abs(a.level-b.level)>0.25E0 AND (a.equation-b.equation)*(a.level-b.level)<0""")
def j22(fx):
    return L.opposed_pairs(looks(fx))


cte("look_places", "SELECT *, row_number() OVER (PARTITION BY look_id ORDER BY equation DESC, camera_id) AS p1, CASE WHEN level IS NOT NULL THEN row_number() OVER (PARTITION BY look_id ORDER BY level DESC NULLS LAST, camera_id) END AS p2 FROM look_rows")
cte("look_tau_raw", "SELECT l.look_id, t.raw FROM (SELECT DISTINCT look_id FROM look_places) l LEFT JOIN (SELECT a.look_id, sum(CASE WHEN a.p2<b.p2 THEN 1 ELSE -1 END)/CAST(count(*) AS DOUBLE) AS raw FROM look_places a JOIN look_places b ON a.look_id=b.look_id AND a.p1<b.p1 WHERE a.p2 IS NOT NULL AND b.p2 IS NOT NULL GROUP BY a.look_id) t USING (look_id)")
cte("look_tau", f"SELECT look_id, {fixed('raw', 3)} AS tau FROM look_tau_raw")


def places(fx):
    return L.look_orders(looks(fx).withColumnsRenamed({"look_id": "grp", "camera_id": "item"}))


@query("e5_kendall_tau", "SELECT look_id AS grp, tau FROM look_tau")
def e5(fx):
    return L.kendall(places(fx))


@query("t12_look_orders", "SELECT look_id AS grp, camera_id AS item, p1 AS first_place, p2 AS second_place FROM look_places")
def t12(fx):
    return rounded(places(fx))


@query("e7_shadow_summary", f"SELECT count(*) AS looks, {r('median(tau)')} AS median_tau, {r('avg(tau)')} AS mean_tau, count(*) FILTER (WHERE same) AS same_first FROM look_tau JOIN (SELECT look_id, bool_or(p1=1 AND p2=1) AS same FROM look_places GROUP BY look_id) USING (look_id)")
def e7(fx):
    p = places(fx)
    same = p.groupBy("grp").agg(F.max((F.col("first_place") == 1) & F.coalesce(F.col("second_place") == 1, F.lit(False))).alias("same_first"))
    return rounded(L.shadow_summary(L.kendall(p).join(same, "grp")))


@query("p32_preference_features", f"SELECT camera_id, {r('anomaly')} AS movement, {r('scale_prior')} AS road, {r('incident_floor')} AS incident, {r('queue_floor')} AS queue, round(least(1E0, greatest(0E0, (6E0-{sun('lat', 'lon', 'now')})/12E0)), 4)+0E0 AS dark, {r('brightness')} AS bright, CASE WHEN highway='motorway' THEN 1E0 ELSE 0E0 END AS freeway FROM scored_plain, clock")
def p32(fx):
    x = F.col("x")
    out = L.features(plain_scores(fx), fx.now)
    return rounded(out.select("camera_id", x[0].alias("movement"), x[1].alias("road"), x[2].alias("incident"), x[3].alias("queue"), F.round(x[5], 4).alias("dark"), x[6].alias("bright"), x[7].alias("freeway")))


@query("k11_candidate_pool", "SELECT camera_id, attention, equation FROM scored_plain, clock WHERE now-last_at<=3E0*86400E0")
def k11(fx):
    return L.candidate_pool(plain_scores(fx), fx.now, F.lit(86400.0)).select("camera_id", "attention", "equation")


def pool(fx):
    k = F.col("camera_id")
    return fx.camera.select("camera_id", "region_id", F.array(*[((k * (i + 3)) % 101) / 100.0 for i in range(8)]).alias("x"))


ZERO_TO_SEVEN = range(8)
X_OF = lambda q, i: f"(({q}_id*{i + 3})%101)/100E0"
cte("pair_pool", """SELECT camera_id, region_id FROM (SELECT *, camera_id%7=0 AS shown, count(*) FILTER (WHERE camera_id%7<>0) OVER (PARTITION BY region_id) AS fresh FROM fx_camera) WHERE NOT shown OR fresh<2""")
drawn = lambda seed, q: f"SELECT region_id, camera_id AS {q}_id, row_number() OVER (PARTITION BY region_id ORDER BY md5(concat(camera_id, ':{seed}')), camera_id) AS draw FROM pair_pool"
SURE = "+".join(["0E0", *[f"{0.1 * (i + 1)!r}::DOUBLE*({X_OF('a', i)}-{X_OF('b', i)})" for i in ZERO_TO_SEVEN]])


def rested_pool(fx):
    recent = fx.camera.filter(F.col("camera_id") % 7 == 0).select("region_id", "camera_id")
    return L.rested(pool(fx), recent)


@query("e8_next_pair", f"""SELECT region_id, a_id, b_id, {r('doubt')} AS doubt FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY doubt, a_id, b_id) AS rn FROM (
  SELECT region_id, a_id, b_id, abs(1E0/(1E0+exp(-({SURE})))-0.5E0) AS doubt FROM ({drawn(511, 'a')}) JOIN ({drawn(512, 'b')}) USING (region_id, draw) WHERE draw<=31 AND a_id<>b_id)) WHERE rn=1""")
def e8(fx):
    return rounded(L.next_pairs(rested_pool(fx), F.array(*[F.lit(0.1 * (i + 1)) for i in range(8)]), 40, 511))


@query("e8_first_pair", f"""SELECT region_id, a_id, b_id FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY draw) AS rn FROM (
  SELECT region_id, a_id, b_id, draw FROM ({drawn(511, 'a')}) JOIN ({drawn(512, 'b')}) USING (region_id, draw) WHERE draw<=31 AND a_id<>b_id)) WHERE rn=1""")
def e8_first(fx):
    return L.next_pairs(rested_pool(fx), F.array(*[F.lit(0.1)] * 8), 4, 511).select("region_id", "a_id", "b_id")


@query("e9_next_eval_pair", f"""SELECT CAST(region_id AS INTEGER) AS region_id, CASE WHEN swap THEN b ELSE a END AS a_id, CASE WHEN swap THEN a ELSE b END AS b_id, CASE WHEN used THEN 'disagree' ELSE 'random' END AS stratum FROM (
  SELECT t.region_id, used, substr(md5(concat(t.region_id, ':513')), 1, 1)<'8' AS swap, CASE WHEN used THEN d_a ELSE r_a END AS a, CASE WHEN used THEN d_b ELSE r_b END AS b FROM (
    SELECT w.*, s.d_a, s.d_b, substr(md5(concat(w.region_id, ':511')), 1, 1)<'8' AND s.d_a IS NOT NULL AS used FROM (
      SELECT region_id, max(CASE WHEN draw=1 THEN n_id END) AS r_a, max(CASE WHEN draw=2 THEN n_id END) AS r_b FROM ({drawn(512, 'n')}) GROUP BY region_id) w
    LEFT JOIN (SELECT region_id, a_id AS d_a, b_id AS d_b FROM (SELECT p.region_id, o.a_id, o.b_id, row_number() OVER (PARTITION BY p.region_id ORDER BY md5(concat(o.a_id, ':', o.b_id, ':511'))) AS rn FROM (
      SELECT a.camera_id AS a_id, b.camera_id AS b_id FROM look_rows a JOIN look_rows b ON a.look_id=b.look_id AND a.camera_id<b.camera_id
      WHERE abs(a.equation-b.equation)>0.02E0 AND abs(a.level-b.level)>0.25E0 AND (a.equation-b.equation)*(a.level-b.level)<0) o JOIN pair_pool p ON p.camera_id=o.a_id JOIN pair_pool q ON q.camera_id=o.b_id) WHERE rn=1) s USING (region_id)
    WHERE w.r_b IS NOT NULL) t)""")
def e9(fx):
    opposed = L.opposed_pairs(looks(fx)).join(fx.camera.select(F.col("camera_id").alias("a_id"), "region_id"), "a_id")
    return L.next_eval_pairs(rested_pool(fx), opposed, 511)
