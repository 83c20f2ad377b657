"""Hand-worked cases for rules SQL cannot state, and thresholds worth naming."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curbwatch.functions import geo as G
from curbwatch.functions import scoring as S
from curbwatch.functions import text as X
from curbwatch.functions.numeric import to_fixed
from curbwatch.operators import hubpaths as H
from curbwatch.operators import learning as L
from curbwatch.operators import roads as R
from curbwatch.sources import feeds, osm
from curbwatch.streaming import folds


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("x,digits,want", [(1.005, 2, 1.0), (0.0025, 3, 0.003), (0.0625, 3, 0.063), (-0.0625, 3, -0.063), (2.5, 0, 3.0), (1234.5675, 3, 1234.568)])
def test_rounding_judges_the_binary_value(spark, x, digits, want):
    assert one(spark, to_fixed(F.lit(x), digits)) == want


def test_bands(spark):
    assert one(spark, S.combine(F.lit(0.9), F.lit(0.0))) == pytest.approx(0.45)
    assert one(spark, S.combine(F.lit(0.1), F.lit(0.2))) == pytest.approx(0.6)
    assert one(spark, S.combine(F.lit(0.9), F.lit(0.19))) == pytest.approx(0.45)


def test_queue_reach_edges(spark):
    assert one(spark, S.queue_reach(F.lit(10.0), F.lit(0.0))) == 1.0
    assert one(spark, S.queue_reach(F.lit(0.0), F.lit(0.0))) == 0.0
    assert one(spark, S.queue_reach(F.lit(60.0), F.lit(240.0))) == 0.25
    assert one(spark, S.queue_reach(F.lit(60.0), F.lit(None).cast("double"))) == 0.0


def test_sun_at_a_known_noon(spark):
    # Equator at the equinox, close to overhead at noon.
    assert one(spark, G.solar_elevation(F.lit(0.0), F.lit(0.0), F.lit(1710936000.0))) > 87.0
    assert one(spark, G.solar_elevation(F.lit(40.0), F.lit(-90.0), F.lit(1710914400.0))) < 0.0


@pytest.mark.parametrize("text,want", [("I-39/US 51 at County B", {"I39", "US51"}), ("US 12/18", {"US12", "US18"}), ("WIS 30", {"SR30"}), ("I 039;CTH 5", {"I39", "CR5"}), ("Main St", set())])
def test_route_tokens(spark, text, want):
    assert set(one(spark, X.route_tokens(F.lit(text)))) == want


@pytest.mark.parametrize("text,want", [("I 35", "I-35"), ("I-35/80", "I-35"), ("IA 5 @ MM 3", "IA-5"), ("turn in 5", None), ("Main St", None)])
def test_route_label(spark, text, want):
    assert one(spark, X.route_label(F.lit(text))) == want


def test_place_and_label(spark):
    assert one(spark, X.dispatch_place(F.lit("I-5 NBx[Main]"))) == "I-5 northbound at Main"
    assert one(spark, X.dispatch_place(F.lit("I-5x[Main]"))) == "I-5x[Main]"
    assert one(spark, X.dispatch_place(F.lit("CR-18 EB x[NE 3RD AVE AND THE BAY, (OLD)]"))) == "CR-18 eastbound at NE 3rd Ave and the Bay, (Old)"
    assert one(spark, X.sentence_label(F.lit("STALLED BUS W/TRAILER"))) == "Stalled bus with trailer"
    assert one(spark, X.without_device_number(F.lit("4071 US-20/SR 5 NEAR 1ST ST"))) == "US-20 / SR 5 near 1st St"


def brute_learning(polls):
    n, mean, since, out = {}, {}, None, []
    for at, d, cell in polls:
        c, m = n.get(cell, 0), mean.get(cell, 0.0)
        known = c >= 5
        odd = known and ((m > 0.008 and d <= 0.004) or d >= 2 * m)
        since = (at if since is None else since) if odd else None
        learned = not odd or at - since >= 10800
        out.append((c, learned))
        if learned:
            n[cell], mean[cell] = c + 1, m + (d - m) / (c + 1)
    return out


def test_learning_rule_across_waves(spark):
    rng = random.Random(5)
    rows, at = [], 1_700_000_000.0
    for i in range(500):
        at += rng.choice([600.0, 3600.0, 20_000.0])
        rows.append((i, 1, at, rng.choice([0.001, 0.01, 0.012, 0.05])))
    df = spark.createDataFrame(rows, "poll_id long, camera_id long, at double, diff double")
    got = {r["poll_id"]: (r["cell_n"], r["learned"]) for r in folds.learned_baseline(df).collect()}
    cell = lambda t: (int(t // 3600) + 96) % 168
    want = brute_learning([(r[2], r[3], cell(r[2])) for r in rows])
    assert [got[i] for i in range(500)] == want


def test_diary_spacing_counts_from_the_last_written(spark):
    rows = [(0, "movement", 1, 0.0), (1, "movement", 1, 1000.0), (2, "movement", 1, 1800.0), (3, "movement", 1, 3000.0), (4, "incident", 1, 1000.0), (5, "movement", 1, 700_000.0)]
    df = spark.createDataFrame(rows, "entry_id long, kind string, camera_id long, at double")
    assert sorted(r["entry_id"] for r in folds.spaced_entries(df).collect()) == [0, 2, 4, 5]


def test_shortest_path_through_a_hub_is_rejected(spark):
    rows = [("site:A", "n1", 100.0), ("n1", "site:B", 100.0), ("site:B", "n2", 100.0), ("n2", "site:C", 100.0), ("n1", "n2", 500.0)]
    e = spark.createDataFrame([(a, b, m, m / 10, "motorway") for a, b, m in rows], "src string, dst string, length_m double, tt_s double, highway string")
    got = {(r["src"], r["dst"]): r["length_m"] for r in H.shortest_between_hubs(e).collect()}
    # A reaches C shortest by way of B, so A-C is dropped although a longer way avoids B.
    assert got == {("A", "B"): 200.0, ("B", "C"): 200.0}


def test_components_of_a_long_chain(spark):
    nodes = spark.range(60).select("id")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(39)] + [(50, 55)], "a long, b long")
    got = {r["id"]: r["component"] for r in R.components(nodes, pairs).collect()}
    assert all(got[i] == 0 for i in range(40)) and got[55] == 50 and got[45] == 45


def test_trip_drives_past_a_crossing_camera(spark):
    sites = spark.createDataFrame([(i, 1, 40.0 + 0.01 * i, -90.0, None if i == 2 else "I-35") for i in range(5)], "site_id long, region_id int, lat double, lon double, route string")
    edges = spark.createDataFrame([(i, i + 1, "freeway", 1000.0, 40.0) for i in range(4)], "src long, dst long, kind string, length_m double, tt_s double")
    trips = R.plan_trips(edges, sites).orderBy("stop").collect()
    assert [r["site_id"] for r in trips] == [0, 1, 3, 4] and trips[-1]["distance_m"] == 4000.0 and trips[0]["heading"] == "northbound"


def test_solver_and_fixed_schedule_agree(spark):
    rng = np.random.default_rng(1)
    a, b = rng.random((300, 8)), rng.random((300, 8))
    y = (a - b) @ np.array([3, 1, 2, 0.5, 1, 0, 0, -1]) + rng.normal(0, 0.3, 300) > 0
    rows = [(int(i), 1, float(i), a[i].tolist(), b[i].tolist(), "a" if y[i] else "b") for i in range(300)]
    df = spark.createDataFrame(rows, "vote_id long, voter long, ts double, a_x array<double>, b_x array<double>, pick string")
    exact = L.fit_voters(df).first()["weights"]
    assert np.allclose(exact, L.fit_all(df), atol=2e-3)
    assert np.allclose(exact, L.descend(a - b, y.astype(float)), atol=1e-12)


def test_osm_one_way_rules(spark):
    way = '{"type":"way","id":%d,"nodes":[1,2],"geometry":[{"lat":40,"lon":-90},{"lat":40.001,"lon":-90}],"tags":{%s}}'
    body = '{"elements":[%s]}' % ",".join([way % (1, '"highway":"motorway"'), way % (2, '"highway":"primary","oneway":"-1","maxspeed":"50 mph"'), way % (3, '"highway":"primary","lanes":"2;3"')])
    got = {r["way_id"]: r for r in osm.road_segments(osm.ways(spark.createDataFrame([(body,)], "body string"))).collect()}
    assert not got[1]["two_way"] and not got[2]["two_way"] and got[3]["two_way"]
    assert (got[2]["a"], got[2]["b"]) == (2, 1) and math.isclose(got[2]["maxspeed_kmh"], 80.4672) and got[3]["lanes"] is None


def test_511_view_labels_only_when_several(spark):
    body = '[{"Latitude":41,"Longitude":-93,"Location":"I-80 at 5th","Views":[{"Url":"https://a/1","Description":"East"},{"Url":"https://a/2","Description":"West","Status":"Disabled"}]}]'
    row = feeds.dev511(spark.createDataFrame([(body,)], "body string"), "x").first()
    assert row["location"] == "I-80 at 5th" and row["roadway"] == "I-80"


def adjacency_case(spark, opposite):
    """Sites A and B on one straight road; site C's snap stands beside it on a parallel carriageway."""
    nodes = spark.createDataFrame([("site:A", 40.0, -90.0), ("n1", 40.005, -90.0), ("site:B", 40.01, -90.0)], "node string, lat double, lon double")
    road = spark.createDataFrame([("site:A", "n1", 556.0, 20.0, "motorway"), ("n1", "site:B", 556.0, 20.0, "motorway")], "src string, dst string, length_m double, tt_s double, highway string")
    sites = spark.createDataFrame([("A", 40.0, -90.0, True, ["I5"]), ("B", 40.01, -90.0, True, ["I5"]), ("C", 40.006, -90.0003, True, ["I5"])], "site_id string, lat double, lon double, is_freeway boolean, refs array<string>")
    snaps = spark.createDataFrame([("A", 40.0, -90.0, 0.0, False, True), ("B", 40.01, -90.0, 0.0, False, True), ("C", 40.006, -90.0003, 180.0 if opposite else 0.0, False, True)],
                                  "site_id string, lat double, lon double, seg_bearing double, two_way boolean, is_freeway boolean")
    return [(r["src"], r["dst"], r["kind"]) for r in R.adjacency(H.shortest_between_hubs(road), sites, nodes, snaps, road).collect()]


def test_a_snap_on_the_flow_blocks_and_the_other_side_does_not(spark):
    assert adjacency_case(spark, opposite=True) == [("A", "B", "freeway")]
    assert adjacency_case(spark, opposite=False) == []


def test_every_evaluation_vote_is_predicted(spark):
    from curbwatch.operators import learning as L
    rng = random.Random(3)
    vec = lambda: [rng.random() for _ in range(L.WIDTH)]
    rows = [(i, 1, 1_700_000_000.0 + i, vec(), vec(), rng.choice("ab"), "evaluate" if i % 5 else "learn") for i in range(2600)]
    votes = spark.createDataFrame(rows, "vote_id long, voter long, ts double, a_x array<double>, b_x array<double>, pick string, mode string")
    got = {r["vote_id"] for r in L.held_out(votes).collect()}
    assert got == {i for i in range(2600) if i % 5}
    same = spark.createDataFrame([(9000, 1, 1_800_000_000.0, [0.5] * L.WIDTH, [0.5] * L.WIDTH, "a", "evaluate")], votes.schema)
    assert L.held_out(votes.union(same)).filter("vote_id = 9000").first()["by_person"] is None


def test_hit_rates_without_a_look(spark):
    from curbwatch.operators import learning as L
    rows = [(i, "s" if i % 2 else "t", "a", "evaluate", 0.3 if i % 3 else -0.3, None if i % 2 else 0.1) for i in range(12)]
    df = spark.createDataFrame(rows, "vote_id long, stratum string, pick string, mode string, by_equation double, by_look double")
    got = {(r["stratum"], r["ranker"]): r["n"] for r in L.hit_rates(df, {"equation": "by_equation", "look": "by_look"}).collect()}
    assert got == {("s", "equation"): 6, ("t", "equation"): 6, ("t", "look"): 6, ("all", "equation"): 6, ("all", "look"): 6}


def test_hubs_are_compared_with_the_last_kept(spark):
    from curbwatch.operators.roads import splice
    seg = spark.createDataFrame([(1, 0, "n1", "n2", 100.0, 10.0, "primary", False)], "way_id long, seg_index int, a string, b string, length_m double, tt_s double, highway string, two_way boolean")
    hubs = spark.createDataFrame([("A", 1, 0, t) for t in (10.8, 10.0, 10.4)], "site_id string, way_id long, seg_index int, t double")
    got = sorted(round(r["length_m"], 6) for r in splice(seg, hubs).collect())
    assert got == sorted([10.0, 89.2]) or got == sorted([10.0, 0.8, 89.2])


def test_an_edited_remark_ends_a_verdict(spark):
    from curbwatch.operators.floors import current_verdicts
    inc = spark.createDataFrame([(1, "T", 5.0, "L", "new"), (2, "T", 5.0, "L", None)], "incident_id long, type string, reported_at double, location string, remarks string")
    old = inc.withColumn("remarks", F.when(F.col("incident_id") == 1, "old"))
    assert [r["incident_id"] for r in current_verdicts(inc, old).collect()] == [2]


def test_catalog_and_log_round_trip(spark, tmp_path):
    import json
    from curbwatch.sources import tables as T
    cam = dict(id=1, region="r", source="s", image_path="i", roadway="I-5", direction=None, location="x", lat=1.0, lon=2.0, video_url=None, video_auth=False, link_id=None, source_system="z", mile_marker=None)
    (tmp_path / "cameras.json").write_text(json.dumps([cam]))
    assert T.read_catalog(spark, str(tmp_path / "cameras.json")).first()["roadway"] == "I-5"
    (tmp_path / "bad.json").write_text(json.dumps([{**cam, "lat": "north"}]))
    with pytest.raises(Exception):
        T.read_catalog(spark, str(tmp_path / "bad.json")).collect()
    T.write_log(spark.createDataFrame([(0, 1_700_000_000.0)], "rank int, ts double"), F.col("ts"), str(tmp_path / "log"))
    assert str(spark.read.json(str(tmp_path / "log")).first()["day"]) == "2023-11-14"


def test_outline_with_a_hole(spark):
    from curbwatch.operators.metros import camera_state
    from curbwatch.sources import tables as T
    body = '{"states":[{"code":"AA","name":"A","rings":[[[0,0],[0,4],[4,4],[4,0]],[[1,1],[1,2],[2,2],[2,1]]]}]}'
    s = T.state_outlines(spark.createDataFrame([(body,)], "body string")).withColumn("state_id", F.lit(1)).withColumn("source_id", F.lit(1))
    cams = spark.createDataFrame([(1, 1, 3.0, 3.0), (2, 1, 1.5, 1.5), (3, 1, 9.0, 9.0)], "camera_id long, source_id int, lat double, lon double")
    got = {r["camera_id"]: r["inside"] for r in camera_state(cams, s.drop("code", "name")).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_unknown_camera_choice_is_an_error(spark):
    from curbwatch.sources import tables as T
    cams = spark.createDataFrame([(1, True, "a"), (2, False, "b")], "camera_id long, is_freeway boolean, location string")
    assert T.select_cameras(cams, "2").count() == 1
    assert T.select_cameras(cams.withColumn("location", F.lit(None).cast("string")), "1").columns == cams.columns
    assert T.select_cameras(cams.withColumn("location", F.lit(None).cast("string")), "1").count() == 1
    with pytest.raises(Exception):
        T.select_cameras(cams, "2,9").collect()


def test_local_source_may_not_redefine_a_published_one(spark):
    from curbwatch.sources import tables as T
    pub = spark.createDataFrame([("a", 1)], "key string, v int")
    assert T.overlay(pub, spark.createDataFrame([("b", 2)], "key string, v int"), "key").count() == 2
    with pytest.raises(Exception):
        T.overlay(pub, spark.createDataFrame([("a", 2)], "key string, v int"), "key").collect()
