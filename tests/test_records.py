"""Documents that are read back strictly, refusals, clocks of several zones, and the evidence documents by hand."""

import json

import pytest
from pyspark.sql import functions as F

from curbwatch.operators import city, events
from curbwatch.sources import tables as T


def sections(spark, size=3):
    sites = spark.createDataFrame([(r, 10 * r + i, 41.0 + i, -93.0, i % 2 == 0, [10 * r + i]) for r in (1, 2) for i in range(7)], "region_id int, id long, lat double, lon double, is_freeway boolean, cameras array<long>")
    cams = sites.select("region_id", "id", F.lit("I-80").alias("roadway"), F.lit("x").alias("location"), "lat", "lon", F.col("id").alias("site"), "is_freeway", F.lit(False).alias("has_video"))
    edges = spark.createDataFrame([(1, 10, 11, "freeway", 100.0, 5.0), (2, 20, 21, "nearby", 0.0, 0.0)], "region_id int, src long, dst long, kind string, length_m double, tt_s double")
    meta = spark.createDataFrame([(1, "A", "s", 7, 7, 1), (2, "B", "s", 7, 7, 1)], "region_id int, name string, source string, sites long, cameras long, edges long")
    parts = {"meta": meta, "sites": sites, "cameras": cams, "edges": edges}
    return T.graph_sections(parts, size), parts


def test_graph_documents_round_trip(spark):
    lines, parts = sections(spark)
    for part, df in parts.items():
        got = T.graph_part(lines, part)
        assert sorted(map(str, got.select(*df.columns).collect())) == sorted(map(str, df.collect()))
    sizes = [len(json.loads(r.line)["rows"]) for r in lines.filter("part = 'sites'").collect()]
    assert sum(sizes) == 14 and len(sizes) > 2


@pytest.mark.parametrize("damage", [lambda c: F.substring(c, 1, 30), lambda c: F.regexp_replace(c, '"version":1', '"version":2'), lambda c: F.lit("")])
def test_a_damaged_section_fails_with_its_place(spark, damage):
    lines, _ = sections(spark)
    bad = lines.withColumn("line", F.when((F.col("region_id") == 2) & (F.col("part") == "edges"), damage(F.col("line"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="damaged graph section/2/edges/0"):
        T.graph_part(bad, "edges").collect()
    assert T.graph_part(bad, "sites").count() == 14


def test_a_place_without_a_source_is_refused(spark):
    places = spark.createDataFrame([("Ames", "IA", 42.0, -93.6), ("Reno", "NV", 39.5, -119.8)], "name string, state string, lat double, lon double")
    sources = spark.createDataFrame([("s", ["IA"])], "source string, states array<string>")
    assert [r.source for r in T.covered_regions(places.filter("state = 'IA'"), sources, 10.0).collect()] == ["s"]
    with pytest.raises(Exception, match="no source covers Reno"):
        T.covered_regions(places, sources, 10.0).collect()


def test_clocks_on_both_changes(spark):
    """Around 10 March and 3 November 2024; Phoenix keeps its time."""
    rows = [(1, 1710057540.0, "America/Chicago"), (2, 1710057600.0, "America/Chicago"), (3, 1730613540.0, "America/New_York"), (4, 1730613600.0, "America/New_York"),
            (5, 1710057600.0, "America/Phoenix"), (6, 1710057600.0 + 8 * 3600, "America/Chicago")]
    df = spark.createDataFrame([(i, t, z, 41.0, -90.0) for i, t, z in rows], "poll_id long, at double, zone string, lat double, lon double")
    got = {r.poll_id: r.local_time for r in events.local_night(df).collect()}
    assert got == {1: "2024-03-10 01:59", 2: "2024-03-10 03:00", 3: "2024-11-03 01:59", 4: "2024-11-03 01:00", 5: "2024-03-10 01:00"}


def test_a_count_belongs_to_one_frame(spark):
    newest = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 5.0)], "camera_id long, frame_at double")
    counts = spark.createDataFrame([(1, 5.0, 3), (2, 4.0, 9), (3, 5.0, 1)], "camera_id long, frame_at double, vehicles int")
    got = {r.camera_id: (r.status, r.vehicles) for r in city.vehicle_status(newest, counts, F.col("camera_id") != 3).collect()}
    assert got == {1: ("counted", 3), 2: ("none", None), 3: ("off", None)}


NOW = 1_700_000_000.0
CAMERAS = [(i, "I-80", f"view {i}") for i in range(1, 6)]


def world(spark):
    cams = spark.createDataFrame(CAMERAS, "camera_id long, roadway string, location string")
    state = spark.createDataFrame([(1, 0.02, 0.01, 9, NOW - 300, True), (2, 0.001, 0.01, 9, NOW - 30, False), (3, None, None, 0, None, None), (4, 0.01, 0.0, 1, NOW - 7200, False)],
                                  "camera_id long, diff double, baseline double, cell_n long, last_at double, ambiguous boolean")
    corridor = spark.createDataFrame([(1, 2, "upstream", 900.4, 1, 40.2, 216.0), (1, 3, "downstream", 500.0, 1, 20.0, None), (1, 4, "nearby", 90.0, 1, 5.0, None), (1, 2, "upstream", 1200.0, 2, 60.0, 288.0),
                                      (1, 5, "upstream", 700.0, 1, 30.0, 7200.0)], "camera_id long, neighbor_id long, side string, length_m double, hops int, tt_s double, wave_s double")
    return cams, state, corridor


def test_evidence_of_a_record(spark):
    cams, state, corridor = world(spark)
    inc = spark.createDataFrame([(7, "C1", "Crash", True, False, "I-80 at 5", "Ames", "Story", NOW - 600, "two cars")],
                                "incident_id long, type string, label string, road_relevant boolean, implies_closure boolean, location string, city string, county string, reported_at double, remarks string")
    links = spark.createDataFrame([(7, 1, 0.1234, 1)], "incident_id long, camera_id long, km double, rank int")
    doc = json.loads(events.evidence_records(inc.select("incident_id"), inc, links, state, cams, F.lit(NOW), corridor).first().document)
    assert doc["dispatch_record"] == {"agency_code": "C1", "agency_code_meaning": "Crash", "code_is_about_the_road": True, "code_implies_the_road_is_blocked": False, "reported_location": "I-80 at 5",
                                      "city": "Ames", "county": "Story", "reported": "10 minutes ago", "dispatcher_remarks": "two cars"}
    (named,) = doc["cameras_the_record_names"]
    assert named["distance_from_the_reported_location"] == "123 m" and named["times_its_usual"] == 2.0 and named["still_although_this_hour_usually_moves"] is True and named["newest_frame"] == "5 minutes ago"
    along = doc["nearby_cameras_on_the_same_corridor"]
    assert [n["camera_id"] for n in along] == ["5", "2", "3", "4"]
    assert along[1]["road_distance"] == "900 m" and along[1]["side"] == "on the approach to the reported location" and along[1]["a_queue_at_the_incident_would_reach_here_in"] == "4 minutes"
    assert along[0]["picture"] == "no picture yet" and along[2]["side"] == "past the reported location" and "a_queue_at_the_incident_would_reach_here_in" not in along[2]
    assert along[3]["side"] == "nearby, off the corridor" and "times_its_usual" not in along[3]


def test_evidence_of_a_still_camera(spark):
    cams, state, corridor = world(spark)
    asked = spark.createDataFrame([(1,), (2,)], "camera_id long")
    counts = spark.createDataFrame([(1, NOW - 300, 0, {"car": 0}), (2, NOW - 999, 5, {"car": 5})], "camera_id long, frame_at double, vehicles int, by_class map<string,int>")
    out = events.gate_evidence(asked, state.withColumn("zone", F.lit("America/Chicago")), cams, corridor, asked.limit(1), counts, F.lit(NOW))
    docs = {r.camera_id: json.loads(r.document) for r in out.collect()}
    assert docs[1]["camera"]["vehicles_a_detector_counted_in_this_picture"] == "0" and docs[2]["camera"]["vehicles_a_detector_counted_in_this_picture"] == "not counted"
    assert docs[1]["camera"]["a_dispatch_record_already_names_this_camera"] is True and docs[1]["camera"]["time_of_day"] == "Tuesday 4 PM"
    assert [n["camera_id"] for n in docs[1]["cameras_on_the_same_corridor"]] == ["5", "2", "3", "4"] and docs[2]["cameras_on_the_same_corridor"] == []


def test_evidence_of_leaders(spark):
    cams, state, _ = world(spark)
    leaders = state.filter("camera_id < 3").withColumns({"region_id": F.lit(1), "rank": (3 - F.col("camera_id")).cast("int"), "highway": F.lit("motorway"), "scale_prior": F.lit(0.5),
                                                         "incident": F.when(F.col("camera_id") == 1, "Crash"), "queue_floor": F.lit(0.2), "still_floor": F.lit(None).cast("double")})
    regions = spark.createDataFrame([(1, "Ames", "America/Chicago")], "region_id int, name string, zone string")
    doc = json.loads(events.review_evidence(regions, leaders, cams, regions, F.lit(NOW)).first().document)
    assert doc["city"] == "Ames" and [c["camera_id"] for c in doc["cameras"]] == ["2", "1"]
    assert [c["incident_reported_here"] for c in doc["cameras"]] == ["none", "Crash"] and doc["cameras"][0]["how_much_traffic_the_road_carries"].startswith("0.5 on a scale")
    assert doc["cameras"][0]["queue_expected_from_an_incident_ahead"] is True and doc["cameras"][0]["stopped_traffic_confirmed"] is False
