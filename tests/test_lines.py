"""Places along polylines against a plain walk, and crowded spots."""

import math
import random

from pyspark.sql import functions as F

from curbwatch.config import EARTH_M
from curbwatch.operators import lines as N
from curbwatch.operators import roads as R

LAT, LON = 41.0, -93.0
KY = math.pi / 180 * EARTH_M
KX = KY * math.cos(math.radians(LAT))


def place(x, y):
    return (LAT + y / KY, LON + x / KX)


def walk(line, s):
    """The point at s metres along a line of x, y points."""
    for (ax, ay), (bx, by) in zip(line, line[1:]):
        m = math.hypot(bx - ax, by - ay)
        if s <= m:
            return ax + s / m * (bx - ax), ay + s / m * (by - ay)
        s -= m
    return line[-1]


def project(line, px, py):
    best, base = None, 0.0
    for (ax, ay), (bx, by) in zip(line, line[1:]):
        m = math.hypot(bx - ax, by - ay)
        u = max(0.0, min(1.0, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / m ** 2))
        d = math.hypot(px - ax - u * (bx - ax), py - ay - u * (by - ay))
        if best is None or d < best[0] - 1e-9:
            best = (d, base + u * m)
        base += m
    return best, base


def test_random_lines(spark):
    rng = random.Random(5)
    lines = {i: [(x * 40.0 + rng.uniform(-9, 9), rng.uniform(-60, 60)) for x in range(rng.randint(2, 30))] for i in range(40)}
    points = {i: (rng.uniform(-100, 900), rng.uniform(-150, 150)) for i in range(60)}
    df = spark.createDataFrame([(i, [place(*p) for p in line]) for i, line in lines.items()], "count_id long, coords array<struct<lat:double,lon:double>>")
    pts = spark.createDataFrame([(i, *place(*p), LAT, LON) for i, p in points.items()], "camera_id long, lat double, lon double, lat0 double, lon0 double")
    got = {(r.camera_id, r.count_id): r for r in N.nearest_on_lines(pts, df, "camera_id", "count_id", 150.0).collect()}
    want = {(c, i): (*project(line, *p)[0], project(line, *p)[1]) for c, p in points.items() for i, line in lines.items()}
    assert set(got) == {k for k, v in want.items() if v[0] <= 150.0} and len(got) > 500
    for (c, i), r in got.items():
        d, t, total = want[c, i]
        (ax, ay), (bx, by) = walk(lines[i], max(0.0, t - 25)), walk(lines[i], min(total, t + 25))
        heading = math.degrees(math.atan2(bx - ax, by - ay)) % 360
        assert abs(r.distance_m - d) < 1e-5 and abs(r.t - t) < 1e-4 and abs((r.heading - heading + 180) % 360 - 180) < 1e-3


def test_a_line_along_the_cameras_road_wins(spark):
    """A crossing road passes closer, at its bend it even runs alike for a piece; the heading over 25 m either way decides."""
    along = [(x, 60.0) for x in range(-200, 201, 50)]
    crossing = [(0.0, -300.0), (0.0, -10.0), (8.0, 5.0), (16.0, 5.0), (16.0, 300.0)]
    lines = spark.createDataFrame([(1, [place(*p) for p in along], "US 12", 700), (2, [place(*p) for p in crossing], "US 12", 900), (3, [place(0.0, 1.0)], "US 12", 1)],
                                  "count_id long, coords array<struct<lat:double,lon:double>>, roadway string, aadt long")
    cams = spark.createDataFrame([(7, LAT, LON, LAT, LON, ["US12"], 90.0), (8, LAT, LON, LAT, LON, [], None), (9, LAT, LON, LAT, LON, ["I80"], 90.0)],
                                 "camera_id long, lat double, lon double, lat0 double, lon0 double, refs array<string>, want double")
    got = {r.camera_id: (r.count_id, r.aadt, r.aligned) for r in N.match_counts(cams, lines).collect()}
    assert got == {7: (1, 700, True), 8: (2, 900, True)}


def test_a_crowded_spot(spark):
    """A hundred thousand cameras and two thousand equal segments at one spot: every spot is snapped once, so no pairs of them are made."""
    cams = spark.range(100_000).select(F.col("id").alias("camera_id"), F.lit(LAT).alias("lat"), F.lit(LON).alias("lon"), F.lit(LAT).alias("lat0"), F.lit(LON).alias("lon0"),
                                       F.array(F.lit("US12")).alias("refs"), F.lit("N").alias("direction"), F.lit(False).alias("at_intersection"))
    a, b = place(-50, 10), place(50, 10)
    segs = spark.range(2000).select((F.col("id") + 5).alias("way_id"), F.lit(0).alias("seg_index"), *[F.lit(v).alias(n) for n, v in zip(("a_lat", "a_lon", "b_lat", "b_lon"), (*a, *b))],
                                    F.lit("primary").alias("highway"), F.lit("US 12").alias("ref"), F.lit(True).alias("two_way"))
    got = R.snap_cameras(cams, segs)
    assert got.groupBy("way_id").count().collect() == [(5, 100_000)]


def test_road_of_a_path(spark):
    """Legs are joined in travel order, turned where they are drawn the other way, and the site between two is there once."""
    p = lambda *xs: [place(x, 0.0) for x in xs]
    links = spark.createDataFrame([("a", "b", 10.0, p(0, 5, 10)), ("c", "b", 20.0, p(30, 10)), ("c", "d", 5.0, p(30, 35)), ("a", "x", 1.0, p(0, 1)), ("x", "d", 900.0, p(1, 35)),
                                   ("d", "x", 800.0, p(35, 20, 1)), ("q", "r", 1.0, p(0, 1))], "src string, dst string, length_m double, points array<struct<lat:double,lon:double>>")
    pairs = spark.createDataFrame([(1, "a", "c"), (2, "c", "a"), (3, "a", "d"), (4, "a", "a"), (5, "a", "q"), (6, "b", "x")], "pair_id long, from_site string, to_site string")
    got = {r.pair_id: (r.hops, r.path, [round((q.lon - LON) * KX) for q in r.line], r.length_m) for r in N.road_paths(pairs, links).collect()}
    assert got == {1: (2, ["a", "b", "c"], [0, 5, 10, 30], 30.0), 2: (2, ["c", "b", "a"], [30, 10, 5, 0], 30.0), 3: (2, ["a", "x", "d"], [0, 1, 20, 35], 801.0), 6: (2, ["b", "a", "x"], [10, 5, 0, 1], 11.0)}
    assert 1 not in {r.pair_id for r in N.road_paths(pairs, links, 1).collect()}


def test_roads_on_random_graphs(spark):
    """Paths against a plain search by hops: of all shortest ways the one whose sites, read from the end, come first."""
    rng, links, pairs, want = random.Random(23), [], [], {}
    for g in range(60):
        n = rng.randint(2, 24)
        name = [f"{g}-{i}" for i in range(n)]
        held = {tuple(rng.sample(name, 2)) for _ in range(rng.randint(0, rng.choice((n // 5, 2 * n))))} | {(a, b) for a, b in zip(name, name[1:]) if rng.random() < 0.95}
        links += [(a, b, 1.0, [place(0, 0), place(1, 0)]) for a, b in held]
        next_to = {x: {b for a, b in held if a == x} | {a for a, b in held if b == x} for x in name}
        for _ in range(12):
            start, end = rng.choice(name), rng.choice(name)
            hops, front = {start: 0}, [start]
            while front:
                front = sorted({y for x in front for y in next_to[x] if y not in hops and not hops.update({y: hops[x] + 1})})
            pairs.append((len(pairs), start, end))
            if start != end and end in hops:
                way = [end]
                while way[-1] != start:
                    way.append(min(x for x in next_to[way[-1]] if hops[x] == hops[way[-1]] - 1))
                want[pairs[-1][0]] = way[::-1]
    l = spark.createDataFrame(links, "src string, dst string, length_m double, points array<struct<lat:double,lon:double>>")
    p = spark.createDataFrame(pairs, "pair_id long, from_site string, to_site string")
    for most in (8, 3, 2):
        got = {r.pair_id: (r.hops, r.path, r.length_m) for r in N.road_paths(p, l, most).collect()}
        assert got == {k: (len(w) - 1, w, len(w) - 1.0) for k, w in want.items() if len(w) <= most + 1}
    assert {len(w) for w in want.values()} >= set(range(2, 12))


def test_a_search_grows_from_both_ends(spark, monkeypatch):
    """From the root of a tree to a leaf eight hops down, less than a fifth of the 510 sites are listed, in one table a round."""
    l = spark.createDataFrame([(i // 2, i, 1.0, [place(0, 0), place(1, 0)]) for i in range(2, 512)], "src long, dst long, length_m double, points array<struct<lat:double,lon:double>>")
    written, plain = [], N.durable
    monkeypatch.setattr(N, "durable", lambda df: written.append(plain(df)) or written[-1])
    (got,) = N.road_paths(spark.createDataFrame([(7, 1, 300)], "pair_id long, from_site long, to_site long"), l).collect()
    assert got.path == [1, 2, 4, 9, 18, 37, 75, 150, 300]
    assert len(written) <= 6 and sum(df.count() for df in written if "pair_id" in df.columns) < 102


def test_point_at_a_distance(spark):
    df = spark.createDataFrame([([place(0, 0), place(3, 4), place(3, 10)], s) for s in (-5.0, 0.0, 2.5, 5.0, 8.0, 11.0, 99.0)], "line array<struct<lat:double,lon:double>>, s double")
    legs = N.legs(F.col("line"), F.lit(LAT), F.lit(LON))
    got = [(round(r.p.x, 6) + 0.0, round(r.p.y, 6) + 0.0, round(r.m, 6)) for r in df.select(N.point_at(legs, F.col("s")).alias("p"), N.length(legs).alias("m")).collect()]
    assert got == [(0, 0, 11), (0, 0, 11), (1.5, 2, 11), (3, 4, 11), (3, 7, 11), (3, 10, 11), (3, 10, 11)]


def test_crowds_of_cameras_and_lines_meet_once(spark, monkeypatch):
    """Thousands of lines drawn alike are one shape at one place, the lowest of the camera's route wins, and the reading is spread by rows."""
    shape = [place(-100, 10), place(100, 10)]
    at = F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in shape])
    counted = spark.range(4000).select((F.col("id") + 5).alias("count_id"), at.alias("coords"), F.when(F.col("id") % 2 == 0, "US 12").otherwise("I-80").alias("roadway"), (F.col("id") * 3).alias("aadt"))
    refs = F.when(F.col("id") % 3 == 0, F.array(F.lit("US12"))).when(F.col("id") % 3 == 1, F.array(F.lit("I80"))).otherwise(F.array().cast("array<string>"))
    cams = spark.range(3000).select(F.col("id").alias("camera_id"), *[F.lit(v).alias(c) for c, v in zip(("lat", "lon", "lat0", "lon0"), (LAT, LON, LAT, LON))], refs.alias("refs"), F.lit(90.0).alias("want"))
    met, plain = [], R.snap_candidates
    monkeypatch.setattr(R, "snap_candidates", lambda points, segments, m: met.append((points.count(), segments.count())) or plain(points, segments, m))
    got = N.match_counts(cams, counted).groupBy(F.col("camera_id") % 3, "count_id", "aadt", "aligned").count().collect()
    assert sorted(map(tuple, got)) == [(0, 5, 0, True, 1000), (1, 6, 3, True, 1000), (2, 5, 0, True, 1000)] and met == [(1, 1)]
