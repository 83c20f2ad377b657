"""Road graph operators against textbook algorithms on random inputs."""

import heapq
import math
import random

from pyspark.sql import functions as F

from curbwatch.operators import hubpaths as H
from curbwatch.operators import roads as D
from curbwatch.operators import spatial as S

ROAD = "src string, dst string, length_m double, tt_s double, highway string"


def dijkstra(edges, start, cutoff):
    """Metres of the shortest way to every node, and whether all shortest ways pass another hub on it."""
    out, heap, done = {}, [(0, False, start)], {}
    while heap:
        metres, via, node = heapq.heappop(heap)
        if node in done:
            continue
        done[node] = (metres, via)
        for dst, step in edges.get(node, {}).items():
            if dst not in done and metres + step <= cutoff:
                heapq.heappush(heap, (metres + step, via or (node != start and node.startswith("site:")), dst))
    out = {n: v for n, v in done.items() if n != start}
    return out


def test_hub_paths_on_random_graphs(spark):
    """200 graphs of up to 14 nodes with bends, one-way streets, rings, parallel ways and dead ends."""
    rng, rows, want = random.Random(17), [], {}
    for g in range(200):
        n = rng.randint(3, 14)
        name = [f"site:{g}-{i}" if rng.random() < 0.35 else f"n{g}-{i}" for i in range(n)]
        edges = {}
        for i in range(n - 1):  # a long bent road, then some crossings
            edges[name[i], name[i + 1]] = float(rng.randint(1, 9) * 100)
            if rng.random() < 0.6:
                edges[name[i + 1], name[i]] = edges[name[i], name[i + 1]]
        for _ in range(rng.randint(0, n)):
            a, b = rng.sample(name, 2)
            edges[a, b] = float(rng.randint(1, 20) * 100)
        ring = [f"r{g}-{i}" for i in range(3)]
        edges |= {(a, b): 100.0 for a, b in zip(ring, ring[1:] + ring[:1])}
        out = {}
        for (a, b), metres in edges.items():
            out.setdefault(a, {})[b] = metres
            rows.append((a, b, metres, metres / 10, rng.choice(["motorway", "primary"])))
            if rng.random() < 0.2:
                rows.append((a, b, metres + 50, 1.0, "primary"))
        for start in name:
            if start.startswith("site:"):
                for node, (metres, via) in dijkstra(out, start, 3000).items():
                    if node.startswith("site:") and not via:
                        want[start[5:], node[5:]] = metres
    df = spark.createDataFrame(rows, ROAD)
    got = H.shortest_between_hubs(df, 3000).collect()
    assert {(r.src, r.dst): r.length_m for r in got} == want and len(want) > 300
    step = {}
    for a, b, metres, tt, cls in rows:
        step[a, b] = min(step.get((a, b), (9e9,)), (metres, tt, cls))
    for r in got:
        legs = [step[p] for p in zip(r.path, r.path[1:])]
        assert r.path[0] == f"site:{r.src}" and r.path[-1] == f"site:{r.dst}" and not any(x.startswith("site:") for x in r.path[1:-1])
        assert sum(x[0] for x in legs) == r.length_m and abs(sum(x[1] for x in legs) - r.tt_s) < 1e-9
        assert r.classes == [x[2] for i, x in enumerate(legs) if i == 0 or x[2] != legs[i - 1][2]]


def test_a_long_bent_road_is_one_arc(spark):
    """A thousand bends between two hubs: two arcs, each way one, whatever the number of nodes."""
    nodes = ["site:A", *[f"n{i}" for i in range(1000)], "site:B"]
    rows = [(a, b, 7.0, 1.0, "primary") for a, b in zip(nodes, nodes[1:])]
    rows += [(b, a, *rest) for a, b, *rest in rows]
    df = spark.createDataFrame(rows, ROAD)
    arcs, steps = H.contracted(df)
    assert sorted((r.a, r.b, r.length_m) for r in arcs.collect()) == [("site:A", "site:B", 7007.0), ("site:B", "site:A", 7007.0)]
    assert steps.groupBy("arc").agg(F.count(F.lit(1)).alias("n")).filter("n = 1001").count() == 2
    (path,) = [r.path for r in H.shortest_between_hubs(df).collect() if r.src == "A"]
    assert path == nodes


def test_no_hubs_no_paths(spark):
    df = spark.createDataFrame([("a", "b", 1.0, 1.0, "primary")], ROAD)
    assert H.shortest_between_hubs(df).count() == 0 and H.shortest_between_hubs(df.limit(0)).count() == 0


def test_a_slanting_line_lists_the_cells_beside_it(spark):
    """Every place within the radius lies in a listed cell, and a line of 14 km lists far fewer cells than its extent has."""
    rng = random.Random(5)
    lines = [(i, 40 + rng.uniform(-.1, .1), -90 + rng.uniform(-.1, .1), 40 + rng.uniform(-.1, .1), -90 + rng.uniform(-.1, .1)) for i in range(60)]
    lines += [(60, 40.0, -90.0, 40.0, -89.9), (61, 40.0, -90.0, 40.1, -90.0), (62, 40.0, -90.0, 40.0, -90.0), (63, 40.0, -90.0, 40.1, -89.9)]
    spots = []
    for i, a, b, c, d in lines:
        for _ in range(60):
            u, off, way = rng.random(), rng.uniform(0, 59.9), rng.uniform(0, 2 * math.pi)
            spots.append((i, a + u * (c - a) + off * math.cos(way) / 111_195, b + u * (d - b) + off * math.sin(way) / 111_195 / math.cos(math.radians(40.2))))
    width = 0.4 / S.KM_PER_DEG
    l = spark.createDataFrame(lines, "line long, a_lat double, a_lon double, b_lat double, b_lon double")
    cells = l.select("line", S.line_cells(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"), 0.06, width).alias("g"))
    at = spark.createDataFrame(spots, "line long, lat double, lon double").withColumn("c", S.cell(F.col("lat"), F.col("lon"), width))
    assert at.join(cells, "line").filter(~F.array_contains("g", F.col("c"))).count() == 0
    assert cells.filter(F.size("g") != F.size(F.array_distinct("g"))).count() == 0
    assert cells.filter("line = 63").select(F.size("g")).first()[0] < 120


def test_a_crowd_of_alike_sites_meets_a_path_once(spark, monkeypatch):
    """Sites at one spot are one snap and steps drawn alike one line; a path passes the others of a crowd, but not its own ends."""
    sites = [(str(i), 40.0, -90.0) for i in range(300)] + [("a", 40.0, -90.02), ("b", 40.0, -89.98), ("c", 41.0, -90.0), ("d", 41.0, -89.99), ("e", 41.0, -89.99)]
    table = spark.createDataFrame([(*s, False, [], True, 0.0) for s in sites], "site_id string, lat double, lon double, is_freeway boolean, refs array<string>, two_way boolean, seg_bearing double")
    ways = [("a", "b"), ("b", "a"), ("c", "d"), ("c", "e"), ("1", "2")]
    paths = spark.createDataFrame([(s, d, 3400.0 if s in "ab" else 850.0, 1.0, ["primary"], [f"site:{s}", f"site:{d}"]) for s, d in ways if s != "1"] + [("1", "2", 1.0, 1.0, ["primary"], ["site:1", "site:2"])],
                                  "src string, dst string, length_m double, tt_s double, classes array<string>, path array<string>")
    road = spark.createDataFrame([(f"site:{s}", f"site:{d}", "primary") for s, d in ways], "src string, dst string, highway string")
    met, plain = [], D.snap_candidates
    monkeypatch.setattr(D, "snap_candidates", lambda pts, lines, m: met.append((pts.count(), lines.count())) or plain(pts, lines, m))
    kept = D.adjacency(paths, table, table.select(F.concat(F.lit("site:"), "site_id").alias("node"), "lat", "lon"), table, road)
    assert sorted((r.src, r.dst) for r in kept.collect()) == []
    assert met == [(5, 4)]
    alone = table.filter("site_id not in ('e') and (length(site_id) > 3 or site_id in ('a', 'b', 'c', 'd', '1', '2'))")
    kept = D.adjacency(paths.filter("dst <> 'e'"), alone, table.select(F.concat(F.lit("site:"), "site_id").alias("node"), "lat", "lon"), alone, road)
    assert sorted((r.src, r.dst) for r in kept.collect()) == [("1", "2"), ("c", "d")]  # the crowd's two sites block a-b, not each other
