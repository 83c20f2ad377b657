"""The skew-safe helpers against plain windows, with one key holding most rows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from curbwatch.operators import scale as S
from curbwatch.operators.spatial import nearest_within


def skewed(spark, n=900):
    rng = random.Random(7)
    rows = [(i, 1 if rng.random() < 0.7 else rng.randint(2, 6), float(rng.randint(0, 4_000_000)), rng.choice([0.0, rng.random()])) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, key long, at double, v double").withColumn("chunk", S.time_chunk("at", 300_000.0))


def test_running_equals_one_window(spark):
    df = skewed(spark)
    w = Window.partitionBy("key").orderBy("at", "row_id")
    for inclusive, end in ((True, 0), (False, -1)):
        frame = w.rowsBetween(Window.unboundedPreceding, end)
        want = df.select("row_id", F.coalesce(F.sum("v").over(frame), F.lit(0.0)).alias("s"), F.max("v").over(frame).alias("m"))
        got = S.running(df, ["key"], "chunk", ["at", "row_id"], inclusive, s2=("sum", F.col("v")), m2=("max", F.col("v"))).select("row_id", "s2", "m2")
        bad = want.join(got, "row_id").filter((F.abs(F.col("s") - F.col("s2")) > 1e-9) | ~F.col("m").eqNullSafe(F.col("m2")))
        assert bad.count() == 0 and got.count() == df.count()


def test_halo_gives_the_same_moving_median(spark):
    df = skewed(spark)
    want = df.select("row_id", F.percentile("v", 0.5).over(Window.partitionBy("key").orderBy("at", "row_id").rowsBetween(-6, 0)).alias("m"))
    cut = S.with_halo(df, ["key"], "chunk", ["at", "row_id"], 6)
    got = cut.withColumn("m2", F.percentile("v", 0.5).over(Window.partitionBy("key", "chunk").orderBy("at", "row_id").rowsBetween(-6, 0))).filter("not _halo")
    assert want.join(got, "row_id").filter("abs(m - m2) > 1e-12").count() == 0


def test_group_median_is_exact(spark):
    df = skewed(spark)
    want = df.groupBy("key").agg(F.percentile("v", 0.5).alias("m"))
    got = S.group_median(df, ["key"], "v", "m2", 0.05)
    assert want.join(got, "key").filter("abs(m - m2) > 1e-12").count() == 0 and got.count() == want.count()


def test_chunk_rank_equals_row_number(spark):
    df = skewed(spark)
    want = df.select("row_id", F.row_number().over(Window.partitionBy("key").orderBy(F.col("v").desc(), "row_id")).alias("r"))
    got = S.chunk_rank(df.drop("chunk"), ["key"], [("_v", F.floor(F.col("v") * 10), True)], [F.col("v").desc(), F.col("row_id")], "r2")
    assert want.join(got, "row_id").filter("r != r2").count() == 0


def test_nearest_in_a_crowded_cell(spark):
    rng = random.Random(3)
    # Most targets stand within a few hundred metres, many at one spot.
    spots = [(i, 40.0 + (0.0 if rng.random() < 0.4 else rng.gauss(0, 0.004)), -90.0 + (0.0 if rng.random() < 0.4 else rng.gauss(0, 0.004))) for i in range(600)]
    points = [(i, 40.0 + rng.gauss(0, 0.01), -90.0 + rng.gauss(0, 0.01)) for i in range(40)]
    t = spark.createDataFrame(spots, "t long, lat double, lon double")
    p = spark.createDataFrame(points, "p long, lat double, lon double")
    from curbwatch.functions.geo import haversine_km
    pairs = p.alias("p").crossJoin(t.alias("t")).withColumn("km", haversine_km(F.col("p.lat"), F.col("p.lon"), F.col("t.lat"), F.col("t.lon"))).filter("km <= 1.5")
    want = pairs.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy(F.round("km", 9), "t"))).filter("r <= 6").select("p", "t", "r")
    got = nearest_within(p, "p", t, "t", 1.5, 6).select("p", "t", F.col("rank").alias("r"))
    assert want.exceptAll(got).count() == 0 and got.exceptAll(want).count() == 0


def test_points_at_one_position_are_asked_once(spark, monkeypatch):
    """A thousand points at each of three positions: targets are sought for three, and every point gets its own rows."""
    from curbwatch.operators import spatial
    p = spark.range(3000).select(F.col("id").alias("p"), (40.0 + F.col("id") % 3 * 0.001).alias("lat"), F.lit(-90.0).alias("lon"))
    t = spark.createDataFrame([(i, 40.0 + i * 0.0005, -90.0) for i in range(9)], "t long, lat double, lon double")
    ranked, plain = [], spatial.top_per
    monkeypatch.setattr(spatial, "top_per", lambda df, keys, *rest: (keys == ["p_id"] and ranked.append(df.select("p_id").distinct().count())) or plain(df, keys, *rest))
    got = nearest_within(p, "p", t, "t", 1.5, 2)
    want = {(0, 0, 1), (0, 1, 2), (1, 2, 1), (1, 1, 2), (2, 4, 1), (2, 3, 2)}
    assert {(r[0], r[1], r[2]) for r in got.select(F.col("p") % 3, "t", "rank").distinct().collect()} == want
    assert got.count() == 6000 and ranked == [3]
