"""Streams over files that arrive out of order, across restarts, and with late rows, against the batch operators."""

import math
import random
import shutil
import tracemalloc

import pytest
from pyspark.sql import functions as F

from curbwatch.operators import city
from curbwatch.streaming import folds, ordered
from curbwatch.streaming import polls as P

T0 = 1_700_000_000.0
POLLS = "poll_id long, camera_id long, at double, diff double, result string"


class Feed:
    """A folder that files are put into one by one, and a stream over it."""

    def __init__(self, spark, folder, ddl):
        self.spark, self.folder, self.ddl, self.n = spark, folder, ddl, 0
        self.source, self.path, self.checkpoint = (str(folder / x) for x in ("in", "out", "checkpoint"))
        (folder / "in").mkdir()

    def put(self, rows):
        made = self.folder / f"made-{self.n}"
        self.spark.createDataFrame(rows, self.ddl).coalesce(1).write.parquet(str(made))
        shutil.copy(next(made.glob("part-*.parquet")), f"{self.source}/{self.n}.parquet")
        self.n += 1

    @property
    def stream(self):
        return self.spark.readStream.schema(self.ddl).option("maxFilesPerTrigger", 1).parquet(self.source)

    @property
    def table(self):
        return self.spark.read.schema(self.ddl).parquet(self.source)


@pytest.fixture
def feed(spark, tmp_path):
    return lambda ddl: Feed(spark, tmp_path, ddl)


def poll_files():
    """Three files, the middle of the time first, with ties in time."""
    rng = random.Random(9)
    rows = [(i, i % 4, T0 + (i // 2) * 400.0, rng.random() / 40, rng.choice(["fresh"] * 4 + ["unchanged", "not_modified", "unavailable"])) for i in range(360)]
    parts = [rows[120:240], rows[:120], rows[240:]]
    for p in parts:
        rng.shuffle(p)
    return parts


def in_order(rows):
    """What a camera's polls add up to when they are taken one by one in the order of time."""
    profile, recent, last = folds.empty_profile(), [], None
    for poll_id, _, at, diff, result in sorted(rows, key=lambda r: (r[2], r[0])):
        if result == "fresh":
            cell = int((at // 3600 + 4 * 24) % 168)
            seen = folds.learn_polls([at], [diff], [cell], profile)
            recent, last = (recent + [diff])[-24:], (at, cell, seen["cell_n"][-1], seen["ambiguous"][-1])
    middle = sorted(recent)
    return len(rows), (middle[(len(middle) - 1) // 2] + middle[len(middle) // 2]) / 2, last


@pytest.mark.parametrize("restart", [True, False])
def test_camera_states_over_files_out_of_order(feed, restart):
    feed = feed(POLLS)
    rows = []
    for part in poll_files():
        rows += part
        feed.put(part)
        if restart:
            P.run_once(P.camera_states(feed.stream, "2 days"), feed.path, feed.checkpoint)
    P.run_once(P.camera_states(feed.stream, "2 days"), feed.path, feed.checkpoint)
    states, late = P.read_states(feed.spark, feed.path)
    got = {r.camera_id: (r.polls, r.rolling, (r.last_at if "last_at" in r else r.at, r.cell, r.cell_n, r.ambiguous)) for r in states.collect()}
    for camera in range(4):
        polls, rolling, last = in_order([r for r in rows if r[1] == camera])
        assert got[camera][0] == polls and math.isclose(got[camera][1], rolling) and got[camera][2] == last
    assert late.count() == 0


def test_a_frame_two_hours_late(feed):
    """Counts and late rows add up to the input, the late frame is in no state and no pulse."""
    cameras = feed
    feed = feed(POLLS)
    rows = [(i, i % 3, T0 + i * 60.0, 0.01 + i / 10_000, "fresh") for i in range(200)]
    late = [(900, 1, T0 + 199 * 60.0 - 7200, 9.0, "fresh"), (901, 1, T0 + 199 * 60.0 - 7201, 9.0, "unavailable"), (902, 2, T0 + 199 * 60.0 - 7200, 9.0, "fresh")]
    for part in (rows[:100], rows[100:], [*late, (903, 0, T0 + 200 * 60.0, 0.5, "fresh")]):
        feed.put(part)
    P.run_once(P.camera_states(feed.stream), feed.path, feed.checkpoint)
    states, gone = P.read_states(feed.spark, feed.path)
    assert {r.camera_id: r.late for r in states.collect()} == {0: 0, 1: 2, 2: 1}
    assert {r.poll_id for r in gone.collect()} == {900, 901, 902}
    assert states.agg(F.sum("polls")).first()[0] + gone.count() == feed.table.count()

    cams = feed.spark.createDataFrame([(i, 1) for i in range(3)], "camera_id long, region_id int")
    P.run_pulse(P.pulse_updates(feed.stream), cams, feed.path + "-pulse", feed.checkpoint + "-pulse")
    got = sorted(map(tuple, P.read_pulse(feed.spark, feed.path + "-pulse").collect()))
    in_time = feed.table.filter("poll_id not in (900, 901, 902)")
    assert got == sorted(map(tuple, city.pulse(in_time, cams).collect())) and len(got) > 100
    side = feed.spark.read.parquet(feed.path + "-pulse/late")
    assert {(r.camera_id, r.poll_id, r.late_n) for r in side.collect()} == {(1, 900, 1), (2, 902, 1)}


def test_pulse_of_cameras_in_two_files(feed):
    """Cameras of one minute that arrive in two files are one median, and it equals the batch."""
    feed = feed(POLLS)
    for rows in [(0, 0, T0, 0.01), (1, 1, T0 + 1, 0.02)], [(2, 2, T0 + 2, 0.03), (3, 3, T0 + 3, 0.04), (4, 0, T0 + 70, 0.05)]:
        feed.put([(*r, "fresh") for r in rows])
    cams = feed.spark.createDataFrame([(i, 1) for i in range(4)], "camera_id long, region_id int")
    P.run_pulse(P.pulse_updates(feed.stream), cams, feed.path, feed.checkpoint)
    got = sorted(map(tuple, P.read_pulse(feed.spark, feed.path).collect()))
    assert got == sorted(map(tuple, city.pulse(feed.table, cams).collect())) and got[0][2:] == (0.025, 4)


def test_diary_over_files_out_of_order(feed):
    feed = feed("kind string, camera_id long, at double, entry_id long")
    rng = random.Random(4)
    rows = [(rng.choice(["movement", "incident"]), i % 3, T0 + rng.randrange(40) * 450.0, i) for i in range(240)]
    rows.sort(key=lambda r: r[2])
    for part in (rows[80:160], rows[:80], rows[160:]):
        feed.put(rng.sample(part, len(part)))
        P.run_once(P.diary_entries(feed.stream), feed.path, feed.checkpoint)
    got, late = ordered.decisions(feed.spark, feed.path, ["kind", "camera_id"], ordered.Spacing.out)
    assert sorted(r.entry_id for r in got.filter("kept").collect()) == sorted(r.entry_id for r in folds.spaced_entries(feed.table).collect())
    assert got.count() == 240 and late.count() == 0
    # Entries the watermark has passed are decided for good, and a late one changes nothing.
    feed.put([("movement", 0, T0 + 5 * 86400.0, 900)])
    P.run_once(P.diary_entries(feed.stream), feed.path, feed.checkpoint)
    feed.put([("movement", 0, T0 - 86400.0, 901)])
    P.run_once(P.diary_entries(feed.stream), feed.path, feed.checkpoint)
    after, late = ordered.decisions(feed.spark, feed.path, ["kind", "camera_id"], ordered.Spacing.out)
    assert [r.entry_id for r in late.collect()] == [901]
    assert after.filter("entry_id < 900").exceptAll(got).count() == 0 and after.count() == 241
    final = feed.spark.read.parquet(feed.path).filter("status = 'final'")
    assert final.filter("entry_id < 240").select("entry_id").distinct().count() == 240


def test_first_seen_over_files_out_of_order(feed):
    """A record that leaves the feed is forgotten and dated anew on return; one listed twice counts once."""
    feed = feed("incident_id long, fetch_no long, at double")
    rng = random.Random(2)
    rows = [(i, f, T0 + f * 100.0) for i in range(6) for f in range(30) if rng.random() < 0.6]
    rows += rows[::9]
    rows.sort(key=lambda r: r[1])
    third = len(rows) // 3
    for part in (rows[third:2 * third], rows[:third], rows[2 * third:]):
        feed.put(rng.sample(part, len(part)))
        P.run_once(P.first_seen(feed.stream, 100.0, "2500 seconds"), feed.path, feed.checkpoint)
    got, late = ordered.decisions(feed.spark, feed.path, ["incident_id"], ordered.FirstSeen.out)
    snaps = feed.table.select("incident_id", F.col("fetch_no").alias("fetch")).distinct()
    want = city.first_seen(snaps, F.floor(F.col("fetch") / 28)).select("incident_id", "fetch", "seen_from")
    assert sorted(map(tuple, got.select("incident_id", "fetch_no", "seen_from").collect())) == sorted(map(tuple, want.collect()))
    assert late.count() == 0
    # Long absent, then back: its state was deleted when the fetch after its last one passed.
    feed.put([(0, 500, T0 + 50_000.0), (1, 501, T0 + 50_100.0)])
    P.run_once(P.first_seen(feed.stream, 100.0, "2500 seconds"), feed.path, feed.checkpoint)
    back = ordered.decisions(feed.spark, feed.path, ["incident_id"], ordered.FirstSeen.out)[0]
    assert {(r.incident_id, r.seen_from) for r in back.filter("fetch_no >= 500").collect()} == {(0, 500), (1, 501)}
    state = feed.spark.read.format("statestore").option("stateVarName", "record").load(feed.checkpoint)
    assert {r.key.incident_id for r in state.collect()} <= {0, 1}


def test_triggers_hold_for_their_time(feed):
    feed = feed(POLLS)
    hot = (F.col("result") == "fresh") & (F.col("diff") > 0.02)
    files = [[(0, 0, T0, 0.05, "fresh"), (1, 1, T0 + 100, 0.05, "fresh"), (2, 2, T0 + 200, 0.01, "fresh")],
             [(3, 0, T0 - 50, 0.09, "fresh"), (4, 1, T0 + 350, 0.05, "unchanged")],
             [(5, 1, T0 + 390, 0.03, "fresh"), (6, 3, T0 + 399, 0.001, "fresh")]]
    wanted = [{(0, 0), (1, 1)}, {(1, 1)}, {(1, 5)}]
    for part, want in zip(files, wanted):
        feed.put(part)
        P.run_once(P.trigger_holds(feed.stream, hot), feed.path, feed.checkpoint)
        now = feed.table.agg(F.max("at")).first()[0]
        batch = feed.table.filter(hot & (F.lit(now) - F.col("at") < 300.0)).groupBy("camera_id").agg(F.max_by("poll_id", "at").alias("poll_id"))
        got = {(r.camera_id, r.poll_id) for r in P.read_holds(feed.spark, feed.path).collect()}
        assert got == want == {tuple(r) for r in batch.collect()}


def test_waves_are_bounded_in_time_and_rows():
    slots = [(0, 5), (1, 5), (2, 5), (9, 1), (10, 1), (11, 30), (12, 1)]
    assert folds.waves_of(slots, 5 * 3600.0, 10) == [(0, 1, 0), (2, 2, 1), (9, 10, 2), (11, 11, 3), (12, 12, 4)]
    assert folds.waves_of(slots, 1e9, 1000) == [(0, 12, 0)] and folds.waves_of([], 1.0, 1) == []


def test_a_fold_that_was_ended_goes_on(spark, tmp_path):
    """A run that fails while its input is written starts over, one that lost a wave does that wave again and keeps the others; waves of any size give the same rows."""
    rng = random.Random(12)
    rows = [(i, i % 3, T0 + i * 900.0, rng.random() / 40) for i in range(400)]
    polls = spark.createDataFrame(rows, "poll_id long, camera_id long, at double, diff double")
    bad = polls.withColumn("diff", F.when(F.col("poll_id") == 250, F.raise_error(F.lit("lost"))).otherwise(F.col("diff")))
    want = sorted(map(str, folds.learned_baseline(polls).collect()))
    with pytest.raises(Exception):
        folds.learned_baseline(bad, rows=100, folder=str(tmp_path / "a")).collect()
    assert sorted(map(str, folds.learned_baseline(polls, rows=100, folder=str(tmp_path / "a")).collect())) == want
    first = (tmp_path / "a" / "done" / "wave=0" / "_SUCCESS").stat().st_mtime_ns
    shutil.rmtree(tmp_path / "a" / "done" / "wave=2")
    assert sorted(map(str, folds.learned_baseline(polls, rows=100, folder=str(tmp_path / "a")).collect())) == want
    assert (tmp_path / "a" / "done" / "wave=0" / "_SUCCESS").stat().st_mtime_ns == first
    assert len(list((tmp_path / "a" / "done").glob("wave=*"))) > 3
    assert sorted(map(str, folds.learned_baseline(polls, seconds=20 * 3600.0).collect())) == want
    assert folds.learned_baseline(polls.limit(0)).count() == 0


class Held:
    """State of one key, in memory."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def put(self, value):
        self.value = value

    update = put

    def clear(self):
        self.value = None


def test_many_entries_of_one_diary_wait_packed():
    """Two hundred thousand entries of one kind and camera take a few dozen bytes each while they wait, and are decided as one by one."""
    class Handle:
        timers = []
        getListState = getValueState = lambda self, *names: Held()
        registerTimer = lambda self, ms: self.timers.append(ms)

    class Mark:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    n, spacing = 200_000, ordered.Spacing(1800.0)
    spacing.init(Handle())
    rows = ({"at": T0 + (i * 7919 % n) * 60.0, "entry_id": i} for i in range(n))
    tracemalloc.start()
    kept = sum(r.kept for r in spacing.handleInputRows(("movement", 1), rows, Mark(0)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert kept == math.ceil(n / 30) and peak < 20e6 and len(spacing.held.value) < n / 1000
    half = int((T0 + n // 2 * 60.0) * 1000)
    final = list(spacing.handleExpiredTimer(("movement", 1), Mark(half), None))
    assert len(final) == n // 2 + 1 and len(spacing.waiting()[0]) == n // 2 - 1 and Handle.timers == [int(T0 * 1000), half + 60_000]


def test_a_frame_of_the_pulse_is_written_once(feed):
    """A frame counts in up to six minutes, but is only spread over them when the pulse is read."""
    feed = feed(POLLS)
    rows = [(i, i % 2, T0 + i * 300.0, 0.01, "fresh") for i in range(40)]
    feed.put(rows)
    cams = feed.spark.createDataFrame([(i, 1) for i in range(2)], "camera_id long, region_id int")
    P.run_pulse(P.pulse_updates(feed.stream), cams, feed.path, feed.checkpoint)
    assert feed.spark.read.parquet(feed.path + "/newest").count() == 40
    assert sorted(map(tuple, P.read_pulse(feed.spark, feed.path).collect())) == sorted(map(tuple, city.pulse(feed.table, cams).collect()))
