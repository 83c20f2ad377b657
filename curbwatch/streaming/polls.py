"""Streaming jobs over the poll log.

Files may arrive out of time order. Polls are folded in the order of their time
(`ordered.py`); one that comes later than LATE behind the newest poll is counted
and written to a late table instead, so frames in time and late ones add up to the
input. A camera's state is kept for good, as large as one profile. Sinks overwrite
the folder of their epoch, so a replayed epoch is not there twice.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CITY, CORRIDOR
from ..functions.geo import hour_of_week_at
from ..functions.numeric import with_fixed
from ..operators.city import newest_per_minute
from ..operators.scale import group_median
from . import ordered

#: How far behind the newest poll a poll may come and still count.
LATE = "10 minutes"


def camera_states(polls: DataFrame, late: str = LATE) -> DataFrame:
    """Per-camera state after every micro-batch, and the polls that came late.

    `polls` is a stream of (poll_id, camera_id, ts, at, diff, result). Rows of kind
    `state` hold outcome counts, recent history and the learned cell over all polls
    in time so far; rows of kind `late` are one late poll each.
    """
    cell = hour_of_week_at(F.col("at")).alias("cell")
    return ordered.process(polls, ["camera_id"], ordered.CameraState(), ["poll_id", "at", "diff", "result", cell], late)


def read_states(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The newest state of each camera, and the late polls, from all epochs written so far."""
    rows = spark.read.schema(ordered.CameraState.out + ", epoch bigint").parquet(path)
    columns = [c for c in rows.columns if c not in ("kind", "camera_id", "poll_id", "epoch")]
    newest = rows.filter("kind = 'state'").groupBy("camera_id").agg(F.max(F.struct("epoch", *columns)).alias("s"))
    return newest.select("camera_id", *[F.col(f"s.{c}").alias(c) for c in columns]), rows.filter("kind = 'late'").select("camera_id", "poll_id", "at")


def pulse_updates(polls: DataFrame, late: str = LATE) -> DataFrame:
    """Fresh frames of the stream, each with whether it came late (T4); `run_pulse` sums them up."""
    frames = polls.filter((F.col("result") == "fresh") & F.col("diff").isNotNull())
    return ordered.process(frames, ["camera_id"], ordered.Lateness(), ["at", "poll_id", "diff"], late)


def run_pulse(stream: DataFrame, cameras: DataFrame, path: str, checkpoint: str) -> None:
    """Drain `pulse_updates` into `path`/newest, the newest frame of each camera and minute of arrival of each epoch, and `path`/late.

    Frames are spread over the minutes they count in when they are read, so a frame is written once.
    """
    def sink(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        arrived = batch.filter("not late").groupBy("camera_id", F.ceil(F.col("at") / 60.0).alias("minute")).agg(F.max(F.struct("at", "poll_id", "diff")).alias("newest"))
        arrived.join(cameras.select("camera_id", "region_id"), "camera_id").select("camera_id", "region_id", "newest.*").write.mode("overwrite").parquet(f"{path}/newest/epoch={epoch}")
        batch.filter("late").select("camera_id", "poll_id", "at", "late_n").write.mode("overwrite").parquet(f"{path}/late/epoch={epoch}")
        batch.unpersist()

    _drain(stream, sink, checkpoint)


def first_seen(fetches: DataFrame, period_s: float, late: str = "1 day") -> DataFrame:
    """Which fetch dates each undated record, decided as fetches come (T3). `fetches`: a stream of (incident_id, fetch_no, at)."""
    return ordered.process(fetches, ["incident_id"], ordered.FirstSeen(period_s), ["at", "fetch_no"], late)


def diary_entries(entries: DataFrame, repeat_s: float = CITY.diary_repeat_s, late: str = "1 day") -> DataFrame:
    """Whether each diary entry is kept, decided as entries come (T5). `entries`: a stream of (kind, camera_id, at, entry_id)."""
    return ordered.process(entries, ["kind", "camera_id"], ordered.Spacing(repeat_s), ["at", "entry_id"], late)


def trigger_holds(polls: DataFrame, trigger: Column, hold_s: float = CORRIDOR.promote_hold_s) -> DataFrame:
    """Triggers that begin and end to hold (T6): polls that are `trigger`, for `hold_s` of the time of all polls."""
    return ordered.process(polls, ["camera_id"], ordered.TriggerHold(), ["at", "poll_id"], f"{hold_s} seconds", trigger)


def read_holds(spark: SparkSession, path: str) -> DataFrame:
    """Triggers that hold after all epochs so far: the newest row of each camera, unless it ends the hold."""
    rows = spark.read.schema(ordered.TriggerHold.out + ", epoch bigint").parquet(path)
    last = rows.groupBy("camera_id").agg(F.max(F.struct("epoch", F.col("held"), "at", "poll_id")).alias("s"))
    return last.filter("s.held").select("camera_id", "s.at", "s.poll_id")


def read_pulse(spark: SparkSession, path: str) -> DataFrame:
    """City medians from all updates written so far: the newest of each camera and minute over all epochs, then the median."""
    frames = spark.read.parquet(f"{path}/newest").select("camera_id", "at", "poll_id", "diff", "region_id")
    flat = newest_per_minute(frames, CITY.pulse_recent_s).select("region_id", (F.col("minute") * 60.0).alias("at"), "diff")
    med = group_median(flat, ["region_id", "at"], "diff", "median", 1e-3).filter(F.col("median_n") >= CITY.pulse_min_cameras)
    return with_fixed(med, 5, diff=F.col("median")).select("region_id", "at", "diff", F.col("median_n").alias("cameras"))


@contextmanager
def _state_store(spark: SparkSession):
    """Processors with timers need the RocksDB state store; the session's own setting comes back afterwards."""
    before = {k: spark.conf.get(k, None) for k in ordered.PROVIDER}
    for k, v in ordered.PROVIDER.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _drain(stream: DataFrame, sink, checkpoint: str) -> None:
    """Take what the source holds now, let the watermark's timers fire, and stop."""
    with _state_store(stream.sparkSession):
        stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Drain what the source holds now into parquet and stop; the checkpoint carries on from there the next time."""
    _drain(stream, lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}"), checkpoint)


def poll_stream(spark: SparkSession, folder: str, files: int = 8) -> DataFrame:
    """The event table as a file stream, at most `files` files a micro-batch."""
    from ..plans.fixtures import Fixtures
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    fx = Fixtures(spark, folder)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "events.parquet").parquet(folder)
    fx.table = lambda name: source  # type: ignore[method-assign]
    return fx.poll
