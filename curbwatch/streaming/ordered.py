"""Stateful processors that take a key's rows in event-time order.

Files arrive in any order, so a row waits in its key's state until the watermark
has passed it; an event timer then folds what waited, by time and id. What is
still waiting is folded on a copy whenever the key gets rows, so readers always
see a result over every row in time. A row the watermark has passed already is
late: it changes no state, is counted with its key and goes out as a row of its
own, so rows in time and late rows add up to the input.

Spark drops late rows before a processor sees them if they carry the watermark's
column. `in_event_time` therefore leaves that column out: the watermark still
moves and drives the timers, and the processor decides what is late.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import CITY, CORRIDOR, SCORE
from .folds import empty_profile, learn_polls

#: Entries of one packed piece of state.
PACK = 4096
PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def in_event_time(df: DataFrame, delay: str, where: Column | None = None) -> DataFrame:
    """`df` under a watermark on its seconds `at` (after 1970), without the watermark's column. Rows that are not `where` move the watermark and go no further."""
    timed = df.withColumn("_time", F.timestamp_micros((F.col("at") * 1e6).cast("bigint"))).withWatermark("_time", delay)
    if where is not None:  # naming the watermark's column keeps the filter above the watermark
        timed = timed.filter(F.when(F.col("_time").isNotNull(), where))
    return timed.drop("_time")


def _named(ddl: str) -> Row:
    """Makes rows of the columns of a DDL string."""
    return Row(*[c.split()[0] for c in ddl.split(", ")])


def _ms(at: float) -> int:
    """The first whole millisecond that is not before `at`."""
    return math.ceil(at * 1000)


class Ordered(StatefulProcessor):
    """Base: `fields` names the columns a row waits with, time first and id second."""

    fields: list[str]
    held_ddl: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.held_ddl)
        self.open()

    def open(self) -> None:
        """Open the key's own state."""

    def waiting(self) -> list[tuple]:
        return [tuple(r) for r in self.held.get()] if self.held.exists() else []

    def wait(self, rows: list[tuple]) -> None:
        if rows:
            self.held.put(rows)
        else:
            self.held.clear()

    def late(self, key: tuple, rows: list[tuple]) -> Iterator[Row]:
        """Rows for what came too late."""
        yield from ()

    def seen(self, key: tuple, rows: list[tuple]) -> Iterator[Row]:
        """Rows after a batch of `key`, given all that waits, in order. Changes no state."""
        yield from ()

    def take(self, key: tuple, rows: list[tuple]) -> Iterator[Row]:
        """Fold rows that will not change any more into the key's state."""
        yield from ()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        new, late = [], []
        for r in rows:
            (late if _ms(r[self.fields[0]]) <= mark else new).append(tuple(r[f] for f in self.fields))
        if late:
            yield from self.late(key, late)
        held = self.waiting()
        if new:
            if not held or min(new)[0] < held[0][0]:
                self.handle.registerTimer(_ms(min(new)[0]))
            held = sorted(held + new, key=lambda r: r[:2])
            self.wait(held)
        yield from self.seen(key, held)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        held = self.waiting()
        ready = [r for r in held if _ms(r[0]) <= mark]
        if not ready:
            return
        rest = held[len(ready):]
        self.wait(rest)
        if rest:
            self.handle.registerTimer(_ms(rest[0][0]))
        yield from self.take(key, ready)

    def close(self) -> None:
        pass


class CameraState(Ordered):
    """Outcome counts, recent history and the learned cell of a camera."""

    fields = ["at", "poll_id", "diff", "result", "cell"]
    held_ddl = "at double, poll_id bigint, diff double, result string, cell int"
    out = ("kind string, camera_id bigint, poll_id bigint, at double, polls bigint, late bigint, frames bigint, unchanged bigint, unavailable bigint, samples int, "
           "rolling double, cell int, cell_n bigint, cell_mean double, ambiguous boolean")

    def open(self) -> None:
        self.state = self.handle.getValueState("camera", (
            "last double, polls bigint, frames bigint, unchanged bigint, unavailable bigint, recent array<double>, n array<bigint>, mean array<double>, "
            "m2 array<double>, since double, cell int, cell_n bigint, cell_mean double, ambiguous boolean"))
        self.late_n = self.handle.getValueState("late", "n bigint")

    def _load(self) -> dict:
        profile = empty_profile()
        if not self.state.exists():
            return {"last": None, "polls": 0, "frames": 0, "unchanged": 0, "unavailable": 0, "recent": [], "profile": profile, "cell": None, "cell_n": 0, "cell_mean": 0.0, "ambiguous": False}
        last, polls, frames, same, gone, recent, n, mean, m2, since, cell, cell_n, cell_mean, flag = self.state.get()
        profile = {"n": np.array(n, np.int64), "mean": np.array(mean, float), "m2": np.array(m2, float), "since": np.nan if since is None else since}
        return {"last": last, "polls": polls, "frames": frames, "unchanged": same, "unavailable": gone, "recent": list(recent), "profile": profile,
                "cell": cell, "cell_n": cell_n, "cell_mean": cell_mean, "ambiguous": flag}

    @staticmethod
    def _fold(s: dict, rows: list[tuple]) -> dict:
        fresh = [r for r in rows if r[3] == "fresh" and r[2] is not None]
        s["polls"] += len(rows)
        s["frames"] += sum(r[3] == "fresh" for r in rows)
        s["unchanged"] += sum(r[3] in ("unchanged", "not_modified") for r in rows)
        s["unavailable"] += sum(r[3] == "unavailable" for r in rows)
        if fresh:
            s["recent"] = (s["recent"] + [r[2] for r in fresh])[-SCORE.history:]
            seen = learn_polls(*(np.array([r[i] for r in fresh]) for i in (0, 2, 4)), s["profile"])
            s.update(last=fresh[-1][0], cell=fresh[-1][4], cell_n=seen["cell_n"][-1], cell_mean=seen["cell_mean"][-1], ambiguous=seen["ambiguous"][-1])
        return s

    def late(self, key: tuple, rows: list[tuple]) -> Iterator[Row]:
        self.late_n.update(((self.late_n.get()[0] if self.late_n.exists() else 0) + len(rows),))
        row = _named(self.out)
        for r in rows:
            yield row("late", key[0], r[1], r[0], *[None] * 11)

    def seen(self, key: tuple, rows: list[tuple]) -> Iterator[Row]:
        s = self._fold(self._load(), rows)
        late = self.late_n.get()[0] if self.late_n.exists() else 0
        rolling = float(np.median(s["recent"])) if len(s["recent"]) >= SCORE.min_samples else None
        yield _named(self.out)("state", key[0], None, s["last"], s["polls"], late, s["frames"], s["unchanged"], s["unavailable"], len(s["recent"]), rolling, s["cell"], s["cell_n"], s["cell_mean"], s["ambiguous"])

    def take(self, key: tuple, rows: list[tuple]) -> Iterator[Row]:
        s = self._fold(self._load(), rows)
        p = s["profile"]
        since = None if np.isnan(p["since"]) else float(p["since"])
        self.state.update((s["last"], s["polls"], s["frames"], s["unchanged"], s["unavailable"], [float(x) for x in s["recent"]], p["n"].tolist(), p["mean"].tolist(), p["m2"].tolist(),
                           since, s["cell"], s["cell_n"], s["cell_mean"], s["ambiguous"]))
        yield from ()


class Decided(Ordered):
    """A fold that decides on every row: `status` is final, held (may still change) or late. `key_out` is the DDL of the key."""

    def initial(self):
        raise NotImplementedError

    def decide(self, held, row: tuple) -> tuple[object, tuple]:
        """What is held after a row, and the decision's columns."""
        raise NotImplementedError

    def load(self):
        return self.state.get() if self.state.exists() else self.initial()

    def _decided(self, key: tuple, rows: list[tuple], status: str, keep: bool) -> Iterator[Row]:
        held, row = self.load(), _named(self.out)
        for r in rows:
            held, decision = self.decide(held, r)
            yield row(status, *key, r[0], r[1], *decision)
        if keep:
            self.state.update(held)

    def late(self, key: tuple, rows: list[tuple]) -> Iterator[Row]:
        row = _named(self.out)
        for r in rows:
            yield row("late", *key, r[0], r[1], *[None] * self.decisions)

    def seen(self, key: tuple, rows: list[tuple]) -> Iterator[Row]:
        yield from self._decided(key, rows, "held", False)

    def take(self, key: tuple, rows: list[tuple]) -> Iterator[Row]:
        yield from self._decided(key, rows, "final", True)


class Spacing(Decided):
    """Diary entries of one kind and camera, at least `repeat_s` after the last one kept (T5)."""

    fields, held_ddl, decisions = ["at", "entry_id"], "at binary, entry_id binary", 1
    out = "status string, kind string, camera_id bigint, at double, entry_id bigint, kept boolean"

    def __init__(self, repeat_s: float = CITY.diary_repeat_s):
        self.repeat_s = repeat_s

    def open(self) -> None:
        self.state = self.handle.getValueState("last", "last double")

    def initial(self):
        return (-math.inf,)

    def decide(self, held, row):
        kept = row[0] - held[0] >= self.repeat_s
        return ((row[0],) if kept else held), (kept,)

    # There are few kinds and cameras with many entries each, so what waits is kept packed, sixteen bytes an entry.
    def waiting(self) -> tuple[np.ndarray, np.ndarray]:
        packs = [(np.frombuffer(a), np.frombuffer(i, np.int64)) for a, i in self.held.get()] if self.held.exists() else []
        return (np.concatenate([a for a, _ in packs]), np.concatenate([i for _, i in packs])) if packs else (np.empty(0), np.empty(0, np.int64))

    def wait(self, rows: tuple[np.ndarray, np.ndarray]) -> None:
        at, ids = rows
        if len(at):
            self.held.put([(at[k:k + PACK].tobytes(), ids[k:k + PACK].tobytes()) for k in range(0, len(at), PACK)])
        else:
            self.held.clear()

    @staticmethod
    def _each(at: np.ndarray, ids: np.ndarray) -> Iterator[tuple]:
        for k in range(0, len(at), PACK):
            yield from zip(at[k:k + PACK].tolist(), ids[k:k + PACK].tolist())

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        new_at, new_ids = array("d"), array("q")
        for r in rows:
            at, entry = r["at"], r["entry_id"]
            if _ms(at) <= mark:
                yield from self.late(key, [(at, entry)])
            else:
                new_at.append(at)
                new_ids.append(entry)
        at, ids = self.waiting()
        if new_at:
            first = min(new_at)
            if not len(at) or first < at[0]:
                self.handle.registerTimer(_ms(first))
            at, ids = np.concatenate([at, np.frombuffer(new_at)]), np.concatenate([ids, np.frombuffer(new_ids, np.int64)])
            order = np.lexsort((ids, at))
            at, ids = at[order], ids[order]
            self.wait((at, ids))
        yield from self.seen(key, self._each(at, ids))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at, ids = self.waiting()
        n = int(np.searchsorted(np.ceil(at * 1000), timerValues.getCurrentWatermarkInMs(), side="right"))
        if n == 0:
            return
        self.wait((at[n:], ids[n:]))
        if n < len(at):
            self.handle.registerTimer(_ms(float(at[n])))
        yield from self.take(key, self._each(at[:n], ids[:n]))


class FirstSeen(Decided):
    """The fetch an undated record is dated by: the first after one it was absent from.

    Fetches wait in a map by number, so a record that is listed twice in one fetch
    counts once. A record that the fetch after its last one does not hold has left
    the feed: a timer at that fetch's time deletes its state.
    """

    fields, held_ddl, decisions = ["at", "fetch_no"], "at double, fetch_no bigint", 1
    out = "status string, incident_id bigint, at double, fetch_no bigint, seen_from bigint"

    def __init__(self, period_s: float):
        self.period_s = period_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fetches = handle.getMapState("fetches", "fetch_no bigint", "at double")
        self.state = handle.getValueState("record", "fetch_no bigint, at double, seen_from bigint")

    def waiting(self) -> list[tuple]:
        return sorted((v[0], k[0]) for k, v in self.fetches.iterator()) if self.fetches.exists() else []

    def wait(self, rows: list[tuple]) -> None:
        self.fetches.clear()
        for at, fetch in dict.fromkeys(rows):
            self.fetches.updateValue((fetch,), (at,))

    def seen(self, key: tuple, rows: list[tuple]) -> Iterator[Row]:
        yield from super().seen(key, list(dict.fromkeys(rows)))

    def initial(self):
        return (None, None, None)

    def decide(self, held, row):
        at, fetch = row
        seen = held[2] if held[0] is not None and fetch - held[0] <= 1 else fetch
        return (fetch, at, seen), (seen,)

    def take(self, key: tuple, rows: list[tuple]) -> Iterator[Row]:
        yield from super().take(key, rows)
        self.handle.registerTimer(_ms(rows[-1][0] + self.period_s))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)
        if self.state.exists() and _ms(self.state.get()[1] + self.period_s) <= timerValues.getCurrentWatermarkInMs():
            self.state.clear()


class TriggerHold(StatefulProcessor):
    """The newest trigger of a camera, dropped once the watermark, `hold_s` behind the newest poll, reaches it.

    Order of arrival does not matter: an older trigger never replaces a newer one,
    and one that the watermark has passed holds no more.
    """

    out = "camera_id bigint, at double, poll_id bigint, held boolean"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "at double, poll_id bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        best = max(((r["at"], r["poll_id"]) for r in rows if _ms(r["at"]) > mark), default=None)
        now = tuple(self.newest.get()) if self.newest.exists() else None
        if best is None or (now is not None and now >= best):
            return
        self.newest.update(best)
        self.handle.registerTimer(_ms(best[0]))
        yield _named(self.out)(key[0], *best, True)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.newest.exists() and _ms(self.newest.get()[0]) <= timerValues.getCurrentWatermarkInMs():
            gone = tuple(self.newest.get())
            self.newest.clear()
            yield _named(self.out)(key[0], *gone, False)

    def close(self) -> None:
        pass


class Lateness(StatefulProcessor):
    """Every poll of a camera with whether the watermark had passed it, and how many of the camera's were late so far."""

    out = "camera_id bigint, at double, poll_id bigint, diff double, late boolean, late_n bigint"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.late_n = handle.getValueState("late", "n bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        row = _named(self.out)
        before = n = self.late_n.get()[0] if self.late_n.exists() else 0
        for r in rows:
            late = _ms(r["at"]) <= mark
            n += late
            yield row(key[0], r["at"], r["poll_id"], r["diff"], late, n if late else None)
        if n != before:
            self.late_n.update((n,))

    def close(self) -> None:
        pass


def process(df: DataFrame, keys: list[str], processor, columns: list[str | Column], delay: str, where: Column | None = None) -> DataFrame:
    """Run a processor over a stream keyed by `keys`, under a watermark `delay` behind the newest row of all keys."""
    timed = in_event_time(df, delay, where).select(*keys, *columns)
    return timed.groupBy(*keys).transformWithState(processor, processor.out, "Append", "EventTime")


def decisions(spark, path: str, keys: list[str], ddl: str) -> tuple[DataFrame, DataFrame]:
    """Of a Decided processor's output: one decision a row id (final, else the newest held one), and the late rows."""
    rows = spark.read.schema(ddl + ", epoch bigint").parquet(path)
    id_ = ddl.split(", ")[len(keys) + 2].split()[0]
    in_time = rows.filter("status <> 'late'")
    rest = [c for c in in_time.columns if c not in (*keys, id_, "status", "epoch")]
    newest = in_time.groupBy(*keys, id_).agg(F.max(F.struct((F.col("status") == "final").alias("_final"), "epoch", *rest)).alias("_d"))
    return newest.select(*keys, id_, *[F.col(f"_d.{c}").alias(c) for c in rest]), rows.filter("status = 'late'").select(*keys, id_, "at")
