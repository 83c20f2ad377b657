"""Order-dependent folds, run in bounded waves over time.

Whether a poll is learned depends on what was learned before it, so such a fold
cannot be a window. A wave holds one stretch of time of every key, bounded in time
and in rows; the state a wave leaves behind is a small table joined into the next. A
key's group in a task is therefore one stretch of its history, never all of it.

The input is read once and written by wave; a wave then reads its own part and
writes its rows and state to a folder of its own. Nothing is kept in memory between
waves, so a run that was ended goes on after its last whole wave.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CITY, SCORE
from ..functions.geo import hour_of_week_at
from ..operators.scale import finished, work_folder

WAVE_S = 7 * 86400.0
#: Time is counted in slots of an hour; a wave is so many rows at most, unless one slot has more.
SLOT_S, WAVE_ROWS = 3600.0, 20_000_000

Fold = Callable[[pd.DataFrame, "dict | None"], tuple[pd.DataFrame, dict]]


def waves_of(slots: Sequence[tuple[int, int]], seconds: float, rows: int) -> list[tuple[int, int, int]]:
    """(first slot, last slot, wave) of consecutive slots (number, rows) packed up to `seconds` and `rows`."""
    out: list[list[int]] = []
    held = 0
    for slot, n in slots:
        if out and held + n <= rows and (slot + 1 - out[-1][0]) * SLOT_S <= seconds:
            out[-1][1], held = slot, held + n
        else:
            out.append([slot, slot, len(out)])
            held = n
    return [tuple(w) for w in out]


def fold_in_waves(df: DataFrame, keys: Sequence[str], order: Sequence[str], fold: Fold, out: str, state: str,
                  seconds: float = WAVE_S, rows: int = WAVE_ROWS, folder: str | None = None) -> DataFrame:
    """Fold every key's rows in order.

    `fold(rows, held)` gets a key's sorted rows of one wave and what it held after
    the last, and returns output rows and what it holds now. `out` and `state` are
    DDL of the output and of the state without the keys. With the `folder` of a run
    that was ended before, its whole waves are kept and the rest is done.
    """
    spark = df.sparkSession
    key_ddl = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    out_type = T._parse_datatype_string(out)
    held_type = T._parse_datatype_string(f"{key_ddl}, {state}")
    names = [f.name for f in held_type.fields]
    schema = T.StructType([T.StructField("row", out_type), T.StructField("held", held_type)])
    keys, order = list(keys), list(order)
    columns = [f.name for f in out_type.fields]

    def step(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        held = right.iloc[0][names].to_dict() if len(right) else None
        if len(left) == 0:
            return pd.DataFrame({"row": [None], "held": [held]})
        got, now = fold(left.sort_values(order), held)
        now.update({k: left.iloc[0][k] for k in keys})
        records = got[columns].to_dict("records")
        return pd.DataFrame({"row": [*records, None], "held": [None] * len(records) + [now]})

    root = folder or work_folder(spark, "fold")
    if not finished(spark, f"{root}/input"):
        slot = F.floor(F.col("at") / SLOT_S).alias("_slot")
        slots = [tuple(r) for r in df.groupBy(slot).agg(F.count(F.lit(1))).orderBy("_slot").collect()]  # hours of the log, not rows
        waves = spark.createDataFrame([(s, w) for a, b, w in waves_of(slots, seconds, rows) for s, _ in slots if a <= s <= b], "_slot bigint, _wave int")
        work = df.withColumn("_slot", slot).join(F.broadcast(waves), "_slot").drop("_slot")
        work.write.mode("overwrite").partitionBy("_wave").parquet(f"{root}/input")
    whole = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_wave", T.IntegerType())])).parquet(f"{root}/input")
    held = spark.createDataFrame([], held_type)
    for (wave,) in whole.select("_wave").distinct().orderBy("_wave").collect():
        path = f"{root}/done/wave={wave}"
        if not finished(spark, path):
            part = whole.filter(F.col("_wave") == wave).drop("_wave")
            part.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(step, schema).write.mode("overwrite").parquet(path)
        held = spark.read.schema(schema).parquet(path).filter(F.col("held").isNotNull()).select("held.*")
    if not finished(spark, f"{root}/done/wave=0"):
        return spark.createDataFrame([], out_type)
    return spark.read.schema(schema).parquet(f"{root}/done/wave=*").filter(F.col("row").isNotNull()).select("row.*")


def learn_polls(at: np.ndarray, diff: np.ndarray, cell: np.ndarray, held: dict) -> dict[str, list]:
    """Fold polls into hour-of-week cells, leaving out events until they last.

    `held` carries arrays n, mean, m2 over 168 cells and `since`, and is updated.
    """
    # Plain numbers: one poll at a time, an array's element costs several times a list's.
    n, mean, m2, since = held["n"].tolist(), held["mean"].tolist(), held["m2"].tolist(), held["since"]
    at, diff, cell = (np.asarray(x).tolist() for x in (at, diff, cell))
    seen = {"cell_n": [], "cell_mean": [], "cell_m2": [], "ambiguous": [], "learned": []}
    for t, d, c in zip(at, diff, cell):
        known = n[c] >= SCORE.cell_samples
        still = bool(known and mean[c] > SCORE.active_diff and d <= SCORE.activity_floor)
        unusual = still or bool(known and d >= SCORE.learn_skip_ratio * mean[c])
        seen["cell_n"].append(n[c])
        seen["cell_mean"].append(mean[c])
        seen["cell_m2"].append(m2[c])
        seen["ambiguous"].append(still)
        if unusual:
            since = t if math.isnan(since) else since
        else:
            since = math.nan
        learned = not unusual or t - since >= SCORE.learn_resume_s
        seen["learned"].append(learned)
        if learned:
            n[c] += 1
            step = d - mean[c]
            mean[c] += step / n[c]
            m2[c] += step * (d - mean[c])
    held["n"][:], held["mean"][:], held["m2"][:], held["since"] = n, mean, m2, since
    return seen


def empty_profile() -> dict:
    return {"n": np.zeros(168, np.int64), "mean": np.zeros(168), "m2": np.zeros(168), "since": np.nan}


def _load(held: dict | None) -> dict:
    if held is None:
        return empty_profile()
    since = held["since"]
    return {"n": np.array(held["n"], np.int64), "mean": np.array(held["mean"], float), "m2": np.array(held["m2"], float),
            "since": np.nan if since is None else float(since)}


def learned_baseline(fresh: DataFrame, **waves) -> DataFrame:
    """Every poll's cell before it, by the learning rule that skips events."""

    def fold(rows: pd.DataFrame, held: dict | None) -> tuple[pd.DataFrame, dict]:
        profile = _load(held)
        seen = learn_polls(rows["at"].to_numpy(), rows["diff"].to_numpy(), rows["cell"].to_numpy(), profile)
        out = rows[["poll_id", "camera_id", "at", "cell", "diff"]].assign(**seen)
        since = None if np.isnan(profile["since"]) else float(profile["since"])
        return out, {"n": profile["n"].tolist(), "mean": profile["mean"].tolist(), "m2": profile["m2"].tolist(), "since": since}

    polls = fresh.filter(F.col("diff").isNotNull()).select("poll_id", "camera_id", "at", "diff", hour_of_week_at(F.col("at")).alias("cell"))
    return fold_in_waves(
        polls, ["camera_id"], ["at", "poll_id"], fold,
        "poll_id bigint, camera_id bigint, at double, cell int, diff double, cell_n bigint, cell_mean double, cell_m2 double, ambiguous boolean, learned boolean",
        "n array<bigint>, mean array<double>, m2 array<double>, since double", **waves)


def spaced_entries(entries: DataFrame, repeat_s: float = CITY.diary_repeat_s) -> DataFrame:
    """Drop an entry of one kind and camera within half an hour of the last one kept (T5)."""

    def fold(rows: pd.DataFrame, held: dict | None) -> tuple[pd.DataFrame, dict]:
        last = -np.inf if held is None or held["last"] is None else float(held["last"])
        keep = []
        for t in rows["at"].to_numpy():
            ok = t - last >= repeat_s
            keep.append(ok)
            last = t if ok else last
        return rows[keep], {"last": float(last)}

    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in entries.schema.fields)
    return fold_in_waves(entries, ["kind", "camera_id"], ["at", "entry_id"], fold, out, "last double")


def live_motion(pictures: DataFrame, window: int = 60, warmup: int = 10, epsilon: float = 0.1 / 255, duplicate: float = 0.01 / 255) -> DataFrame:
    """Change of each accepted picture and the median of the last sixty.

    A picture nearly identical to the last accepted one is dropped and never
    compared against. `pictures` is (camera_id, at, seq, thumb).
    """

    def fold(rows: pd.DataFrame, held: dict | None) -> tuple[pd.DataFrame, dict]:
        prev = None if held is None or held["prev"] is None else np.array(held["prev"])
        recent = [] if held is None or held["recent"] is None else list(held["recent"])
        kind, change, median, anomaly = [], [], [], []
        for thumb in rows["thumb"]:
            now = np.array(thumb)
            d = None if prev is None else float(np.abs(now - prev).mean())
            if d is not None and d < duplicate:
                kind.append("duplicate"), change.append(d), median.append(None), anomaly.append(None)
                continue
            prev = now
            if d is None:
                kind.append("first"), change.append(None), median.append(None), anomaly.append(None)
                continue
            recent = (recent + [d])[-window:]
            m = float(np.median(recent))
            warm = len(recent) < warmup
            kind.append("warming" if warm else "scored"), change.append(d), median.append(m)
            anomaly.append(None if warm else min(1.0, SCORE.anomaly_at_baseline * d / max(m, epsilon)))
        out = rows[["camera_id", "seq"]].assign(kind=kind, change=change, median=median, anomaly=anomaly)
        return out.astype(object).where(out.notna(), None), {"prev": None if prev is None else prev.tolist(), "recent": recent}

    return fold_in_waves(pictures, ["camera_id"], ["at", "seq"], fold,
                         "camera_id bigint, seq bigint, kind string, change double, median double, anomaly double",
                         "prev array<double>, recent array<double>")
