"""Sharding by histogram sort: exact byte counts below probes, then one exchange (operator 4)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

_LOW, _HIGH = -(1 << 63), 1 << 63
#: Probes of one counting job.
PROBES = 112


@dataclass
class Boundary:
    """A splitter still between `low` and `high` in the key column after the fixed `prefix`."""
    goal: float
    prefix: tuple[int, ...] = ()
    low: int = _LOW
    high: int = _HIGH
    below: tuple[int, int] = (0, 0)  # bytes and rows below (prefix, low)
    under: tuple[int, int] = (0, 0)  # the same for (prefix, high)
    found: tuple[int, ...] | None = None


def place(keys: Sequence[str], cuts: Sequence[tuple[int, ...]]) -> Column:
    """How many of the ascending cuts stand at or before the row's key. A cut may name only the first key columns."""
    if not cuts:
        return F.lit(0)
    whole = [(*c, *[_LOW] * (len(keys) - len(c))) for c in cuts]
    whole = [c if max(c) < _HIGH else _after(c) for c in whole]
    struct = lambda c: "struct(" + ", ".join(f"bigint('{v}')" for v in c) + ")"
    return F.expr(f"size(filter(array({', '.join(map(struct, whole))}), c -> c <= struct({', '.join(keys)})))")


def _after(cut: tuple[int, ...]) -> tuple[int, ...]:
    """The first key after all that begin like `cut` before its component out of range."""
    at = next(i for i, v in enumerate(cut) if v >= _HIGH)
    if at == 0:
        return (_HIGH - 1,) * len(cut)
    return _after((*cut[:at - 1], cut[at - 1] + 1, *[_LOW] * (len(cut) - at))) if cut[at - 1] + 1 >= _HIGH else (
        *cut[:at - 1], cut[at - 1] + 1, *[_LOW] * (len(cut) - at))


def splitters(df: DataFrame, keys: Sequence[str], size: str, n: int, tolerance: float) -> list[tuple[int, ...]]:
    """n - 1 keys that cut the rows, in key order, into n parts of nearly equal size.

    Every round counts exactly, in one job over all partitions, the bytes and rows
    below evenly spaced probes between the bounds of each open splitter. One closes
    when a probe is within `tolerance` of a part's size or only one row is left
    between its bounds. When one value of a key column holds more than that, the
    search goes on in the next column among rows of that value.
    """
    total, rows = df.agg(F.coalesce(F.sum(size), F.lit(0)), F.count(F.lit(1))).first()
    open_ = [Boundary(total * j / n, under=(total, rows)) for j in range(1, n)]
    all_, allowed = list(open_), tolerance * total / n
    while open_:
        probes = {}
        for b in open_:
            m = min(max(1, PROBES // len(open_)), b.high - b.low - 1)
            probes[id(b)] = sorted({b.low + (b.high - b.low) * i // (m + 1) for i in range(1, m + 1)} - {b.low, b.high})
        tuples = sorted({(*b.prefix, v, *[_LOW] * (len(keys) - len(b.prefix) - 1)) for b in open_ for v in probes[id(b)]})
        below, sums = (0, 0), dict.fromkeys(range(len(tuples) + 1), (0, 0))
        sums |= {r[0]: (r[1], r[2]) for r in df.groupBy(place(keys, tuples)).agg(F.sum(size), F.count(F.lit(1))).collect()}  # a row per probe
        counts = {}
        for i, t in enumerate(tuples):
            below = counts[t] = (below[0] + sums[i][0], below[1] + sums[i][1])
        for b in open_:
            for v in probes[id(b)]:
                here = counts[(*b.prefix, v, *[_LOW] * (len(keys) - len(b.prefix) - 1))]
                if here[0] <= b.goal:
                    b.low, b.below = v, here
                else:
                    b.high, b.under = v, here
                    break
            near_low = b.goal - b.below[0] <= b.under[0] - b.goal
            off = min(b.goal - b.below[0], b.under[0] - b.goal)
            last = len(b.prefix) + 1 == len(keys) and b.high == b.low + 1
            if off <= allowed or b.under[1] - b.below[1] <= 1 or last:
                b.found = (*b.prefix, b.low if near_low else b.high)
            elif b.high == b.low + 1:
                b.prefix, b.low, b.high = (*b.prefix, b.low), _LOW, _HIGH
        open_ = [b for b in open_ if b.found is None]
    return [b.found for b in all_]


def keyed(df: DataFrame) -> DataFrame:
    """Add the sort key: hash of the text, so equal texts are neighbours; doc_id; a row number for rows equal in both."""
    return df.withColumns({
        "_size": (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint"),
        "_hash": F.xxhash64("text"),
        "_id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LOW)),
        "_row": F.monotonically_increasing_id(),
    })


KEY = ("_hash", "_id", "_row")


def shard(df: DataFrame, n: int = 8, tolerance: float = 0.001, carry: Sequence[str] | None = None) -> DataFrame:
    """Place rows in n shards of nearly equal bytes: the columns of `df` (or those of `carry`), then size, shard and slot.

    Size is the text's UTF-8 bytes plus 1 (null: 1). Rows are ordered by the hash
    of their text, doc_id (null first) and, where both are equal, by their place in
    the input, so copies share a shard unless a boundary falls among them: a group
    of copies larger than the tolerance is cut wherever the bytes ask for it. The
    slot counts from 0 within a shard in that order. One range exchange on (shard,
    key) places the rows; slots come from row numbers of its partitions and the
    counts of (partition, shard), of which there are as many as partitions and
    shards, so no shard is gathered in one task. An empty table gives an empty one.
    Columns of `df` named size, shard or slot are replaced.
    """
    rows = keyed(df.drop("size", "shard", "slot"))
    names = [c for c in carry or df.columns if c not in ("size", "shard", "slot")]
    cuts = splitters(stage(rows.select(*KEY, "_size"), "keys"), KEY, "_size", n, tolerance)
    tasks = max(n, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sent = (rows.withColumn("shard", place(KEY, cuts).cast("int")).repartitionByRange(tasks, "shard", *KEY).sortWithinPartitions("shard", *KEY)
            .select(*names, F.col("_size").alias("size"), "shard", F.monotonically_increasing_id().alias("_at")))
    placed = stage(sent, "shards")
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part"), "shard").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    slot = F.col("_at") - F.col("_first") + F.col("_before")
    return (placed.withColumn("_part", part).join(F.broadcast(counts), ["_part", "shard"])
            .select(*names, "size", "shard", slot.alias("slot")))
