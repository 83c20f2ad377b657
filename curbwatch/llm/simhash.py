"""SimHash near-duplicates through segment popcounts (operator 5)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import pieces, stage
from .graph import components
from .words import LOWER, SOLID, spans

SHINGLE = 3
SEED = 42
DISTANCE = 3
#: Rows of one side of a comparison in a task.
BLOCK = 2048


def _fingerprint_piece(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive texts given as offsets into their bytes."""
    data = LOWER[data]
    start, end, text = spans(offsets, data, SOLID)
    n_texts = len(offsets) - 1
    # One space after each word: a run of words is then one slice.
    spaced = np.append(SOLID[data], False)
    spaced[end] = True
    at = np.cumsum(spaced) - spaced
    packed = np.append(data, np.uint8(32))
    packed[end[np.isin(end, offsets, invert=True)]] = 32
    flat = packed[spaced].tobytes()
    per_text = np.bincount(text, minlength=n_texts)
    first = np.cumsum(per_text) - per_text
    begin, stop = at[start], at[start] + (end - start)
    n = len(start)
    whole = np.flatnonzero((per_text > 0) & (per_text < SHINGLE))
    runs = np.flatnonzero(text[:max(0, n - SHINGLE + 1)] == text[SHINGLE - 1:]) if n >= SHINGLE else np.zeros(0, np.int64)
    from_ = np.concatenate([begin[runs], begin[first[whole]]])
    to = np.concatenate([stop[runs + SHINGLE - 1], stop[first[whole] + per_text[whole] - 1]])
    owner = np.concatenate([text[runs], whole])
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(flat[a:b], SEED) for a, b in zip(from_.tolist(), to.tolist())), np.uint64, len(from_))
    order = np.argsort(owner, kind="stable")
    h, owner = h[order], owner[order]
    out = np.zeros(n_texts, np.uint64)
    if not len(h):
        return out
    heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    counts = np.diff(np.append(heads, len(h)))
    value = np.zeros(len(heads), np.uint64)
    for bit in range(64):
        ones = np.add.reduceat(((h >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), heads)
        value |= (2 * ones > counts).astype(np.uint64) << np.uint64(bit)
    out[owner[heads]] = value
    return out


def fingerprint(column: pa.Array) -> pa.Array:
    out = np.zeros(len(column), np.uint64)
    for row, end, offsets, data in pieces(column):
        out[row:end] = _fingerprint_piece(offsets, data)
    return pa.array(out.view(np.int64))


fingerprints = F.arrow_udf(fingerprint, LongType())


def _links_of(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each linked fingerprint of two blocks with the lowest one it reaches inside them."""
    nodes, where = np.unique(np.concatenate([left, right]), return_inverse=True)
    i, j = np.nonzero(np.bitwise_count(left[:, None] ^ right[None, :]) <= DISTANCE)
    i, j = where[:len(left)][i], where[len(left):][j]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        after = label.copy()
        np.minimum.at(after, i, low)
        np.minimum.at(after, j, low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def compare_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, role, fp) in group order to links (a, b). Role 0: left, 1: right, 2: both.

    A group holds at most about BLOCK rows a side; only the last group of a batch,
    which may go on in the next, is carried.
    """
    carried: list[np.ndarray] = []

    def links(columns: list[np.ndarray]) -> pa.RecordBatch:
        half, cell, left, right, role, fp = columns
        change = np.zeros(len(fp), bool)
        for c in (half, cell, left, right):
            change[1:] |= c[1:] != c[:-1]
        heads = np.append(np.append(0, np.flatnonzero(change)), len(fp))
        a, b = [], []
        for s, e in zip(heads[:-1].tolist(), heads[1:].tolist()):
            if e - s < 2:
                continue
            f, r = fp[s:e], role[s:e]
            x, y = _links_of(f[r != 1], f[r != 0])
            a.append(x)
            b.append(y)
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(join(a).view(np.int64)), pa.array(join(b).view(np.int64))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        cols[-1] = cols[-1].view(np.uint64)
        if carried:
            cols = [np.concatenate(x) for x in zip(carried, cols)]
        same = np.ones(len(cols[0]), bool)
        for c in cols[:4]:
            same &= c == c[-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        carried = [c[cut:] for c in cols]
        if cut:
            yield links([c[:cut] for c in cols])
    if carried:
        yield links(carried)


def near_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column fp) at 3 or fewer differing bits.

    The 32 counts of set bits in two-bit segments embed a fingerprint in a grid;
    the Manhattan distance of two embeddings is a lower bound of their differing
    bits. Within 3, one half of the 16 counts each has distance 1 or less, so every
    fingerprint stands in the cell of either half and looks into the cells one step
    up; pairs are verified by exact bits inside tasks. Cells where nobody stands or
    nobody else looks are dropped by counts. A crowded cell is cut into blocks that
    meet pairwise, and only the links of a spanning forest leave a task.
    """
    counts = lambda half: half - F.shiftright(half, 1).bitwiseAND(F.lit(0x55555555))
    steps = F.array(*[F.lit(1 << (2 * i)).cast("bigint") for i in range(16)])
    both = distinct.select("fp", F.posexplode(F.array(counts(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))), counts(F.shiftrightunsigned("fp", 32)))).alias("half", "own"))
    ups = F.filter(steps, lambda s: F.col("own").bitwiseAND(s * 2) == 0)
    looks = both.select("fp", "half", F.explode(F.concat(F.array(F.struct(F.col("own").alias("cell"), F.lit(True).alias("home"))),
                                                        F.transform(ups, lambda s: F.struct((F.col("own") + s).alias("cell"), F.lit(False).alias("home"))))).alias("c"))
    looks = looks.select("half", "c.cell", "c.home", "fp")
    live = looks.groupBy("half", "cell").agg(F.sum(F.col("home").cast("bigint")).alias("_homes"), F.count(F.lit(1)).alias("_all"))
    live = stage(live.filter("_homes >= 1 and _all >= 2").select("half", "cell", F.ceil(F.col("_all") / BLOCK).cast("int").alias("_lefts"),
                                                                 F.ceil(F.col("_homes") / BLOCK).cast("int").alias("_rights")), "cells")
    met = looks.join(live, ["half", "cell"])
    block = lambda n: F.pmod(F.xxhash64("fp", F.lit(7)), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    single = (F.col("_lefts") == 1) & (F.col("_rights") == 1)
    place = lambda l, r, role: F.struct(l.alias("left"), r.alias("right"), F.lit(role).alias("role"))
    zero = F.lit(0)
    lefts = F.transform(upto("_rights"), lambda r: place(block("_lefts"), r, 0))
    rights = F.transform(upto("_lefts"), lambda l: place(l, block("_rights"), 1))
    places = (F.when(single & F.col("home"), F.array(place(zero, zero, 2))).when(F.col("home"), F.concat(lefts, rights)).otherwise(lefts))
    rows = met.select("half", "cell", F.explode(places).alias("p"), "fp").select("half", "cell", "p.left", "p.right", "p.role", "fp")
    keys = ["half", "cell", "left", "right"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare_groups, "a long, b long")


def near_groups(hashed: DataFrame) -> DataFrame:
    """(fp, component_id) for every fingerprint of `hashed` (doc_id, fp): the smallest doc_id reachable by links."""
    lows = hashed.groupBy("fp").agg(F.min("doc_id").alias("low"))
    lows = stage(lows, "fingerprints")
    label = components(near_links(lows.select("fp")))
    named = stage(lows.join(label, lows["fp"] == label["id"], "left").select("fp", "low", F.coalesce("label", "fp").alias("label")), "labels")
    least = named.groupBy("label").agg(F.min("low").alias("component_id"))
    return named.join(least, "label").select("fp", "component_id")


def simhash(df: DataFrame) -> DataFrame:
    """doc_id, fp (long) and component_id of every row of `df` (doc_id, text).

    Words are split at white space after lower-casing A-Z; shingles have three
    words, repeats count; a text of fewer words is one shingle; null and empty texts
    have fingerprint zero and link like any other. Rows that share a text share a
    fingerprint, so copies meet only as one. Null ids never name a component unless
    it has no other. An empty table gives an empty one.
    """
    hashed = stage(df.select("doc_id", fingerprints("text").alias("fp")), "hashed")
    groups = stage(near_groups(hashed), "groups")
    return hashed.join(groups, "fp").select("doc_id", "fp", "component_id")


def keep_one(df: DataFrame) -> DataFrame:
    """The rows of `df` without near-duplicates: of each group stays the row of the smallest doc_id.

    Among rows of that doc_id the first in the input stays (a null id comes last).
    All columns pass through unchanged.
    """
    rows = stage(df.withColumns({"_fp": fingerprints("text"), "_row": F.monotonically_increasing_id()}), "rows")
    label = components(near_links(rows.select(F.col("_fp").alias("fp")).distinct())).withColumnsRenamed({"id": "_fp", "label": "_label"})
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row"))
    per_text = stage(rows.groupBy("_fp").agg(first.alias("_first")), "firsts")
    group = per_text.join(label, "_fp", "left").groupBy(F.coalesce("_label", "_fp")).agg(F.min("_first").alias("_first"))
    winners = group.select(F.col("_first._row").alias("_row"))
    losers = stage(rows.select("_row").join(winners, "_row", "left_anti"), "losers")
    return rows.join(losers, "_row", "left_anti").select(*df.columns)
