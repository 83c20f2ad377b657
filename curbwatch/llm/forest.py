"""Embedding near-duplicates through a forest of random-projection trees (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import stage
from .graph import components

COSINE = 0.9
#: Trees to begin with; they double until the links of QUERIES points, compared with all points, are found to this share.
TREES, QUERIES, RECALL = 12, 1024, 0.999
#: Points of a leaf at most, and rows of one side of a comparison when links are counted.
LEAF, BLOCK = 512, 1024
#: A split sends points this far (in ranks) beyond the median to both sides.
SPILL = 0.05
#: Points of a node from which its splits are fitted, and levels fitted at once.
SAMPLE, LEVELS = 2048, 6
SEED = 42


def _raw(column: pa.Array) -> pa.Array:
    """Bytes of every usable vector; null for vectors that are null, empty or zero, or hold null or non-finite numbers."""
    kind = np.float64 if pa.types.is_float64(column.type.value_type) else np.float32
    out: list[bytes | None] = []
    for x in column:
        v = None if x.as_py() is None else x.values
        v = None if v is None or v.null_count or not len(v) else v.to_numpy(zero_copy_only=False).astype(kind) + kind(0)
        out.append(None if v is None or not np.isfinite(v).all() or not v.any() else v.tobytes())
    return pa.array(out, pa.binary())


raw = F.arrow_udf(_raw, BinaryType())


def unit(values: list[bytes], width: int) -> np.ndarray:
    """Rows of length 1 in double precision."""
    x = np.frombuffer(b"".join(values), np.float32 if width == 4 else np.float64).reshape(len(values), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _direction(tree: int, node: int, split: int, dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, tree, node, split]).standard_normal(dim)


def _height(x: np.ndarray, points: np.ndarray, tree: int, node: int, split: int) -> np.ndarray:
    """Places along a split's direction; a trace of the point's number parts equal places."""
    trace = (points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(split)) * np.uint64(0xD6E8FEB86659FD93)
    return x @ _direction(tree, node, split, x.shape[1]) + (trace >> np.uint64(11)).astype(np.float64) * (1e-9 / (1 << 53))


def _fit(width: int):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        """Bounds of the splits of one node, level by level, from its sample."""
        tree, node, levels = (int(pdf[c].iloc[0]) for c in ("tree", "node", "levels"))
        pdf = pdf.sort_values("point")
        x, points = unit(pdf["raw"].tolist(), width), pdf["point"].to_numpy()
        low, high, held = np.full(1 << levels, np.inf), np.full(1 << levels, -np.inf), {1: np.arange(len(pdf))}
        for split in range(1, 1 << levels):
            at = held.pop(split)
            if not len(at):
                low[split], high[split] = 0, 0
                held[2 * split] = held[2 * split + 1] = at
                continue
            h = _height(x[at], points[at], tree, node, split)
            low[split], high[split] = np.quantile(h, [0.5 - SPILL, 0.5 + SPILL])
            held[2 * split], held[2 * split + 1] = at[h <= high[split]], at[h >= low[split]]
        return pd.DataFrame({"tree": [tree], "node": [node], "levels": [levels], "low": [low.tobytes()], "high": [high.tobytes()]})

    return fit


def groups_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Whole groups of rows in key order; only the last group of a batch, which may go on in the next, is carried."""
    held: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        cols = [held.column(i).to_numpy() for i in range(keys)]
        change = np.zeros(len(held), bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        heads = [0, *np.flatnonzero(change).tolist()]
        for s, e in zip(heads[:-1], heads[1:]):
            yield held.slice(s, e - s)
        held = held.slice(heads[-1])
    if held is not None:
        yield held


def _descend(width: int):
    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(tree, node, point, raw, levels, low, high) to rows of the nodes below, a point in both where it spills."""
        for b in batches:
            t = pa.Table.from_batches([b])
            keys, both = np.unique(np.stack([t.column(0).to_numpy(), t.column(1).to_numpy()]), axis=1, return_inverse=True)
            both = both.ravel()
            for key in range(keys.shape[1]):
                at = np.flatnonzero(both == key)
                g = t.take(pa.array(at))
                tree, node, levels = g.column(0)[0].as_py(), g.column(1)[0].as_py(), g.column(4)[0].as_py()
                low, high = (np.frombuffer(g.column(i)[0].as_py()) for i in (5, 6))
                points, values = g.column(2).to_numpy(), g.column(3)
                x = unit(values.to_pylist(), width)
                rows, places, todo = [], [], [(1, np.arange(len(g)))]
                while todo:
                    split, here = todo.pop()
                    if split >= 1 << levels:
                        rows.append(here)
                        places.append(np.full(len(here), node * (1 << LEVELS) + 1 + split - (1 << levels)))
                        continue
                    h = _height(x[here], points[here], tree, node, split)
                    todo += [(2 * split, here[h <= high[split]]), (2 * split + 1, here[h >= low[split]])]
                at, child = np.concatenate(rows), np.concatenate(places)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), tree), pa.int64()), pa.array(child, pa.int64()), pa.array(points[at]),
                                                  pa.concat_arrays(values.take(pa.array(at)).chunks) if len(at) else pa.array([], pa.binary())], ["tree", "node", "point", "raw"])

    return descend


def leaves(points: DataFrame, width: int, trees: range) -> list[DataFrame]:
    """(tree, node, point, raw) of all leaves of the numbered trees, a table for each round of splits.

    All nodes above LEAF points are split at once, each up to LEVELS times at
    medians of a bounded sample of its points, and all its points go down; rounds
    go on until no node is above. Roots are apart by tree and by dimension.
    """
    dim = (F.octet_length("raw") / width).cast("bigint")
    items = points.select(F.explode(F.sequence(F.lit(trees.start).cast("bigint"), F.lit(trees.stop - 1).cast("bigint"))).alias("_t"), "point", "raw").select(
        (dim * (1 << 20) + F.col("_t")).alias("tree"), F.lit(0).cast("bigint").alias("node"), "point", "raw")
    done = []
    while True:
        sizes = stage(items.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n")), "nodes")
        done.append(items.join(sizes.filter(F.col("n") <= LEAF).select("tree", "node"), ["tree", "node"], "left_semi"))
        crowded = sizes.filter(F.col("n") > LEAF).select("tree", "node", "n", F.least(F.lit(LEVELS), F.ceil(F.log2(F.col("n") / LEAF))).cast("int").alias("levels"))
        if crowded.isEmpty():
            return done
        big = items.join(crowded, ["tree", "node"])
        # The lowest SAMPLE hashes of a node are among the share of hashes that about four times as many points have.
        hashed = big.withColumn("_h", F.xxhash64("point", "tree"))
        low = hashed.filter(F.col("_h").cast("double") <= -2.0 ** 63 + 2.0 ** 64 * 4 * SAMPLE / F.col("n"))
        order = F.row_number().over(Window.partitionBy("tree", "node").orderBy("_h", "point"))
        sample = low.withColumn("_n", order).filter(F.col("_n") <= SAMPLE).select("tree", "node", "levels", "point", "raw")
        models = stage(sample.groupBy("tree", "node").applyInPandas(_fit(width), "tree long, node long, levels int, low binary, high binary"), "splits")
        down = items.join(models, ["tree", "node"]).select("tree", "node", "point", "raw", "levels", "low", "high")
        items = stage(down.mapInArrow(_descend(width), "tree long, node long, point long, raw binary"), "items")


def _linked(width: int):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Verified links of each leaf, as those of a spanning forest: every linked point with the lowest it reaches there."""
        for g in groups_of(batches, 2):
            if len(g) < 2:
                continue
            points = g.column(2).to_numpy()
            x = unit(g.column(3).to_pylist(), width)
            i, j = np.nonzero(x @ x.T >= COSINE)
            i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            label = points.copy()
            while True:
                after = label.copy()
                low = np.minimum(label[i], label[j])
                np.minimum.at(after, i, low)
                np.minimum.at(after, j, low)
                if (after == label).all():
                    break
                label = after
            moved = label != points
            yield pa.RecordBatch.from_arrays([pa.array(points[moved]), pa.array(label[moved])], ["a", "b"])

    return linked


def _asked(width: int, shared):
    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(point, raw, label) to the links with the queries that no label joins, one for each point and query's label, and in rows without a link the counts of all."""
        queries: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in {len(r) for _, r, _ in shared.value}:
            rows = [q for q in shared.value if len(q[1]) == size]
            queries[size] = np.array([q[0] for q in rows]), unit([q[1] for q in rows], width), np.array([q[2] for q in rows])
        known = missed = 0
        for b in batches:
            points, values, labels = b.column(0).to_numpy(), b.column(1).to_pylist(), b.column(2).to_numpy()
            size = np.array([len(v) for v in values])
            for n, (ids, y, groups) in queries.items():
                mine = np.flatnonzero(size == n)
                for at in np.array_split(mine, -(-len(mine) // BLOCK)) if len(mine) else []:
                    near = (unit([values[i] for i in at], width) @ y.T >= COSINE) & (points[at][:, None] != ids)
                    i, j = np.nonzero(near & (labels[at][:, None] != groups))
                    known, missed = known + int(near.sum()), missed + len(i)
                    if len(i):
                        _, first = np.unique(np.stack([points[at][i], groups[j]]), axis=1, return_index=True)
                        none = pa.array(np.zeros(len(first), np.int64))
                        yield pa.RecordBatch.from_arrays([pa.array(points[at][i][first]), pa.array(ids[j][first]), none, none], ["a", "b", "known", "missed"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([known]), pa.array([missed])], ["a", "b", "known", "missed"])

    return asked


def joined(points: DataFrame, width: int) -> DataFrame:
    """(id, label) of every linked point: components of the links verified in the leaves of as many trees as the recall asks for.

    How often two ends of a link meet in a tree falls with its depth and with the
    cosine of the vectors around them. So the links of QUERIES points, picked by hash,
    are taken from all points, and while more than 1 - RECALL of them join points of
    different components, the trees double. Links so found are kept.
    """
    # A stated number of rows, whatever the points.
    chosen = points.orderBy(F.xxhash64("point", F.lit(SEED)), "point").limit(QUERIES).select("point", "raw").collect()
    links, trees = None, range(TREES)
    while True:
        for leaf in leaves(points, width, trees):
            more = leaf.repartition("tree", "node").sortWithinPartitions("tree", "node").mapInArrow(_linked(width), "a long, b long")
            links = more if links is None else links.unionByName(more)
        links = stage(links.distinct(), "links")
        labels = stage(components(links), "labels")
        named = {r.id: r.label for r in labels.join(F.broadcast(points.sparkSession.createDataFrame([(r.point,) for r in chosen], "id long")), "id").collect()} if chosen else {}
        shared = points.sparkSession.sparkContext.broadcast([(r.point, bytes(r.raw), named.get(r.point, r.point)) for r in chosen])
        rows = points.join(labels, points["point"] == labels["id"], "left").select("point", "raw", F.coalesce("label", "point").alias("label"))
        asked = stage(rows.mapInArrow(_asked(width, shared), "a long, b long, known long, missed long"), "asked")
        known, missed = asked.agg(F.coalesce(F.sum("known"), F.lit(0)), F.coalesce(F.sum("missed"), F.lit(0))).first()
        if not missed:
            return labels
        links = links.unionByName(asked.filter("a is not null").select("a", "b"))
        if missed <= (1 - RECALL) * known:
            return stage(components(links), "labels")
        trees = range(trees.stop, 2 * trees.stop)


def _counted(width: int):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(label, left, right, point, raw, weight, role) to (point, n): weight of the right side's points linked to each of the left."""
        for g in groups_of(batches, 3):
            points, weight, role = (g.column(i).to_numpy() for i in (3, 5, 6))
            x = unit(g.column(4).to_pylist(), width)
            l, r = role != 1, role != 0
            if not l.any() or not r.any():
                continue
            near = (x[l] @ x[r].T >= COSINE) & (points[l][:, None] != points[r][None, :])
            yield pa.RecordBatch.from_arrays([pa.array(points[l]), pa.array(near @ weight[r])], ["point", "n"])

    return counted


def link_counts(members: DataFrame, width: int) -> DataFrame:
    """(point, n) over members (label, point, raw, weight): how many vectors of its component each point links to, exactly.

    A component above BLOCK points is cut into blocks that meet pairwise in tasks of
    their own; no pair leaves a task.
    """
    sizes = stage(members.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks")), "sizes")
    cut = members.join(sizes, "label").withColumn("_own", F.pmod(F.xxhash64("point"), F.col("_blocks")).cast("int"))
    upto = F.sequence(F.lit(0), F.col("_blocks") - 1)
    place = lambda l, r, role: F.struct(l.alias("left"), r.alias("right"), F.lit(role).alias("role"))
    own = F.col("_own")
    places = F.when(F.col("_blocks") == 1, F.array(place(own, own, 2))).otherwise(
        F.concat(F.transform(upto, lambda r: place(own, r, 0)), F.transform(upto, lambda l: place(l, own, 1))))
    rows = cut.select("label", F.explode(places).alias("p"), "point", "raw", "weight").select("label", "p.left", "p.right", "point", "raw", "weight", "p.role")
    keys = ["label", "left", "right"]
    return (rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_counted(width), "point long, n long")
            .groupBy("point").agg(F.sum("n").alias("n")))


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per row of `df`: its id, n_links and component_id.

    Vectors link at cosine COSINE or more in double precision, whatever their other
    columns. Equal vectors are one point of the forest with a weight. Links verified
    in leaves are united over trees, as many as a measured recall asks for; then every
    component's links are counted exactly, so a link is missed only if its two ends
    share no component. Vectors
    that are null, empty or zero, or hold null or non-finite numbers, link with
    nothing, and vectors of different lengths not with each other. A null id never
    names a component unless it has no other. An empty table gives an empty one.
    """
    width = 8 if df.schema[vec_col].dataType.elementType.typeName() == "double" else 4
    rows = stage(df.select(F.col(id_col).alias("vec_id"), raw(F.col(vec_col)).alias("raw")), "vectors")
    points = stage(rows.filter("raw is not null").groupBy("raw").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("low"))
                   .withColumn("point", F.monotonically_increasing_id()), "points")
    labels = joined(points, width)
    members = points.join(labels, points["point"] == labels["id"]).select("label", "point", "raw", "weight", "low")
    least = members.groupBy("label").agg(F.min("low").alias("component_id"))
    known = members.select("label", "point").join(least, "label").join(link_counts(members, width), "point", "left").select("point", "component_id", F.col("n").alias("_n"))
    per_raw = points.join(known, "point", "left").select(F.col("raw").alias("_raw"), (F.coalesce("_n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                                                         F.coalesce("component_id", "low").alias("component_id"))
    out = rows.join(per_raw, rows["raw"] == per_raw["_raw"], "left")
    return out.select(F.col("vec_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                      F.coalesce("component_id", "vec_id").alias("component_id"))
