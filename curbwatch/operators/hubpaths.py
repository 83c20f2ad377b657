"""Shortest road paths between hubs on a contracted graph.

Most road nodes only bend a road: they have two neighbors and no hub. Runs of them
are contracted to one arc each by pointer doubling, so the relaxation takes as many
rounds as a path has junctions, not nodes. A label holds its last arc instead of its
path; only labels that improved are written, one small table a round, and paths are
read off backwards for the pairs that are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ROADS
from .scale import durable

HUB = "site:"


def is_hub(node: str | Column) -> Column:
    return (F.col(node) if isinstance(node, str) else node).startswith(HUB)


def chains(edges: DataFrame) -> DataFrame:
    """Every directed edge with the chain it lies on and its place in it, 0 for the chain's last edge.

    `edges`: src, dst (distinct pairs). An edge into a node that is no hub and has
    exactly two neighbors goes on with the edge out of it that does not turn back;
    no two edges go on with the same one. A chain is named by its last edge. Edges
    of rings without a junction are on no chain.
    """
    e = edges.select("src", "dst")
    ends = e.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(e.select(F.col("dst").alias("node"), F.col("src").alias("other")))
    bends = ends.groupBy("node").agg(F.min("other").alias("x"), F.max("other").alias("y"), F.count_distinct("other").alias("n")).filter((F.col("n") == 2) & ~is_hub("node"))
    onward = bends.select("node", "x", "y").alias("b")
    goes = e.join(onward, F.col("dst") == F.col("b.node")).select("src", "dst", F.when(F.col("b.x") == F.col("src"), F.col("b.y")).otherwise(F.col("b.x")).alias("to"))
    goes = goes.join(e.select(F.col("src").alias("dst"), F.col("dst").alias("to")), ["dst", "to"], "left_semi")
    place = e.join(goes, ["src", "dst"], "left").select("src", "dst", F.when(F.col("to").isNull(), F.col("src")).otherwise(F.col("dst")).alias("last_src"),
                                                        F.coalesce("to", "dst").alias("last_dst"), F.col("to").isNotNull().cast("long").alias("place"), F.col("to").isNotNull().alias("open"))
    place, left = durable(place), None
    while True:
        now = place.filter("open").count()
        if now == 0 or now == left:  # what is left goes round in rings
            return place.filter("not open").drop("open")
        left = now
        further = place.select(F.col("src").alias("last_src"), F.col("dst").alias("last_dst"), F.col("last_src").alias("s"), F.col("last_dst").alias("d"), F.col("place").alias("p"), F.col("open").alias("o"))
        moved = place.filter("open").join(further, ["last_src", "last_dst"]).select("src", "dst", F.col("s").alias("last_src"), F.col("d").alias("last_dst"), (F.col("place") + F.col("p")).alias("place"), F.col("o").alias("open"))
        place = durable(place.filter("not open").unionByName(moved))


def contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Arcs between hubs and junctions, and the edges of each in order.

    `edges`: src, dst, length_m, tt_s, highway, one row a pair. Arcs: arc, a, b,
    length_m, tt_s; of parallel arcs the shortest. Steps: arc, place (falling along
    the way), src, dst, length_m, tt_s, highway.
    """
    placed = chains(edges)
    steps = durable(edges.join(placed, ["src", "dst"]).withColumn("arc", F.concat_ws("\n", "last_src", "last_dst")).drop("last_src", "last_dst"))
    arcs = steps.groupBy("arc").agg(F.max_by("src", "place").alias("a"), F.min_by("dst", "place").alias("b"), F.sum("length_m").alias("length_m"), F.sum("tt_s").alias("tt_s"))
    # A chain that begins or ends at a bend is a dead end: nothing leads into it or out of it.
    ends = edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other")))
    firm = durable(ends.groupBy("node").agg(F.count_distinct("other").alias("n")).filter((F.col("n") != 2) | is_hub("node")).select("node"))
    arcs = arcs.filter("a <> b").join(firm.withColumnRenamed("node", "a"), "a", "left_semi").join(firm.withColumnRenamed("node", "b"), "b", "left_semi")
    best = arcs.groupBy("a", "b").agg(F.min(F.struct(F.round("length_m", 6).alias("metres"), "tt_s", "arc", "length_m")).alias("m"))
    return durable(best.select("m.arc", "a", "b", "m.length_m", "m.tt_s")), steps


def shortest_between_hubs(edges: DataFrame, cutoff_m: float = ROADS.adjacency_cutoff_m) -> DataFrame:
    """Shortest road path between hubs within a cutoff, those through another hub dropped afterwards.

    Returns src, dst, length_m, tt_s, classes (road classes along the way, repeats
    left out) and path (nodes). Equal lengths, to a micrometre, prefer a path
    through no hub, then less time.
    """
    one = edges.filter("src <> dst").groupBy("src", "dst").agg(F.min(F.struct("length_m", "tt_s", "highway")).alias("e")).select("src", "dst", "e.length_m", "e.tt_s", "e.highway")
    arcs, steps = contracted(durable(one))
    out = arcs.select(F.col("a").alias("node"), F.col("b").alias("next"), F.col("length_m").alias("step_m"), F.col("tt_s").alias("step_s"), F.col("arc").alias("step"))
    label = F.struct("metres", "via", F.round("tt_s", 6).alias("seconds"), "old", "length_m", "tt_s", "last", "arc")

    def better(labels: DataFrame) -> DataFrame:
        return labels.groupBy("start", "node").agg(F.min(label).alias("l"))

    first = out.filter(is_hub("node") & (F.col("step_m") <= cutoff_m)).select(
        F.col("node").alias("start"), F.col("next").alias("node"), F.round("step_m", 6).alias("metres"), F.lit(False).alias("via"), F.col("step_s").alias("tt_s"),
        F.lit(False).alias("old"), F.col("step_m").alias("length_m"), F.col("node").alias("last"), F.col("step").alias("arc"))
    columns = first.columns
    front = durable(better(first).select("start", "node", "l.*").select(*columns))
    log = [front]
    while front.limit(1).count():
        grown = front.join(out, "node").filter((F.col("next") != F.col("start")) & (F.col("length_m") + F.col("step_m") <= cutoff_m)).select(
            "start", F.col("next").alias("node"), F.round(F.col("length_m") + F.col("step_m"), 6).alias("metres"), (F.col("via") | is_hub("node")).alias("via"),
            (F.col("tt_s") + F.col("step_s")).alias("tt_s"), F.lit(True).alias("new"), (F.col("length_m") + F.col("step_m")).alias("length_m"), F.col("node").alias("last"), F.col("step").alias("arc"))
        # Of equal labels the one held stays: `old` is false for what is held and true for what is new.
        grown = grown.withColumnRenamed("new", "old").select(*columns)
        held = reduce(DataFrame.unionByName, log)
        front = durable(better(held.unionByName(grown)).filter("l.old").select("start", "node", "l.*").withColumn("old", F.lit(False)).select(*columns))
        log.append(front)
    best = durable(better(reduce(DataFrame.unionByName, log)).select("start", "node", "l.*"))
    kept = best.filter(is_hub("node") & ~F.col("via"))
    return _paths(kept, best, steps)


def _paths(kept: DataFrame, best: DataFrame, steps: DataFrame) -> DataFrame:
    """The edges of each kept label's path, arc by arc from its end, put together in order."""
    at = durable(kept.select("start", F.col("node").alias("goal"), "node"))
    back, parts, n = best.select("start", "node", "last", "arc"), [], 0
    while at.limit(1).count():
        here = durable(at.join(back, ["start", "node"]))
        parts.append(here.select("start", "goal", "arc", F.lit(n).alias("n")))
        at, n = here.filter(F.col("last") != F.col("start")).select("start", "goal", F.col("last").alias("node")), n - 1
    if not parts:
        parts = [kept.select("start", F.col("node").alias("goal"), "arc", F.lit(0).alias("n"))]
    ways = reduce(DataFrame.unionByName, parts).join(steps, "arc")
    edge = F.struct("n", (-F.col("place")).alias("p"), "src", "dst", "length_m", "tt_s", "highway")
    paths = ways.groupBy("start", "goal").agg(F.array_sort(F.collect_list(edge)).alias("s"))  # as long as a path within the cutoff
    total = lambda c: F.aggregate(F.col("s"), F.lit(0.0), lambda held, x: held + x[c])
    classes = F.transform(F.col("s"), lambda x: x["highway"])
    turns = F.filter(classes, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(classes, i - 1)))
    return paths.select(F.expr(f"substring(start, {len(HUB) + 1})").alias("src"), F.expr(f"substring(goal, {len(HUB) + 1})").alias("dst"), total("length_m").alias("length_m"), total("tt_s").alias("tt_s"),
                        turns.alias("classes"), F.concat(F.array("start"), F.transform(F.col("s"), lambda x: x["dst"])).alias("path"))
