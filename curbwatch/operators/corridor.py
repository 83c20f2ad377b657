"""Bounded walks over the directed site graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CORRIDOR
from .scale import durable, top_per

WAVE_MPS = CORRIDOR.wave_kmh * 1000.0 / 3600.0


def adjacency(edges: DataFrame, side: str) -> DataFrame:
    """(site, next, length_m, tt_s): upstream walks edges backwards, nearby edges carry no direction."""
    flow = edges.filter(F.col("kind") != "nearby")
    beside = edges.filter(F.col("kind") == "nearby")
    fwd = lambda d: d.select(F.col("src").alias("site"), F.col("dst").alias("next"), "length_m", "tt_s")
    back = lambda d: d.select(F.col("dst").alias("site"), F.col("src").alias("next"), "length_m", "tt_s")
    return {"upstream": lambda: back(flow), "downstream": lambda: fwd(flow),
            "nearby": lambda: fwd(beside).unionByName(back(beside))}[side]()


def walk(adj: DataFrame, hops: int, max_m: float | None) -> DataFrame:
    """Shortest length to every site within a number of hops, never back to the start.

    Each level extends only the sites whose best length was found one level before;
    a longer way to a site can never lead to a shorter way beyond it.
    """
    best = F.min(F.struct("length_m", "hops", "tt_s")).alias("b")
    step = adj.filter(F.col("site") != F.col("next")).groupBy("site", "next").agg(F.min(F.struct("length_m", "tt_s")).alias("e"))
    step = step.select("site", "next", F.col("e.length_m").alias("step_m"), F.col("e.tt_s").alias("step_s"))
    if max_m is not None:
        step = step.filter(F.col("step_m") <= max_m)
    if hops > 1:
        step = durable(step)
    reached = step.select(F.col("site").alias("start"), F.col("next").alias("site"), F.col("step_m").alias("length_m"),
                          F.lit(1).alias("hops"), F.col("step_s").alias("tt_s"))
    for level in range(2, hops + 1):
        frontier = reached.filter(F.col("hops") == level - 1)
        grown = (frontier.join(step, "site").filter(F.col("next") != F.col("start"))
                 .select("start", F.col("next").alias("site"), (F.col("length_m") + F.col("step_m")).alias("length_m"),
                         F.lit(level).alias("hops"), (F.col("tt_s") + F.col("step_s")).alias("tt_s")))
        if max_m is not None:
            grown = grown.filter(F.col("length_m") <= max_m)
        reached = (reached.unionByName(grown).groupBy("start", "site").agg(best)
                   .select("start", "site", "b.length_m", "b.hops", "b.tt_s"))
    return reached


def corridor(edges: DataFrame, site_cameras: DataFrame, promotion: bool = False) -> DataFrame:
    """Neighbor cameras of every camera: upstream three hops and five kilometers, other sides one hop.

    The promotion variant walks two hops on every side.
    """
    p = CORRIDOR.promote_hops
    edges = durable(edges.select("src", "dst", "kind", "length_m", "tt_s"))
    plan = {"upstream": (p if promotion else CORRIDOR.upstream_hops, CORRIDOR.max_upstream_m),
            "downstream": (p if promotion else 1, None), "nearby": (p if promotion else 1, None)}
    sides = None
    for side, (hops, bound) in plan.items():
        part = walk(adjacency(edges, side), hops, bound).withColumn("side", F.lit(side))
        sides = part if sides is None else sides.unionByName(part)
    here = site_cameras.select(F.col("site_id").alias("start"), "camera_id")
    there = site_cameras.select(F.col("site_id").alias("site"), F.col("camera_id").alias("neighbor_id"))
    out = sides.join(here, "start").join(there, "site").filter(F.col("camera_id") != F.col("neighbor_id"))
    return out.select("camera_id", "neighbor_id", "side", "length_m", "hops", "tt_s",
                      F.when(F.col("side") == "upstream", F.col("length_m") / WAVE_MPS).alias("wave_s"))


def corridor_options(links: DataFrame, neighbors: DataFrame, per_incident: int, total: int) -> DataFrame:
    """Cameras an arbiter may choose between: the named ones first, then up to four corridor neighbors."""
    named = links.select("incident_id", "camera_id")
    reach = (links.select("incident_id", F.col("camera_id").alias("anchor"))
             .join(neighbors.select(F.col("camera_id").alias("anchor"), F.col("neighbor_id").alias("camera_id"), "side", "length_m"), "anchor")
             .join(named, ["incident_id", "camera_id"], "left_anti"))
    side_rank = F.when(F.col("side") == "upstream", 0).when(F.col("side") == "downstream", 1).otherwise(2)
    shortest = (reach.withColumn("side_rank", side_rank).groupBy("incident_id", "camera_id")
                .agg(F.min(F.struct("length_m", "side_rank", "side")).alias("s"))
                .select("incident_id", "camera_id", "s.length_m", "s.side_rank", "s.side"))
    extra = top_per(shortest, ["incident_id"], [F.col("side_rank"), F.col("length_m"), F.col("camera_id")], per_incident, "pick")
    both = (links.select("incident_id", "camera_id", F.lit(0).alias("group"), F.col("rank").alias("pick"), F.lit("named").alias("side"),
                         (F.col("km") * 1000.0).alias("length_m"))
            .unionByName(extra.select("incident_id", "camera_id", F.lit(1).alias("group"), "pick", "side", "length_m")))
    return top_per(both, ["incident_id"], [F.col("group"), F.col("pick")], total, "option").drop("group", "pick")


def next_hop(edges: DataFrame, sites: DataFrame, direction: str) -> DataFrame:
    """The flow edge each site steps along, staying on its own kind of road where it can.

    `edges` needs an `ordinal`, `sites` (site_id, is_freeway).
    """
    at, to = ("src", "dst") if direction == "down" else ("dst", "src")
    flow = edges.filter(F.col("kind").isin("freeway", "ramp", "street"))
    e = flow.join(sites.select(F.col("site_id").alias(at), "is_freeway"), at)
    wanted = F.when(F.col("is_freeway"), "freeway").otherwise("street")
    best = F.min(F.struct((F.col("kind") != wanted).alias("other"), "ordinal", F.col(to).alias("next"), "kind", "length_m", "tt_s")).alias("b")
    return (e.groupBy(F.col(at).alias("site_id")).agg(best)
            .select("site_id", F.col("b.next").alias("next_site"), F.col("b.kind").alias("kind"),
                    F.col("b.length_m").alias("length_m"), F.col("b.tt_s").alias("tt_s")))


def site_camera(site_cameras: DataFrame) -> DataFrame:
    """The camera that stands for a site: its first with video, else its first."""
    first = F.min(F.struct((~F.col("has_video")).alias("mute"), "ordinal", "camera_id")).alias("c")
    return site_cameras.groupBy("site_id").agg(first).select("site_id", F.col("c.camera_id").alias("camera_id"),
                                                             (~F.col("c.mute")).alias("has_video"))


def tour_dwell(hops: DataFrame) -> DataFrame:
    """Seconds each hop of a tour stays up."""
    return hops.withColumn("dwell_s", F.greatest(F.lit(4.5), F.least(F.lit(11.0), F.col("tt_s") / 11.0)))


def trip_dwell(stops: DataFrame) -> DataFrame:
    """Seconds each stop of a trip stays up: a base, the drive to the next stop, and a little for video."""
    ahead = F.lead("leg_s").over(Window.partitionBy("region_id", "trip_id").orderBy("stop"))
    drive = F.coalesce(ahead / 8.0, F.lit(0.0))
    return stops.withColumn("dwell_s", F.least(F.lit(14.0), 6.0 + drive) + F.when(F.col("has_video"), 5.0).otherwise(0.0))


def promotions(triggers: DataFrame, neighbors: DataFrame, now) -> DataFrame:
    """Cameras woken because a neighbor saw something, nearest hops first, thirty in all (K6).

    `triggers` is (camera_id, reason, strength, at).
    """
    live = triggers.filter(now - F.col("at") < CORRIDOR.promote_hold_s)
    side = F.when(F.col("side") == "upstream", 0).when(F.col("side") == "downstream", 1).otherwise(2)
    near = neighbors.filter(F.col("hops") <= CORRIDOR.promote_hops)
    cand = (live.join(near, "camera_id")
            .select(F.col("neighbor_id").alias("uid"), F.col("camera_id").alias("because"), "reason", "hops",
                    (-F.col("strength")).alias("weak"), side.alias("side_rank"), "length_m"))
    first = cand.groupBy("uid").agg(F.min(F.struct("hops", "weak", "side_rank", "length_m", "because", "reason")).alias("c"))
    return (first.select("uid", "c.*").orderBy("hops", "weak", "side_rank", "length_m", "uid", "because").limit(CORRIDOR.promote_max)
            .select("uid", "because", "reason", "hops", (-F.col("weak")).alias("strength"), "length_m"))
