"""Connected components of link tables, as joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, stage


def components(links: DataFrame) -> DataFrame:
    """(id, label): the lowest id each linked id reaches. `links` has long columns a and b.

    Large-star and small-star rounds alternate until a round changes nothing. A
    component shrinks to a star around its lowest id, whose links are one row per
    member, so no group is ever gathered: the minimum per id is combined before
    the shuffle and the join on a hot centre is left to AQE, which splits it.
    Every round's table is written to the shared folder and the one before dropped.
    """
    now = stage(links.select("a", "b").filter("a <> b").distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        after = stage(small.filter("a <> b").distinct(), "links")
        drop_staged(now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    return now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("label")).unionByName(
        now.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct())


def _mark(links: DataFrame) -> tuple:
    """Row count and a checksum that ignores order."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
