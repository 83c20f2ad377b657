"""Mixing sources to target weights: repetition rates per source, then hash-seeded copies (operator 6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Draws that a document has in reserve; each source uses the one that comes nearest to its target.
DRAWS = 16


def word_count(text: str = "text") -> Column:
    """Words between white space (space and tab to carriage return); null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def draw(doc_id: Column, number: Column) -> Column:
    """A number in [0, 1) that depends only on the id and the number of the draw: four of 32 bits from each digest."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.floor(number / 4).cast("string")).cast("binary"))
    return F.conv(F.substring(digest, F.lit(1) + (number % 4).cast("int") * 8, F.lit(8)), 16, 10).cast("double") / float(1 << 32)


def copies_at(rate: Column, u: Column) -> Column:
    """floor(rate) copies, and one more with probability equal to the fraction."""
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("bigint")).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Target size of every source from (source, source_size); one row per source.

    A source gets weight x level, at most `most` times its size. The level is the
    largest of (what is left after the sources before it are full) / (weights from
    it on), in the order in which sources fill up: the fixed point of resharing
    the excess by weight until none is above.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_n", F.row_number().over(by_name) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_n") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumns({"_w": w, "_cap": F.col("source_size") * float(most)})
    fill = Window.orderBy(F.col("_cap") / F.col("_w"), "_n")
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) * float(share) - F.coalesce(F.sum("_cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_w").over(fill.rowsBetween(0, Window.unboundedFollowing))
    levels = ranked.withColumn("_level", left / rest)
    target = F.least(F.col("_cap"), F.max("_level").over(every) * F.col("_w"))
    return levels.select("source", "source_size", target.alias("target"))


def rates(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, draws: int = DRAWS) -> DataFrame:
    """From (doc_id, source, size), one row per source: source_size, target, rate and `pick`, the number of the draw its documents use.

    Sizes are aggregated before any shuffle, so a source with a third of all rows
    costs no more than another. Every draw gives a document its extra copy with
    the same probability; of `draws` of them a source takes the one whose words
    come nearest to the target (ties: the first).
    """
    goal = stage(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
                 .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)), "targets")
    tried = sized.join(goal.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    sums = tried.groupBy("source").agg(*[F.sum(F.col("size") * copies_at(F.col("rate"), draw(F.col("doc_id"), F.lit(k)))).alias(f"_{k}") for k in range(draws)])
    off = sums.join(goal.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).withColumn(
        "_off", F.array(*[F.abs(F.col(f"_{k}") - F.col("target")) for k in range(draws)]))
    return stage(off.select("source", "source_size", "target", "rate", (F.array_position("_off", F.array_min("_off")) - 1).cast("int").alias("pick")), "rates")


def measured(df: DataFrame) -> DataFrame:
    """doc_id, source and size in words of every document, written once because three passes read it."""
    return stage(df.select("doc_id", "source", word_count().alias("size")), "sizes")


def planned(df: DataFrame, sized: DataFrame | None = None, **settings) -> DataFrame:
    """Every document of `df` with source_size, target, rate and copies, which may be 0.

    `sized`: what measured() returned for the documents, if it is there already.

    A null source is a source of its own, after the others. A null text counts no
    words. Rows that share a doc_id share their draw. Sources without words have
    target and rate 0. An empty table gives an empty one. Columns of `df` named
    like a new column are replaced.
    """
    plan = rates(measured(df) if sized is None else sized, **settings).withColumnRenamed("source", "_mix_source")
    kept = df.drop("source_size", "target", "rate", "copies")
    out = kept.join(plan, kept["source"].eqNullSafe(plan["_mix_source"]))
    copies = copies_at(F.col("rate"), draw(F.col("doc_id"), F.col("pick")))
    return out.select(*kept.columns, "source_size", "target", "rate", copies.alias("copies"))


def mix(df: DataFrame, **settings) -> DataFrame:
    """The documents of the mix: each row as often as planned() says, in the columns of `df`."""
    plan = planned(df, **settings)
    return plan.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.greatest(F.col("copies"), F.lit(1))))).filter("copies >= 1").select(*df.columns)
