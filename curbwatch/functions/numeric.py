"""Rounding and clamping expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def to_fixed(x: Column, digits: int) -> Column:
    """Round to `digits` decimals judging the exact binary value, ties away from zero.

    Spark's own ``round`` judges the shortest decimal text, so 1.005 would become
    1.01. ``format_number`` judges the binary value but takes true ties to even; a
    true tie is an odd multiple of a power of two, and is nudged outward first.
    """
    pattern = "0." + "0" * digits if digits else "0"

    def one(v: Column) -> Column:
        halves = F.abs(v) * float(2 ** (digits + 1))
        tie = (halves == F.floor(halves)) & (halves % 2.0 == 1.0)
        nudged = v + F.when(tie, F.signum(v) * 1e-9).otherwise(0.0)
        return F.call_function("format_number", nudged, F.lit(pattern)).cast("double") + 0.0

    # The lambda binds x once, so a chain of rounded columns stays linear in size when Catalyst inlines it.
    return F.element_at(F.transform(F.array(x), one), 1)


def with_fixed(df: DataFrame, digits: int, **named: Column) -> DataFrame:
    """Add rounded columns."""
    return df.withColumns({k: to_fixed(v, digits) for k, v in named.items()})


def array_median(values: Column) -> Column:
    """Exact median of a small array: the middle two are averaged on an even count."""
    s = F.array_sort(values)
    n = F.size(s)
    upper = F.element_at(s, F.floor(n / 2).cast("int") + 1)
    lower = F.element_at(s, F.floor((n + 1) / 2).cast("int"))
    return F.when(n > 0, (lower + upper) / 2.0)


def fraction(part: Column, whole: Column) -> Column:
    """part / whole, null where there is nothing to divide by."""
    return F.when(whole != 0, part / whole)
