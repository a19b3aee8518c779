"""Means, minima and maxima over a sample's parts (sections, resources)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def part_stats(values: Column, again: Column | None = None) -> Column:
    """A struct of mean, min and max of an array of numbers, zeros if it is empty.

    again: values that count once more in the mean (the entry point's section, which is listed twice).
    """
    whole = F.concat(values, again) if again is not None else values
    total = F.aggregate(whole, F.lit(0.0), lambda a, x: a + x)
    some = F.size(whole) > 0
    zero = F.lit(0.0)
    return F.struct(
        F.when(some, total / F.size(whole)).otherwise(zero).alias("mean"),
        F.when(some, F.array_min(whole).cast("double")).otherwise(zero).alias("min"),
        F.when(some, F.array_max(whole).cast("double")).otherwise(zero).alias("max"),
    )
