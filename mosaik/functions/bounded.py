"""Aggregates whose state has a bound, whatever the data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distinct_upto(v: Column, most: int) -> Column:
    """The number of distinct values that are not null, most + 1 if there are more.

    A theta sketch holds the hashes of all values while they are no more than its size, and its count is exact then; beyond,
    its estimate is not under its size. So a task keeps and sends a bounded number of hashes of 64 bits instead of all
    values; that two of 65,536 values share one is a matter of 1 in 10 ** 10."""
    return F.least(F.theta_sketch_estimate(F.theta_sketch_agg(v, max(4, most.bit_length()))), F.lit(most + 1)).cast("long")
