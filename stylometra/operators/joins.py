"""Joins by ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def range_join(points: DataFrame, at: str, ranges: DataFrame, low: str, high: str, width: int) -> DataFrame:
    """Rows of points with each range whose bounds (included) hold their whole number; null numbers and bounds meet none.

    Both sides are dealt by bins of `width` numbers: a range is repeated for each bin that it touches, a point lies in
    one, so the join is an equi-join and no row meets all ranges. Choose the width near the usual length of a range.
    """
    bins = F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
    wide = ranges.where(F.col(low) <= F.col(high)).withColumn("_bin", F.explode(bins))
    met = points.withColumn("_bin", F.floor(F.col(at) / width)).join(wide, "_bin")
    return met.where(F.col(at).between(F.col(low), F.col(high))).drop("_bin")
