"""Joins that handlers write by hand, as equi-joins on buckets with the exact condition inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_join(points: DataFrame, bands: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs of a point and a band with low <= value < high, over buckets of `width`.

    A point lies in one bucket and a band in those it covers, so each pair meets once, and no side is compared with all of the
    other. width should be near the usual size of a band: wider ones are copied to each bucket they cover.
    """
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    cover = bands.where(F.col(low) < F.col(high)).withColumn("bucket_", F.explode(F.sequence(bucket(low), bucket(high))))
    return points.withColumn("bucket_", bucket(value)).join(cover, "bucket_").where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("bucket_")


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], at: Column, other: Column, reach: int) -> DataFrame:
    """Pairs of equal keys whose times, long columns `at` of left and `other` of right, are at most `reach` apart.

    Each right row stands in its own bucket of `reach` and in both next ones; columns other than the keys must differ by name.
    """
    own = left.withColumn("bucket_", F.floor(at / reach).cast("long"))
    near = right.withColumn("bucket_", F.explode(F.array(*[F.floor(other / reach).cast("long") + k for k in (-1, 0, 1)])))
    return own.join(near, [*keys, "bucket_"]).where(F.abs(at - other) <= reach).drop("bucket_")
