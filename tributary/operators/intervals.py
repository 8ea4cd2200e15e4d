"""Joins of points with the intervals around them, by bins of two widths.

Short intervals are exploded to narrow bins, long ones to wide bins, and a point goes to one bin of either width, so the
join is an equality of bins with a range test inside one bin. No bin has more than its width of different points, however
many points or intervals a unit has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.operators import skew

#: Places in a bin of either width; an interval of more than SHORT places goes to wide bins.
NARROW, WIDE, SHORT = 32, 2048, 512


def bins(first: str, last: str) -> Column:
    """(width, bin) of every bin that an interval touches; none for an empty interval or one without an end."""
    width = F.when(F.col(last) - F.col(first) < SHORT, NARROW).otherwise(WIDE)
    low, high = (F.floor(F.col(c) / width).cast("bigint") for c in (first, last))
    return F.when(F.col(first) <= F.col(last), F.transform(F.sequence(low, high), lambda b: F.struct(width.alias("width"), b.alias("bin"))))


def around(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, first: str, last: str) -> DataFrame:
    """(keys, at, interval): each different point with each interval of its key that holds it, ``interval`` a struct of the
    columns of ``intervals``. Points and intervals without a key or place meet nothing."""
    own = F.struct(*[F.col(c) for c in intervals.columns]).alias("interval")
    dealt = intervals.select(*keys, own, F.explode(bins(first, last)).alias("b")).select(*keys, "b.width", "b.bin", "interval")
    places = points.select(*keys, at).distinct()
    spots = F.array(*[F.struct(F.lit(w).alias("width"), F.floor(F.col(at) / w).cast("bigint").alias("bin")) for w in (NARROW, WIDE)])
    places = places.select("*", F.explode(spots).alias("b")).select(*keys, at, "b.width", "b.bin")
    return places.join(dealt, [*keys, "width", "bin"]).where(F.col(at).between(F.col(f"interval.{first}"), F.col(f"interval.{last}"))).select(*keys, at, "interval")


def narrowest(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, first: str, last: str, name: str) -> DataFrame:
    """``points`` with ``name`` of the narrowest interval around each, of equally narrow ones the smallest; null if none."""
    met = around(points, intervals.select(*keys, name, first, last), keys, at, first, last)
    best = met.groupBy(*keys, at).agg(F.min(F.struct((F.col(f"interval.{last}") - F.col(f"interval.{first}")).alias("span"), F.col(f"interval.{name}").alias(name))).alias("best"))
    return skew.salted(points, best, [*keys, at]).withColumn(name, F.col(f"best.{name}")).drop("best")


def outside(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, first: str, last: str) -> DataFrame:
    """The ``points`` that no interval of their key holds, points without key or place among them."""
    held = around(points, intervals, keys, at, first, last).select(*keys, at).distinct().withColumn("__held", F.lit(True))
    return skew.salted(points, held, [*keys, at]).where("__held is null").drop("__held")
