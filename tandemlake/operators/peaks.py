"""Abundant unit lengths by kernel density, and the reads they cover."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandemlake.operators.units import in_intervals, in_range


def density(units: DataFrame, low: int, high: int, bandwidth: float = 0.5) -> DataFrame:
    """(x, density) at each whole length from low to high: Gaussian kernels on the lengths in that range.

    Units are first counted by length, so all that is left to sum is an array of at most high - low + 1 counts.
    """
    counts = in_range(units, low, high).groupBy("ulen").agg(F.count(F.lit(1)).alias("n"))
    listed = counts.agg(F.sort_array(F.collect_list(F.struct("ulen", "n"))).alias("lengths"), F.sum("n").alias("total")).filter("total > 0")
    grid = listed.select(F.explode(F.sequence(F.lit(low), F.lit(high))).alias("x"), "lengths", "total")
    kernel = lambda u: u["n"] * F.exp(-0.5 * F.pow((u["ulen"] - F.col("x")) / bandwidth, F.lit(2.0)))
    summed = F.aggregate("lengths", F.lit(0.0), lambda acc, u: acc + kernel(u))
    return grid.select("x", (summed / (F.col("total") * bandwidth * math.sqrt(2 * math.pi))).alias("density"))


def peaks(densities: DataFrame, min_density: float = 0.01) -> DataFrame:
    """Lengths whose density is above both neighbours' and at least min_density; the ends of the range are none."""
    order = Window.partitionBy(F.lit(0)).orderBy("x")  # a grid of whole lengths, bounded by its two parameters
    near = densities.withColumn("left", F.lag("density").over(order)).withColumn("right", F.lead("density").over(order))
    return near.filter("density > left AND density > right").filter(F.col("density") >= min_density).select("x", "density")


def peak_intervals(found: DataFrame, deviation: float = 0.015) -> DataFrame:
    """Closed intervals (lo, hi) of whole lengths around the peaks; overlapping ones are merged."""
    lo, hi = F.ceil(F.col("x") * (1 - deviation)), F.floor(F.col("x") * (1 + deviation))
    order = Window.partitionBy(F.lit(0)).orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = found.select(lo.alias("lo"), hi.alias("hi"))
    islands = spans.withColumn("new", F.when(F.col("lo") <= reach, 0).otherwise(1)).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def gated(units: DataFrame, low: int, high: int, min_covered: int) -> DataFrame:
    """Units in range of the reads that such units cover by min_covered or more."""
    chosen = in_range(units, low, high)
    reads = chosen.groupBy("read_id").agg(F.sum("ulen").alias("covered")).filter(F.col("covered") >= min_covered).select("read_id")
    return chosen.join(reads, "read_id", "left_semi")


def find_intervals(
    units: DataFrame, low: int = 300, high: int = 400, min_covered: int = 2000, bandwidth: float = 0.5, min_density: float = 0.01, deviation: float = 0.015
) -> DataFrame:
    return peak_intervals(peaks(density(gated(units, low, high, min_covered), low, high, bandwidth), min_density), deviation)


def covered_reads(units: DataFrame, intervals: DataFrame, min_covered: int = 2000) -> DataFrame:
    """(read_id, covered) of the reads whose units in the intervals sum to min_covered or more."""
    sums = in_intervals(units, intervals).groupBy("read_id").agg(F.sum("ulen").cast("long").alias("covered"))
    return sums.filter(F.col("covered") >= min_covered)


def filter_reads(reads: DataFrame, units: DataFrame, min_covered: int = 2000, **options: float) -> DataFrame:
    """The reads that units of abundant lengths cover; see find_intervals for the options."""
    kept = covered_reads(units, find_intervals(units, min_covered=min_covered, **options), min_covered)
    return reads.join(kept.select("read_id"), "read_id", "left_semi")
