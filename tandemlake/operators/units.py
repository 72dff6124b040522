"""Unit tables: lengths, composition, coverage, windows of units, and sequences of units."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandemlake.functions.sequences import revcomp, subseq


def in_range(units: DataFrame, low: int, high: int) -> DataFrame:
    return units.filter(F.col("ulen").between(low, high))


def in_intervals(units: DataFrame, intervals: DataFrame) -> DataFrame:
    """Units with a length in one of the closed intervals (lo, hi). These are disjoint and few: as many as there are peaks,
    at most half the length range; so they are broadcast."""
    return units.join(F.broadcast(intervals), F.col("ulen").between(F.col("lo"), F.col("hi")), "left_semi")


def composition(units: DataFrame) -> DataFrame:
    """Units of each length in each read."""
    return units.groupBy("read_id", "ulen").agg(F.count(F.lit(1)).alias("n"))


def length_totals(units: DataFrame) -> DataFrame:
    """Number and total length of the units of each length."""
    return units.groupBy("ulen").agg(F.count(F.lit(1)).alias("n")).withColumn("total", F.col("ulen") * F.col("n"))


def covered_strata(units: DataFrame, reads: DataFrame, low: int, high: int, divisor: int = 1000) -> DataFrame:
    """(read_id, covered, stratum): total length of a read's units in range, and that by `divisor`; reads without are in 0."""
    sums = in_range(units, low, high).groupBy("read_id").agg(F.sum("ulen").cast("long").alias("covered"))
    covered = F.coalesce("covered", F.lit(0).cast("long"))
    return reads.select("read_id").join(sums, "read_id", "left").select("read_id", covered.alias("covered"), F.floor(covered / divisor).alias("stratum"))


def stratified_lengths(units: DataFrame, strata: DataFrame, low: int, high: int, least: int = 0) -> DataFrame:
    """Units of each length and stratum, from stratum `least` on."""
    joined = in_range(units, low, high).join(strata.filter(F.col("stratum") >= least), "read_id")
    return joined.groupBy("stratum", "ulen").agg(F.count(F.lit(1)).alias("n"))


def variation(units: DataFrame, by: list[str], max_cv: float = 0.1) -> DataFrame:
    """Coefficient of variation of unit lengths of each group of two or more units, where it is below max_cv."""
    stats = units.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.stddev_samp("ulen") / F.avg("ulen"), 3).alias("cv"))
    return stats.filter((F.col("n") > 1) & (F.col("cv") < max_cv))


def windows(units: DataFrame, k: int) -> DataFrame:
    """The runs of k + 1 units, from the begin of one to the end of the k-th after it."""
    order = Window.partitionBy("read_id").orderBy("unit_ord")
    return units.withColumn("window_end", F.lead("end", k).over(order)).filter("window_end IS NOT NULL").select("read_id", "unit_ord", "start", "window_end")


def boundaries(units: DataFrame, k: int = 2, offset: int = 1) -> DataFrame:
    """The k units that follow the first `offset` ones, and the k that come before the last `offset`: as (side, start, end).
    Reads with fewer than offset + k units have none."""
    order = Window.partitionBy("read_id").orderBy("unit_ord")
    n = F.count(F.lit(1)).over(Window.partitionBy("read_id"))
    placed = units.withColumn("at", F.row_number().over(order) - 1).withColumn("n", n).withColumn("stop", F.lead("end", k - 1).over(order))
    sides = F.array(
        F.when(F.col("at") == offset, F.lit("prefix")),
        F.when(F.col("at") == F.col("n") - offset - k, F.lit("suffix")),
    )
    chosen = placed.filter((F.col("n") >= offset + k) & F.col("stop").isNotNull()).select("read_id", F.explode(sides).alias("side"), "start", F.col("stop").alias("end"))
    return chosen.filter("side IS NOT NULL")


def merged(intervals: DataFrame, by: list[str]) -> DataFrame:
    """Union of half-open intervals (start, end) within each group: touching ones become one."""
    order = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = intervals.withColumn("first", F.when(F.col("start") <= reach, 0).otherwise(1))
    islands = islands.withColumn("island", F.sum("first").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def cover_rate(units: DataFrame, reads: DataFrame) -> DataFrame:
    """Share of each read that its units cover."""
    sums = units.groupBy("read_id").agg(F.sum("ulen").alias("covered"))
    return reads.join(sums, "read_id").select("read_id", F.round(F.col("covered") / F.col("length"), 2).alias("cover_rate"))


def sequences(units: DataFrame, reads: DataFrame, forward: bool = False, compressed: bool = False) -> DataFrame:
    """units with the sequence of each; with `forward` those of strand 1 are reverse-complemented."""
    joined = units.join(reads.select("read_id", "seq"), "read_id")
    seq = subseq("seq", "start", "end")
    if compressed:
        seq = F.regexp_replace(seq, "(.)\\1+", "$1")
    if forward:
        seq = F.when(F.col("strand") == 1, revcomp(seq)).otherwise(seq)
    return joined.withColumn("unit_seq", seq).drop("seq")


def reversed_units(units: DataFrame, reads: DataFrame) -> DataFrame:
    """Units as they lie on the reverse complement of their reads: mirrored places, reversed order."""
    n = F.count(F.lit(1)).over(Window.partitionBy("read_id"))
    at = F.row_number().over(Window.partitionBy("read_id").orderBy("unit_ord"))
    placed = units.withColumn("unit_ord", (n - at).cast("int")).join(reads.select("read_id", "length"), "read_id")
    return placed.select(
        "read_id", "unit_ord", (F.col("length") - F.col("end")).alias("start"), (F.col("length") - F.col("start")).alias("end"),
        *(c for c in units.columns if c not in ("read_id", "unit_ord", "start", "end")),
    )


def reversed_reads(reads: DataFrame) -> DataFrame:
    return reads.withColumns({"seq": revcomp("seq"), "strand": F.lit(1) - F.col("strand")})
