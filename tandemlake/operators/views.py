"""Data behind the viewers: dot plots, length transitions, distance matrices, alignments to representatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandemlake.functions.kernels import aligned_sizes, aligner
from tandemlake.functions.sequences import kmers


def dot_plot(left: DataFrame, right: DataFrame, k: int = 13) -> DataFrame:
    """(read_id, other_id, x, y) of equal k-mers of reads that both tables pair by pair_id: pair_id, read_id, seq each."""

    def words(df: DataFrame, name: str, at: str) -> DataFrame:
        runs = F.when(F.length("seq") >= k, F.transform(F.sequence(F.lit(1), F.length("seq") - (k - 1)), lambda i: F.substring("seq", i, F.lit(k))))
        return df.select("pair_id", F.col("read_id").alias(name), F.posexplode(runs).alias(at, "kmer"))

    # rows of words are far more than their sequences let Spark expect: never broadcast
    return words(left, "read_id", "x").hint("merge").join(words(right, "other_id", "y"), ["pair_id", "kmer"]).select("read_id", "other_id", "x", "y")


def shared_kmer_count(pairs: DataFrame, k: int = 13) -> DataFrame:
    return pairs.withColumn("shared", F.size(F.array_intersect(kmers("x", k), kmers("y", k))))


def length_transitions(units: DataFrame) -> DataFrame:
    """Pairs of neighbouring units' lengths and how often they occur."""
    order = Window.partitionBy("read_id").orderBy("unit_ord")
    return units.withColumn("next", F.lead("ulen").over(order)).filter("next IS NOT NULL").groupBy("ulen", "next").agg(F.count(F.lit(1)).alias("n"))


def labelled_units(units: DataFrame) -> DataFrame:
    """(read_id, unit_ord, start, end, repr_id, info): the bars of reads drawn as labelled units, with the text of each.
    units: read_id, unit_ord, start, end, repr_id."""
    info = F.concat(
        F.lit("unit "), F.col("unit_ord"), F.lit(" (id="), F.coalesce(F.col("repr_id").cast("string"), F.lit("")), F.lit(") ["), F.col("start"), F.lit(":"), F.col("end"),
        F.lit("] ("), F.col("end") - F.col("start"), F.lit(" bp)"),
    )
    return units.select("read_id", "unit_ord", "start", "end", "repr_id", info.alias("info"))


def composition_scatter(units: DataFrame) -> DataFrame:
    """(read_id, ulen, n, total) for scatter plots of unit lengths in reads."""
    return units.groupBy("read_id", "ulen").agg(F.count(F.lit(1)).alias("n")).withColumn("total", F.col("n") * F.col("ulen"))


def unit_distances(units: DataFrame, pairs: DataFrame, cyclic: bool = False) -> DataFrame:
    """(a_read_id, b_read_id, a_ord, b_ord, diff) in percent of all units of paired reads; units: read_id, unit_ord, unit_seq."""
    side = lambda x: units.select(F.col("read_id").alias(f"{x}_read_id"), F.col("unit_ord").alias(f"{x}_ord"), F.col("unit_seq").alias(x))
    rows = pairs.select("a_read_id", "b_read_id").distinct().join(side("a"), "a_read_id").join(side("b"), "b_read_id")
    r = aligned_sizes("cyclic" if cyclic else "global")("a", "b")
    diff = F.round(100 * F.shiftright("r", 32) / F.col("r").bitwiseAND(F.lit((1 << 32) - 1)), 2)
    return rows.withColumn("r", r).select("a_read_id", "b_read_id", "a_ord", "b_ord", diff.alias("diff"))


def unit_diffs(units: DataFrame, reprs: DataFrame, cyclic: bool = True) -> DataFrame:
    """units with the difference in percent from their representative; units: repr_id, unit_seq; reprs: repr_id, seq."""
    r = aligner("cyclic" if cyclic else "global")("unit_seq", "seq")
    rows = units.join(reprs, "repr_id").withColumn("r", r)
    return rows.withColumn("diff", F.round(100 * F.col("r.n_diff") / F.col("r.aln_len"), 2)).drop("r", "seq")
