"""Relational operators on overlap tables (see schemas.OVERLAPS; diff in percent)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandemlake.operators.components import min_labels, stored
from tandemlake.schemas import OVERLAP_COLUMNS

_MIRRORED = {"a_start": ("a_len", "a_end"), "a_end": ("a_len", "a_start"), "b_start": ("b_len", "b_end"), "b_end": ("b_len", "b_start")}


def _mirror(name: str) -> Column:
    length, other = _MIRRORED[name]
    return F.col(length) - F.col(other)


def filtered(overlaps: DataFrame, max_diff: float = 2.0, min_length: int = 3000) -> DataFrame:
    """Mean span of min_length or more and diff below max_diff percent."""
    span = F.expr("((a_end - a_start) + (b_end - b_start)) div 2")
    return overlaps.filter((span >= min_length) & (F.col("diff") < max_diff))


def swapped(overlaps: DataFrame) -> DataFrame:
    """a and b exchanged; on strand 1 both are mirrored, so that the new a is forward."""
    other = {"a": "b", "b": "a"}
    place = lambda c: F.when(F.col("strand") == 1, _mirror(c)).otherwise(F.col(c))
    out = {c: place(other[c[0]] + c[1:]) if c in _MIRRORED else F.col(other[c[0]] + c[1:]) if c[:2] in ("a_", "b_") else F.col(c) for c in OVERLAP_COLUMNS}
    return overlaps.select(*(v.alias(k) for k, v in out.items()))


def mirrored(overlaps: DataFrame) -> DataFrame:
    """Both reads reverse-complemented."""
    return overlaps.select(*(_mirror(c).alias(c) if c in _MIRRORED else F.col(c) for c in OVERLAP_COLUMNS))


def normalized(overlaps: DataFrame) -> DataFrame:
    """Each overlap twice: seen from either read as a."""
    return overlaps.select(*OVERLAP_COLUMNS).union(swapped(overlaps))


def of_read(overlaps: DataFrame, read_id: int, strand: int | None = None) -> DataFrame:
    """Overlaps of one read, which becomes a; with strand 1 as seen from its reverse complement."""
    own = overlaps.filter((F.col("a_read_id") == read_id) | (F.col("b_read_id") == read_id))
    own = normalized(own).filter(F.col("a_read_id") == read_id)
    return mirrored(own) if strand == 1 else own


def neighbours(overlaps: DataFrame) -> DataFrame:
    """(read_id, other_id, strand): each read itself on strand 0 and whatever it overlaps."""
    both = overlaps.select(F.col("a_read_id").alias("read_id"), F.col("b_read_id").alias("other_id"), "strand").union(
        overlaps.select(F.col("b_read_id"), F.col("a_read_id"), "strand")
    )
    return both.union(both.select("read_id", F.col("read_id"), F.lit(0))).distinct()


def relative_starts(overlaps: DataFrame) -> DataFrame:
    """Where each neighbour begins on a read's axis, for pile-ups."""
    a = overlaps.select(F.col("a_read_id").alias("read_id"), F.col("b_read_id").alias("other_id"), "strand", (F.col("a_start") - F.col("b_start")).alias("start"))
    from_b = F.when(F.col("strand") == 0, F.col("b_start") - F.col("a_start")).otherwise((F.col("b_len") - F.col("b_end")) - (F.col("a_len") - F.col("a_end")))
    return a.union(overlaps.select("b_read_id", "a_read_id", "strand", from_b))


def best_per_pair(overlaps: DataFrame) -> DataFrame:
    """For each pair and strand the overlap with the least diff, then the longest on a, then the first in order."""
    order = Window.partitionBy("a_read_id", "b_read_id", "strand").orderBy("diff", (F.col("a_start") - F.col("a_end")), *OVERLAP_COLUMNS)
    return overlaps.withColumn("place", F.row_number().over(order)).filter("place = 1").select(*OVERLAP_COLUMNS)


def degrees(overlaps: DataFrame) -> DataFrame:
    """Number of other reads that each read overlaps."""
    pairs = overlaps.select(F.least("a_read_id", "b_read_id").alias("x"), F.greatest("a_read_id", "b_read_id").alias("y")).distinct()
    return pairs.select(F.explode(F.array("x", "y")).alias("read_id")).groupBy("read_id").agg(F.count(F.lit(1)).alias("n"))


def stratified_degrees(overlaps: DataFrame, strata: DataFrame) -> DataFrame:
    """Reads of each stratum and degree; reads without overlaps have degree 0."""
    joined = strata.join(degrees(overlaps), "read_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return joined.groupBy("stratum", "n").agg(F.count(F.lit(1)).alias("reads"))


def reduced(overlaps: DataFrame, max_slip: int = 100) -> DataFrame:
    """Of the overlaps of a pair that are linked by steps of at most max_slip in all four coordinates, the one with the
    least diff, first in order on ties.

    An overlap whose neighbours of the pair, by a_start, are farther away is alone and stands. Of the others steps are found
    by an equi-join on the pair and a coarse cell of a_start, components by label propagation, so that they spread over cells.
    """
    places = ["a_start", "a_end", "b_start", "b_end"]
    key = ["a_read_id", "b_read_id", "strand"]
    order = Window.partitionBy(*key).orderBy("a_start")
    far = lambda begin, end: F.coalesce(end - begin > max_slip, F.lit(True))
    alone = F.col("a_start").isNotNull() & far(F.lag("a_start").over(order), F.col("a_start")) & far(F.col("a_start"), F.lead("a_start").over(order))
    told = stored(overlaps.select(*OVERLAP_COLUMNS, alone.alias("alone")))
    nodes = stored(told.filter("NOT alone").select(*OVERLAP_COLUMNS).distinct().withColumn("node", F.monotonically_increasing_id()))
    cell = F.floor(F.col("a_start") / (max_slip + 1))
    left = nodes.select(*key, *(F.col(c).alias(f"l_{c}") for c in places), F.col("node").alias("u"), F.explode(F.array(cell, cell + 1)).alias("cell"))
    right = nodes.select(*key, *(F.col(c).alias(f"r_{c}") for c in places), F.col("node").alias("v"), cell.alias("cell"))
    near = [F.abs(F.col(f"l_{c}") - F.col(f"r_{c}")) <= max_slip for c in places]
    steps = left.join(right, [*key, "cell"]).filter(near[0] & near[1] & near[2] & near[3] & (F.col("u") != F.col("v"))).select("u", "v")
    labelled = nodes.join(min_labels(steps), "node", "left").withColumn("label", F.coalesce("label", "node"))
    order = Window.partitionBy(*key, "label").orderBy("diff", *OVERLAP_COLUMNS)
    chosen = labelled.withColumn("place", F.row_number().over(order)).filter("place = 1").select(*OVERLAP_COLUMNS)
    return told.filter("alone").select(*OVERLAP_COLUMNS).union(chosen)


def best_edges(edges: DataFrame) -> DataFrame:
    """For each node the longest-overlap edge out of it: shortest extension, then least diff, then first target."""
    order = Window.partitionBy("src_id", "src_end").orderBy("length", "diff", "dst_id", "dst_end")
    return edges.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")
