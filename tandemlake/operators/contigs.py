"""Contigs: reads are placed along a path, refined against its raw sequence, and voted on in windows.

All steps are joins and aggregations on (path, read) and (path, window); no task ever holds a whole path's reads.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tandemlake.functions.align import align
from tandemlake.functions.sequences import revcomp
from tandemlake.operators.components import computed, kept, spread
from tandemlake.operators.graph import path_sequences
from tandemlake.operators.overlaps import mirrored, normalized
from tandemlake.operators.pile import consensus_of


def placed_reads(paths: DataFrame, overlaps: DataFrame) -> DataFrame:
    """(path_id, read_id, strand, pos): mean place on the path, rounded down, of the source nodes and whatever overlaps them."""
    steps = paths.select("path_id", F.explode("path").alias("s")).select("path_id", "s.at", "s.src_id", "s.src_end", "s.dst_id", "s.dst_end")
    seen = normalized(overlaps)
    oriented = seen.withColumn("src_end", F.lit("E")).unionByName(mirrored(seen).withColumn("src_end", F.lit("B")))
    shift = oriented.select(
        F.col("a_read_id").alias("src_id"), "src_end", F.col("b_read_id").alias("read_id"),
        F.abs(F.when(F.col("src_end") == "B", 1).otherwise(0) - F.col("strand")).alias("strand"), (F.col("a_start") - F.col("b_start")).alias("shift"),
    )
    near = steps.join(shift, ["src_id", "src_end"])
    onward = near.filter((F.col("read_id") == F.col("dst_id")) & (F.col("strand") == F.when(F.col("dst_end") == "B", 1).otherwise(0)))
    onward = onward.groupBy("path_id", "at").agg(F.min("shift").alias("onward"))
    order = Window.partitionBy("path_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    at = steps.select("path_id", "at").join(onward, ["path_id", "at"], "left").withColumn("pos", F.coalesce(F.sum("onward").over(order), F.lit(0)))
    spots = near.join(at.select("path_id", "at", "pos"), ["path_id", "at"]).select("path_id", "read_id", "strand", (F.col("pos") + F.col("shift")).alias("pos"))
    first = steps.filter("at = 0").select("path_id", F.col("src_id").alias("read_id"), F.when(F.col("src_end") == "B", 1).otherwise(0).alias("strand"), F.lit(0).cast("long").alias("pos"))
    return spots.union(first).groupBy("path_id", "read_id", "strand").agg(F.floor(F.sum("pos") / F.count(F.lit(1))).alias("pos"))


def refine(contig: str, start: int, read: str) -> tuple[int, int, str, str] | None:
    """(start, end, read part, path) of a read on a piece of contig around where it should begin; the path is from contig
    to read part. A negative start cuts the read's begin off; None if nothing lies on the contig."""
    if start < 0:
        read, start = read[-start:], 0
    piece = contig[start : start + len(read) + len(read) // 10 + 20]
    if not read or not piece:
        return None
    if len(piece) < len(read):
        tail = align(piece, read, "prefix")
        end, read = start + len(piece), read[: tail.t_end]
    else:
        end = start + align(read, piece, "prefix").t_end
    slack = min(start, 100)
    back = align(read[::-1], contig[start - slack : end][::-1], "prefix") if end > start - slack else None
    begin = end - back.t_end if back and back.t_end else start
    if end <= begin or not read:
        return None
    return begin, end, read, align(contig[begin:end], read, "global").cigar


def slice_of(cigar: str, begin: int, low: int, high: int, read: str) -> str:
    """The part of a read that a path from the contig (at `begin`) lays on [low, high)."""
    place, at, first, last = begin, 0, None, 0
    for op in cigar:
        if op != "D":
            if place >= low and first is None:
                first = at
            place += 1
        at += op != "I"
        if place == high:
            last = at
            break
    return read[first if first is not None else at : last or at]


_REFINED = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("part", StringType()), StructField("cigar", StringType())])


@F.pandas_udf(_REFINED)
def refined(contig: pd.Series, start: pd.Series, seq: pd.Series) -> pd.DataFrame:
    known = lambda c, s, r: c is not None and r is not None and not pd.isna(s)
    rows = [(refine(c, int(s), r) if known(c, s, r) else None) or (None,) * 4 for c, s, r in zip(contig, start, seq, strict=True)]
    return pd.DataFrame(rows, columns=["start", "end", "part", "cigar"]).astype({"start": "Int32", "end": "Int32"})


@F.pandas_udf(ArrayType(StringType()))
def _slices(cigar: pd.Series, start: pd.Series, part: pd.Series, windows: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series([[slice_of(c, int(s), int(w) * int(n), (int(w) + 1) * int(n), p) for w in ws] for c, s, p, ws, n in zip(cigar, start, part, windows, size, strict=True)])


def consensus_contigs(paths: DataFrame, overlaps: DataFrame, reads: DataFrame, window: int = 1000) -> DataFrame:
    """(path_id, seq): windows of the raw path sequence, each the majority of the reads that cover all of it. A window that
    no read covers stays as it is; the rest behind the last whole window is dropped."""
    raw = path_sequences(paths, reads).withColumn("size", F.length("seq"))
    spots = placed_reads(paths, overlaps).join(reads.select("read_id", F.col("seq").alias("read")), "read_id")
    spots = spots.filter(F.col("pos") + F.length("read") > 0).withColumn("read", F.when(F.col("strand") == 1, revcomp("read")).otherwise(F.col("read")))
    joined = spots.join(raw, "path_id").withColumn("base", F.greatest(F.col("pos") - 200, F.lit(0)))
    piece = F.expr("substring(seq, int(base) + 1, int(length(read) * 1.2) + 500)")
    rows = spread(joined.select("path_id", "read_id", "pos", "base", "read", piece.alias("piece")), "path_id", "read_id", "pos")
    found = computed(rows, "r", refined("piece", F.col("pos") - F.col("base"), "read")).filter("r.start IS NOT NULL")
    found = found.select("path_id", (F.col("r.start") + F.col("base")).cast("int").alias("start"), (F.col("r.end") + F.col("base")).cast("int").alias("end"), "r.part", "r.cigar")
    low, high = F.ceil(F.col("start") / window).cast("int"), F.floor(F.col("end") / window).cast("int") - 1
    covered = found.filter(low <= high).withColumn("windows", F.sequence(low, high))
    parts = covered.select("path_id", "windows", _slices("cigar", "start", "part", "windows", F.lit(window)).alias("parts"))
    each = parts.select("path_id", F.explode(F.arrays_zip("windows", "parts")).alias("z")).select("path_id", F.col("z.windows").alias("w"), F.col("z.parts").alias("part"))

    voted = consensus_of(kept(each), ["path_id", "w"], "part", "voted")
    whole = raw.filter(F.col("size") >= window).select("path_id", "seq", F.explode(F.sequence(F.lit(0), F.floor(F.col("size") / window).cast("int") - 1)).alias("w"))
    pieces = whole.select("path_id", "w", F.expr(f"substring(seq, w * {window} + 1, {window})").alias("raw")).join(voted, ["path_id", "w"], "left")
    listed = pieces.groupBy("path_id").agg(F.sort_array(F.collect_list(F.struct("w", F.coalesce("voted", "raw").alias("s")))).alias("s"))
    return listed.select("path_id", F.array_join("s.s", "").alias("seq"))
