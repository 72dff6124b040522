"""Tandem repeats and units of whole read tables; reads are independent, so nothing is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemlake.functions.kernels import unit_splits
from tandemlake.functions.units import READ_TYPES, SelfAlignment, covering, repeat_spans, self_alignments_of, units_of_reads

_CHOSEN = "read_id long, aln_ord int, ab int, ae int, bb int, be int, cigar string"


def settings(read_type: str | None, given: dict) -> dict:
    """Options of self_alignments_of: those of the read type (CLR or CCS), where one is named, and over them those given."""
    if read_type is not None and read_type not in READ_TYPES:
        raise ValueError(f"unknown read type {read_type}; known are {', '.join(READ_TYPES)}")
    return {**READ_TYPES.get(read_type or "", {}), **given}


#: Letters of the reads that are aligned with themselves at once, about.
LETTERS = 1 << 22


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list[str]]]:
    """Ids and sequences of reads, LETTERS at a time."""
    for frame in frames:
        ids, seqs = frame["read_id"].tolist(), [s or "" for s in frame["seq"]]
        begin = size = 0
        for n, seq in enumerate(seqs, 1):
            size += len(seq)
            if size >= LETTERS or n == len(seqs):
                yield ids[begin:n], seqs[begin:n]
                begin, size = n, 0


def detect(reads: DataFrame, read_type: str | None = None, **options: float) -> DataFrame:
    """Self-alignments (see schemas.SELF_ALIGNMENTS) of each read, with options of self_alignments_of."""
    options = settings(read_type, options)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, seqs in _batches(frames):
            rows = [(i, *x) for i, alns in zip(ids, self_alignments_of(seqs, **options), strict=True) for x in alns]
            yield pd.DataFrame(rows, columns=["read_id", "ab", "ae", "bb", "be", "cigar"])

    return reads.select("read_id", "seq").mapInPandas(run, "read_id long, ab int, ae int, bb int, be int, cigar string")


def measured(alignments: DataFrame) -> DataFrame:
    """alignments with distance and slope."""
    slope = F.round((F.col("ae") - F.col("ab")) / (F.col("be") - F.col("bb")), 3)
    return alignments.withColumns({"distance": F.col("ab") - F.col("bb"), "slope": slope})


def repeats_of(alignments: DataFrame, min_span: int = 500) -> DataFrame:
    """Repeat intervals: merged spans of the self-alignments of each read."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        spans = repeat_spans([SelfAlignment(*map(int, x)) for x in zip(frame["ab"], frame["ae"], frame["bb"], frame["be"], strict=True)], min_span)
        return pd.DataFrame([(frame["read_id"].iloc[0], k, s, e) for k, (s, e) in enumerate(spans)], columns=["read_id", "tr_ord", "start", "end"])

    return alignments.groupBy("read_id").applyInPandas(run, "read_id long, tr_ord int, start int, end int")


def chosen_alignments(repeats: DataFrame, alignments: DataFrame, min_len: int = 1000) -> DataFrame:
    """The greedy cover of each read's repeats by its self-alignments; a group is one read."""

    def run(key: tuple, spans: pd.DataFrame, alns: pd.DataFrame) -> pd.DataFrame:
        own = [SelfAlignment(int(a), int(b), int(c), int(d), e) for a, b, c, d, e in zip(alns["ab"], alns["ae"], alns["bb"], alns["be"], alns["cigar"], strict=True)]
        found = covering(list(zip(spans["start"], spans["end"], strict=True)), own, min_len)
        return pd.DataFrame([(key[0], k, *x) for k, x in enumerate(found)], columns=["read_id", "aln_ord", "ab", "ae", "bb", "be", "cigar"])

    return repeats.groupBy("read_id").cogroup(alignments.groupBy("read_id")).applyInPandas(run, _CHOSEN)


def cut_units(chosen: DataFrame, max_cv: float = 0.1) -> DataFrame:
    """Units of the chosen alignments: (read_id, unit_ord, start, end, ulen), alignment by alignment."""
    each = chosen.select("read_id", "aln_ord", F.posexplode(unit_splits("ab", "bb", "cigar")).alias("at", "u")).select("read_id", "aln_ord", "at", "u.*")
    each = each.withColumn("ulen", F.col("end") - F.col("start"))
    stats = each.groupBy("read_id", "aln_ord").agg(F.count(F.lit(1)).alias("n"), F.round(F.stddev_samp("ulen") / F.avg("ulen"), 3).alias("cv"))
    kept = each.join(stats.filter((F.col("n") > 1) & (F.col("cv") < max_cv)).select("read_id", "aln_ord"), ["read_id", "aln_ord"])
    listed = kept.groupBy("read_id").agg(F.sort_array(F.collect_list(F.struct("aln_ord", "at", "start", "end", "ulen"))).alias("units"))
    return listed.select("read_id", F.posexplode("units").alias("unit_ord", "u")).select("read_id", "unit_ord", "u.start", "u.end", "u.ulen")


def find_units(reads: DataFrame, max_cv: float = 0.1, min_len: int = 1000, min_repeat: int = 500, read_type: str | None = None, **options: float) -> DataFrame:
    """From reads to units in one narrow pass, with options of self_alignments_of."""
    options = settings(read_type, options)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, seqs in _batches(frames):
            found = units_of_reads(seqs, max_cv, min_len, min_repeat, **options)
            rows = [(i, n, s, e, e - s) for i, own in zip(ids, found, strict=True) for n, (s, e) in enumerate(own)]
            yield pd.DataFrame(rows, columns=["read_id", "unit_ord", "start", "end", "ulen"])

    return reads.select("read_id", "seq").mapInPandas(run, "read_id long, unit_ord int, start int, end int, ulen int")
