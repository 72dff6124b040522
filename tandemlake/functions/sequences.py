"""Sequence expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def revcomp(seq: Column | str) -> Column:
    return F.reverse(F.translate(_col(seq), "acgtACGT", "tgcaTGCA"))


def subseq(seq: Column | str, start: Column | str, end: Column | str) -> Column:
    """Bases of the half-open interval [start, end)."""
    return _col(seq).substr((_col(start) + 1).cast("int"), (_col(end) - _col(start)).cast("int"))


def kmers(seq: Column | str, k: int) -> Column:
    """Distinct runs of k bases, in the order of their first place; none if the sequence is shorter. One pass of a look-ahead
    over the sequence: a substring for each place would walk to that place every time."""
    return F.array_distinct(F.regexp_extract_all(_col(seq), F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1)))


def homopolymer_compressed(seq: Column | str) -> Column:
    return F.regexp_replace(_col(seq), "(.)\\1+", "$1")


def is_tandem(seq: Column | str) -> Column:
    """Whether a shorter sequence repeats to make this one: it then occurs inside its own double."""
    s = _col(seq)
    twice = F.concat(s, s)
    return (F.length(s) > 1) & (F.instr(F.substring(twice, F.lit(2), F.length(twice) - 2), s) > 0)


def can_be_query(a: Column, b: Column) -> Column:
    return F.length(a) * 10 < F.length(b) * 11


def interval_overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
