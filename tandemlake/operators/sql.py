"""The library's kernels under names of SQL: UDFs, expressions that stay in the JVM, and table functions.

    register(spark)
    SELECT r.read_id, u.* FROM alignments r, LATERAL unit_rows(r.ab, r.bb, r.cigar) u
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tandemlake.functions import kernels
from tandemlake.functions.consensus import variants
from tandemlake.functions.units import split_units
from tandemlake.operators.contigs import refined, slice_of
from tandemlake.operators.encode import encode_read

#: Functions whose bodies are expressions of SQL: they are put in the place of the call, and stay in the JVM.
SQL_FUNCTIONS = {
    "revcomp(seq STRING) RETURNS STRING": "reverse(translate(seq, 'acgtACGT', 'tgcaTGCA'))",
    "kmers(seq STRING, k INT) RETURNS ARRAY<STRING>": "array_distinct(regexp_extract_all(seq, concat('(?s)(?=(.{', cast(k as string), '}))'), 1))",
    "homopolymer_compressed(seq STRING) RETURNS STRING": "regexp_replace(seq, '(.)\\\\1+', '$1')",
    "is_tandem(seq STRING) RETURNS BOOLEAN": "length(seq) > 1 AND instr(substring(concat(seq, seq), 2, 2 * length(seq) - 2), seq) > 0",
    "can_be_query(a STRING, b STRING) RETURNS BOOLEAN": "length(a) * 10 < length(b) * 11",
}


@F.pandas_udf(StringType())
def window_part(cigar: pd.Series, begin: pd.Series, low: pd.Series, high: pd.Series, read: pd.Series) -> pd.Series:
    """The part of a read that a path from a contig (at begin) lays on [low, high)."""
    rows = zip(cigar, begin, low, high, read, strict=True)
    return pd.Series([None if c is None or r is None or pd.isna([b, lo, hi]).any() else slice_of(c, int(b), int(lo), int(hi), r) for c, b, lo, hi, r in rows], dtype=object)


class SplitUnits:
    """The units that an alignment cuts, a row for each; none for nulls."""

    def eval(self, ab: int, bb: int, cigar: str) -> Iterator[tuple[int, int, int]]:
        if ab is not None and bb is not None and cigar is not None:
            yield from ((k, s, e) for k, (s, e) in enumerate(split_units(ab, bb, cigar)))


class Variants:
    """The differences of a sequence from a template, a row for each; none for nulls."""

    def eval(self, template: str, seq: str) -> Iterator[tuple[int, int, str, str]]:
        if template is not None and seq is not None:
            yield from variants(template, seq)


class EncodeRead:
    """A read as representatives, an array of (repr_id, seq, low, high): a row for each; none for nulls."""

    def eval(self, seq: str, reprs: list[Row]) -> Iterator[tuple]:
        if seq and reprs:
            yield from encode_read(seq, [(r["repr_id"], r["seq"], r["low"], r["high"]) for r in reprs if r is not None and r["seq"] is not None])


#: Table functions, to be used in FROM and after LATERAL, with the columns of their rows.
TABLE_FUNCTIONS = {
    "unit_rows": (SplitUnits, "unit_ord int, start int, end int"),
    "variant_rows": (Variants, "pos int, place int, op string, base string"),
    "encoding_rows": (EncodeRead, "start int, end int, length int, repr_id int, diff double, strand int, type string"),
}


def register(spark: SparkSession) -> None:
    """Makes all of them callable in the session; again is no harm."""
    kernels.register(spark)
    for name, one in (("refine_mapping", refined), ("window_part", window_part)):
        spark.udf.register(name, one)
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    for name, (handler, columns) in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, F.udtf(handler, returnType=columns, useArrow=True))
