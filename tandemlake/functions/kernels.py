"""Arrow UDFs around the sequence kernels, and their registration for SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from tandemlake.functions.align import align, align_cyclic, cigar_of_text, dovetail, gapped, revcomp
from tandemlake.functions.consensus import consensus, log_prob_align, log_prob_composition, log_prob_gen, variants
from tandemlake.functions.seeds import places_in_windows
from tandemlake.functions.units import split_units

ALIGNED = "n_diff int, aln_len int, t_start int, t_end int, cigar string"
DOVETAILED = "a_start int, a_end int, b_start int, b_end int, aln_len int, n_diff int"


def _struct(names: str) -> StructType:
    """A struct of ints and strings, without a session to parse its text."""
    return StructType([StructField(n, IntegerType() if t == "int" else StringType()) for n, t in (x.split() for x in names.split(", "))])


def _frame(rows: list[tuple | None], names: str) -> pd.DataFrame:
    columns = [x.split()[0] for x in names.split(", ")]
    return pd.DataFrame([r or (None,) * len(columns) for r in rows], columns=columns).astype({c: "Int32" for c, t in (x.split() for x in names.split(", ")) if t == "int"})


def aligner(mode: str) -> Callable:
    """Column function (query, target) -> struct of ALIGNED; null where either is null. Equal rows of a batch are aligned once."""

    @F.pandas_udf(_struct(ALIGNED))
    def run(query: pd.Series, target: pd.Series) -> pd.DataFrame:
        one = align_cyclic if mode == "cyclic" else lambda q, t: align(q, t, mode)
        place: dict[tuple, int] = {}
        at = [place.setdefault(pair, len(place)) for pair in zip(query, target, strict=True)]
        return _frame([None if q is None or t is None else tuple(one(q, t)) for q, t in place], ALIGNED).take(at).reset_index(drop=True)

    return run


def aligned_sizes(mode: str) -> Callable:
    """Column function (query, target) -> long: differences times 2^32 and the alignment's length, of aligner's alignment. Without
    its path, most of the time of short sequences is saved."""

    @F.pandas_udf(LongType())
    def run(query: pd.Series, target: pd.Series) -> pd.Series:
        one = align_cyclic if mode == "cyclic" else lambda q, t: align(q, t, mode)
        known: dict[tuple, int | None] = {}
        for q, t in zip(query, target, strict=True):
            if (q, t) not in known:
                found = None if q is None or t is None else one(q, t)
                known[q, t] = found and found.n_diff << 32 | found.length
        return pd.Series([known[pair] for pair in zip(query, target, strict=True)], dtype="Int64")

    return run


@F.pandas_udf(_struct(DOVETAILED))
def dovetailed(a: pd.Series, b: pd.Series, a_pos: pd.Series, b_pos: pd.Series) -> pd.DataFrame:
    return _frame([None if x is None or y is None else dovetail(x, y, int(i), int(j)) for x, y, i, j in zip(a, b, a_pos, b_pos, strict=True)], DOVETAILED)


@F.pandas_udf(ArrayType(IntegerType()))
def window_places(query: pd.Series, target: pd.Series, windows: pd.Series, max_diff: pd.Series, k: pd.Series) -> pd.Series:
    """windows: for each row the begins and ends, one after the other."""
    pairs = lambda w: list(zip(w[::2], w[1::2], strict=True))
    rows = zip(query, target, windows, max_diff, k, strict=True)
    return pd.Series([None if q is None or t is None else places_in_windows(q, t, pairs([int(x) for x in w]), float(d), int(n)) for q, t, w, d, n in rows])


@F.pandas_udf(StringType())
def text_cigar(a: pd.Series, symbols: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or s is None or y is None else cigar_of_text(x, s, y) for x, s, y in zip(a, symbols, b, strict=True)])


@F.pandas_udf(ArrayType(_struct("start int, end int")))
def unit_splits(ab: pd.Series, bb: pd.Series, cigar: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else [{"start": s, "end": e} for s, e in split_units(int(a), int(b), c)] for a, b, c in zip(ab, bb, cigar, strict=True)])


@F.pandas_udf(ArrayType(_struct("pos int, place int, op string, base string")))
def variant_list(template: pd.Series, seq: pd.Series) -> pd.Series:
    named = lambda v: dict(zip(("pos", "place", "op", "base"), v, strict=True))
    return pd.Series([None if t is None or s is None else [named(v) for v in variants(t, s)] for t, s in zip(template, seq, strict=True)])


@F.pandas_udf(_struct("source string, target string"))
def gapped_pair(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None) if x is None or y is None else gapped(x, y, align(x, y).cigar) for x, y in zip(a, b, strict=True)], columns=["source", "target"])


@F.pandas_udf(StringType())
def consensus_agg(seqs: pd.Series) -> str:
    """Grouped aggregate: majority consensus, seeded with the median length; sequences are taken in sorted order."""
    return consensus(sorted(s for s in seqs if s is not None), "median")


@F.pandas_udf(DoubleType())
def gen_log_prob(cons: pd.Series, obs: pd.Series) -> pd.Series:
    return pd.Series([None if c is None or o is None else log_prob_gen(c, o) for c, o in zip(cons, obs, strict=True)])


@F.pandas_udf(DoubleType())
def align_log_prob(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else log_prob_align(a, b) for a, b in zip(x, y, strict=True)])


@F.pandas_udf(DoubleType())
def composition_log_prob(cons: pd.Series, units: pd.Series) -> pd.Series:
    return pd.Series([None if c is None or u is None else log_prob_composition(c, list(u)) for c, u in zip(cons, units, strict=True)])


@F.pandas_udf(StringType())
def revcomp_udf(seq: pd.Series) -> pd.Series:
    return seq.map(lambda s: None if s is None else revcomp(s))


def register(spark: SparkSession) -> None:
    """Makes the kernels callable from SQL."""
    for mode in ("global", "glocal", "prefix", "cyclic"):
        spark.udf.register(f"align_{mode}", aligner(mode))
    for name, one in (
        ("dovetail", dovetailed), ("split_units", unit_splits), ("variants", variant_list), ("gapped_pair", gapped_pair), ("consensus", consensus_agg),
        ("log_prob_gen", gen_log_prob), ("log_prob_align", align_log_prob), ("log_prob_composition", composition_log_prob),
    ):
        spark.udf.register(name, one)
