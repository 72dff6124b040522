"""Encoding of reads as representative units, and variants of the complete ones against their representatives."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandemlake.functions.align import align, revcomp
from tandemlake.functions.kernels import variant_list
from tandemlake.functions.sequences import homopolymer_compressed, subseq
from tandemlake.functions.sequences import revcomp as turned
from tandemlake.operators.components import dealt_join, kept
from tandemlake.operators.pile import SHARE, pile

#: What claimed bases are overwritten with.
MASK = b"N"
ENCODINGS = "read_id long, start int, end int, length int, repr_id int, diff double, strand int, type string"


def span_kind(start: int, end: int, length: int, margin: float, diff: float, noisy: float, usual: tuple[int, int]) -> str:
    """What a mapped span of a read is: at the read's ends, unlike its representative, of unusual length, or complete."""
    tests = (("boundary", start < margin or end > length - margin), ("noisy", diff >= noisy), ("deviating", not usual[0] <= end - start <= usual[1]))
    return next((kind for kind, holds in tests if holds), "complete")


def encode_read(seq: str, reprs: list[tuple[int, str, int, int]], max_diff: float = 0.4, noisy: float = 0.23, boundary: float = 0.15) -> list[tuple]:
    """Mapping of representatives (id, seq, least and greatest usual length) on both strands. Rows of ENCODINGS without read_id,
    by start.

    Spans are claimed from the likest hit on; of equal ones that on the strand of the span claimed before, then by id. A
    queue holds one hit for each representative and strand. A hit whose place has been claimed in part since it was found
    goes back into the queue with its next best place in what is free, or not at all if that is too unlike."""
    usual = {k: (lo, hi) for k, _, lo, hi in reprs}
    margin = boundary * max((hi for _, hi in usual.values()), default=0)
    oriented = {(k, s): (revcomp(u) if s else u) for k, u, _, _ in reprs for s in (0, 1) if u}
    free = bytearray(seq, "utf-8")
    claimed: list[tuple] = []
    queue: list[tuple[float, tuple[int, int], int, int, int]] = []  # the last: how many claims the hit knows of

    def look(key: tuple[int, int]) -> None:
        hit = align(oriented[key], free.decode(), "glocal")
        if hit.diff < max_diff and hit.t_end > hit.t_start:
            heappush(queue, (hit.diff, key, hit.t_start, hit.t_end, len(claimed)))

    for key in oriented:
        look(key)
    strand = 0
    while queue:
        equal = [heappop(queue)]
        while queue and queue[0][0] == equal[0][0]:
            equal.append(heappop(queue))
        touched = [any(s < end and start < e for s, e, *_ in claimed[known:]) for _, _, start, end, known in equal]
        stale, fresh = ([hit for hit, t in zip(equal, touched, strict=True) if t is wanted] for wanted in (True, False))
        for hit in stale:
            look(hit[1])
        if stale:  # they may now be as good as those that are left
            for hit in fresh:
                heappush(queue, hit)
            continue
        hit = min(fresh, key=lambda x: (x[1][1] != strand, x[1]))
        for other in fresh:
            if other is not hit:
                heappush(queue, other)
        diff, (k, strand), start, end, _ = hit
        claimed.append((start, end, end - start, k, round(diff, 3), strand, span_kind(start, end, len(seq), margin, diff, noisy, usual[k])))
        free[start:end] = MASK * (end - start)
        look((k, strand))
    return sorted(claimed)


def encode_reads(reads: DataFrame, reprs: list[tuple[int, str, int, int]], **options: float) -> DataFrame:
    """ENCODINGS of all reads; the representatives of an analysis are a handful and travel with the function."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, *x) for i, s in zip(frame["read_id"], frame["seq"], strict=True) if s for x in encode_read(s, reprs, **options)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in ENCODINGS.split(", ")])

    return reads.select("read_id", "seq").mapInPandas(run, ENCODINGS)


def encode_with(reads: DataFrame, **options: float) -> DataFrame:
    """ENCODINGS of reads that bring representatives of their own: `reprs`, an array of (repr_id, seq, low, high)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            own = ([(int(r["repr_id"]), r["seq"], int(r["low"]), int(r["high"])) for r in rs] for rs in frame["reprs"])
            rows = [(i, *x) for i, s, rs in zip(frame["read_id"], frame["seq"], own, strict=True) if s for x in encode_read(s, rs, **options)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in ENCODINGS.split(", ")])

    return reads.select("read_id", "seq", "reprs").mapInPandas(run, ENCODINGS)


def cover_rates(encodings: DataFrame, reads: DataFrame) -> DataFrame:
    sums = encodings.groupBy("read_id").agg(F.sum("length").alias("covered"))
    return reads.join(sums, "read_id").select("read_id", F.round(F.col("covered") / F.length("seq"), 2).alias("cover_rate"))


def detect_variants(units: DataFrame, reprs: DataFrame, least_fraction: float = 0.1) -> DataFrame:
    """(repr_id, pos, place, op, base, n, fraction) of differences that enough of a representative's units have.
    units: repr_id, unit_seq; reprs: repr_id, seq. Equal units are aligned once, counts are partial sums."""
    counted = units.groupBy("repr_id", "unit_seq").agg(F.count(F.lit(1)).alias("n"))
    counts = pile(counted.filter("unit_seq IS NOT NULL"), reprs, ["repr_id"], "unit_seq", "seq")
    totals = units.groupBy("repr_id").agg(F.count(F.lit(1)).alias("total"))
    return counts.join(totals, "repr_id").withColumn("fraction", F.col("n") / F.col("total")).filter(F.col("fraction") >= least_fraction).drop("total")


def complete_units(encodings: DataFrame, reads: DataFrame, compressed: bool = False) -> DataFrame:
    """Complete encodings with the unit_seq that each covers, on the strand of its representative; with `compressed`, without
    repeated bases. Null where the read isn't given."""
    own = encodings.filter("type = 'complete'").join(reads.select("read_id", F.col("seq").alias("read_seq")), "read_id", "left")
    cut = subseq("read_seq", "start", "end")
    cut = F.when(F.col("strand") == 1, turned(cut)).otherwise(cut)
    return own.withColumn("unit_seq", homopolymer_compressed(cut) if compressed else cut).drop("read_seq")


def variant_columns(units: DataFrame, reprs: DataFrame, least_fraction: float = 0.1) -> DataFrame:
    """The variants of detect_variants, numbered within each representative by place as `col`, from 0. They are no more than
    places of the representative divided by the fraction, so one task can number them."""
    order = Window.partitionBy("repr_id").orderBy("pos", "place", "op", "base")
    return detect_variants(units, reprs, least_fraction).withColumn("col", F.row_number().over(order) - 1)


def variant_lists(units: DataFrame, reprs: DataFrame, columns: DataFrame) -> DataFrame:
    """(repr_id, unit_seq, n, cols): the variants of each distinct unit of a representative, in order, and how many units are
    like it: the sparse rows of the matrix of units and variants. Units of representatives that aren't given have no row."""
    counted = units.filter("unit_seq IS NOT NULL").groupBy("repr_id", "unit_seq").agg(F.count(F.lit(1)).alias("n"))
    each = dealt_join(counted, reprs.select("repr_id", "seq"), ["repr_id"], SHARE)
    at = ["repr_id", "pos", "place", "op", "base"]
    found = each.select("repr_id", "unit_seq", "n", F.explode_outer(variant_list("seq", "unit_seq")).alias("v")).select("repr_id", "unit_seq", "n", "v.*")
    numbered = found.join(columns.select(*at, "col"), at, "left")
    return numbered.groupBy("repr_id", "unit_seq", "n").agg(F.sort_array(F.collect_list("col")).alias("cols"))


def variant_vectors(encodings: DataFrame, reads: DataFrame, reprs: DataFrame, least_fraction: float = 0.1, compressed: bool = False) -> DataFrame:
    """encodings with var_vec, for each variant of the representative 1 if the unit has it, else 0; of a representative without
    variants, one 0. Null for encodings that aren't complete, and where the read or the representative isn't given.
    reprs: repr_id, seq. Equal units of a representative are aligned once."""
    if compressed:
        reprs = reprs.withColumn("seq", homopolymer_compressed("seq"))
    units = kept(complete_units(encodings, reads, compressed))
    columns = kept(variant_columns(units.filter("unit_seq IS NOT NULL"), reprs, least_fraction))  # fractions of the units at hand
    widths = columns.groupBy("repr_id").agg(F.count(F.lit(1)).cast("int").alias("width"))
    lists = variant_lists(units, reprs, columns).join(widths, "repr_id", "left")
    dense = F.transform(F.sequence(F.lit(0), F.coalesce("width", F.lit(1)) - 1), lambda c: F.array_contains("cols", c).cast("int"))
    vectors = kept(lists.select("repr_id", "unit_seq", dense.alias("var_vec")))
    known = dealt_join(units.filter("unit_seq IS NOT NULL"), vectors, ["repr_id", "unit_seq"], 50 * SHARE)
    unknown = units.join(vectors.select("repr_id").distinct(), "repr_id", "left_anti").union(units.filter("unit_seq IS NULL").join(vectors.select("repr_id").distinct(), "repr_id", "left_semi"))
    rest = encodings.filter("type <> 'complete' OR type IS NULL").unionByName(unknown.drop("unit_seq"))
    return known.select(*encodings.columns, "var_vec").unionByName(rest.withColumn("var_vec", F.lit(None).cast("array<int>")))


def variant_linkage(lists: DataFrame) -> DataFrame:
    """(repr_id, col_a, col_b, n_a, n_b, n_both, total, r2) of variants a < b that some unit has together; r2 is the squared
    correlation of having them, null where all units have one. lists: rows of variant_lists. The pairs of a distinct unit
    are as many as its variants allow, and are counted with partial sums."""
    totals = lists.groupBy("repr_id").agg(F.sum("n").alias("total"))
    singles = lists.select("repr_id", "n", F.explode("cols").alias("col")).groupBy("repr_id", "col").agg(F.sum("n").alias("m"))
    first = lists.select("repr_id", "n", "cols", F.explode("cols").alias("col_a"))
    pairs = first.select("repr_id", "n", "col_a", F.explode(F.filter("cols", lambda c: c > F.col("col_a"))).alias("col_b"))
    both = pairs.groupBy("repr_id", "col_a", "col_b").agg(F.sum("n").alias("n_both")).join(totals, "repr_id")
    for x in "ab":
        both = both.join(singles.select("repr_id", F.col("col").alias(f"col_{x}"), F.col("m").alias(f"n_{x}")), ["repr_id", f"col_{x}"])
    share = lambda c: F.col(c) / F.col("total")
    spread_of = lambda c: share(c) * (1 - share(c))
    gap = share("n_both") - share("n_a") * share("n_b")
    r2 = F.when((F.col("n_a") < F.col("total")) & (F.col("n_b") < F.col("total")), gap * gap / (spread_of("n_a") * spread_of("n_b")))
    return both.select("repr_id", "col_a", "col_b", "n_a", "n_b", "n_both", "total", F.round(r2, 6).alias("r2"))
