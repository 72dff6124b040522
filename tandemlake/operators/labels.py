"""Overlaps of reads whose units are labelled with representative units."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemlake.functions.kernels import aligner, dovetailed
from tandemlake.functions.kmers import ranges, starts_of
from tandemlake.operators.components import computed, spread
from tandemlake.schemas import OVERLAP_COLUMNS


def repr_alignments(repr_units: DataFrame) -> DataFrame:
    """(target_id, i, j, aln_len, n_diff) of every two representative units of a target, both ways; few for each target."""
    left = repr_units.select("target_id", F.col("repr_id").alias("i"), F.col("seq").alias("x"))
    right = repr_units.select("target_id", F.col("repr_id").alias("j"), F.col("seq").alias("y"))
    half = left.join(right, "target_id").filter("i <= j").withColumn("r", aligner("global")("x", "y")).select("target_id", "i", "j", "r.aln_len", "r.n_diff")
    return half.union(half.filter("i < j").select("target_id", F.col("j"), F.col("i"), "aln_len", "n_diff"))


#: Units of one block of a target's reads, about; two blocks meet in one row.
BLOCK_UNITS = 768
#: Pairs of units that numpy takes at once: many rows of small targets, or one row.
STEP = 1 << 20
_DIFFS = "target_id long, a_read_id long, b_read_id long, shift int, diff double"


class Side(NamedTuple):
    """Units of one side of several rows, each row's by read: row, read, place and label of each; and the rows' starts."""

    row: np.ndarray
    read: np.ndarray
    ord: np.ndarray
    label: np.ndarray

    @property
    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the reads begin, and the number of each unit's read."""
        begins = starts_of(self.row, self.read)
        return begins, np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(self.row))))


def _diagonals(a: Side, b: Side, known: tuple[np.ndarray, ...], same: np.ndarray, min_units: int) -> tuple[np.ndarray, ...]:
    """(row, a read, b read, shift, diff) of rows of two blocks each, all at once. known is (row, i, j, length, differences); same tells rows
    whose two blocks are one. Units of every two reads are paired as numbers, which are summed by read, read and shift."""
    rows = np.arange(len(same) + 1)
    code = lambda row, label: row << 32 | (label.astype(np.int64) + (1 << 31))
    labels, place = np.unique(np.concatenate((code(known[0], known[1]), code(known[0], known[2]))), return_inverse=True)
    first = np.searchsorted(labels, rows << 32)
    many = np.diff(first)
    table = np.concatenate(([0], np.cumsum(many * many)))
    at = lambda row, i, j: table[row] + (i - first[row]) * many[row] + j - first[row]
    lengths, diffs = np.zeros(table[-1], np.int64), np.zeros(table[-1], np.int64)
    spot = at(known[0], place[: len(known[0])], place[len(known[0]) :])
    lengths[spot], diffs[spot] = known[3], known[4]

    def usable(x: Side) -> tuple[Side, np.ndarray]:
        """Units with a known label in reads of min_units, with the labels' places, and numbers of units of the reads."""
        begins, number = x.groups
        sizes = np.diff(np.append(begins, len(number)))[number]
        found = np.minimum(np.searchsorted(labels, code(x.row, x.label)), max(len(labels) - 1, 0))
        use = (labels[found] == code(x.row, x.label)) & (sizes >= min_units) if len(labels) else np.zeros(len(number), bool)
        return Side(x.row[use], x.read[use], x.ord[use].astype(np.int64), found[use]), sizes[use]

    (a, a_sizes), (b, b_sizes) = usable(a), usable(b)
    if not len(a.row) or not len(b.row):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0),)
    (a_begins, x), (b_begins, y) = a.groups, b.groups
    a_first, b_first = np.searchsorted(a.row, rows), np.searchsorted(b.row, rows)
    # of one block with itself a read meets those behind it
    behind = np.append(a_begins[1:], len(a.row))[x] - a_first[a.row] + b_first[a.row]
    begin = np.where(same[a.row], behind, b_first[a.row])
    counts = b_first[a.row + 1] - begin
    i, j = np.repeat(np.arange(len(a.row)), counts), ranges(begin, counts)
    later = a.read[i] > b.read[j]  # the first read of a pair is the one with the lower id
    row = a.row[i]
    spot = at(row, np.where(later, b.label[j], a.label[i]), np.where(later, a.label[i], b.label[j]))
    n = lengths[spot]
    met = (n > 0) & (a.read[i] != b.read[j])
    i, j, n, spot = i[met], j[met], n[met], spot[met]
    if not len(i):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0),)

    shift = a.ord[i] - b.ord[j]
    pair = x[i] * len(b_begins) + y[j]
    order = np.argsort(pair, kind="stable")
    i, j, n, spot, shift, pair = i[order], j[order], n[order], spot[order], shift[order], pair[order]
    begins = starts_of(pair)
    low, high = np.minimum.reduceat(shift, begins), np.maximum.reduceat(shift, begins)
    base = np.concatenate(([0], np.cumsum(high - low + 1)))
    of = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(pair))))
    slot = base[of] + shift - low[of]
    if base[-1] > 8 * len(slot):  # places far apart
        found, slot = np.unique(slot, return_inverse=True)
        total = np.bincount(slot, n, len(found))
        unlike = np.bincount(slot, diffs[spot], len(found))
    else:
        total = np.bincount(slot, n, base[-1])
        found = np.flatnonzero(total)
        total, unlike = total[found], np.bincount(slot, diffs[spot], base[-1])[found]
    own = np.searchsorted(base, found, "right") - 1
    i, j, shift = i[begins[own]], j[begins[own]], found - base[own] + low[own]
    turned = a.read[i] > b.read[j]
    shift = np.where(turned, -shift, shift)
    nf, ns = np.where(turned, b_sizes[j], a_sizes[i]), np.where(turned, a_sizes[i], b_sizes[j])
    allowed = (shift >= min_units - ns) & (shift <= nf - min_units)
    pairs = np.where(turned, b.read[j], a.read[i]), np.where(turned, a.read[i], b.read[j])
    return a.row[i][allowed], *(r[allowed] for r in pairs), shift[allowed], (unlike / total)[allowed]


def diagonal_diffs(units: DataFrame, distances: DataFrame, min_units: int = 3, less_than: float | None = None) -> DataFrame:
    """(target_id, a_read_id, b_read_id, shift, diff): for reads a < b of a target and every shift that pairs min_units or
    more of their units, the share of differing columns over all pairs; with less_than only where it is less.
    units: target_id, read_id, unit_ord, repr_id. Pairs of labels that distances lacks count for nothing.

    A target's reads are dealt into blocks of about BLOCK_UNITS units. Every two blocks meet in a row of their own, on
    which numpy sums the diagonals; so there is no row for each pair of units, and a deep target is many tasks' work."""
    sizes = units.groupBy("target_id").agg(F.count(F.lit(1)).alias("n")).select("target_id", F.ceil(F.col("n") / BLOCK_UNITS).cast("int").alias("blocks"))
    placed = units.join(sizes, "target_id").withColumn("block", F.pmod(F.xxhash64("read_id"), F.col("blocks")).cast("int"))
    unit = F.struct(F.col("read_id").cast("long").alias("r"), F.col("unit_ord").cast("int").alias("o"), F.col("repr_id").cast("int").alias("l"))
    packed = placed.groupBy("target_id", "blocks", "block").agg(F.sort_array(F.collect_list(unit)).alias("u"))
    arrays = lambda x: [F.col(f"u.{f}").alias(f"{x}{f}") for f in "rol"]
    others = F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("j")
    a = packed.select("target_id", F.col("block").alias("i"), others, *arrays("a"))
    earlier = F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i")
    b = packed.select("target_id", earlier, F.col("block").alias("j"), *arrays("b"))
    known = distances.groupBy("target_id").agg(F.collect_list(F.struct(*(F.col(c).cast("int").alias(c) for c in ("i", "j", "aln_len", "n_diff")))).alias("k"))
    known = known.select("target_id", *(F.col(f"k.{c}").alias(f"k_{c}") for c in ("i", "j", "aln_len", "n_diff")))
    rows = spread(a.join(b, ["target_id", "i", "j"]), "target_id", "i", "j").join(known, "target_id")
    rows = rows.select(F.col("target_id").cast("long").alias("target_id"), *(c for c in rows.columns if c != "target_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = {c: batch.column(c) for c in batch.schema.names if c not in ("target_id", "i", "j")}
            flat = {c: x.flatten().to_numpy(zero_copy_only=False) for c, x in lists.items()}
            ends = {c: np.concatenate(([0], np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False)))) for c, x in lists.items()}
            targets, same = batch.column("target_id").to_numpy(), batch.column("i").to_numpy() == batch.column("j").to_numpy()
            work = np.cumsum(np.diff(ends["ar"]) * np.diff(ends["br"]))
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(work, (work[first - 1] if first else 0) + STEP, "right")))
                part = {c: x[ends[c][first] : ends[c][last]] for c, x in flat.items()}
                row = {c: np.repeat(np.arange(last - first), np.diff(ends[c][first : last + 1])) for c in ("ar", "br", "k_i")}
                a, b = (Side(row[f"{x}r"], *(part[f"{x}{f}"] for f in "rol")) for x in "ab")
                t, *found = _diagonals(a, b, (row["k_i"], *(part[f"k_{c}"] for c in ("i", "j", "aln_len", "n_diff"))), same[first:last], min_units)
                found = [targets[first:last][t], found[0], found[1], found[2].astype(np.int32), found[3]]
                if less_than is not None:
                    found = [x[found[-1] < less_than] for x in found]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], [c.split()[0] for c in _DIFFS.split(", ")])
                first = last

    return rows.mapInArrow(run, _DIFFS)


def labelled_overlaps(units: DataFrame, reads: DataFrame, repr_units: DataFrame, min_units: int = 3, max_units_diff: float = 0.01, max_seq_diff: float = 0.02) -> DataFrame:
    """Overlaps of labelled reads. units: schemas.LABELED_UNITS; reads: target_id, read_id, strand, seq, length as oriented
    for the target. diff is that of the labels. The result has a forward, is distinct, and reads overlap once for each shift."""
    found = diagonal_diffs(units, repr_alignments(repr_units), min_units, max_units_diff)
    ends = found.withColumns({"a_ord": F.greatest("shift", F.lit(0)), "b_ord": F.greatest(-F.col("shift"), F.lit(0))})
    for x in "ab":
        place = units.select("target_id", F.col("read_id").alias(f"{x}_read_id"), F.col("unit_ord").alias(f"{x}_ord"), F.col("start").alias(f"{x}_pos"))
        own = reads.select("target_id", F.col("read_id").alias(f"{x}_read_id"), F.col("strand").alias(f"{x}_strand"), F.col("seq").alias(f"{x}_seq"), F.col("length").alias(f"{x}_len"))
        ends = ends.join(place, ["target_id", f"{x}_read_id", f"{x}_ord"]).join(own, ["target_id", f"{x}_read_id"])
    rows = computed(spread(ends, "target_id", "a_read_id", "b_read_id", "shift"), "r", dovetailed("a_seq", "b_seq", "a_pos", "b_pos")).filter(F.col("r").isNotNull() & (F.col("r.n_diff") / F.col("r.aln_len") < max_seq_diff))
    turned = F.col("a_strand") == 1
    place = lambda x, e, other: F.when(turned, F.col(f"{x}_len") - F.col(f"r.{x}_{other}")).otherwise(F.col(f"r.{x}_{e}")).alias(f"{x}_{e}")
    out = rows.select(
        "a_read_id", "b_read_id", F.expr("cast(a_strand ^ b_strand as int)").alias("strand"), place("a", "start", "end"), place("a", "end", "start"), "a_len",
        place("b", "start", "end"), place("b", "end", "start"), "b_len", F.round(100 * F.col("diff"), 2).alias("diff"),
    )
    return out.select(*OVERLAP_COLUMNS).distinct()
