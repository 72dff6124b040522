"""Re-labelling of the units around each target read: synchronisation and clustering, one bounded group at a time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemlake.functions.clustering import SplitMerge, representatives, synchronize
from tandemlake.functions.consensus import consensus
from tandemlake.functions.sequences import revcomp, subseq
from tandemlake.operators.components import spread
from tandemlake.operators.overlaps import neighbours

_SYNCED = "target_id long, read_id long, strand int, unit_ord int, start int, end int, repr_id int"


def involved(overlaps: DataFrame, reads: DataFrame) -> DataFrame:
    """(target_id, read_id, strand, seq, length): each target's reads, oriented like the target; so are their `quals`, if reads have them."""
    near = neighbours(overlaps).select(F.col("read_id").alias("target_id"), F.col("other_id").alias("read_id"), F.col("strand").cast("int").alias("strand"))
    quals = ["quals"] if "quals" in reads.columns else []
    joined = near.join(reads.select("read_id", "seq", "length", *quals), "read_id")
    turned = lambda name, other: F.when(F.col("strand") == 1, other(name)).otherwise(F.col(name)).alias(name)
    return joined.select("target_id", "read_id", "strand", turned("seq", revcomp), "length", *(turned(q, F.reverse) for q in quals))


def synchronized(overlaps: DataFrame, units: DataFrame, reads: DataFrame, ward_threshold: float = 0.15, map_threshold: float = 0.1, compat: bool = False) -> DataFrame:
    """Units (schemas.LABELED_UNITS) of each target's reads in the phase of representatives, which are made from the
    target's own units. A group is a target with the reads that overlap it: as many as the depth of sequencing."""
    own = units.join(reads.select("read_id", "seq"), "read_id").select(F.col("read_id").alias("target_id"), "unit_ord", subseq("seq", "start", "end").alias("unit"))
    mates = involved(overlaps, reads)

    def run(key: tuple, cut: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        reprs = representatives(cut.sort_values("unit_ord")["unit"].tolist(), ward_threshold) if len(cut) else {}
        rows = []
        for r in near.sort_values(["read_id", "strand"]).itertuples():
            rows += [(key[0], r.read_id, r.strand, n, s, e, k) for n, (s, e, k) in enumerate(synchronize(r.seq, reprs, map_threshold, compat))]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in _SYNCED.split(", ")])

    own, mates = spread(own, "target_id"), spread(mates, "target_id")
    return own.groupBy("target_id").cogroup(mates.groupBy("target_id")).applyInPandas(run, _SYNCED)


def clustered(synced: DataFrame, mates: DataFrame, ward_threshold: float = 0.01, alpha: float = 1.0) -> DataFrame:
    """synced with repr_id replaced by the cluster of each unit and its consensus as repr_seq. The sampler is seeded with
    the target's id, so a lost task that runs again gives the same labels. Where mates have `quals` (array<int>, a value for
    each base), they weigh the bases of the units."""
    has_quals = "quals" in mates.columns
    cut = synced.drop("repr_id").join(mates, ["target_id", "read_id", "strand"]).withColumn("unit", subseq("seq", "start", "end")).drop("seq", "length")
    if has_quals:
        cut = cut.withColumn("quals", F.slice("quals", F.col("start") + 1, F.col("end") - F.col("start")))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["read_id", "strand", "unit_ord"]).reset_index(drop=True)
        units = frame["unit"].tolist()
        quals = [list(map(int, q)) for q in frame["quals"]] if has_quals else None
        labels = SplitMerge(units, quals, alpha, int(frame["target_id"].iloc[0])).run(ward_threshold)
        cons = {k: consensus(sorted(u for u, x in zip(units, labels, strict=True) if x == k), "median") for k in set(labels)}
        return frame.drop(columns=["unit", *(["quals"] if has_quals else [])]).assign(repr_id=labels, repr_seq=[cons[k] for k in labels])

    return spread(cut, "target_id").groupBy("target_id").applyInPandas(run, _SYNCED + ", repr_seq string")


def repr_units(labels: DataFrame) -> DataFrame:
    return labels.select("target_id", "repr_id", F.col("repr_seq").alias("seq")).distinct()
