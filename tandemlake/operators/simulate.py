"""Simulated reads as tables: rows are made by tasks, each from a generator seeded with its own id."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from random import Random

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tandemlake.functions import simulate as sim


def reads_of(spark: SparkSession, genome: str, depth: int = 10, length: int = 10000, error_rate: float = 1.0, seed: int = 111) -> DataFrame:
    """len(genome) * depth // length reads: read_id, name, strand, seq, length and the true start."""
    shared = spark.sparkContext.broadcast(genome)  # a simulated genome, bounded by the driver that made it

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i in frame["id"]:
                seq, start, strand = sim.sampled_read(Random(f"{seed}:{i}"), shared.value, length, error_rate)
                rows.append((i, f"sim/{i}", 0, seq, len(seq), start, strand))
            yield pd.DataFrame(rows, columns=["read_id", "name", "strand", "seq", "length", "true_start", "true_strand"])

    return spark.range(len(genome) * depth // length).mapInPandas(run, "read_id long, name string, strand tinyint, seq string, length int, true_start int, true_strand int")


@lru_cache(maxsize=4)
def hetero_genome(seed: str, unit_len: int, n_copy: int, mutate_rate: float, flank: int) -> str:
    return sim.hetero_repeat(Random(seed), unit_len, n_copy, mutate_rate, flank)


def reads_of_genomes(
    spark: SparkSession, genomes: int, unit_len: int = 300, n_copy: int = 30, mutate_rate: float = 4.0, flank: int = 1500, depth: int = 8, length: int = 5000, error_rate: float = 0.0, seed: int = 111
) -> DataFrame:
    """Reads of `genomes` heterogeneous repeats: read_id, genome, seq, length. Tasks make the genomes themselves, each from
    its own number, so nothing grows on the driver."""
    each = max(1, (unit_len * n_copy + 2 * flank) * depth // length)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i in frame["id"]:
                genome = hetero_genome(f"{seed}:{i // each}", unit_len, n_copy, mutate_rate, flank)
                seq, _, _ = sim.sampled_read(Random(f"{seed}:read:{i}"), genome, length, error_rate)
                rows.append((i, i // each, seq, len(seq)))
            yield pd.DataFrame(rows, columns=["read_id", "genome", "seq", "length"])

    return spark.range(genomes * each).mapInPandas(run, "read_id long, genome long, seq string, length int")


def tandem_reads(
    spark: SparkSession, n_seq: int, unit_len: int = 350, n_copy: int = 12, weights: tuple[float, float, float, float] = (98.0, 1.0, 0.5, 0.5), prefix: int = 1000, suffix: int = 1000, seed: int = 111
) -> DataFrame:
    """Reads that hold one homogeneous repeat each, with its unit."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, f"tandem/{i}", 0, *sim.homo_repeat(Random(f"{seed}:{i}"), unit_len, n_copy, weights, prefix, suffix)) for i in frame["id"]]
            yield pd.DataFrame(rows, columns=["read_id", "name", "strand", "seq", "unit"]).assign(length=lambda f: f["seq"].str.len().astype("int32"))

    return spark.range(n_seq).mapInPandas(run, "read_id long, name string, strand tinyint, seq string, unit string, length int")
