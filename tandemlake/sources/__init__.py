"""Readers and writers: FASTA, Parquet stages, tab-separated tables, alignment listings and TOML options."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemlake.functions.kernels import text_cigar


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, name, strand, seq, length): records split at `>` by the reader itself, so files split over
    tasks; names must not hold one. An id is a hash of name and sequence, the same however the files are split."""
    records = spark.read.option("lineSep", ">").text(path).filter("length(trim(value)) > 0")
    name, body = F.regexp_extract("value", r"^([^\r\n]*)", 1), F.regexp_replace("value", r"^[^\r\n]*", "")
    rows = records.select(name.alias("name"), F.regexp_replace(body, r"\s", "").alias("seq"))
    return rows.select(F.xxhash64("name", "seq").alias("read_id"), "name", F.lit(0).cast("tinyint").alias("strand"), "seq", F.length("seq").alias("length"))


def fasta_lines(reads: DataFrame, width: int = 100) -> DataFrame:
    """One text column with a record for each read; reads on the reverse strand are marked `_rc`."""
    name = F.concat(F.lit(">"), F.coalesce("name", F.col("read_id").cast("string")), F.when(F.col("strand") == 1, "_rc").otherwise(""))
    body = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    return reads.select(F.concat(name, F.lit("\n"), body).alias("value"))


def write_fasta(reads: DataFrame, path: str, width: int = 100) -> None:
    fasta_lines(reads, width).write.text(path)


def read_range(reads: DataFrame, start: int, end: int) -> DataFrame:
    """Reads of an id range, both ends included; the bounds reach the Parquet scan."""
    return reads.filter(F.col("read_id").between(start, end))


def write_stage(df: DataFrame, path: str, by: str | None = None, blocks: int | None = None, block_bases: int | None = None) -> DataFrame:
    """Writes a stage's table and reads it back; `by` clusters rows of a key, `blocks` bounds the number of files. With
    `block_bases` there are as many files as the lengths of all reads need, of about that many bases each."""
    if block_bases:
        blocks = max(1, -(-(df.agg(F.sum("length")).first()[0] or 0) // block_bases))
    if by:
        df = df.repartition(blocks, by) if blocks else df.repartition(by)
    elif blocks:
        df = df.repartition(blocks)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A tab-separated table with a header; give the schema to spare a pass over the file."""
    reader = spark.read.option("sep", "\t").option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def repeat_reads(reads: DataFrame, repeats: DataFrame, alignments: DataFrame, return_all: bool = False) -> DataFrame:
    """Reads with their repeat intervals and self-alignments as arrays; only reads that have an interval unless
    return_all. Alignments are in order of (distance, ab)."""
    intervals = repeats.groupBy("read_id").agg(F.sort_array(F.collect_list(F.struct("tr_ord", "start", "end"))).alias("trs"))
    paired = F.struct((F.col("ab") - F.col("bb")).alias("distance"), "ab", "ae", "bb", "be", "cigar")
    grouped = alignments.groupBy("read_id").agg(F.sort_array(F.collect_list(paired)).alias("alignments"))
    out = reads.join(intervals, "read_id", "left" if return_all else "inner").join(grouped, "read_id", "left")
    empty = lambda c: F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c)
    return out.select(*reads.columns, empty("trs"), empty("alignments"))


def aligned_paths(chosen: DataFrame, listing: DataFrame) -> DataFrame:
    """chosen (read_id, ab, ae, bb, be and more) with the cigar of each alignment, from a listing that shows them as text:
    the same keys, a_text, symbols and b_text. Only the paths of chosen alignments are made."""
    keys = ["read_id", "ab", "ae", "bb", "be"]
    shown = listing.select(*keys, "a_text", "symbols", "b_text")
    return chosen.drop("cigar").join(shown, keys).withColumn("cigar", text_cigar("a_text", "symbols", "b_text")).drop("a_text", "symbols", "b_text")


@dataclass(frozen=True)
class Options:
    """Settings of a run, from a TOML file; unknown sections are kept in `other`."""

    db_prefix: str
    peaks: dict = field(default_factory=dict)
    overlaps: dict = field(default_factory=dict)
    clustering: dict = field(default_factory=dict)
    other: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str | Path) -> Options:
        found = tomllib.loads(Path(path).read_text())
        if "db_prefix" not in found:
            raise ValueError("db_prefix is required")
        known = {k: found.pop(k, {}) for k in ("peaks", "overlaps", "clustering")}
        return cls(db_prefix=found.pop("db_prefix"), other=found, **known)
