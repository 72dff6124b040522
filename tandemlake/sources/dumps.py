"""Readers of the text dumps that hold reads, repeat intervals and self-alignments: sequences in FASTA, and records of one-letter lines.

A record begins with a line of its own kind (`R` for a read, `P` for an alignment), which is what the text reader splits at; so
Spark cuts large files into byte ranges anywhere, from any store, and a record comes whole to one task. All parsing is in
SQL expressions. Listings of alignments have no such mark: each file is one row, so a file should list a block of reads.

Defined results: lines of other kinds are passed over; a record without the lines asked for has no rows; an empty file gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemlake.sources import aligned_paths, read_fasta, repeat_reads


def _records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """value: each record from behind its kind on. What a file has before the first record is none."""
    rows = spark.read.option("lineSep", f"\n{kind} ").text(path)
    own = F.regexp_replace("value", rf"\A{kind} ", "")  # at the begin of a file no line ends before it
    return rows.select(own.alias("value")).filter(F.col("value").rlike(r"\A\d"))


def _numbers(c: Column) -> Column:
    return F.transform(F.split(F.trim(c), r"\s+"), lambda x: x.try_cast("int"))


def read_db_dump(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, name, trs) of each `R` record: the header (from `H`, and well and pulses from `L`) and the repeat intervals of
    `T0` as an array of (tr_ord, start, end)."""
    line = lambda kind, rest: F.regexp_extract("value", rf"(?m)^{kind} {rest}$", 1)
    own = _records(spark, path, "R").select(
        F.regexp_extract("value", r"\A(\d+)", 1).try_cast("long").alias("read_id"), line("H", r"\d+ ([^\r\n]+)").alias("h"), line("L", r"([^\r\n]+)").alias("l"), line("T0", r"\d+((?: +\d+)*)").alias("t"),
    )
    place = _numbers(F.col("l"))
    name = F.when(F.col("l") == "", F.col("h")).otherwise(F.concat("h", F.lit("/"), place[0], F.lit("/"), place[1], F.lit("_"), place[2]))
    at = F.when(F.trim("t") == "", F.array().cast("array<int>")).otherwise(_numbers(F.col("t")))
    pairs = F.transform(F.filter(at, lambda x, k: k % 2 == 0), lambda x, k: F.struct(k.cast("int").alias("tr_ord"), x.alias("start"), F.get(at, 2 * k + 1).alias("end")))
    return own.select("read_id", name.alias("name"), pairs.alias("trs"))


def repeats_of_dump(dump: DataFrame) -> DataFrame:
    """(read_id, tr_ord, start, end)."""
    return dump.select("read_id", F.explode("trs").alias("t")).select("read_id", "t.*")


def read_alignment_dump(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, ab, ae, bb, be) of each `C` line, under the read of its `P` record."""
    spans = F.regexp_extract_all("value", F.lit(r"(?m)^C +(\d+ +\d+ +\d+ +\d+)\s*$"), F.lit(1))
    rows = _records(spark, path, "P").select(F.regexp_extract("value", r"\A(\d+)", 1).try_cast("long").alias("read_id"), F.explode(spans).alias("c"))
    at = _numbers(F.col("c"))
    return rows.select("read_id", *(at[k].alias(n) for k, n in enumerate(("ab", "ae", "bb", "be"))))


def read_alignment_listing(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, ab, ae, bb, be, a_text, symbols, b_text) of listed alignments: a header of seven numbers between tabs, then the
    three rows in turn, broken into lines of any width. Commas within numbers are left out."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", ",", "").alias("value"))
    each = files.select(F.explode(F.split("value", r"(?m)^(?=[^\n\t]*\t)")).alias("value")).filter(F.instr("value", "\t") > 0)
    head = F.transform(F.split(F.regexp_extract("value", r"\A([^\r\n]*)", 1), "\t"), lambda x: F.trim(x).try_cast("int"))
    lines = F.filter(F.split(F.regexp_replace("value", r"\A[^\n]*\n?", ""), r"\r?\n"), lambda x: x != "")
    row = lambda k: F.array_join(F.filter(F.col("lines"), lambda x, n: n % 3 == k), "")
    own = each.select(head.alias("h"), lines.alias("lines"))
    return own.select(
        F.get("h", F.lit(0)).cast("long").alias("read_id"), *(F.get("h", F.lit(k)).alias(n) for k, n in ((2, "ab"), (3, "ae"), (4, "bb"), (5, "be"))),
        row(0).alias("a_text"), row(1).alias("symbols"), row(2).alias("b_text"),
    )


def load_repeat_reads(spark: SparkSession, fasta: str, db_dump: str, alignment_dump: str, ids: tuple[int, int] | None = None, return_all: bool = False) -> DataFrame:
    """Reads with arrays of their repeats and self-alignments (see repeat_reads), from the three dumps; ids is a range, both ends
    included. Sequences find their numbers by the header that the database dump gives for each."""
    dump = read_db_dump(spark, db_dump)
    alignments = read_alignment_dump(spark, alignment_dump).withColumn("cigar", F.lit(None).cast("string"))
    if ids:
        dump, alignments = (x.filter(F.col("read_id").between(*ids)) for x in (dump, alignments))
    reads = read_fasta(spark, fasta).drop("read_id").withColumn("name", F.trim("name"))
    numbered = reads.join(dump.select("read_id", F.trim("name").alias("name")), "name")
    return repeat_reads(numbered.select("read_id", "name", "strand", "seq", "length"), repeats_of_dump(dump), alignments, return_all)


def load_paths(spark: SparkSession, chosen: DataFrame, listing: str) -> DataFrame:
    """chosen with the cigar of each alignment that the listing shows."""
    return aligned_paths(chosen, read_alignment_listing(spark, listing))
