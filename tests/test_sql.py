"""SQL names of the kernels against the functions that they stand for."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tandemlake.functions import sequences
from tandemlake.functions.align import align
from tandemlake.functions.consensus import variants
from tandemlake.functions.units import split_units
from tandemlake.operators import detect, encode
from tandemlake.operators.contigs import refine, slice_of
from tandemlake.operators.sql import register

UNIT = "acgtacgttgcagtca"


@pytest.fixture(scope="module")
def sql(spark):
    register(spark)
    register(spark)
    words = ["", "a", "aa", "acgacg", "acga", "aaccgt", "ACGTTT", "gattacagattaca", None]
    spark.createDataFrame([(k, w) for k, w in enumerate(words)], "id int, s string").createOrReplaceTempView("words_v")
    return spark.sql


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize(
    ("call", "column"),
    [
        ("revcomp(s)", lambda: sequences.revcomp("s")), ("kmers(s, 3)", lambda: sequences.kmers("s", 3)), ("homopolymer_compressed(s)", lambda: sequences.homopolymer_compressed("s")),
        ("is_tandem(s)", lambda: sequences.is_tandem("s")), ("can_be_query(s, 'acgta')", lambda: sequences.can_be_query(F.col("s"), F.lit("acgta"))),
    ],
)
def test_expressions(spark, sql, call, column):
    own = sql(f"select id, {call} as x from words_v")
    assert rows(own) == rows(spark.table("words_v").select("id", column().alias("x")))
    assert "Python" not in own._jdf.queryExecution().executedPlan().toString()


def test_unit_rows_equal_the_frame_form(spark, sql):
    cases = [(1, 4, 0, "=" * 12), (2, 5, 1, "==I====D=="), (3, None, 0, "=="), (4, 3, 0, None)]
    spark.createDataFrame(cases, "read_id long, ab int, bb int, cigar string").createOrReplaceTempView("alignments_v")
    found = rows(sql("select a.read_id, u.* from alignments_v a, lateral unit_rows(a.ab, a.bb, a.cigar) u"))
    assert found == sorted(((i, k, s, e) for i, a, b, c in cases if None not in (a, b, c) for k, (s, e) in enumerate(split_units(a, b, c))), key=str) and found
    good = spark.table("alignments_v").filter("ab is not null and cigar is not null")
    assert found == rows(good.select("read_id", F.posexplode(detect.unit_splits("ab", "bb", "cigar")).alias("k", "u")).select("read_id", "k", "u.start", "u.end"))


def test_variant_rows_can_be_counted(spark, sql):
    seqs = ["acgtacgt", "acgtcgt", "acggtacgt", "tcgtacgt", "acgtacgt", None]
    spark.createDataFrame([(s,) for s in seqs], "s string").createOrReplaceTempView("seqs_v")
    found = rows(sql("select v.*, count(*) as n from seqs_v, lateral variant_rows('acgtacgt', s) v group by all"))
    counted: dict = {}
    for s in seqs:
        for v in variants("acgtacgt", s) if s is not None else ():
            counted[v] = counted.get(v, 0) + 1
    assert found == sorted(((*v, n) for v, n in counted.items()), key=str) and len(found) >= 3
    assert sql("select * from variant_rows('acgt', cast(null as string))").count() == 0


def test_encoding_rows_equal_encode_with(spark, sql):
    reads = [(1, "tt" + UNIT * 3 + "gg"), (2, UNIT[:8]), (3, ""), (4, None)]
    reprs = spark.createDataFrame([(0, UNIT, 14, 18)], "repr_id int, seq string, low int, high int").groupBy().agg(F.collect_list(F.struct("repr_id", "seq", "low", "high")).alias("reprs"))
    given = spark.createDataFrame(reads, "read_id long, seq string").join(reprs)
    given.createOrReplaceTempView("reads_v")
    found = rows(sql("select r.read_id, e.* from reads_v r, lateral encoding_rows(r.seq, r.reprs) e"))
    assert found == rows(encode.encode_with(given)) and len(found) >= 3


def test_contig_kernels(sql):
    contig = UNIT * 4 + "ccattg" + UNIT[::-1] * 4
    read = contig[20:110]
    start, end, part, cigar = refine(contig, 18, read)
    found = sql(f"select refine_mapping('{contig}', 18, '{read}') as r, window_part('{cigar}', {start}, 40, 60, '{part}') as w, refine_mapping(cast(null as string), 1, 'a') as x, window_part('=', 0, 0, 1, cast(null as string)) as y").first()
    assert tuple(found["r"]) == (start, end, part, cigar) and found["w"] == slice_of(cigar, start, 40, 60, part) == contig[40:60]
    assert found["y"] is None and (found["x"] is None or found["x"]["start"] is None)
    assert sql("select align_glocal('acgt', 'ttacgttt').n_diff as n").first()["n"] == align("acgt", "ttacgttt", "glocal").n_diff
