"""Queries on the repeats that benchmark items spell, against the genomes that they come from and against brute force."""

from __future__ import annotations

from collections import Counter

import pytest

from tandemlake import plans
from tandemlake.functions.align import align, dovetail, revcomp
from tandemlake.functions.consensus import variants
from tandemlake.operators import encode
from tandemlake.operators.encode import encode_read
from tandemlake.plans import stand_ins as V


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("items")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").filter("length(text) > 160").orderBy("item_id").limit(3).write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.fixture(scope="module")
def reads(spark, folder):
    return {r["read_id"]: r for r in V.genome_reads(spark, folder).collect()}


@pytest.fixture(scope="module")
def genomes(spark, folder):
    return {r["item_id"]: r for r in V.genomes(spark, folder).collect()}


def test_reads_lie_in_their_genomes(reads, genomes):
    assert len(genomes) >= 2 and all(len(g["genome"]) == 2 * V.FLANK + V.COPIES * V.UNIT and set(g["genome"]) <= set("acgt") for g in genomes.values())
    for r in reads.values():
        seq = revcomp(r["seq"]) if r["true_strand"] else r["seq"]
        assert genomes[r["item_id"]]["genome"][r["true_start"] : r["true_start"] + V.READ] == seq


def test_units(spark, folder, reads):
    found: dict = {}
    for u in plans.QUERIES["item_units"](spark, folder).collect():
        found.setdefault(u["read_id"], []).append(u["ulen"])
    assert len(found) >= 0.8 * len(reads) and all(n == V.UNIT for ns in found.values() for n in ns)


def test_overlaps_equal_their_definition_and_the_truth(spark, folder, reads):
    """Every overlap is that of two sequences that differ by 2 % at most, and no long true overlap of reads with units is lost."""
    rows = plans.QUERIES["item_overlaps"](spark, folder).collect()
    for o in rows:
        a, b = reads[o["a_read_id"]]["seq"], reads[o["b_read_id"]]["seq"]
        b = revcomp(b) if o["strand"] else b
        found = align(a[o["a_start"] : o["a_end"]], b[o["b_start"] : o["b_end"]])
        assert o["a_read_id"] < o["b_read_id"] and 100 * found.n_diff <= 2.01 * found.length
        assert (o["a_start"] == 0 or o["b_start"] == 0) and (o["a_end"] == len(a) or o["b_end"] == len(b))
    exact = {(o["a_read_id"], o["b_read_id"], o["strand"], o["a_start"], o["a_end"]) for o in rows if o["diff"] == 0}
    units = {r["read_id"] for r in plans.QUERIES["item_units"](spark, folder).collect()}
    for i, x in reads.items():
        for j, y in reads.items():
            shift = y["true_start"] - x["true_start"]
            if i < j and x["item_id"] == y["item_id"] and {i, j} <= units and 0 < shift <= 260:
                span = (0, V.READ - shift) if x["true_strand"] else (shift, V.READ)
                assert (i, j, x["true_strand"] ^ y["true_strand"], *span) in exact


def test_labels_and_second_pass(spark, folder, reads):
    labels = plans.QUERIES["item_labels"](spark, folder).collect()
    by_target: dict = {}
    for u in labels:
        seq = reads[u["read_id"]]["seq"]
        seq = revcomp(seq) if u["strand"] else seq
        found = align(u["repr_seq"], seq[u["start"] : u["end"]])
        assert found.diff < 0.05
        by_target.setdefault((u["target_id"], u["repr_id"]), set()).add(u["repr_seq"])
    assert labels and all(len(x) == 1 for x in by_target.values())
    second = plans.QUERIES["item_labelled_overlaps"](spark, folder).collect()
    for o in second:
        a, b = reads[o["a_read_id"]]["seq"], reads[o["b_read_id"]]["seq"]
        b = revcomp(b) if o["strand"] else b
        assert dovetail(a, b, o["a_start"], o["b_start"]) is not None and align(a[o["a_start"] : o["a_end"]], b[o["b_start"] : o["b_end"]]).diff < 0.02
    assert second


def test_contigs_are_made_of_the_genomes(spark, folder, genomes):
    found = [r["seq"] for r in plans.QUERIES["item_contigs"](spark, folder).collect()]
    near = lambda s: min(align(x, g["genome"], "glocal").diff for g in genomes.values() for x in (s, revcomp(s))) if s else 0.0
    assert any(found) and max(map(near, found)) < 0.08


def test_encodings_equal_each_reads_own(spark, folder, reads, genomes):
    found = {tuple(r) for r in plans.QUERIES["item_encodings"](spark, folder).collect()}
    assert found == {(i, *x) for i, r in reads.items() for x in encode_read(r["seq"], [(0, genomes[r["item_id"]]["unit"], V.UNIT - 4, V.UNIT + 4)])}
    assert sum(x[-1] == "complete" for x in found) > 2 * len(reads)


def matrix(encodings, reads, reprs, least, squeeze=lambda s: s):
    """{encoding: vector} and {(repr, a, b): units that have both}, by plain loops; encodings as tuples of ENCODINGS."""
    own, counts, totals = {}, {}, Counter()
    for e in encodings:
        if e[7] == "complete":
            unit = reads[e[0]][e[1] : e[2]]
            own[e] = variants(reprs[e[4]], squeeze(revcomp(unit) if e[6] else unit))
            totals[e[4]] += 1
            counts.setdefault(e[4], Counter()).update(own[e])
    columns = {k: sorted(v for v, n in c.items() if n / totals[k] >= least) for k, c in counts.items()}
    vectors = {e: [int(v in vs) for v in columns[e[4]]] or [0] for e, vs in own.items()}
    both = Counter((e[4], a, b) for e, x in vectors.items() for a in range(len(x)) for b in range(a + 1, len(x)) if x[a] and x[b])
    return vectors, both


def test_variant_vectors_and_linkage_equal_a_plain_matrix(spark, folder, reads, genomes):
    found = [tuple(r) for r in plans.QUERIES["item_variant_vectors"](spark, folder).select(*(x.split()[0] for x in encode.ENCODINGS.split(", ")), "var_vec").collect()]
    vectors, both = matrix([r[:-1] for r in found], {i: r["seq"] for i, r in reads.items()}, {i: g["unit"] for i, g in genomes.items()}, 0.04)
    assert {r[:-1]: r[-1] for r in found if r[-1] is not None} == vectors and len(found) == plans.QUERIES["item_encodings"](spark, folder).count()
    assert max(map(len, vectors.values())) > 3 and any(map(any, vectors.values()))
    linked = plans.QUERIES["item_variant_linkage"](spark, folder).collect()
    assert {(r["repr_id"], r["col_a"], r["col_b"]): r["n_both"] for r in linked} == both
    for r in linked:
        xs, ys = zip(*((x[r["col_a"]], x[r["col_b"]]) for e, x in vectors.items() if e[4] == r["repr_id"]), strict=True)
        assert (r["n_a"], r["n_b"], r["total"]) == (sum(xs), sum(ys), len(xs))
        n, a, b, c = len(xs), sum(xs), sum(ys), r["n_both"]
        assert r["r2"] == (pytest.approx((n * c - a * b) ** 2 / (a * (n - a) * b * (n - b)), abs=1e-6) if a < n and b < n else None)


def test_variant_vectors_of_odd_rows(spark):
    """Missing reads and representatives, copies of one unit, no variants at all, and rows that aren't complete."""
    squeeze = lambda s: "".join(c for k, c in enumerate(s) if not k or s[k - 1] != c)
    reads = {1: "acgtacgtaagtacgg", 2: "ttttcccc"}
    rows = [
        (1, 0, 4, 4, 0, 0.0, 0, "complete"), (1, 4, 8, 4, 0, 0.0, 1, "complete"), (1, 8, 12, 4, 0, 0.0, 0, "complete"), (1, 12, 16, 4, 0, 0.0, 0, "noisy"),
        (2, 0, 4, 4, 1, 0.0, 0, "complete"), (2, 0, 4, 4, 1, 0.0, 0, "complete"),
    ]
    lost = [(9, 0, 4, 4, 0, 0.0, 0, "complete"), (2, 4, 8, 4, 7, 0.0, 0, "complete"), (2, 4, 8, 4, 1, 0.0, 0, None)]
    table = spark.createDataFrame(rows + lost, encode.ENCODINGS)
    given = spark.createDataFrame(list(reads.items()), "read_id long, seq string")
    reprs = {0: "acgt", 1: "tttt"}
    shown = spark.createDataFrame(list(reprs.items()), "repr_id int, seq string")
    for compressed in (False, True):
        found = sorted((tuple(r) for r in encode.variant_vectors(table, given, shown, 0.3, compressed).collect()), key=str)
        one = squeeze if compressed else lambda s: s
        vectors, _ = matrix(rows, reads, {k: one(s) for k, s in reprs.items()}, 0.3, one)
        assert found == sorted(((*e, vectors.get(e)) for e in rows + lost), key=str)
    assert encode.variant_vectors(table.limit(0), given, shown).count() == 0
