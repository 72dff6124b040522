from __future__ import annotations

from inspect import signature
from random import Random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tandemlake.functions import simulate as sim
from tandemlake.functions.align import MODES, align, align_cyclic, cigar_of_text, dovetail, gapped, revcomp
from tandemlake.functions.clustering import SplitMerge, canonical, distance_matrix, synchronize, ward
from tandemlake.functions.consensus import consensus, log_prob_composition, log_prob_gen, variants
from tandemlake.functions.units import SelfAlignment, covering, repeat_spans, self_alignments, split_units, units_of
from tandemlake.operators.clustering import clustered
from tandemlake.operators.contigs import refine, slice_of
from tandemlake.operators.encode import encode_read

DNA = st.text("acgt", max_size=14)


def table_distance(q: str, t: str, mode: str) -> int:
    row = [0 if mode == "glocal" else j for j in range(len(t) + 1)]
    for i, x in enumerate(q, 1):
        new = [i]
        for j, y in enumerate(t, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1] if mode == "global" else min(row)


@settings(max_examples=300, deadline=None)
@given(DNA.filter(bool), DNA, st.sampled_from(MODES))
def test_aligner_equals_plain_table(q, t, mode):
    found = align(q, t, mode)
    assert found.n_diff == table_distance(q, t, mode) == sum(op != "=" for op in found.cigar)
    x, y = gapped(q, t[found.t_start : found.t_end], found.cigar)
    assert (x.replace("-", ""), y.replace("-", "")) == (q, t[found.t_start : found.t_end])
    assert all((a == b) == (op == "=") for a, b, op in zip(x, y, found.cigar, strict=True))


def test_aligner_edges():
    assert align("", "acg").cigar == "DDD" and align("", "acg", "glocal").length == 0 and align("acg", "").cigar == "III"
    assert align_cyclic("gtac", "acgt").n_diff == 0
    assert revcomp(revcomp("acgtACGTN")) == "acgtACGTN"


def test_alignment_text():
    assert cigar_of_text("..ac-gt", "  ||*|*", "..acagc") == "==I=X"
    assert cigar_of_text("aac-gt", "a[|*|]", "aacagt") == "=I="


def test_dovetail():
    assert dovetail("aaccgg", "ccggtt", 2, 0) == (2, 6, 0, 4, 4, 0)
    assert dovetail("acgt", "acgt", 0, 4) is None


@pytest.mark.parametrize(("cigar", "expected"), [("======", [(0, 3), (3, 6), (6, 9)]), ("===D===", [(0, 3), (3, 7)]), ("==I==", [(0, 3), (3, 5), (5, 7)]), ("=====X", [(0, 3), (3, 6), (6, 9)])])
def test_split_units(cigar, expected):
    assert split_units(3, 0, cigar) == expected


def test_covering_subtracts_rejected_alignments():
    noisy = SelfAlignment(100, 2000, 0, 1000)  # slope 1.9
    good = SelfAlignment(200, 2000, 0, 1800)
    assert covering([(0, 2000)], [good, noisy]) == []
    assert covering([(0, 2000)], [good]) == [good]
    assert covering([(0, 900)], [good]) == []


def test_repeat_of_one_unit_is_found():
    seq, unit = sim.homo_repeat(Random(5), 300, 8, (98, 1, 0.5, 0.5), 800, 800)
    alignments = self_alignments(seq)
    spans = repeat_spans(alignments)
    assert len(spans) == 1 and abs(spans[0][0] - 800) < 30
    lengths = [e - s for s, e in units_of(spans, alignments)]
    assert len(lengths) >= 6 and all(abs(n - 300) < 15 for n in lengths)


def test_consensus():
    assert consensus(["acgt", "acgt", "aagt"]) == "acgt"
    assert consensus(["acgt", "acggt", "acggt"]) == "acggt"
    assert consensus([]) == "" and consensus(["ac", "", ""]) == ""
    assert variants("acgt", "aagt") == [(1, 0, "X", "a")]


def test_likelihoods_prefer_the_truth():
    assert log_prob_gen("acgt", "acgt") > log_prob_gen("acgt", "acga") and log_prob_gen("", "a") == float("-inf")
    assert log_prob_composition("acgt", ["acgt"] * 3) > log_prob_composition("acgt", ["acgt", "acga", "aagt"])


def test_clustering_parts_two_units():
    r = Random(3)
    a = sim.unique_seq(r, 80)
    b = sim.mutated(r, a, (90, 5, 2.5, 2.5))
    units = [a, b] * 5
    assert ward(distance_matrix(units), 0.02) == [0, 1] * 5 == SplitMerge(units, seed=1).run(0.02)
    assert canonical([5, 2, 5]) == [0, 1, 0] and SplitMerge([a]).run() == [0] and SplitMerge([]).run() == []


def test_synchronize_finds_the_phase():
    r = Random(4)
    a, flank = sim.unique_seq(r, 60), sim.unique_seq(r, 40)
    assert synchronize(flank + a * 3 + flank[::-1], {0: a}) == [(40, 100, 0), (100, 160, 0), (160, 220, 0)]


def test_refine_and_slices():
    contig = sim.unique_seq(Random(6), 600)
    begin, end, part, cigar = refine(contig, 95, contig[100:400])
    assert (begin, end, part) == (100, 400, contig[100:400])
    assert slice_of(cigar, begin, 200, 300, part) == contig[200:300]
    assert refine(contig, -50, contig[:0] + "a" * 50 + contig[:200])[:2] == (0, 200)


def test_encode_read_types():
    r = Random(8)
    unit = sim.unique_seq(r, 100)
    seq = sim.unique_seq(r, 60) + unit + revcomp(unit) + sim.unique_seq(r, 60)
    rows = encode_read(seq, [(0, unit, 95, 105)], max_diff=0.2)
    assert [(s, e, strand, kind) for s, e, _, _, _, strand, kind in rows] == [(60, 160, 0, "complete"), (160, 260, 1, "complete")]


@given(st.integers(0, 10**6))
@settings(max_examples=50, deadline=None)
def test_scripts(seed):
    r = Random(seed)
    seq = sim.unique_seq(r, 40)
    for script in (sim.stochastic_script(r, 40, (80, 5, 10, 5)), sim.deterministic_script(r, 40, (80, 5, 10, 5))):
        out = sim.apply_script(r, seq, script)
        assert len(out) == 40 + script.count("I") - script.count("D") and sum(op != "I" for op in script) == 40
    assert not sim.has_period(sim.non_tandem_seq(r, 6)) and sim.has_period("acac") and not sim.has_period("a")


def test_simulator_counts_and_ends():
    r = Random(2)
    assert [sim.deterministic_script(r, 200, (90, 5, 3, 2)).count(op) for op in "=XID"] == [186, 10, 6, 4]
    assert len(sim.apply_script(r, "a" * 200, "=" * 100 + "D" * 50 + "X" * 50)) == 150
    assert all(a != b for a, b in zip("acgt" * 20, sim.apply_script(r, "acgt" * 20, "X" * 80), strict=True))
    genome = sim.unique_seq(r, 500)
    reads = [sim.sampled_read(r, genome, 100, 0.0) for _ in range(2000)]
    assert all((revcomp(s) if strand else s) == genome[start : start + len(s)] for s, start, strand in reads)
    assert min(len(s) for s, *_ in reads) < 5 and max(len(s) for s, _, strand in reads if strand) == 101 and max(len(s) for s, _, strand in reads if not strand) == 100
    covered = [sum(start <= at < start + len(s) for s, start, _ in reads) for at in (0, 250, 499)]
    assert min(covered) > 0.3 * max(covered)  # the ends are read from one side alone
    seq, unit = sim.homo_repeat(r, 50, 6, (98, 1, 0.5, 0.5), 40, 30)
    assert len(seq) == 370 and len(unit) == 50


class Scripted(SplitMerge):
    """A sampler whose log probabilities are given: the first before the rounds, the last for all that come later."""

    def __init__(self, *found: float):
        super().__init__(["acgt", "acga"])
        self.found = list(found)

    def gibbs(self, rounds: int = 2) -> None:
        pass

    def propose(self, times: int = 30) -> int:
        return 0

    def log_prob(self, labels) -> float:
        return self.found.pop(0) if len(self.found) > 1 else self.found[0]


def test_sampler_runs_until_its_stop_rule_holds():
    no = float("-inf")
    for found, rounds in (
        (range(-300, -100), 201), ([-9, -8.5, -8.2], 3), ([-9, -8] * 20, 11), ([no], 5), ([no, no, -3, -2.5, -2.2], 5), ([-9.0, -9.5, -8.5, -8.1, -7.9, -7.8, -7.1], 6),
    ):
        sampler = Scripted(*map(float, found))
        sampler.run()
        assert sampler.rounds == rounds, found
    assert "max_rounds" not in signature(clustered).parameters
