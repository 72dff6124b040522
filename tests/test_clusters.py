"""Counts of clusters kept up to date, against counts made anew; sparse Ward cuts against full ones; sampler moves."""

from __future__ import annotations

import math
from random import Random

import pytest

from tandemlake.functions import simulate as sim
from tandemlake.functions.align import align, align_cyclic
from tandemlake.functions.clustering import SplitMerge, distance_matrix, ward
from tandemlake.functions.consensus import consensus, log_prob_composition, log_prob_gen, variants
from tandemlake.functions.linkage import similar_pairs, ward_cut
from tandemlake.functions.tally import Tally


def family(seed: int, n: int, kinds: int = 3, length: int = 60) -> list[str]:
    r = Random(seed)
    first = sim.unique_seq(r, length)
    bases = [first, *(sim.mutated(r, first, (92, 4, 2, 2)) for _ in range(kinds - 1))]
    return [sim.mutated(r, bases[k % kinds], (98, 1, 0.5, 0.5)) if k % 2 else bases[k % kinds] for k in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_tally_equals_counts_made_anew(seed):
    units, r = family(seed, 30), Random(seed)
    tally, held = Tally(variants), []
    for _ in range(200):
        if held and r.random() < 0.45:
            tally.remove(held.pop(r.randrange(len(held))))
        else:
            held.append(r.choice(units))
            tally.add(held[-1])
        if r.random() < 0.7:  # some changes go by unasked
            assert tally.consensus() == consensus(sorted(set(held)), "median")
        assert tally.size == len(held)
    for unit in held:
        tally.remove(unit)
    assert tally.consensus() == "" and not tally.copies and not tally.order


def test_tally_of_empty_sequences():
    assert Tally(variants, ["", ""]).consensus() == consensus([""], "median") == ""
    assert Tally(variants, ["", "a", "ac"]).consensus() == consensus(["", "a", "ac"], "median")


class Plain(SplitMerge):
    """The same moves with every consensus and score made anew."""

    def cluster_score(self, members):
        own = [self.units[k] for k in members]
        cons = consensus(sorted(set(own)), "median")
        return log_prob_composition(cons, own) + sum(log_prob_gen(cons, u, self.quals[k] if self.quals else None) for k, u in zip(members, own)) if cons else -math.inf

    def sweep(self, labels, order, among=None):
        for k in order:
            scores = []
            for x in sorted(set(labels) if among is None else among):
                others = [m for m, v in enumerate(labels) if v == x and m != k]
                if others:
                    cons = consensus(sorted({self.units[m] for m in others}), "median")
                    score = math.log10(len(others)) - math.log10(len(labels) - 1 + self.alpha) + log_prob_gen(cons, self.units[k], self.quals[k] if self.quals else None)
                    scores.append((-score, x))
            if scores and -min(scores)[0] > -math.inf:
                labels[k] = min(scores)[1]


@pytest.mark.parametrize("seed", range(4))
def test_sampler_makes_the_moves_of_the_plain_one(seed):
    units, r = family(seed, 14), Random(seed)
    quals = [[r.randrange(10, 40) for _ in u] for u in units] if seed % 2 else None
    mine, plain = SplitMerge(units, quals, 1.0, seed), Plain(units, quals, 1.0, seed)
    assert mine.run(0.02) == plain.run(0.02) and mine.rounds == plain.rounds
    assert mine.log_prob(mine.labels) == pytest.approx(plain.log_prob(plain.labels), abs=1e-9)
    moved = list(range(len(units)))
    again = list(moved)
    mine.sweep(moved, range(len(units)))
    plain.sweep(again, range(len(units)))
    assert moved == again


def turned(units: list[str], seed: int) -> list[str]:
    r = Random(seed)
    at = [r.randrange(len(u) + 1) for u in units]
    return [u[k:] + u[:k] for u, k in zip(units, at, strict=True)]


@pytest.mark.parametrize("cyclic", [False, True])
@pytest.mark.parametrize("threshold", [0.0, 0.01, 0.03, 0.08, 0.15, 0.3, 0.6])
def test_no_pair_within_the_threshold_is_left_out(threshold, cyclic):
    for seed in range(4):
        units = ["", "a", "c", "ac", "acgtac", *family(seed, 16, 4, 40)]
        units = list(dict.fromkeys(turned(units, seed) if cyclic else units))
        one = align_cyclic if cyclic else align
        found = list(similar_pairs(units, threshold, cyclic))
        assert len(found) == len(set(found)) and all(j < i for i, j in found)
        assert {(i, j) for i in range(len(units)) for j in range(i) if one(units[i], units[j]).diff <= threshold} <= set(found)


@pytest.mark.parametrize("threshold", [0.0, 0.01, 0.03, 0.08, 0.15, 0.3])
def test_sparse_cut_equals_that_of_the_matrix(threshold):
    for seed in range(6):
        units = family(seed, 26, 4, 50)
        assert ward_cut(units, threshold) == ward(distance_matrix(units), threshold)
        around = turned(units, seed)
        assert ward_cut(around, threshold, True) == ward(distance_matrix(around, True), threshold)
    assert ward_cut([], threshold) == [] and ward_cut(["", "", "a"], threshold) == [0, 0, 1]


def test_unlike_units_are_never_aligned(monkeypatch):
    """A group of thousands of units of a hundred kinds: alignments stay within kinds."""
    r = Random(5)
    kinds = [sim.unique_seq(r, 100) for _ in range(100)]
    units = [u for k in kinds for u in [k] * 60 + [k[:n] + {"a": "c", "c": "g", "g": "t", "t": "a"}[k[n]] + k[n + 1 :] for n in (10, 50, 90)]]
    calls = []
    monkeypatch.setattr("tandemlake.functions.linkage.align", lambda x, y: calls.append(1) or align(x, y))
    labels = ward_cut(units, 0.011)
    assert len(set(labels)) >= 100 and len(calls) <= 100 * 6
    assert all(len({labels[63 * k + n] for n in range(60)}) == 1 for k in range(100))
