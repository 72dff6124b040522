"""Majority consensus of sequences, its variants, and log10 likelihoods of alignments and compositions."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Sequence
from itertools import groupby

import numpy as np

from tandemlake.functions.align import align

#: Order in which equal counts are decided.
ORDER = {c: k for k, c in enumerate("acgt-")}
Variant = tuple[int, int, str, str]
Edit = tuple[int, int, str]


def operations(cigar: str) -> np.ndarray:
    return np.frombuffer(cigar.encode(), np.uint8)


def variants(template: str, seq: str, compat: bool = False) -> list[Variant]:
    """(position on the template, place within an insertion, op, base) of each difference of seq from the template.

    Insertions before a position count from 1; substitutions and deletions (base `-`) have place 0. With compat a
    difference right behind an insertion keeps the insertion's place, which only a match ends.
    """
    ops = operations(align(seq, template).cigar)
    inserted, deleted = ops == ord("I"), ops == ord("D")
    before = np.cumsum(inserted)
    ends = ops == ord("=") if compat else ~inserted
    place = before - np.maximum.accumulate(np.where(ends, before, 0)) if len(ops) else before
    pos, read = np.cumsum(~inserted) - ~inserted, np.cumsum(~deleted) - ~deleted
    return [(int(pos[k]), int(place[k]), chr(ops[k]), "-" if deleted[k] else seq[read[k]]) for k in np.flatnonzero(ops != ord("="))]


def pile(template: str, seqs: Iterable[str], compat: bool = False) -> Counter[Variant]:
    """How often each difference from the template occurs; a sequence that occurs again is aligned once."""
    out: Counter[Variant] = Counter()
    for seq, n in Counter(seqs).items():
        for v in variants(template, seq, compat):
            out[v] += n
    return out


def column_vote(votes: Iterable[tuple[str, int]], rest: str, total: int) -> str:
    """The base of a column: all that have no vote in it stand for `rest`."""
    counts = Counter({rest: total})
    for base, n in votes:
        counts[base] += n
        counts[rest] -= n
    return min((c for c in counts if counts[c] > 0), key=lambda c: (-counts[c], ORDER.get(c.lower(), len(ORDER)), c), default=rest)


def edited(template: str, edits: Iterable[Edit]) -> str:
    """The template with bases put at (position, place): place 0 replaces (or, with `-`, removes) one, others stand before it."""
    own = [""] * (len(template) + 1)
    kept = [*template, ""]
    for pos, place, base in sorted(edits):
        base = "" if base == "-" else base
        if place:
            own[pos] += base
        else:
            kept[pos] = base
    return "".join(x + y for x, y in zip(own, kept, strict=True))


def elected(seed: str, votes: Counter[Variant], total: int) -> str:
    """The majority of `total` sequences, one of them the seed, from the counted differences of the others from it."""
    columns = groupby(sorted(votes.items()), key=lambda row: row[0][:2])
    return edited(seed, [(*at, column_vote(((v[3], n) for v, n in found), seed[at[0]] if at[1] == 0 else "-", total)) for at, found in columns])


def seeded(seqs: Sequence[str], seed_choice: str) -> list[str]:
    """seqs with the seed first: as given, or in descending length with the longest or the median in front."""
    if seed_choice == "original":
        return list(seqs)
    by_length = sorted(seqs, key=len, reverse=True)
    if seed_choice == "median":
        by_length.insert(0, by_length.pop(len(by_length) // 2))
    elif seed_choice != "longest":
        raise ValueError(f"unknown seed choice {seed_choice}")
    return by_length


def consensus(seqs: Sequence[str], seed_choice: str = "original", compat: bool = False) -> str:
    """Column-wise majority over the alignments of all sequences with the seed, which votes too; empty for none."""
    if not seqs:
        return ""
    seed, *others = seeded(seqs, seed_choice)
    return elected(seed, pile(seed, others, compat), len(seqs))


def polished(seqs: Sequence[str], seed_choice: str = "median", n_iter: int = 1) -> str:
    """consensus, then again with the result as the seed."""
    out = consensus(seqs, seed_choice)
    for _ in range(n_iter - 1):
        if out:
            out = consensus([out, *seqs])
    return out


def log_factorial(n: int) -> float:
    return math.lgamma(n + 1) / math.log(10)


def error_rates(ops: np.ndarray, skipped: str, quality: Sequence[int] | None, p: float) -> np.ndarray:
    """For each operation of a path the error rate of the base at hand; `skipped` is the operation that moves on to none."""
    if quality is None or not len(quality):
        return np.full(len(ops), p)
    moves = ops != ord(skipped)
    return (10 ** (-np.asarray(quality, float) / 10))[np.minimum(np.cumsum(moves) - moves, len(quality) - 1)]


def _log_prob(ops: np.ndarray, right: np.ndarray) -> float:
    """Of a path, given the probability that each of its columns is a match."""
    right = np.clip(right, 1e-10, 1 - 1e-10)
    return float(np.log10(np.where(ops == ord("="), right, 1 - right)).sum())


def log_prob_gen(cons: str, obs: str, quality: Sequence[int] | None = None, p: float = 0.01) -> float:
    """log10 probability of an observation given the consensus; with qualities, an error rate for each of its bases."""
    if not cons:
        return -math.inf
    ops = operations(align(cons, obs).cigar)
    return _log_prob(ops, 1 - error_rates(ops, "I", quality, p))


def log_prob_align(x: str, y: str, qx: Sequence[int] | None = None, qy: Sequence[int] | None = None, p: float = 0.01) -> float:
    """log10 probability that two observations have one origin."""
    ops = operations(align(x, y).cigar)
    return _log_prob(ops, (1 - error_rates(ops, "D", qx, p)) * (1 - error_rates(ops, "I", qy, p)))


def log_prob_columns(length: int, total: int, columns: Iterable[Sequence[int]], p: float) -> float:
    """log10 multinomial probability of `total` sequences over a template of `length`, from the counts of the differences in
    each column that has some."""
    found = [sorted(x) for x in columns]
    right, wrong = math.log10(1 - p), math.log10(p)
    rest = [max(0, total - sum(x)) for x in found]
    ways = sum(log_factorial(total) - log_factorial(r) - sum(map(log_factorial, x)) for x, r in zip(found, rest, strict=True))
    return ways + wrong * sum(map(sum, found)) + right * (total * length + sum(rest))


def log_prob_composition(cons: str, units: Sequence[str], p: float = 0.001) -> float:
    """log10 multinomial probability of the pile of units over the consensus."""
    return log_prob_pile(cons, pile(cons, units), len(units), p)


def log_prob_pile(cons: str, counted: Counter[Variant], total: int, p: float = 0.001) -> float:
    """The same from the counted differences of `total` units."""
    columns: dict[tuple[int, int], list[int]] = {}
    for (pos, place, _, _), n in counted.items():
        columns.setdefault((pos, place), []).append(n)
    untouched = len(cons) - len({pos for pos, _ in columns if pos < len(cons)})
    return log_prob_columns(untouched, total, columns.values(), p)
