"""What is known of a cluster of units: sizes and counted differences, kept up to date as units come and go."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Iterable

from tandemlake.functions.consensus import Variant, elected

#: Of how many seeds a cluster's counts are kept. Members that come and go move the median between a few neighbours.
SEEDS = 4


class Tally:
    """A multiset of sequences and the consensus of its distinct ones, seeded with that of median length.

    A sequence that joins or leaves changes the counts of its own differences alone. `differences(seed, seq)` tells them,
    and should remember its answers: counts are summed anew only for a seed that has none.
    """

    def __init__(self, differences: Callable[[str, str], list[Variant]], seqs: Iterable[str] = ()):
        self.differences = differences
        self.copies: Counter[str] = Counter()
        self.order: list[tuple[int, str]] = []  # distinct sequences, long ones first
        self.votes: dict[str, Counter[Variant]] = {}  # by seed, the latest used last
        self.size = 0
        self._consensus: str | None = None
        for seq in seqs:
            self.add(seq)

    def _change(self, seq: str, by: int) -> None:
        self._consensus = None
        self.votes.pop(seq, None)  # a seed's own table would hold its differences from itself, so it is made anew
        for seed, counts in self.votes.items():
            for v in self.differences(seed, seq):
                counts[v] += by
                if not counts[v]:
                    del counts[v]

    def add(self, seq: str) -> None:
        self.size += 1
        self.copies[seq] += 1
        if self.copies[seq] == 1:
            insort(self.order, (-len(seq), seq))
            self._change(seq, 1)

    def remove(self, seq: str) -> None:
        self.size -= 1
        self.copies[seq] -= 1
        if not self.copies[seq]:
            del self.copies[seq]
            del self.order[bisect_left(self.order, (-len(seq), seq))]
            self._change(seq, -1)

    def consensus(self) -> str:
        """Empty for no sequences."""
        if self._consensus is None:
            self._consensus = self._elect() if self.order else ""
        return self._consensus

    def _elect(self) -> str:
        seed = self.order[len(self.order) // 2][1]
        counts = self.votes.pop(seed, None)
        if counts is None:
            counts = Counter(v for _, seq in self.order if seq != seed for v in self.differences(seed, seq))
        self.votes[seed] = counts
        if len(self.votes) > SEEDS:
            del self.votes[next(iter(self.votes))]
        return elected(seed, counts, len(self.order))
