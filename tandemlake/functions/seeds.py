"""Where a sequence may lie in another, from the places of their common k-mers, before anything is aligned."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from tandemlake.functions.align import Alignment, align
from tandemlake.functions.kmers import kmer_codes, ranges


def seed_hits(query: str, target: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all common k-mers in query and target."""
    places = []
    for seq in (query, target):
        data = np.frombuffer(seq.encode(), np.uint8)
        places.append(kmer_codes(data, np.array([0, len(data)]), k)[1])
    order = np.argsort(places[1], kind="stable")
    ranked = places[1][order]
    first, last = np.searchsorted(ranked, places[0], "left"), np.searchsorted(ranked, places[0], "right")
    return np.repeat(np.arange(len(places[0])), last - first), order[ranges(first, last - first)]


def seeded_ranges(query: str, target: str, max_diff: float, k: int = 13) -> list[tuple[int, int]]:
    """Disjoint ranges of target outside of which no alignment of all of query has max_diff or less.

    Such an alignment has at most e differences, so it keeps all but k * e of the query's k-mers, on diagonals that are at
    most e apart: they fill two neighbouring bands of e + 1 diagonals. Where k * e k-mers are all, the range is the target."""
    m = len(query)
    e = int(max_diff * m / (1 - max_diff) + 1e-9) if max_diff < 1 else m
    need = m - k + 1 - k * e
    if need < 1 or not m:
        return [(0, len(target))]
    on_query, on_target = seed_hits(query, target, k)
    if not len(on_query):
        return []
    bands, hits = np.unique((on_target - on_query + m) // (e + 1), return_counts=True)
    held = dict(zip(bands.tolist(), hits.tolist(), strict=True))
    out: list[tuple[int, int]] = []
    for band in sorted({b - x for b in held for x in (0, 1)}):
        if held.get(band, 0) + held.get(band + 1, 0) < need:
            continue
        low = band * (e + 1) - m  # the bands' first diagonal
        start, end = max(0, low - e), min(len(target), low + 2 * (e + 1) + m + e)
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        elif end > start:
            out.append((start, end))
    return out


def places_in_windows(query: str, target: str, windows: Sequence[tuple[int, int]], max_diff: float, k: int = 13) -> list[int]:
    """Begins on target of the best alignments of query in those windows where it differs by max_diff or less; none if the best
    in all of target differs by more. Only seeded ranges are aligned."""
    spans = seeded_ranges(query, target, max_diff, k)
    out: list[int] = []
    sure = False  # that the best in all of target is good enough
    for begin, end in windows:
        near = [(s, e) for s, e in spans if s < end and begin < e]
        if not near:
            continue
        begin, end = max(begin, near[0][0]), min(end, near[-1][1])
        found = align(query, target[begin:end], "glocal")
        if found.diff <= max_diff:
            out.append(begin + found.t_start)
            sure = sure or found.n_diff <= max_diff * len(query)
    if out and not sure:
        best: Alignment | None = None
        for s, e in spans:
            found = align(query, target[s:e], "glocal")
            best = found if best is None or found.n_diff < best.n_diff else best
        if best is None or best.diff > max_diff:
            return []
    return out
