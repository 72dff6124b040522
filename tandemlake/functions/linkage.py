"""Ward clusters of sequences below a height, from the graph of pairs that are alike, without the matrix of all distances.

Ward distances never shrink as clusters grow, and two clusters at most t apart have members at most t apart: if all
members of either differed by more, the mean squared distance across, less half the means within (which merges at t or
less bound), would exceed t squared. So a cut at t falls into the connected components of the graph of pairs within t,
and within a component only clusters that an edge joins can merge next.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from heapq import heapify, heappop, heappush

from tandemlake.functions.align import align, align_cyclic


def similar_pairs(seqs: Sequence[str], threshold: float, cyclic: bool = False) -> Iterator[tuple[int, int]]:
    """(i, j), j < i, of distinct sequences that may differ in a share of at most threshold of their columns: none that do is left out.

    e differences leave one of e + 1 pieces of a sequence whole, at most e places from where it was; in a rotation, which may
    cut one more, one of e + 2, anywhere. Sequences too short for their pieces are paired with all.
    """
    index: dict[str, list[tuple[int, int]]] = {}
    sizes: set[int] = set()
    loose: set[int] = set()
    limits = [int(threshold / (1 - threshold) * len(s) + 1e-9) if threshold < 0.5 else len(s) for s in seqs]
    for i, seq in enumerate(seqs):
        found = set(range(i)) if limits[i] >= len(seq) else set(loose)
        for size in sizes if limits[i] < len(seq) else ():
            for at in range(len(seq) - size + 1):
                for j, place in index.get(seq[at : at + size], ()):
                    if cyclic or abs(place - at) <= limits[j]:
                        found.add(j)
        yield from ((i, j) for j in sorted(found) if abs(len(seq) - len(seqs[j])) <= min(limits[i], limits[j]) or j in loose or limits[i] >= len(seq))
        n = limits[i] + 1 + cyclic
        if n > len(seq):
            loose.add(i)
            continue
        bounds = [len(seq) * k // n for k in range(n + 1)]
        for lo, hi in zip(bounds, bounds[1:]):
            index.setdefault(seq[lo:hi], []).append((i, lo))
            sizes.add(hi - lo)


def _components(n: int, edges: Sequence[tuple[int, int]]) -> list[list[int]]:
    """Members, in order, of the components that have edges."""
    root = list(range(n))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i, j in edges:
        a, b = sorted((top(i), top(j)))
        root[b] = a
    out: dict[int, list[int]] = {}
    for x in range(n):
        out.setdefault(top(x), []).append(x)
    return [m for m in out.values() if len(m) > 1]


def ward_cut(units: Sequence[str], threshold: float, cyclic: bool = False) -> list[int]:
    """Cluster numbers, by first appearance, as clustering.ward gives them for the matrix of all units. Equal units count as one
    of their weight. Distances are computed for pairs in one component alone; its merges, nearest first (ties: the first units), wait in a heap."""
    weights: dict[str, int] = {}
    for u in units:
        weights[u] = weights.get(u, 0) + 1
    distinct = list(weights)
    known: dict[tuple[int, int], float] = {}
    one: Callable = align_cyclic if cyclic else align

    def distance(i: int, j: int) -> float:
        pair = (max(i, j), min(i, j))
        if pair not in known:
            known[pair] = one(distinct[pair[0]], distinct[pair[1]]).diff
        return known[pair]

    edges = [(i, j) for i, j in similar_pairs(distinct, threshold, cyclic) if distance(i, j) <= threshold]
    owner = list(range(len(distinct)))
    for members in _components(len(distinct), edges):
        for x, cluster in _merged(members, [weights[distinct[k]] for k in members], distance, threshold).items():
            for k in cluster:
                owner[k] = x
    numbers: dict[int, int] = {}
    of = dict(zip(distinct, owner, strict=True))
    return [numbers.setdefault(of[u], len(numbers)) for u in units]


def _merged(members: list[int], weights: list[int], distance: Callable[[int, int], float], threshold: float) -> dict[int, list[int]]:
    """Clusters of a component, by first member: squared Ward distances in one row for each live cluster, updated as two merge."""
    size = dict(zip(members, weights, strict=True))
    clusters = {k: [k] for k in members}
    rows: dict[int, dict[int, float]] = {k: {} for k in members}
    for n, i in enumerate(members):
        for j in members[:n]:
            rows[i][j] = rows[j][i] = 2 * size[i] * size[j] / (size[i] + size[j]) * distance(i, j) ** 2
    queue = [(d, i, j) for i in members for j, d in rows[i].items() if i < j and math.sqrt(d) <= threshold]
    heapify(queue)
    while queue:
        d, i, j = heappop(queue)
        if j not in rows or i not in rows or rows[i][j] != d:
            continue
        gone, own = rows.pop(j), rows[i]
        del own[j]
        for k, row in rows.items():
            if k != i:
                total = size[i] + size[j] + size[k]
                now = ((size[i] + size[k]) * own[k] + (size[j] + size[k]) * gone[k] - size[k] * d) / total
                own[k] = row[i] = now
                del row[j]
                if math.sqrt(max(now, 0.0)) <= threshold:
                    heappush(queue, (now, min(i, k), max(i, k)))
        size[i] += size[j]
        clusters[i] += clusters.pop(j)
    return clusters
