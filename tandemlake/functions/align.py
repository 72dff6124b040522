"""Edit-distance alignment of two sequences with its path, on machine-independent bit vectors.

A column of the dynamic-programming table is two big integers (its +1 and -1 vertical steps); horizontal steps
are kept as well, so the path is read back without recomputation. Modes: `global` aligns both wholly, `glocal`
the query wholly to any part of the target, `prefix` the query wholly to a beginning of the target.

Paths are over `=XID` with I consuming the query alone and D the target alone. Of several best ends the first
is taken, and on the way back a match or mismatch is preferred to D, and D to I.
"""

from __future__ import annotations

from typing import NamedTuple

MODES = ("global", "glocal", "prefix")
_COMPLEMENT = str.maketrans("acgtACGTnN", "tgcaTGCAnN")


def revcomp(seq: str) -> str:
    return seq.translate(_COMPLEMENT)[::-1]


class Alignment(NamedTuple):
    n_diff: int
    length: int
    t_start: int
    t_end: int
    cigar: str

    @property
    def diff(self) -> float:
        return self.n_diff / self.length if self.length else 0.0


def align(query: str, target: str, mode: str = "global") -> Alignment:
    """The best alignment of query with target. An empty query takes no column of a glocal or prefix target."""
    m, n = len(query), len(target)
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    if not m:
        return Alignment(n, n, 0, n, "D" * n) if mode == "global" else Alignment(0, 0, 0, 0, "")
    full, high = (1 << m) - 1, 1 << (m - 1)
    places: dict[str, int] = {}
    for k, c in enumerate(query):
        places[c] = places.get(c, 0) | 1 << k
    up, down = full, 0
    score = m
    best, end = (m, 0) if mode != "global" else (0, n)
    anchored = int(mode != "glocal")
    ups, downs, rights, lefts = [up], [down], [0], [0]
    for j, c in enumerate(target, 1):
        x = places.get(c, 0) | down
        diagonal = (((x & up) + up) ^ up) | x
        right = (down | ~(diagonal | up)) & full
        left = up & diagonal
        score += 1 if right & high else -1 if left & high else 0
        rights.append(right)
        lefts.append(left)
        right = (right << 1 | anchored) & full
        left = left << 1 & full
        up = (left | ~(diagonal | right)) & full
        down = right & diagonal
        ups.append(up)
        downs.append(down)
        if mode != "global" and score < best:
            best, end = score, j
    if mode == "global":
        best = score
    i, j, now = m, end, best
    path: list[str] = []
    while i or (j and anchored):
        if not i:
            path.append("D" * j)
            j = 0
            break
        if not j:
            path.append("I" * i)
            i = 0
            break
        bit = 1 << (i - 1)
        before = now - (1 if rights[j] & bit else -1 if lefts[j] & bit else 0)  # one column to the left
        corner = before - (1 if ups[j - 1] & bit else -1 if downs[j - 1] & bit else 0)
        same = query[i - 1] == target[j - 1]
        if corner + (not same) == now:
            path.append("=" if same else "X")
            i, j, now = i - 1, j - 1, corner
        elif before + 1 == now:
            path.append("D")
            j, now = j - 1, before
        else:
            path.append("I")
            i, now = i - 1, now - (1 if ups[j] & bit else -1 if downs[j] & bit else 0)
    cigar = "".join(reversed(path))
    return Alignment(best, len(cigar), j, end, cigar)


def align_cyclic(query: str, target: str) -> Alignment:
    """Global alignment with the rotation of target that a glocal match in the doubled target suggests."""
    if not query or not target:
        return align(query, target)
    start = align(query, target + target, "glocal").t_start % len(target)
    return align(query, target[start:] + target[:start])


def can_be_query(a: str, b: str) -> bool:
    """Whether a is short enough to be aligned wholly within b: less than 1.1 times its length."""
    return 10 * len(a) < 11 * len(b)


def _best_prefix(a: str, b: str) -> tuple[Alignment, int, int]:
    """A prefix alignment of one with the other, whichever differs less (a into b on ties); and the ends in a and b."""
    first = align(a, b, "prefix") if can_be_query(a, b) else None
    second = align(b, a, "prefix") if can_be_query(b, a) else None
    if first is None or (second is not None and second.diff < first.diff):
        return second, second.t_end, len(b)
    return first, len(a), first.t_end


def dovetail(a: str, b: str, a_pos: int, b_pos: int) -> tuple[int, int, int, int, int, int] | None:
    """Extends a match point to both sides until one sequence ends: (a_start, a_end, b_start, b_end, length, n_diff);
    None where there is nothing on either side. A side with an empty part is left out."""
    a_start, a_end, b_start, b_end = a_pos, a_pos, b_pos, b_pos
    length = n_diff = 0
    if a_pos and b_pos:
        found, x, y = _best_prefix(a[:a_pos][::-1], b[:b_pos][::-1])
        a_start, b_start, length, n_diff = a_pos - x, b_pos - y, found.length, found.n_diff
    if a_pos < len(a) and b_pos < len(b):
        found, x, y = _best_prefix(a[a_pos:], b[b_pos:])
        a_end, b_end, length, n_diff = a_pos + x, b_pos + y, length + found.length, n_diff + found.n_diff
    return (a_start, a_end, b_start, b_end, length, n_diff) if length else None


def gapped(a: str, b: str, cigar: str) -> tuple[str, str]:
    """Both sequences with gaps, as a path aligns them."""
    x, y = iter(a), iter(b)
    return "".join("-" if op == "D" else next(x) for op in cigar), "".join("-" if op == "I" else next(y) for op in cigar)


def cigar_of_text(a_row: str, marks: str, b_row: str) -> str:
    """The path of an alignment printed in three rows: `|` marks a match; gaps are `-`. The alignment lies between
    `[` and `]`, or without these between the first and last columns where neither row has `.`."""
    begin = marks.find("[")
    finish = marks.find("]")
    if begin >= 0:
        begin += 1
    else:
        begin = next((k for k, (x, y) in enumerate(zip(a_row, b_row, strict=False)) if x != "." and y != "."), len(a_row))
    if finish < 0:
        finish = len(a_row)
        while finish > begin and (a_row[finish - 1] == "." or b_row[finish - 1] == "."):
            finish -= 1
    out = []
    for x, mark, y in zip(a_row[begin:finish], marks[begin:finish], b_row[begin:finish], strict=True):
        out.append("=" if mark == "|" else "I" if x == "-" else "D" if y == "-" else "X")
    return "".join(out)
