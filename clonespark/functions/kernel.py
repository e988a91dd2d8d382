"""Distances between blocks of sequences, in numpy.

Sequences of one length form a matrix of letter codes; all pairs of two such
matrices are scored together, a position at a time.
"""

from __future__ import annotations

import numpy as np

from clonespark.constants import AMINO_ACIDS, BLOSUM62, BSD4, GAP_CDR3, SHORT_COST, SHORTEST, TRIM_LEFT, TRIM_RIGHT, WEIGHT_CDR3

_CODE = np.full(256, 255, np.uint8)
for _k, _a in enumerate(AMINO_ACIDS):
    _CODE[ord(_a)] = _k
_COST = BSD4.astype(np.int32)


def encode(sequences: list[str]) -> np.ndarray:
    """Letter codes of sequences of one length, a row each."""
    if not sequences:
        return np.zeros((0, 0), np.uint8)
    out = _CODE[np.frombuffer("".join(sequences).encode("ascii", "replace"), np.uint8)].reshape(len(sequences), -1)
    if (out == 255).any():
        bad = next(s for s, row in zip(sequences, out, strict=True) if (row == 255).any())
        raise ValueError(f"not an amino-acid sequence: {bad!r}")
    return out


def gap_places(n: int) -> range:
    """Where the one gap may go between sequences of which the shorter has n letters."""
    return range(min(5, n // 2), max(n - 5, (n + 1) // 2) + 1)


def cdr3_block(left: np.ndarray, right: np.ndarray, weight: int = WEIGHT_CDR3, gap: int = GAP_CDR3) -> np.ndarray:
    """All distances between rows of left and rows of right, each matrix of one length."""
    if left.shape[1] > right.shape[1]:
        return cdr3_block(right, left, weight, gap).T
    n, more = left.shape[1], right.shape[1] - left.shape[1]
    shape = (len(left), len(right))
    if n < SHORTEST:
        return np.full(shape, weight * SHORT_COST + more * gap, np.int32)
    rows = [_COST[left[:, k]] for k in range(n)]  # a row of costs for each left letter
    total = np.zeros(shape, np.int32)
    if not more:
        for k in range(TRIM_LEFT, n - TRIM_RIGHT):
            total += rows[k][:, right[:, k]]
        return weight * total
    places = gap_places(n)
    for k in range(places.start, n - TRIM_RIGHT):
        total += rows[k][:, right[:, k + more]]
    for k in range(TRIM_LEFT, places.start):
        total += rows[k][:, right[:, k]]
    best = total.copy()
    for g in places[1:]:  # the gap moves right: letter g - 1 is now before it
        k = g - 1
        if k >= TRIM_LEFT:
            total += rows[k][:, right[:, k]]
        if k < n - TRIM_RIGHT:
            total -= rows[k][:, right[:, k + more]]
        np.minimum(best, total, out=best)
    return weight * best + more * gap


class Sequences:
    """Sequences by length, to be compared with others length by length."""

    def __init__(self, sequences: list[str]):
        self.size = len(sequences)
        lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
        self.groups = {int(n): (at := np.flatnonzero(lengths == n), encode([sequences[i] for i in at])) for n in np.unique(lengths)}

    def distances(self, other: Sequences, weight: int = WEIGHT_CDR3, gap: int = GAP_CDR3) -> np.ndarray:
        out = np.zeros((self.size, other.size), np.int32)
        for at, left in self.groups.values():
            for to, right in other.groups.values():
                out[np.ix_(at, to)] = cdr3_block(left, right, weight, gap)
        return out


def cdr3_distance(a: str, b: str, weight: int = WEIGHT_CDR3, gap: int = GAP_CDR3) -> float:
    """The distance of two non-empty sequences."""
    if not a or not b:
        raise ValueError("both sequences must have letters")
    return float(cdr3_block(encode([a]), encode([b]), weight, gap)[0, 0])


def hamming(a: str, b: str) -> int:
    """Places that differ, or -1 between different lengths."""
    return sum(x != y for x, y in zip(a, b, strict=True)) if len(a) == len(b) else -1


def loop_distance(a: str, b: str, gap: int | None = None, weight: int = 1) -> float:
    """Distance of two aligned loop strings. A gap or stop on either side costs nothing, or gap on one
    side only where gap is given; spaces must stand at the same places."""
    if len(a) != len(b) or any((x == " ") != (y == " ") for x, y in zip(a, b, strict=True)):
        raise ValueError("loop strings are not aligned")
    total = 0
    for x, y in zip(a, b, strict=True):
        letters = (x in AMINO_ACIDS) + (y in AMINO_ACIDS)
        if letters == 2:
            total += int(BSD4[AMINO_ACIDS.index(x), AMINO_ACIDS.index(y)])
        elif gap is not None and letters == 1:
            total += gap
    return float(weight * total)


def blosum62(a: str, b: str) -> int:
    return int(BLOSUM62[AMINO_ACIDS.index(a), AMINO_ACIDS.index(b)])


def nucleotide_matches(a: str, b: str, mismatch: int = -4) -> int:
    """Length of the longest prefix of both with the best score: 1 for a match, mismatch for none."""
    n = min(len(a), len(b))
    if not n:
        return 0
    score = np.cumsum([1 if x == y else mismatch for x, y in zip(a[:n], b[:n], strict=True)])
    best = max(0, int(score.max()))
    at = np.flatnonzero(score == best)
    return int(at[-1]) + 1 if len(at) else 0


def align_one_gap(a: str, b: str) -> tuple[str, str]:
    """The shorter sequence gets one gap block where the BLOSUM62 sum is largest, leftmost of equals."""
    if len(a) == len(b):
        return a, b
    if len(a) > len(b):
        y, x = align_one_gap(b, a)
        return x, y
    more, n = len(b) - len(a), len(a)
    score = lambda x, y: blosum62(x, y) if x in AMINO_ACIDS and y in AMINO_ACIDS else 0
    before = np.cumsum([0] + [score(x, y) for x, y in zip(a, b, strict=False)])
    after = np.cumsum([0] + [score(x, y) for x, y in zip(reversed(a), reversed(b), strict=False)])[::-1]
    g = 1 + int(np.argmax((before + after)[1:n])) if n > 1 else n  # a letter stands on both sides
    return a[:g] + "-" * more + a[g:], b
