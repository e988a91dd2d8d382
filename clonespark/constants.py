"""Alphabets, scores, codon table."""

from __future__ import annotations

import numpy as np

# Fixed values.
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
WEIGHT_CDR3, GAP_CDR3, WEIGHT_V, GAP_V = 3, 12, 1, 4
TRIM_LEFT, TRIM_RIGHT, SHORTEST, SHORT_COST = 3, 2, 5, 20
MASKED = 1000.0
#: BLOSUM62, lower triangle in its published order.
BLOSUM62_ORDER = "ARNDCQEGHILKMFPSTWYV"
BLOSUM62_ROWS = """
4
-1 5
-2 0 6
-2 -2 1 6
0 -3 -3 -3 9
-1 1 0 0 -3 5
-1 0 0 2 -4 2 5
0 -2 0 -1 -3 -2 -2 6
-2 0 1 -1 -3 0 0 -2 8
-1 -3 -3 -3 -1 -3 -3 -4 -3 4
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7
1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7
0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4
"""
#: Amino acids of the 64 codons, bases in the order t, c, a, g.
CODON_BASES = "tcag"
CODON_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
#: What ambiguous nucleotides stand for.
NUCLEOTIDE_CLASSES = {"a": "a", "c": "c", "g": "g", "t": "t", "w": "at", "s": "cg", "k": "gt", "m": "ac", "y": "ct", "r": "ag", "n": "acgt", "v": "acg", "h": "act", "d": "agt", "b": "cgt"}
BASE_PARTNER = {"a": "t", "c": "g", "g": "c", "t": "a", "n": "n", "r": "y", "y": "r", "s": "s", "w": "w", "k": "m", "m": "k", ".": "."}


def _blosum62() -> np.ndarray:
    rows = [[int(v) for v in line.split()] for line in BLOSUM62_ROWS.split("\n") if line]
    out = np.zeros((20, 20), np.int64)
    for i, row in enumerate(rows):
        for j, value in enumerate(row):
            a, b = AMINO_ACIDS.index(BLOSUM62_ORDER[i]), AMINO_ACIDS.index(BLOSUM62_ORDER[j])
            out[a, b] = out[b, a] = value
    return out


#: Scores by place in AMINO_ACIDS.
BLOSUM62 = _blosum62()
#: Distances: equal 0, a negative score 4, else 4 less the score.
BSD4 = np.where(np.eye(20, dtype=bool), 0, 4 - np.maximum(BLOSUM62, 0))
GENETIC_CODE = {a + b + c: CODON_ACIDS[16 * i + 4 * j + k] for i, a in enumerate(CODON_BASES) for j, b in enumerate(CODON_BASES) for k, c in enumerate(CODON_BASES)}
REVERSE_GENETIC_CODE = {aa: sorted(c for c, x in GENETIC_CODE.items() if x == aa) for aa in sorted(set(CODON_ACIDS))}


def translate_codon(codon: str) -> str:
    """The amino acid that all readings of the codon share, else X; a "#" stays."""
    if "#" in codon:
        return "#"
    readings = {""}
    for base in codon:
        readings = {r + b for r in readings for b in NUCLEOTIDE_CLASSES.get(base, "")}
    acids = {GENETIC_CODE[r] for r in readings}
    return acids.pop() if len(acids) == 1 else "X"


EXTENDED_GENETIC_CODE = {a + b + c: aa for a in NUCLEOTIDE_CLASSES for b in NUCLEOTIDE_CLASSES for c in NUCLEOTIDE_CLASSES if (aa := translate_codon(a + b + c)) != "X"}
AA2DEGENERATE_CODONS = {aa: sorted(c for c, x in EXTENDED_GENETIC_CODE.items() if x == aa) for aa in sorted(set(CODON_ACIDS))}
GAP_SYMBOLS = ".*"
