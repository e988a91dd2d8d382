"""Column expressions: everything here stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clonespark.constants import (
    AMINO_ACIDS,
    BASE_PARTNER,
    BLOSUM62,
    BSD4,
    EXTENDED_GENETIC_CODE,
    GAP_CDR3,
    SHORT_COST,
    SHORTEST,
    TRIM_LEFT,
    TRIM_RIGHT,
    WEIGHT_CDR3,
)

VALID_CDR3 = f"^[{AMINO_ACIDS}]*$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _cost(a: Column, b: Column) -> Column:
    """Substitution cost of two letters, by a lookup in a string of 400 digits."""
    digits = F.lit("".join(str(int(v)) for v in BSD4.ravel()))
    place = 20 * (F.instr(F.lit(AMINO_ACIDS), a) - 1) + F.instr(F.lit(AMINO_ACIDS), b)
    return F.substring(digits, place, F.lit(1)).cast("int")


def cdr3_distance(a: Column | str, b: Column | str, weight: int = WEIGHT_CDR3, gap: int = GAP_CDR3) -> Column:
    """Weighted CDR3 distance of two columns, as built-in higher-order functions."""
    a, b = _col(a), _col(b)
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    n, more = F.length(short), F.length(long) - F.length(short)
    first, last = F.least(F.lit(5), F.floor(n / 2)), F.greatest(n - 5, F.floor((n + 1) / 2))

    def letter(s: Column, k: Column) -> Column:
        return F.substring(s, k + 1, F.lit(1))

    def total(g: Column) -> Column:
        def one(sum_: Column, k: Column) -> Column:
            other = F.when(k < g, k).otherwise(k + more)
            used = (k >= TRIM_LEFT) & (k < n - TRIM_RIGHT)
            return sum_ + F.when(used, _cost(letter(short, k), letter(long, other))).otherwise(0)

        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), one)

    gaps = F.when(more == 0, F.array(n.cast("bigint"))).otherwise(F.sequence(first.cast("bigint"), last.cast("bigint")))
    scored = weight * F.array_min(F.transform(gaps, total)) + more * gap
    return F.when(n < SHORTEST, weight * SHORT_COST + more * gap).otherwise(scored).cast("double")


def hamming_distance(a: Column | str, b: Column | str, unequal: str = "flag") -> Column:
    """Places that differ. Different lengths give -1 (flag) or the larger length (longest)."""
    a, b = _col(a), _col(b)
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), F.lit(0), lambda s, k: s + F.when(F.substring(a, k, F.lit(1)) == F.substring(b, k, F.lit(1)), 0).otherwise(1))
    other = F.lit(-1) if unequal == "flag" else F.greatest(F.length(a), F.length(b))
    return F.when(F.length(a) == F.length(b), same).otherwise(other)


def loop_distance(a: Column | str, b: Column | str) -> Column:
    """Distance of two aligned loop strings; a gap, stop or space on either side costs nothing."""
    a, b = _col(a), _col(b)
    return F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))),
        F.lit(0),
        lambda s, k: s + F.when(F.substring(a, k, F.lit(1)).rlike(f"^[{AMINO_ACIDS}]$") & F.substring(b, k, F.lit(1)).rlike(f"^[{AMINO_ACIDS}]$"), _cost(F.substring(a, k, F.lit(1)), F.substring(b, k, F.lit(1)))).otherwise(0),
    ).cast("double")


def blosum62_score(a: Column | str, b: Column | str) -> Column:
    """BLOSUM62 score of two letters; null for other characters."""
    a, b = _col(a), _col(b)
    values = F.array(*[F.lit(int(v)) for v in BLOSUM62.ravel()])
    i, j = F.instr(F.lit(AMINO_ACIDS), a), F.instr(F.lit(AMINO_ACIDS), b)
    return F.when((i > 0) & (j > 0) & (F.length(a) == 1) & (F.length(b) == 1), F.get(values, 20 * (i - 1) + j - 1))


def normalize_gene(c: Column | str) -> Column:
    """Append *01 to a gene name without an allele; null and empty stay."""
    c = _col(c)
    return F.when((F.length(c) > 0) & ~F.contains(c, F.lit("*")), F.concat(c, F.lit("*01"))).otherwise(c)


def trim_allele(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), F.lit(r"\*.*$"), F.lit(""))


def convert_adaptive_gene(c: Column | str) -> Column:
    """TCRBV05-01*01 as TRBV5-1*01; empty and unresolved names as null."""
    c = _col(c)
    named = F.regexp_replace(c, F.lit("^TCR"), F.lit("TR"))
    family = F.regexp_replace(named, F.lit("^(TR[AB][VDJ])0+"), F.lit("$1"))
    member = F.regexp_replace(family, F.lit("^([^-]*-)0+"), F.lit("$1"))
    return F.when(c.isNull() | (c == "") | (F.lower(c) == "unresolved"), F.lit(None)).otherwise(member)


def first_listed(c: Column | str, mark: str = ",") -> Column:
    return F.substring_index(_col(c), mark, 1)


def reverse_complement(c: Column | str) -> Column:
    """Reverse complement of either case; a character without a partner reads NA."""
    c = _col(c)
    pairs = {k: v for k, v in BASE_PARTNER.items()} | {k.upper(): v.upper() for k, v in BASE_PARTNER.items()}
    mapping = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.array_join(F.transform(F.filter(F.reverse(F.split(c, "")), lambda x: x != ""), lambda x: F.coalesce(F.element_at(mapping, x), F.lit("NA"))), "")


def translation(c: Column | str, frame: str = "+1") -> Column:
    """Amino acids of a nucleotide column; frame -n reads the reverse complement. An incomplete last codon
    is left out; an ambiguous codon is read if all its readings agree, else X."""
    if frame[:1] not in "+-" or not frame[1:].isdigit() or int(frame[1:]) < 1:
        raise ValueError(f"no such frame: {frame!r}")
    c = F.lower(reverse_complement(c) if frame[0] == "-" else _col(c))
    letters = "".join(sorted({x for codon in EXTENDED_GENETIC_CODE for x in codon}))
    size = len(letters)
    acids = F.split(F.lit("".join(EXTENDED_GENETIC_CODE.get(x + y + z, "X") for x in letters for y in letters for z in letters)), "")  # a constant, read by place

    def acid(s: Column, k: Column) -> Column:
        places = [F.instr(F.lit(letters), F.substring(s, 3 * k + n, F.lit(1))) for n in (1, 2, 3)]
        known = (places[0] > 0) & (places[1] > 0) & (places[2] > 0)
        found = F.when(known, F.get(acids, (places[0] - 1) * size * size + (places[1] - 1) * size + places[2] - 1)).otherwise("X")
        return F.when(F.contains(F.substring(s, 3 * k + 1, F.lit(3)), F.lit("#")), "#").otherwise(found)

    def protein(s: Column) -> Column:
        places = F.when(F.length(s) >= 3, F.sequence(F.lit(0), F.floor(F.length(s) / 3).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
        return F.array_join(F.transform(places, lambda k: acid(s, k)), "")

    # As the one element of an array c is computed once, however often it is read.
    return F.get(F.transform(F.array(F.substring(c, int(frame[1:]), 1 << 30)), protein), F.lit(0))


def _known(c: Column) -> Column:
    return F.when((c != "") & (c != "NA"), c)


def ctgene_chain(c: Column | str, chain: str) -> Column:
    """struct<v, j> of one chain of a combined gene call "alpha_beta"; null unless both chains are there."""
    c = _known(_col(c))
    chains = F.split(c, "_")
    calls = F.split(first_listed(F.get(chains, F.lit(0 if chain == "A" else 1)), ";"), r"\.")
    j = F.get(calls, F.lit(1)) if chain == "A" else F.when(F.size(calls) >= 4, F.get(calls, F.lit(2))).otherwise(F.get(calls, F.lit(1)))
    both = F.size(chains) >= 2
    return F.struct(F.when(both, _known(F.get(calls, F.lit(0)))).alias("v"), F.when(both & (F.size(calls) >= 2), _known(j)).alias("j"))


def ctaa_chain(c: Column | str, chain: str) -> Column:
    """The first CDR3 of one chain of a combined "alpha_beta" column."""
    chains = F.split(_known(_col(c)), "_")
    return F.when(F.size(chains) >= 2, _known(first_listed(F.get(chains, F.lit(0 if chain == "A" else 1)), ";")))
