import random

import pytest
from pyspark.sql import functions as F

from clonespark.constants import AMINO_ACIDS, BSD4, EXTENDED_GENETIC_CODE, GENETIC_CODE
from clonespark.functions import exprs, kernel

#: Distances of default weights.
GOLDEN = """
CASSIRSSYEQYF CASSIRSYEQYF 12
CASSIRSSYEQYF CASSIRASYEQYF 9
CAVRDSSYKLIF CAVRDSSYKLIF 0
CAVRDSSYKLIF CALSDRSYEKLIF 48
CASSIRSSYEQYF CASSLGTEAFF 66
CASSIRSYEQYF CASSLGTEAFF 54
CAVRDSSYKLIF CAVSANSGTYF 81
CASSIRSSYEQYF CSARDRTGNTIYF 81
CASSIRSYEQYF CSARDRTGNTIYF 81
CAAA CAAAA 72
CASSF CASSF 0
CASSF CASSLGF 24
CAAAA CDDDDDDF 36
CASSFF CASSLGQF 36
"""


def by_definition(a, b, weight=3, gap=12):
    s, l = sorted((a, b), key=len)
    n, d = len(s), len(l) - len(s)
    cost = lambda k, m: int(BSD4[AMINO_ACIDS.index(s[k]), AMINO_ACIDS.index(l[m])])
    if n < 5:
        return weight * 20 + d * gap
    totals = []
    for g in [n] if d == 0 else kernel.gap_places(n):
        totals.append(sum(cost(k, k if k < g else k + d) for k in range(3, n - 2)))
    return weight * min(totals) + d * gap


def random_sequences(n, low=1, high=25, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(AMINO_ACIDS) for _ in range(rng.randint(low, high))) for _ in range(n)]


def test_golden():
    for line in GOLDEN.split("\n"):
        if line:
            a, b, d = line.split()
            assert kernel.cdr3_distance(a, b) == kernel.cdr3_distance(b, a) == int(d) == by_definition(a, b)


def test_kernel_follows_definition():
    a, b = random_sequences(90), random_sequences(90, seed=2)
    got = kernel.Sequences(a).distances(kernel.Sequences(b))
    assert (got == [[by_definition(x, y) for y in b] for x in a]).all()
    assert (kernel.Sequences(a).distances(kernel.Sequences(b), 1, 5) == [[by_definition(x, y, 1, 5) for y in b] for x in a]).all()


def test_expression_follows_definition(spark):
    pairs = list(zip(random_sequences(150), random_sequences(150, seed=2), strict=True))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", exprs.cdr3_distance("a", "b").alias("d")).collect()
    assert all(r.d == by_definition(r.a, r.b) for r in got)


def test_substitution_costs():
    cheap = {1: "FY IV", 2: "DE EQ HY IL KR LM WY", 3: "AS DN EK FW HN IM KQ LV MV NS QR ST"}
    want = {frozenset(p): k for k, v in cheap.items() for p in v.split()}
    for i, a in enumerate(AMINO_ACIDS):
        for j, b in enumerate(AMINO_ACIDS):
            assert BSD4[i, j] == (0 if a == b else want.get(frozenset(a + b), 4))


def test_invalid_letters():
    for bad in ("CASSX", "cassf", "CAS*F"):
        with pytest.raises(ValueError):
            kernel.cdr3_distance(bad, "CASSF")
    with pytest.raises(ValueError):
        kernel.cdr3_distance("", "CASSF")


def test_nucleotide_matches():
    for a, b, m, n in (("atcgatcg", "atcgttcg", -4, 4), ("atcg", "axcg", -1, 4), ("atcg", "axcg", -4, 1), ("", "a", -4, 0), ("aaaa", "tttt", -4, 0)):
        assert kernel.nucleotide_matches(a, b, m) == n


def test_loops_and_alignment():
    assert kernel.loop_distance("AF.", "AYC") == 1 and kernel.loop_distance("AF.", "AYC", gap=4) == 5
    with pytest.raises(ValueError):
        kernel.loop_distance("A F", "AF ")
    assert kernel.align_one_gap("CAF", "CASSF") == ("CA--F", "CASSF")
    assert kernel.align_one_gap("CASSF", "CAF") == ("CASSF", "CA--F")


def test_hamming(spark):
    assert kernel.hamming("CASSI", "CASSILY") == -1 and kernel.hamming("CASS", "CATS") == 1
    df = spark.createDataFrame([("CASSI", "CASSILY"), ("CASS", "CATS"), ("", "")], "a string, b string")
    got = df.select(exprs.hamming_distance("a", "b").alias("p"), exprs.hamming_distance("a", "b", "longest").alias("m")).collect()
    assert [(r.p, r.m) for r in got][:2] == [(-1, 7), (1, 1)]


def test_codons():
    assert len(GENETIC_CODE) == 64 and GENETIC_CODE["atg"] == "M" and GENETIC_CODE["tga"] == "*"
    assert EXTENDED_GENETIC_CODE["gcn"] == "A" and "nnn" not in EXTENDED_GENETIC_CODE


def test_scalar_expressions(spark):
    one = spark.createDataFrame([("acgTNx", "tgtgcnxx", "TCRBV05-01*01", "TRBV9")], "a string, b string, c string, d string")
    r = one.select(
        exprs.reverse_complement("a").alias("rc"), exprs.translation("b").alias("t1"), exprs.translation("b", "+4").alias("t4"), exprs.translation(F.lit("gcacac"), "-1").alias("tm"), exprs.translation(F.lit("tg#nnn")).alias("tx"),
        exprs.convert_adaptive_gene("c").alias("g"), exprs.normalize_gene("d").alias("n"), exprs.trim_allele("c").alias("trim"), exprs.convert_adaptive_gene(F.lit("Unresolved")).alias("u"),
        exprs.blosum62_score(F.lit("W"), F.lit("W")).alias("ww"), exprs.blosum62_score(F.lit("W"), F.lit("-")).alias("no"),
    ).first()
    assert (r.rc, r.t1, r.t4, r.tm, r.tx) == ("NANAcgt", "CA", "A", "VC", "#X")
    assert (r.g, r.n, r.trim, r.u, r.ww, r.no) == ("TRBV5-1*01", "TRBV9*01", "TCRBV05-01", None, 11, None)
    with pytest.raises(ValueError):
        exprs.translation("b", "1")


def test_gap_places():
    assert [list(kernel.gap_places(n)) for n in (5, 6, 7, 12)] == [[2, 3], [3], [3, 4], [5, 6, 7]]
    assert all(len(kernel.gap_places(n)) for n in range(5, 40))
