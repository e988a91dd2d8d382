
import pytest
from pyspark.sql import functions as F

from clonespark.functions.kernel import Sequences
from clonespark.operators import enrichment, genes, junction
from clonespark.operators.distance import DistanceSpec
from clonespark.sources import readers


def write(tmp_path, name, lines):
    (tmp_path / name).write_text("\n".join(lines) + "\n")
    return str(tmp_path / name)


def test_generic(spark, tmp_path):
    path = write(tmp_path, "g.tsv", ["v_a_gene\tj_a_gene\tcdr3_a_aa\tv_b_gene\tj_b_gene\tcdr3_b_aa\tclone_count", "TRAV1\tTRAJ1\tCAVF\tTRBV2*02\tTRBJ1\tCASSF\t3"])
    r = readers.read_clone_table(spark, path).first()
    assert (r.va, r.vb, r.cdr3a, r.clone_count) == ("TRAV1*01", "TRBV2*02", "CAVF", "3")
    named = readers.read_clone_table(spark, path, {"v_a_gene": "x"}, normalize_genes=False)
    assert "x" in named.columns and named.first().x == "TRAV1"
    with pytest.raises(ValueError, match="no rows"):
        readers.read_clone_table(spark, write(tmp_path, "e.tsv", ["va\tvb"]))
    with pytest.raises(ValueError, match="no known format"):
        readers.detect_format(["a", "b"])


def test_rearrangements(spark, tmp_path):
    lines = ["cell_id\tlocus\tproductive\tv_call\tj_call\tjunction_aa"] + [f"c{k}\t{locus}\t{'T' if (k, locus) != (2, 'TRA') else 'F'}\tTR{locus[-1]}V{k}*01,TRAV9\tJ{k}\tC{k}F" for k in range(3) for locus in ("TRA", "TRB")] + ["c2\tTRA\tTRUE\tTRAV7\tJ7\tCF"]
    path = write(tmp_path, "a.tsv", lines)
    got = {r.cell_id: r for r in readers.read_airr(spark, path).collect()}
    assert len(got) == 3 and got["c2"].va == "TRAV7*01" and got["c0"].vb == "TRBV0*01"
    assert readers.read_airr(spark, path, productive_only=False).count() == 4


def test_contigs(spark, tmp_path):
    head = "barcode,is_cell,chain,v_gene,j_gene,full_length,productive,cdr3,umis"
    path = write(tmp_path, "x.csv", [head, "a,True,TRA,TRAV1,J1,True,True,CAF,2", "a,True,TRA,TRAV2,J1,True,True,CAVF,4", "a,True,TRB,TRBV1,J1,True,True,CASF,1", "b,False,TRA,TRAV1,J1,True,True,CAF,1", "b,True,TRB,TRBV1,J1,True,True,CAF,1", "c,True,TRA,TRAV1,J1,True,False,CAF,9", "c,True,TRB,TRBV1,J1,True,True,CAF,1"])
    got = readers.read_10x(spark, path).collect()
    assert [(r.barcode, r.va, r.cdr3a, r.vb) for r in got] == [("a", "TRAV2*01", "CAVF", "TRBV1*01")]


def test_beta_only(spark, tmp_path):
    path = write(tmp_path, "d.tsv", ["vGeneName\tjGeneName\taminoAcid\tcount", "TCRBV05-01*01\tTCRBJ02-07*01\tCASSF\t7", "unresolved\tTCRBJ01-01\tCASF\t1", "TCRBV01-01\tTCRBJ01-01\t\t1"])
    got = readers.read_adaptive(spark, path).orderBy("cdr3b").collect()
    assert [(r.vb, r.jb, r.cdr3b, r["count"]) for r in got] == [(None, "TRBJ1-1*01", "CASF", 1), ("TRBV5-1*01", "TRBJ2-7*01", "CASSF", 7)]


def test_in_memory_formats(spark):
    call = [("TRAV1.TRAJ2.TRAC_TRBV3.None.TRBJ4.TRBC1;TRBV9.X", "CAF;CAVF_CASSF"), ("TRAV1.TRAJ2.TRAC_TRBV3.TRBJ4", "CAF_CASSF"), ("NA", "NA"), ("TRAV1.TRAJ2.TRAC", "CAF"), (None, None), ("NA_TRBV3.None.TRBJ4.C", "NA_CASSF")]
    df = spark.createDataFrame(call, "CTgene_TCR string, CTaa_TCR string").withColumn("extra", F.lit(1))
    rows = readers.as_clone_table(df).collect()
    assert [(r.va, r.ja, r.vb, r.jb, r.cdr3a, r.cdr3b, r.extra) for r in rows] == [("TRAV1*01", "TRAJ2*01", "TRBV3*01", "TRBJ4*01", "CAF", "CASSF", 1)] * 2
    assert readers.as_clone_table(df, drop_incomplete=False).count() == 6
    for kind, names in readers.COLUMN_MAPS.items():
        table = spark.createDataFrame([tuple("CASSF" for _ in names)], ", ".join(f"{c} string" for c in names))
        assert readers.detect_format(table.columns) == kind
        assert {"va", "cdr3a", "vb", "cdr3b"} <= set(readers.as_clone_table(table).columns) and readers.as_clone_table(table, format=kind).count() == 1
    with pytest.raises(ValueError, match="unknown format"):
        readers.as_clone_table(df, format="x")


def test_write(spark, tmp_path):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "va string, subject string")
    readers.write_clones(df, str(tmp_path / "out"), partition_by=["subject"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


GENE = [
    ("TRAV1*01", "s", "A", "V", "gctgcttgtgct", 1, "AA.CA", "1-1;2-3;4-5", "A;A.;CA"),
    ("TRAV1*02", "s", "A", "V", "gctgcttgtgct", 1, "AA.CA", "1-1;2-3;4-5", "A;A.;CA"),
    ("TRAV2*01", "s", "A", "V", "tggtggtgtgct", 1, "WW.CA", "1-1;2-3;4-5", "W;W.;CA"),
    ("TRAJ1*01", "s", "A", "J", "agctttgggacc", 1, "SFGT", "1-2", "SF"),
    ("TRBD1*01", "s", "B", "D", "gggacag", 1, "GT", "", ""),
]


def test_genes(spark, tmp_path):
    head = "id organism chain region nucseq frame aligned_protseq cdr_columns cdrs".split()
    path = write(tmp_path, "genes.tsv", ["\t".join(head)] + ["\t".join(map(str, g)) for g in GENE])
    table = genes.load_gene_table(spark, path, "s")
    assert genes.list_organisms(table) == ["s"] and table.filter("id = 'TRAV1*02'").first().count_rep == "TRAV1"
    loops = {r.gene: r.loops for r in genes.loop_strings(table).collect()}
    assert loops["TRAV1*01"] == "A A."
    v = {(r.g1, r.g2): r.vdist for r in genes.v_distances(genes.loop_strings(table)).collect()}
    assert v["TRAV1*01", "TRAV1*02"] == 0 and v["TRAV1*01", "TRAV2*01"] == 8
    assert genes.v_representatives(table) == {"TRAV1*01": ("TRAV1*01", "TRAV1*01"), "TRAV1*02": ("TRAV1*01", "TRAV1*01"), "TRAV2*01": ("TRAV2*01", "TRAV2*01")}
    assert genes.j_representatives(table).first().rep == "TRAJ1*01"
    assert genes.junction_sequences(table) == {"V": {"TRAV1*01": "tgtgct", "TRAV1*02": "tgtgct", "TRAV2*01": "tgtgct"}, "J": {"TRAJ1*01": "agcttt"}, "D": {"TRBD1*01": "gggacag"}}
    with pytest.raises(ValueError, match="no genes"):
        genes.load_gene_table(spark, path, "other")
    bad = write(tmp_path, "bad.tsv", ["\t".join(head), "\t".join(map(str, (*GENE[0][:6], "WW.CA", *GENE[0][7:])))])
    with pytest.raises(ValueError, match="inconsistent"):
        genes.load_gene_table(spark, bad)
    with pytest.raises(ValueError, match="aligned"):
        genes.v_distances(spark.createDataFrame([("s", "A", "g", "AC"), ("s", "A", "h", "A")], "organism string, chain string, gene string, loops string"))


SEGMENTS = {"V": {"V1*01": "tgtgccagcagc", "V1*02": "tgtgccagcagttta"}, "J": {"J1*01": "gagcagtacttt"}, "D": {"D1": "gggacagggggc", "D2": "gggactagcggg"}}


def test_junction():
    nuc = "tgtgccagc" + "cc" + "gggacag" + "aaa" + "gagcagtacttt"
    r = junction.analyse_junction(SEGMENTS, "B", "V1*01", "J1*01", "CASXXXXEQYF"[: len(nuc) // 3], nuc)
    assert r["source"] == "V" * 9 + "NN" + "D" * 7 + "NNN" + "J" * 12 and (r["d_id"], r["d0_trim"], r["d1_trim"], r["v_trim"], r["j_trim"]) == (1, 0, 5, 3, 0)
    assert (r["vd_insert"], r["dj_insert"], r["vj_insert"], r["new_nucseq"]) == (2, 3, 0, "cc+++++++aaa") and r["masked"].startswith("---")
    alpha = junction.analyse_junction(SEGMENTS, "A", "V1*01", "J1*01", "", nuc)
    assert alpha["vj_insert"] == 12 and "D" not in alpha["source"]
    over = junction.analyse_junction(SEGMENTS, "A", "V1*01", "V", "", "tgtgcc")
    assert over["source"] == "VVVVVV"
    assert junction.analyse_junction(SEGMENTS, "B", "V1*01", "J1*01", "", nuc.replace("cc", "nn", 1))["d_id"] == 0
    before, after = junction.breakpoints("VVNDDJ")
    assert before == [2, -4, 3, -3] and after == [5, -1]


@pytest.fixture(scope="module")
def clones(spark):
    rows = []
    for k in range(24):
        mid = "".join("acgt"[(k * 3 + p * p + k // 5) % 4] for p in range(3 + 3 * (k % 3)))
        nuc = "tgtgccagcagc" + mid + "gggacag" + "ca" + "gagcagtacttt"
        rows.append((k, "V1*01", "J1*01", nuc))
    df = spark.createDataFrame(rows, "clone_idx long, vb string, jb string, cdr3b_nucseq string")
    from clonespark.functions.exprs import translation

    df = df.withColumn("cdr3b", translation("cdr3b_nucseq")).filter(~F.contains("cdr3b", F.lit("*")))
    return df.select("*", *[F.col(f"{c}b{s}").alias(f"{c}a{s}") for c, s in (("v", ""), ("j", ""), ("cdr3", ""), ("cdr3", "_nucseq"))]).cache()


def test_alleles(spark, clones):
    swapped = junction.alternate_alleles(spark.createDataFrame([(0, "V1*01", "J1*01", "tgtgccagcagtttaccgagcagtacttt"), (1, "V1*01", "J1*01", "tgtgccagcagcccc")], "clone_idx long, vb string, jb string, cdr3b_nucseq string"), SEGMENTS, "B")
    assert {r.clone_idx: r.vb for r in swapped.collect()} == {0: "V1*02", 1: "V1*01"}


def test_background(spark, clones):
    made = junction.shuffled_chains(clones, SEGMENTS, "B", 20, seed=3)
    rows = made.collect()
    assert 0 < len(rows) <= 20 and all(len(r.cdr3_nucseq) % 3 == 0 and len(r.cdr3) == len(r.cdr3_nucseq) // 3 and r.v == "V1*01" for r in rows)
    assert sorted(map(tuple, junction.shuffled_chains(clones.repartition(5), SEGMENTS, "B", 20, seed=3).collect())) == sorted(map(tuple, rows))
    some = spark.createDataFrame([("V1*01", "CASSF"), ("V1*01", "CASSLGF")], "v string, c string")
    freq = junction.background_frequencies(clones.withColumn("cdr3a", F.lit("CASSF")).withColumn("cdr3b", F.lit("CASSF")).limit(2), some.toDF("va", "cdr3a"), some.toDF("vb", "cdr3b"), DistanceSpec(("cdr3a", "cdr3b")), 48)
    d = Sequences(["CASSF"]).distances(Sequences(["CASSF", "CASSLGF"]))[0]
    got = {r.d: r.freq for r in freq.filter(F.col("i") == freq.agg(F.min("i")).first()[0]).collect()}
    for t in (0, 10, 24, 47):
        assert abs(got[t] - max(0.25, sum(a + b <= t for a in d for b in d)) / 4) < 1e-12
    assert got[48] == 1.0


def test_matches(spark):
    q = spark.createDataFrame([(0, "CASSIRSSYEQYF"), (1, "CASSLGTEAFF")], "clone_idx long, cdr3b string").withColumn("vb", F.lit("x"))
    db = spark.createDataFrame([(0, "CASSIRSYEQYF", "flu"), (1, "CASSLGTEAFF", "cmv"), (2, "CSARDRTGNTIYF", "ebv")], "clone_idx long, cdr3b string, epitope string").withColumn("vb", F.lit("x"))
    background = spark.range(2).withColumnRenamed("id", "i").withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(200)))).withColumn("freq", F.least(F.lit(1.0), 1e-4 * F.pow(F.lit(1.5), F.col("d").cast("double"))))
    got = enrichment.significant_matches(q, db, background, DistanceSpec(("cdr3b",)), 1.0)
    rows = got.collect()
    assert [(r.query_index, r.db_index, r.distance, r.db_epitope) for r in rows] == [(1, 1, 0.0, "cmv"), (0, 0, 12.0, "flu")]
    assert abs(rows[0].pvalue_adj - 6e-4) < 1e-12 and abs(rows[1].fdr_value - 6e-4 * 1.5**12 / 2) < 1e-9
    assert enrichment.significant_matches(q, db, background.withColumn("freq", F.lit(1.0)), DistanceSpec(("cdr3b",)), 0.5).count() == 0
    none = enrichment.significant_matches(q, db, background.withColumn("freq", F.lit(1.0)), DistanceSpec(("cdr3b",)), 0.5)
    assert none.columns == got.columns and none.dtypes == got.dtypes
