"""Further registered queries: scans of files, repertoires, genes, junctions, statistics, figure tables.

They register beside those of clonespark.queries, with SQL that gives the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clonespark.constants import AMINO_ACIDS, BLOSUM62, GENETIC_CODE
from clonespark.functions import exprs, kernel
from clonespark.functions.stats import adjust_bh, with_poisson_tail
from clonespark.operators import cd8, embedding, enrichment, genes, graph, junction, plotdata
from clonespark.operators import distance as dst
from clonespark.operators.genes import v_distances
from clonespark.operators.graph import shared_folder
from clonespark.operators.repertoire import Repertoire, build_repertoire
from clonespark.queries import BASE, SEGMENTS, SUPPLIERS, _cd8_sql, _cost_sql, _junctions, _numbered, _rule_model, _supplier_matrix, clones, loops, loops_sql, query, seq_distances_sql, table, v_sql
from clonespark.sources import readers


def stored(df: DataFrame, name: str, sep: str | None = None) -> str:
    """df as delimited files (or Parquet, without sep) in a folder that executors share; its path."""
    path = f"{shared_folder(df.sparkSession)}/clonespark/{name}-{uuid.uuid4().hex}"
    (df.write.option("sep", sep).option("header", True).csv if sep else df.write.parquet)(path)
    return path


# ---- files ----------------------------------------------------------------------------------------------

CANONICAL_SQL = "va || '*01' AS va, ja || '*01' AS ja, cdr3a, vb || '*01' AS vb, jb || '*01' AS jb, cdr3b"


@query(f"WITH {BASE} SELECT CAST(clone_idx AS VARCHAR) AS clone_idx, {CANONICAL_SQL} FROM cl")
def table_scan(spark, sf_dir):
    """A tab-separated file under column names of its own."""
    names = {"V_alpha": "va", "J_alpha": "ja", "junction_alpha": "cdr3a", "V_beta": "vb", "J_beta": "jb", "junction_beta": "cdr3b"}
    path = stored(clones(spark, sf_dir).select("clone_idx", *[F.col(b).alias(a) for a, b in names.items()]), "scan", "\t")
    return readers.read_clone_table(spark, path, names).select("clone_idx", "va", "ja", "cdr3a", "vb", "jb", "cdr3b")


@query(f"WITH {BASE}, k AS (SELECT unnest(['dash', 'scirpy', 'dandelion', 'canonical']) AS kind) SELECT kind, clone_idx, {CANONICAL_SQL} FROM cl, k WHERE clone_idx % 11 <> 5")
def clone_formats(spark, sf_dir):
    """The same clones under the names of four formats, each detected and converted; some have no CDR3 and go."""
    c = clones(spark, sf_dir).withColumn("cdr3b", F.when(F.col("clone_idx") % 11 == 5, F.when(F.col("clone_idx") % 2 == 0, "")).otherwise(F.col("cdr3b")))
    out = None
    for kind, names in (*readers.COLUMN_MAPS.items(), ("canonical", {})):
        held = c.select("clone_idx", *[F.col(b).alias(a) for a, b in names.items() if b in c.columns]) if names else c
        assert readers.detect_format(held.columns) == kind
        found = readers.as_clone_table(held).select(F.lit(kind).alias("kind"), "clone_idx", "va", "ja", "cdr3a", "vb", "jb", "cdr3b")
        out = found if out is None else out.unionByName(found)
    return out


@query("SELECT * FROM (VALUES ('a chain''s columns', 'none'), ('canonical', 'canonical'), ('combined', 'screpertoire'), ('combined with a suffix', 'screpertoire'), ('dandelion', 'dandelion'), ('dash', 'dash'), ('scirpy', 'scirpy'), ('three of scirpy', 'none')) t(columns, format)")
def format_detection(spark, sf_dir):
    cases = {
        "canonical": ["va", "cdr3a", "vb", "cdr3b", "extra"], "combined": ["CTgene", "CTaa"], "combined with a suffix": ["CTgene_TCR", "CTaa_TCR", "CTgene"],
        **{k: list(m) for k, m in readers.COLUMN_MAPS.items()}, "three of scirpy": list(readers.COLUMN_MAPS["scirpy"])[:3], "a chain's columns": ["va", "cdr3a"],
    }

    def found(columns: list[str]) -> str:
        try:
            return readers.detect_format(columns)
        except ValueError:
            return "none"

    return spark.createDataFrame([(k, found(c)) for k, c in cases.items()], "columns string, format string")


@query(f"WITH {BASE} SELECT 'TRBV' || (clone_idx % 30 + 1) || '-' || (clone_idx % 9 + 1) || '*01' AS vb, 'TRBJ' || (clone_idx % 2 + 1) || '-' || (clone_idx % 7 + 1) || '*01' AS jb, cdr3b, \"count\" FROM cl WHERE clone_idx % 13 <> 0")
def adaptive_scan(spark, sf_dir):
    k = F.col("clone_idx")
    name = lambda head, a, b: F.concat(F.lit(head), F.lpad((k % a + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((k % b + 1).cast("string"), 2, "0"))
    rows = clones(spark, sf_dir).select(F.concat(name("TCRBV", 30, 9), F.lit("*01")).alias("vGeneName"), name("TCRBJ", 2, 7).alias("jGeneName"), F.when(k % 13 != 0, F.col("cdr3b")).alias("aminoAcid"), F.col("count").alias("templates"))
    return readers.read_adaptive(spark, stored(rows, "adaptive", "\t")).select("vb", "jb", "cdr3b", "count")


@query(f"WITH {BASE} SELECT clone_idx AS cell_id, {CANONICAL_SQL} FROM cl")
def rearrangement_scan(spark, sf_dir):
    """Two lines for each clone in a tab-separated file, and one more that isn't productive."""
    c = clones(spark, sf_dir)
    row = lambda locus, v, j, s, ok: c.select(F.col("clone_idx").alias("cell_id"), F.lit(locus).alias("locus"), F.lit(ok).alias("productive"), F.col(v).alias("v_call"), F.col(j).alias("j_call"), F.col(s).alias("junction_aa"))
    rows = row("TRA", "va", "ja", "cdr3a", "T").union(row("TRB", "vb", "jb", "cdr3b", "true")).union(row("TRB", "va", "ja", "cdr3a", "F"))
    return readers.read_airr(spark, stored(rows, "rearrangements", "\t")).withColumn("cell_id", F.col("cell_id").cast("long"))


@query(f"WITH {BASE} SELECT clone_idx AS barcode, {CANONICAL_SQL} FROM cl WHERE clone_idx % 5 <> 0")
def contig_scan(spark, sf_dir):
    """Contigs of a comma-separated file; a beta contig of fewer UMIs loses, cells that weren't called go."""
    c = clones(spark, sf_dir)
    row = lambda chain, v, j, s, umis: c.select(F.col("clone_idx").alias("barcode"), F.when(F.col("clone_idx") % 5 == 0, "False").otherwise("True").alias("is_cell"), F.lit("true").alias("full_length"), F.lit("True").alias("productive"), F.lit(chain).alias("chain"), F.col(v).alias("v_gene"), F.col(j).alias("j_gene"), F.col(s).alias("cdr3"), F.lit(umis).alias("umis"))
    rows = row("TRA", "va", "ja", "cdr3a", 3).union(row("TRB", "vb", "jb", "cdr3b", 9)).union(row("TRB", "va", "ja", "cdr3a", 8))
    found = readers.read_10x(spark, stored(rows, "contigs", ","))
    return found.withColumn("barcode", F.col("barcode").cast("long"))


@query(f"WITH {BASE} SELECT va, ja, cdr3a, vb, jb, cdr3b, epitope FROM cl")
def database_scan(spark, sf_dir):
    c = clones(spark, sf_dir).select(F.col("va").alias("va_gene"), "ja", "cdr3a", F.col("vb").alias("vb_gene"), "jb", "cdr3b", "epitope")
    return readers.read_tcr_database(spark, stored(c, "database", "\t")).select("va", "ja", "cdr3a", "vb", "jb", "cdr3b", "epitope")


@query(f"WITH {BASE} SELECT clone_idx, epitope, va, cdr3a, vb, cdr3b, \"count\" FROM cl")
def clone_sink(spark, sf_dir):
    """Clones written by epitope and read back."""
    path = f"{shared_folder(spark)}/clonespark/sink-{uuid.uuid4().hex}"
    readers.write_clones(clones(spark, sf_dir), path, "parquet", ["epitope"])
    return spark.read.parquet(path).select("clone_idx", F.col("epitope").cast("string").alias("epitope"), "va", "cdr3a", "vb", "cdr3b", "count")


@query(_cd8_sql())
def cd8_model_scan(spark, sf_dir):
    """Scores by models of files."""
    paths = {}
    for chain, scale in (("A", 5), ("B", 7)):
        m = _rule_model(scale)
        sizes = zip(cd8.HEADERS, (m.low, m.high, m.window, len(m.v) + 1, len(m.j) + 1, len(m.lengths), len(m.positions)), strict=True)
        lines = [*sizes, *m.v.items(), ("other", m.other_v), *m.j.items(), ("other", m.other_j), *((f"L{k}", w) for k, w in enumerate(m.lengths)), *((f"C{k}", w) for k, w in enumerate(m.positions)), ("BIAS", m.bias)]
        path = f"{shared_folder(spark)}/clonespark/model-{uuid.uuid4().hex}"
        spark.createDataFrame([(f"{k} {v}",) for k, v in lines], "value string").coalesce(1).write.text(path)
        paths[chain] = path
    return cd8.cd8_scores(clones(spark, sf_dir), cd8.load_models(spark, paths)).select("clone_idx", (F.round("cd8_score", 6) + 0.0).alias("cd8_score"))


# ---- genes ----------------------------------------------------------------------------------------------

#: Synthetic genes of two organisms; the last loop of a V gene begins at its conserved letter.
GENES = [
    ("AV1*01", "one", "A", "V", "tgtgcttgggct", 1, "C.AWA", "2-3;5-5", ".A;A"), ("AV1*02", "one", "A", "V", "tgtgcttgggct", 1, "C.AWA", "2-3;5-5", ".A;A"),
    ("AV2*01", "one", "A", "V", "gtgttcttggcc", 2, "C..SW", "2-4;5-5", "..S;W"), ("AV3*01", "two", "A", "V", "tgtgcttgggca", 1, "C.AWA", "2-3;5-5", ".A;A"),
    ("AJ1*01", "one", "A", "J", "aattttgggccc", 1, "NFGP", "1-2", "NF"), ("AJ2*01", "one", "A", "J", "aactttggacca", 1, "NFGP", "1-2", "NF"), ("AJ3*01", "one", "A", "J", "gaattttgggcgc", 2, "NFGR", "1-2", "NF"),
    ("BD1*01", "one", "B", "D", "gggacaggg", 1, "GTG", "", ""), ("BJ1*01", "two", "B", "J", "tactttggg", 1, "YFG", "1-2", "YF"),
]


def _genes(spark: SparkSession, organism: str | None = None) -> DataFrame:
    raw = spark.createDataFrame(GENES, genes.GENE_SCHEMA)
    return genes.load_gene_table(spark, stored(raw.coalesce(1), "genes", "\t"), organism)


CODONS = "MAP {" + ", ".join(f"'{c}': '{a}'" for c, a in GENETIC_CODE.items()) + "}"
GENES_SQL = "g AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in GENES) + ") t(id, organism, chain, region, nucseq, frame, aligned, cdr_columns, cdrs))"
PROTEIN = f"array_to_string(list_transform(range(0, (length(nucseq) - frame + 1)//3), lambda k: {CODONS}[substr(nucseq, CAST(frame + 3*k AS INTEGER), 3)]), '')"


@query(f"WITH {GENES_SQL} SELECT id, organism, chain, region, nucseq, (frame - 1)::INTEGER AS nucseq_offset, {PROTEIN} AS protseq, split_part(id, '*', 1) AS count_rep, replace(cdrs, ';', '|') AS loops, CASE WHEN cdrs = '' THEN 0 ELSE len(string_split(cdrs, ';')) END::INTEGER AS n_loops FROM g")
def gene_table_scan(spark, sf_dir):
    return _genes(spark).select("id", "organism", "chain", "region", "nucseq", "nucseq_offset", "protseq", "count_rep", F.array_join("cdrs", "|").alias("loops"), F.size("cdrs").alias("n_loops"))


@query(f"WITH {GENES_SQL} SELECT DISTINCT organism FROM g")
def organisms(spark, sf_dir):
    return spark.createDataFrame([(o,) for o in genes.list_organisms(_genes(spark))], "organism string")


@query(f"WITH {GENES_SQL}, v AS (SELECT 'V' AS kind, id, substr(nucseq, CAST(3*length(replace(substr(aligned, 1, CAST(split_part(list_last(string_split(cdr_columns, ';')), '-', 1) AS INTEGER) - 1), '.', '')) + frame AS INTEGER)) AS seq FROM g WHERE region = 'V'), j AS (SELECT 'J', id, substr(nucseq, 1, CAST(3*length(replace(split_part(cdrs, ';', 1), '.', '')) + frame - 1 AS INTEGER)) FROM g WHERE region = 'J') SELECT * FROM v UNION ALL SELECT * FROM j UNION ALL SELECT 'D', id, nucseq FROM g WHERE region = 'D' AND chain = 'B'")
def junction_segments(spark, sf_dir):
    """What of each gene may stand in a junction."""
    found = genes.junction_sequences(_genes(spark))
    return spark.createDataFrame([(k, i, s) for k, held in found.items() for i, s in held.items()], "kind string, id string, seq string")


@query(f"WITH {GENES_SQL}, j AS (SELECT id, organism, chain, substr({PROTEIN}, 1, length(replace(split_part(cdrs, ';', 1), '.', '')) + 3) AS core FROM g WHERE region = 'J') SELECT id, min(id) OVER (PARTITION BY organism, chain, core) AS rep FROM j")
def j_gene_representatives(spark, sf_dir):
    return genes.j_representatives(_genes(spark))


@query(f"WITH {GENES_SQL}, v AS (SELECT id, organism, array_to_string(string_split(cdrs, ';')[1:-2], ';') AS l FROM g WHERE region = 'V') SELECT id, organism, min(id) OVER (PARTITION BY organism, l) AS rep FROM v")
def v_gene_representatives(spark, sf_dir):
    held = _genes(spark)
    rows = [(i, o, rep) for o in genes.list_organisms(held) for i, (rep, _) in genes.v_representatives(held.filter(F.col("organism") == o)).items()]
    return spark.createDataFrame(rows, "id string, organism string, rep string")


@query("SELECT codon, aa FROM (SELECT unnest(map_entries(" + CODONS + "), recursive := true)) t(codon, aa)")
def codon_table(spark, sf_dir):
    """The genetic code by translating each codon."""
    return spark.createDataFrame([(c,) for c in GENETIC_CODE], "codon string").select("codon", exprs.translation("codon").alias("aa"))


SCORES = "[" + ", ".join(str(int(v)) for v in BLOSUM62.ravel()) + "]"


def _blosum_sql(a: str, b: str) -> str:
    return f"{SCORES}[20*(instr('{AMINO_ACIDS}', {a}) - 1) + instr('{AMINO_ACIDS}', {b})]"


@query(f"SELECT a, b, {_blosum_sql('a', 'b')}::INTEGER AS score FROM (SELECT unnest(string_split('{AMINO_ACIDS}', '')) AS a), (SELECT unnest(string_split('{AMINO_ACIDS}', '')) AS b)")
def blosum62_scores(spark, sf_dir):
    letters = spark.createDataFrame([(x,) for x in AMINO_ACIDS + "-X"], "a string")
    return letters.crossJoin(letters.withColumnRenamed("a", "b")).select("a", "b", exprs.blosum62_score("a", "b").cast("int").alias("score")).filter("score is not null")


def _by_arrow(f: Callable, kind: str, *columns: str) -> Column:
    """A plain function of values as a column; each distinct row of a batch is computed once."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            batch = batch if isinstance(batch, tuple) else (batch,)
            done: dict[tuple, object] = {}
            rows = list(zip(*(c.to_pylist() for c in batch), strict=True))
            for r in rows:
                if r not in done:
                    done[r] = f(*r)
            yield pa.array([done[r] for r in rows], {"double": pa.float64(), "string": pa.string(), "int": pa.int32()}[kind])

    return run(*columns)


@query(f"WITH {loops_sql()} SELECT p.chain, p.gene AS g1, q.gene AS g2, CAST(list_sum(list_transform(range(1, 13), lambda k: CASE WHEN instr('{AMINO_ACIDS}', substr(p.loops, CAST(k AS INTEGER), 1)) > 0 AND instr('{AMINO_ACIDS}', substr(q.loops, CAST(k AS INTEGER), 1)) > 0 THEN {_cost_sql('substr(p.loops, CAST(k AS INTEGER), 1)', 'substr(q.loops, CAST(k AS INTEGER), 1)')} WHEN instr('{AMINO_ACIDS}', substr(p.loops, CAST(k AS INTEGER), 1)) > 0 OR instr('{AMINO_ACIDS}', substr(q.loops, CAST(k AS INTEGER), 1)) > 0 THEN 4 ELSE 0 END)) AS DOUBLE) AS dist FROM lo p JOIN lo q ON p.chain = q.chain")
def loop_pairs_with_gaps(spark, sf_dir):
    """Aligned loops where a gap on one side costs 4."""
    l = loops(spark).drop("organism")
    pairs = l.withColumnsRenamed({"gene": "g1", "loops": "l1"}).join(l.withColumnsRenamed({"gene": "g2", "loops": "l2"}), "chain")
    return pairs.select("chain", "g1", "g2", _by_arrow(lambda a, b: kernel.loop_distance(a, b, 4), "double", "l1", "l2").alias("dist"))


# ---- distances and repertoires --------------------------------------------------------------------------


def _distinct(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Clones whose beta CDR3s are all different: three letters more, made of the key, behind the fifth."""
    k = F.col("clone_idx")
    letter = lambda by: F.substring(F.lit(AMINO_ACIDS), (F.floor(k / by) % 20 + 1).cast("int"), F.lit(1))
    return clones(spark, sf_dir, name).select("clone_idx", "vb", F.concat(F.substring("cdr3b", 1, 5), letter(1), letter(20), letter(400), F.substring("cdr3b", 6, 99)).alias("cdr3b"))


def _distinct_sql(source: str) -> str:
    letter = lambda by: f"substr('{AMINO_ACIDS}', CAST(clone_idx//{by} % 20 + 1 AS INTEGER), 1)"
    return f"ds AS (SELECT clone_idx, substr(cdr3b, 1, 5) || {letter(1)} || {letter(20)} || {letter(400)} || substr(cdr3b, 6) AS cdr3b FROM {source})"


@query(f"WITH {SUPPLIERS}, {_distinct_sql('su')}, {seq_distances_sql('cdr3b', 'sd', 'ds', 'ds')} SELECT p.clone_idx AS i, q.clone_idx AS j, dist FROM sd JOIN ds p ON p.cdr3b = x JOIN ds q ON q.cdr3b = y WHERE dist <= 60 AND p.clone_idx <> q.clone_idx")
def distance_distinct(spark, sf_dir):
    """No two sequences are equal."""
    return dst.distance_sparse(_distinct(spark, sf_dir, "supplier"), 60, ["cdr3b"])


@query(f"WITH {BASE}, {_distinct_sql('cl')}, {seq_distances_sql('cdr3b', 'sd', 'ds', 'ds')} SELECT p.clone_idx AS i, q.clone_idx AS j, dist FROM sd JOIN ds p ON p.cdr3b = x JOIN ds q ON q.cdr3b = y WHERE dist <= 24 AND p.clone_idx <> q.clone_idx")
def distance_sparse_distinct(spark, sf_dir):
    """As many different sequences as the larger table has rows."""
    return dst.distance_sparse(_distinct(spark, sf_dir, "customer"), 24, ["cdr3b"])


@query(f"WITH {SUPPLIERS}, {seq_distances_sql('cdr3a', 'sa', 'su', 'su')}, {loops_sql()}, {v_sql()} SELECT p.clone_idx AS i, q.clone_idx AS j, dist + vdist AS dist FROM sa JOIN su p ON p.cdr3a = x JOIN su q ON q.cdr3a = y JOIN vd ON g1 = p.va AND g2 = q.va WHERE dist + vdist <= 90 AND p.clone_idx <> q.clone_idx")
def distance_alpha(spark, sf_dir):
    """A preset that names the components of one chain."""
    return dst.distance_sparse(clones(spark, sf_dir, "supplier"), 90, "alpha", v_distances(loops(spark)))


@query(f"WITH {SUPPLIERS}, {seq_distances_sql('cdr3b', 'sd', 'su', 'su')}, {loops_sql()}, {v_sql()} SELECT p.clone_idx AS i, q.clone_idx AS j, dist + vdist AS dist FROM sd JOIN su p ON p.cdr3b = x JOIN su q ON q.cdr3b = y JOIN vd ON g1 = p.vb AND g2 = q.vb WHERE dist + vdist <= 90 AND p.clone_idx <> q.clone_idx")
def distance_single_chain(spark, sf_dir):
    """All components of a table that has one chain."""
    return dst.distance_sparse(clones(spark, sf_dir, "supplier").select("clone_idx", "vb", "cdr3b"), 90, "all", v_distances(loops(spark)))


@query(f"WITH {SUPPLIERS}, {seq_distances_sql('cdr3a', 'sa', 'su', 'su')}, {seq_distances_sql('cdr3b', 'sd', 'su', 'su')} SELECT p.clone_idx AS i, q.clone_idx AS j, a.dist + b.dist AS dist FROM su p, su q, sa a, sd b WHERE a.x = p.cdr3a AND a.y = q.cdr3a AND b.x = p.cdr3b AND b.y = q.cdr3b AND a.dist + b.dist <= 60 AND p.clone_idx <> q.clone_idx")
def distance_cdr3_pairs(spark, sf_dir):
    """CDR3s of both chains alone, as with V distances that are all 0."""
    return dst.distance_sparse(clones(spark, sf_dir, "supplier"), 60, "cdr3")


@query(f"WITH {SUPPLIERS} SELECT clone_idx AS clone_idx_x, cdr3b AS cdr3b_x, clone_idx AS clone_idx_y, cdr3b AS cdr3b_y, 0.0::DOUBLE AS distance FROM su WHERE false")
def distance_join_empty(spark, sf_dir):
    """A left join with an empty side has no rows."""
    c = clones(spark, sf_dir, "supplier").select("clone_idx", "cdr3b").withColumn("vb", F.lit(None).cast("string"))
    return dst.distance_join(c, c.limit(0), 6, 3, "left", components=["cdr3b"]).drop("vb_x", "vb_y")


def _repertoire(spark: SparkSession, sf_dir: str) -> Repertoire:
    c = clones(spark, sf_dir, "supplier")
    rep = build_repertoire(c.drop("clone_idx"), "synthetic", deduplicate=False, order=["va", "cdr3a", "vb", "cdr3b", "subject", "epitope", "ja", "jb", "count"])
    return Repertoire(rep.clones, "synthetic", edges=dst.distance_sparse(rep.clones, 24, ["cdr3b"]))


REP = f"{SUPPLIERS}, rp AS (SELECT *, row_number() OVER (ORDER BY va, cdr3a, vb, cdr3b, subject, epitope, ja, jb, \"count\") - 1 AS place FROM su)"


@query(f"WITH {REP}, k AS (SELECT *, row_number() OVER (ORDER BY place) - 1 AS renumbered FROM rp WHERE \"count\" > 4), {seq_distances_sql('cdr3b', 'sd', 'k', 'k')} SELECT p.renumbered AS i, q.renumbered AS j, dist FROM sd JOIN k p ON p.cdr3b = x JOIN k q ON q.cdr3b = y WHERE dist <= 24 AND p.renumbered <> q.renumbered")
def repertoire_edges(spark, sf_dir):
    """A subset renumbers its clones and the edges between them."""
    return _repertoire(spark, sf_dir).subset("`count` > 4").edges


@query(f"WITH {REP}, w AS (SELECT unnest([3, 0, 3, 5]) AS p, unnest([0, 1, 2, 3]) AS n) SELECT n::BIGINT AS clone_idx, va, cdr3a, vb, cdr3b FROM rp JOIN w ON p = place")
def repertoire_take(spark, sf_dir):
    return _repertoire(spark, sf_dir).take([3, 0, 3, 5]).clones.select("clone_idx", "va", "cdr3a", "vb", "cdr3b")


@query(f"WITH {REP} SELECT 'synthetic' AS organism, 'AB' AS chains, 'weighted' AS metric, count(*) AS clones, count(DISTINCT subject) AS subjects FROM rp")
def repertoire_fields(spark, sf_dir):
    """What a repertoire holds, by its fields and in what it prints."""
    rep = _repertoire(spark, sf_dir)
    assert all(x in repr(rep) for x in ("synthetic", "AB", "weighted", "edges"))
    return rep.clones.agg(F.lit(rep.organism).alias("organism"), F.lit(rep.chains).alias("chains"), F.lit(rep.metric).alias("metric"), F.count("*").alias("clones"), F.countDistinct("subject").alias("subjects"))


@query("SELECT * FROM (VALUES ('as it is', 'fine'), ('a gene that is unknown', 'unknown genes in vb'), ('a letter that is none', 'not valid in the clone table'), ('a null', 'not valid in the clone table'), ('no chain', 'missing columns')) t(kind, said)")
def clone_validation(spark, sf_dir):
    c = clones(spark, sf_dir).select("clone_idx", "va", "cdr3a", "vb", "cdr3b")
    odd = F.col("clone_idx") % 50 == 7
    cases = {
        "as it is": c, "a gene that is unknown": c.withColumn("vb", F.when(odd, "W1").otherwise(F.col("vb"))), "a letter that is none": c.withColumn("cdr3a", F.when(odd, "CAXF").otherwise(F.col("cdr3a"))),
        "a null": c.withColumn("va", F.when(~odd, F.col("va"))), "no chain": c.drop("va", "vb"),
    }

    def said(df: DataFrame) -> str:
        try:
            build_repertoire(df, "synthetic", deduplicate=False, v_distances=v_distances(loops(spark)))
        except ValueError as wrong:
            return str(wrong).split(":")[0]
        return "fine"

    return spark.createDataFrame([(k, said(df)) for k, df in cases.items()], "kind string, said string")


# ---- junctions ------------------------------------------------------------------------------------------


@query("WITH c AS (SELECT p_partkey, p_name AS a, p_brand AS b FROM part), x AS (SELECT p_partkey, lower(substr(b, 1, 6)) || a AS a, lower(b) || reverse(a) AS b FROM c), s AS (SELECT p_partkey, k, sum(CASE WHEN substr(a, CAST(k AS INTEGER), 1) = substr(b, CAST(k AS INTEGER), 1) THEN 1 ELSE -4 END) OVER (PARTITION BY p_partkey ORDER BY k) AS s FROM x, range(1, 200) r(k) WHERE k <= least(length(a), length(b))), m AS (SELECT p_partkey, greatest(max(s), 0) AS m FROM s GROUP BY 1) SELECT x.p_partkey, coalesce(max(k) FILTER (s = m), 0)::INTEGER AS matches FROM x LEFT JOIN s ON s.p_partkey = x.p_partkey LEFT JOIN m ON m.p_partkey = x.p_partkey GROUP BY 1")
def matching_prefix(spark, sf_dir):
    """How far two strings agree, when a mismatch costs four matches."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lower(F.substring("p_brand", 1, 6)), "p_name").alias("a"), F.concat(F.lower("p_brand"), F.reverse("p_name")).alias("b"))
    return p.select("p_partkey", _by_arrow(kernel.nucleotide_matches, "int", "a", "b").alias("matches"))


JUNCTION_SQL = f"""
WITH base AS (SELECT c_custkey AS id, 'tgtgccagcagc' || CASE c_custkey % 3 WHEN 0 THEN 'gggacag' WHEN 1 THEN 'actagcg' ELSE 'acgtacg' END AS head, array_to_string(list_transform(range(0, CAST(c_custkey % 4 * 3 + 6 AS BIGINT)), lambda p: substr('acgt', CAST((c_custkey*5 + p*p + p*(c_custkey % 7)) % 4 + 1 AS INTEGER), 1)), '') AS mid FROM customer),
cut AS (SELECT id, head || substr(mid, 1, CAST(length(mid) - 1 - (length(mid) + 6) % 3 AS INTEGER)) || 'gagcagtacttt' AS nuc FROM base),
n AS (SELECT id, substr(nuc, 1, CAST(length(nuc) - length(nuc) % 3 AS INTEGER)) AS nuc FROM cut),
sv AS (SELECT id, k, sum(CASE WHEN substr('{SEGMENTS['V']['V0']}', CAST(k AS INTEGER), 1) = substr(nuc, CAST(k AS INTEGER), 1) THEN 1 ELSE -4 END) OVER (PARTITION BY id ORDER BY k) AS s FROM n, range(1, {len(SEGMENTS['V']['V0']) + 1}) r(k) WHERE k <= length(nuc)),
sj AS (SELECT id, k, sum(CASE WHEN substr(reverse('{SEGMENTS['J']['JB0']}'), CAST(k AS INTEGER), 1) = substr(reverse(nuc), CAST(k AS INTEGER), 1) THEN 1 ELSE -4 END) OVER (PARTITION BY id ORDER BY k) AS s FROM n, range(1, {len(SEGMENTS['J']['JB0']) + 1}) r(k) WHERE k <= length(nuc)),
bv AS (SELECT id, coalesce(max(k) FILTER (s = m), 0) AS ov FROM (SELECT *, greatest(max(s) OVER (PARTITION BY id), 0) AS m FROM sv) GROUP BY id),
bj AS (SELECT id, coalesce(max(k) FILTER (s = m), 0) AS oj FROM (SELECT *, greatest(max(s) OVER (PARTITION BY id), 0) AS m FROM sj) GROUP BY id),
o AS (SELECT n.id, nuc, ov, oj, greatest(ov + oj - length(nuc), 0) AS excess FROM n JOIN bv USING (id) JOIN bj USING (id)),
t AS (SELECT id, nuc, ov - excess//2 AS v, oj - (excess - excess//2) AS j FROM o),
mm AS (SELECT *, substr(nuc, CAST(v + 1 AS INTEGER), CAST(length(nuc) - j - v AS INTEGER)) AS middle FROM t),
ds AS (SELECT * FROM (VALUES (1, '{SEGMENTS['D']['D1']}'), (2, '{SEGMENTS['D']['D2']}')) x(d_id, d)),
hits AS (SELECT mm.id, d_id, st, l, length(d) AS dl, instr(middle, substr(d, CAST(st + 1 AS INTEGER), CAST(l AS INTEGER))) AS pos FROM mm, ds, range(0, 12) a(st), range(1, 13) b(l) WHERE st + l <= length(d) AND instr(middle, substr(d, CAST(st + 1 AS INTEGER), CAST(l AS INTEGER))) > 0),
dd AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY l DESC, d_id, st) AS r FROM hits) WHERE r = 1),
fin AS (SELECT mm.id, nuc, v, j, middle, coalesce(d_id, 0) AS d_id, coalesce(st, 0) AS d0, coalesce(dl - st - l, 0) AS d1, coalesce(l, 0) AS l, coalesce(pos - 1, 0) AS pos, length(middle) AS n FROM mm LEFT JOIN dd USING (id)),
src AS (SELECT *, repeat('V', CAST(v AS INTEGER)) || CASE WHEN l = 0 THEN repeat('N', CAST(n AS INTEGER)) ELSE repeat('N', CAST(pos AS INTEGER)) || repeat('D', CAST(l AS INTEGER)) || repeat('N', CAST(n - pos - l AS INTEGER)) END || repeat('J', CAST(j AS INTEGER)) AS source FROM fin),
cnt AS (SELECT *, list_transform(range(0, length(nuc)//3), lambda k: length(replace(replace(replace(substr(source, CAST(3*k + 1 AS INTEGER), 3), 'V', ''), 'D', ''), 'J', ''))) AS c, list_transform(range(0, length(nuc)//3), lambda k: {CODONS}[substr(nuc, CAST(3*k + 1 AS INTEGER), 3)]) AS aa FROM src)
"""


@query(f"{JUNCTION_SQL} SELECT id AS clone_idx, nuc AS cdr3b_nucseq, CASE WHEN l = 0 THEN middle ELSE substr(middle, 1, CAST(pos AS INTEGER)) || repeat('+', CAST(l AS INTEGER)) || substr(middle, CAST(pos + l + 1 AS INTEGER)) END AS new_nucseq, array_to_string(list_transform(range(1, len(c) + 1), lambda k: CASE c[k] WHEN 0 THEN '-' WHEN 1 THEN lower(aa[k]) ELSE aa[k] END), '') AS masked, array_to_string(c, '') AS new_counts, source, ({len(SEGMENTS['V']['V0'])} - v)::INTEGER AS v_trim, d0::INTEGER AS d0_trim, d1::INTEGER AS d1_trim, ({len(SEGMENTS['J']['JB0'])} - j)::INTEGER AS j_trim, d_id::INTEGER AS d_id, CASE WHEN l = 0 THEN 0 ELSE pos END::INTEGER AS vd_insert, CASE WHEN l = 0 THEN 0 ELSE n - pos - l END::INTEGER AS dj_insert, CASE WHEN l = 0 THEN n ELSE 0 END::INTEGER AS vj_insert FROM cnt")
def junction_analysis(spark, sf_dir):
    return junction.with_junctions(_junctions(spark, sf_dir), SEGMENTS, "B").select("clone_idx", "cdr3b_nucseq", "junction.*")


@query(f"{JUNCTION_SQL} SELECT id AS clone_idx, array_to_string(list_transform(range(1, length(source) + 1), lambda k: CASE WHEN substr(source, CAST(k AS INTEGER), 1) <> 'N' THEN substr(source, CAST(k AS INTEGER), 1) WHEN instr(source, 'D') > 0 AND k > instr(source, 'D') THEN 'N2' ELSE 'N1' END), '-') AS nucseq_src FROM src")
def nucleotide_source(spark, sf_dir):
    return junction.nucleotide_sources(_junctions(spark, sf_dir), SEGMENTS, "B").select("clone_idx", F.array_join("nucseq_src", "-").alias("nucseq_src"))


@query(f"{JUNCTION_SQL}, p AS (SELECT id, source, list_filter(range(1, length(source)), lambda k: substr(source, CAST(k AS INTEGER), 1) <> substr(source, CAST(k + 1 AS INTEGER), 1) OR substr(source, CAST(k + 1 AS INTEGER), 1) = 'N') AS cuts FROM src) SELECT id AS clone_idx, array_to_string(list_filter(cuts, lambda k: instr(source, 'D') = 0 OR k < instr(source, 'D')), ',') AS before, array_to_string(list_filter(cuts, lambda k: instr(source, 'D') > 0 AND k >= instr(source, 'D')), ',') AS after FROM p")
def junction_breakpoints(spark, sf_dir):
    """Where junctions may be cut, as places from the start."""
    places = lambda side: lambda s: ",".join(str(p) for p in junction.breakpoints(s)[side] if p > 0)
    held = junction.with_junctions(_junctions(spark, sf_dir), SEGMENTS, "B").select("clone_idx", F.col("junction.source").alias("source"))
    return held.select("clone_idx", _by_arrow(places(0), "string", "source").alias("before"), _by_arrow(places(1), "string", "source").alias("after"))


_MASKED = "array_to_string(list_transform(range(1, len({c}) + 1), lambda k: CASE {c}[k] WHEN 0 THEN '-' WHEN 1 THEN lower(aa[k]) ELSE aa[k] END), '')"


@query(f"""{JUNCTION_SQL}, al AS (SELECT *, repeat('V', CAST(v AS INTEGER)) || repeat('N', CAST(n AS INTEGER)) || repeat('J', CAST(j AS INTEGER)) AS asrc FROM cnt), ac AS (SELECT *, list_transform(range(0, length(nuc)//3), lambda k: length(replace(replace(substr(asrc, CAST(3*k + 1 AS INTEGER), 3), 'V', ''), 'J', ''))) AS a FROM al)
SELECT id AS clone_index, 'V0' AS va, 'JB0' AS ja, array_to_string(aa, '') AS cdr3a, nuc AS cdr3a_nucseq, {_MASKED.format(c="a")} AS cdr3a_protseq_masked, asrc AS cdr3a_nucseq_src, ({len(SEGMENTS["V"]["V0"])} - v)::INTEGER AS va_trim, ({len(SEGMENTS["J"]["JB0"])} - j)::INTEGER AS ja_trim, n::INTEGER AS a_insert,
'V0' AS vb, 'JB0' AS jb, array_to_string(aa, '') AS cdr3b, nuc AS cdr3b_nucseq, {_MASKED.format(c="c")} AS cdr3b_protseq_masked, source AS cdr3b_nucseq_src, ({len(SEGMENTS["V"]["V0"])} - v)::INTEGER AS vb_trim, d0::INTEGER AS d0_trim, d1::INTEGER AS d1_trim, ({len(SEGMENTS["J"]["JB0"])} - j)::INTEGER AS jb_trim,
CASE WHEN l = 0 THEN 0 ELSE pos END::INTEGER AS vd_insert, CASE WHEN l = 0 THEN 0 ELSE n - pos - l END::INTEGER AS dj_insert, CASE WHEN l = 0 THEN n ELSE 0 END::INTEGER AS vj_insert FROM ac""")
def junction_table(spark, sf_dir):
    """Both chains of each clone in one row; here they have the same nucleotides, of which only the beta chain looks for a D gene."""
    j = _junctions(spark, sf_dir)
    return junction.parse_junctions(j.withColumns({"va": F.col("vb"), "ja": F.col("jb"), "cdr3a": F.col("cdr3b"), "cdr3a_nucseq": F.col("cdr3b_nucseq")}), SEGMENTS)


#: Two alleles of one V gene, the second of which explains more of some junctions.
ALLELES = {"V": {"V0*01": "tgtgccagcagctta", "V0*02": "tgtgccagcagcgggaca"}, "J": {"JB0*01": "tacgagcagtacttt"}, "D": {}}


@query(f"WITH n AS (SELECT id, nuc FROM ({JUNCTION_SQL} SELECT id, nuc FROM n)), s AS (SELECT id, a, k, sum(CASE WHEN substr(seq, CAST(k AS INTEGER), 1) = substr(nuc, CAST(k AS INTEGER), 1) THEN 1 ELSE -4 END) OVER (PARTITION BY id, a ORDER BY k) AS s FROM n, (VALUES (1, '{ALLELES['V']['V0*01']}'), (2, '{ALLELES['V']['V0*02']}')) g(a, seq), range(1, 30) r(k) WHERE k <= least(length(seq), length(nuc))), m AS (SELECT id, a, coalesce(max(k) FILTER (s = t), 0) AS m FROM (SELECT *, greatest(max(s) OVER (PARTITION BY id, a), 0) AS t FROM s) GROUP BY id, a) SELECT 'V0*01' AS \"old\", 'V0*02' AS \"new\", count(*) AS \"count\" FROM m x JOIN m y ON x.id = y.id AND x.a = 1 AND y.a = 2 WHERE y.m >= x.m + 2")
def allele_replacements(spark, sf_dir):
    """How often another allele of the gene explains two nucleotides more of a junction."""
    j = _junctions(spark, sf_dir).withColumns({"vb": F.lit("V0*01"), "jb": F.lit("JB0*01")})
    return junction.allele_swaps(j, ALLELES, "B")[1]


@query(f"WITH {SUPPLIERS}, {BASE}, {seq_distances_sql('cdr3a', 'sa', 'su', 'cl')}, {seq_distances_sql('cdr3b', 'sb', 'su', 'cl')}, {loops_sql()}, {v_sql()}, ha AS (SELECT p.clone_idx AS i, least(floor(dist + vdist), 96) AS d, count(*) AS n FROM su p JOIN sa ON x = p.cdr3a JOIN cl q ON q.cdr3a = y JOIN vd ON g1 = p.va AND g2 = q.va GROUP BY 1, 2), hb AS (SELECT p.clone_idx AS i, least(floor(dist + vdist), 96) AS d, count(*) AS n FROM su p JOIN sb ON x = p.cdr3b JOIN cl q ON q.cdr3b = y JOIN vd ON g1 = p.vb AND g2 = q.vb GROUP BY 1, 2), ps AS (SELECT ha.i, ha.d + hb.d AS d, sum(ha.n * hb.n) AS n FROM ha JOIN hb ON ha.i = hb.i WHERE ha.d + hb.d <= 96 GROUP BY 1, 2), g AS (SELECT clone_idx AS i, d FROM su, range(0, 97) r(d)), c AS (SELECT g.i, g.d, sum(coalesce(ps.n, 0)) OVER (PARTITION BY g.i ORDER BY g.d) AS n FROM g LEFT JOIN ps ON ps.i = g.i AND ps.d = g.d) SELECT i, d::INTEGER AS d, round(greatest(n, 0.25)/((SELECT count(*) FROM cl)*(SELECT count(*) FROM cl)), 12) AS freq FROM c")
def background_distribution(spark, sf_dir):
    """Shares of paired background chains within 0 to 96 of each supplier's clone; the background is all customers' chains."""
    own, other = clones(spark, sf_dir, "supplier"), clones(spark, sf_dir)
    spec = dst.DistanceSpec.of(own, "all", v_distances(loops(spark)))
    return junction.background_frequencies(own, other.select("va", "cdr3a"), other.select("vb", "cdr3b"), spec, 96).withColumn("freq", F.round("freq", 12))


# ---- statistics and graphs ------------------------------------------------------------------------------

BH = "round(least(1, min(raw) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 6)"
NEAR = f"{seq_distances_sql()}, near AS (SELECT p.clone_idx AS i, q.clone_idx AS j, q.epitope AS e FROM sd JOIN cl p ON p.cdr3b = x JOIN cl q ON q.cdr3b = y WHERE dist <= 12)"


def _labels(spark: SparkSession, sf_dir: str) -> tuple[dst.Linked, DataFrame]:
    c = clones(spark, sf_dir)
    return dst.linked(c, 12, ["cdr3b"]), c.select(F.col("clone_idx").alias("i"), "epitope")


@query(f"WITH {BASE}, {NEAR}, c AS (SELECT i, count(*) FILTER (e = 'E0') AS a, count(*) FILTER (e <> 'E0') AS b FROM near GROUP BY i), tt AS (SELECT count(*) FILTER (epitope = 'E0') AS ta, count(*) AS t FROM cl), u AS (SELECT DISTINCT a, b, ta, t, a + b AS k FROM c, tt), su AS (SELECT a, b, h, lgamma(ta + 1) - lgamma(h + 1) - lgamma(ta - h + 1) + lgamma(t - ta + 1) - lgamma(k - h + 1) - lgamma(t - ta - k + h + 1) - lgamma(t + 1) + lgamma(k + 1) + lgamma(t - k + 1) AS lp FROM u, LATERAL (SELECT unnest(range(CAST(greatest(0, k - (t - ta)) AS BIGINT), CAST(least(k, ta) + 1 AS BIGINT))) AS h)), pp AS (SELECT a, b, least(1, sum(exp(lp)) FILTER (exp(lp) <= exp(own)*(1 + 1e-7))) AS p FROM (SELECT *, max(lp) FILTER (h = a) OVER (PARTITION BY a, b) AS own FROM su) GROUP BY a, b), r AS (SELECT i, a + b AS n, CASE WHEN a + b <= 1 THEN 1.0 ELSE round(p, 9) END AS p FROM c JOIN pp USING (a, b)), q AS (SELECT *, count(*) OVER ()*p/(rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1) AS raw FROM r) SELECT i, n AS n_neighbors, round(p, 6) AS pvalue, {BH} AS pvalue_adj FROM q")
def neighbourhood_fisher(spark, sf_dir):
    """Fisher tests of two labels near each clone; the odds ratio is left out here, since it solves an equation."""
    edges, labels = _labels(spark, sf_dir)
    labels = labels.select("i", F.when(F.col("epitope") == "E0", "in").otherwise("out").alias("label"))
    found = enrichment.neighbourhood_test(edges, labels, 12, adjust=False).withColumn("pvalue", F.round("pvalue", 9)).drop("pvalue_adj")
    return adjust_bh(found, "pvalue", "pvalue_adj").select("i", "n_neighbors", F.round("pvalue", 6).alias("pvalue"), F.round("pvalue_adj", 6).alias("pvalue_adj"))


@query(f"WITH {BASE}, {NEAR}, c AS (SELECT i, l.e, count(n.j) AS a FROM (SELECT clone_idx AS i FROM cl) CROSS JOIN (SELECT DISTINCT epitope AS e FROM cl) l LEFT JOIN near n USING (i, e) GROUP BY ALL), tt AS (SELECT epitope AS e, count(*) AS t FROM cl GROUP BY 1), w AS (SELECT c.i, a, t - a AS b, t, sum(a) OVER (PARTITION BY i) AS na, (SELECT count(*) FROM cl) AS n FROM c JOIN tt ON tt.e = c.e), x AS (SELECT i, max(na)::BIGINT AS na, sum(pow(a - t*na/n, 2)/(t*na/n) + pow(b - t*(n - na)/n, 2)/(t*(n - na)/n)) AS x FROM w GROUP BY i), r AS (SELECT i, na, round(CASE WHEN na <= 1 OR x <= 0 THEN 1.0 ELSE greatest(0, 1 - list_sum(list_transform(range(0, 400), lambda k: exp((1.5 + k)*ln(x/2) - x/2 - lgamma(2.5 + k))))) END, 9) AS p FROM x), q AS (SELECT *, count(*) OVER ()*p/(rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1) AS raw FROM r) SELECT i, na AS n_neighbors, round(p, 6) AS pvalue, {BH} AS pvalue_adj FROM q")
def neighbourhood_chi_square(spark, sf_dir):
    edges, labels = _labels(spark, sf_dir)
    found = enrichment.neighbourhood_test(edges, labels.withColumnRenamed("epitope", "label"), 12, "chisq", adjust=False).withColumn("pvalue", F.round("pvalue", 9)).drop("pvalue_adj")
    return adjust_bh(found, "pvalue", "pvalue_adj").select("i", "n_neighbors", F.round("pvalue", 6).alias("pvalue"), F.round("pvalue_adj", 6).alias("pvalue_adj"))


@query("SELECT p_partkey, (p_size % 12)::BIGINT AS k, round((p_partkey % 37)/4.0, 2) AS mu, round(CASE WHEN p_size % 12 = 0 THEN 1.0 WHEN p_partkey % 37 = 0 THEN 0.0 ELSE list_sum(list_transform(range(CAST(p_size % 12 AS BIGINT), 120), lambda j: exp(j*ln((p_partkey % 37)/4.0) - (p_partkey % 37)/4.0 - lgamma(j + 1)))) END, 9) AS tail FROM part")
def poisson_tails(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 12).cast("long").alias("k"), F.round(F.col("p_partkey") % 37 / 4.0, 2).alias("mu"))
    return with_poisson_tail(p, "k", "mu", "tail").withColumn("tail", F.round("tail", 9))


CLUMPS = f"""
WITH RECURSIVE {SUPPLIERS}, {seq_distances_sql('cdr3b', 'sd', 'su', 'su')}, gr AS (SELECT clone_idx AS i, dense_rank() OVER (ORDER BY va || chr(31) || ja || chr(31) || cdr3a) AS a, dense_rank() OVER (ORDER BY vb || chr(31) || jb || chr(31) || cdr3b) AS b FROM su),
e AS (SELECT p.clone_idx AS i, q.clone_idx AS j, dist FROM sd JOIN su p ON p.cdr3b = x JOIN su q ON q.cdr3b = y JOIN gr g ON g.i = p.clone_idx JOIN gr h ON h.i = q.clone_idx WHERE dist <= 12 AND g.a <> h.a AND g.b <> h.b),
ps AS (SELECT x.i, count(y.i) AS possible FROM gr x LEFT JOIN gr y ON x.a <> y.a AND x.b <> y.b GROUP BY x.i), lv AS (SELECT unnest([6, 12]) AS r),
ct AS (SELECT i, r, count(*) AS n, 1e-5*(r + 1) AS f, possible*1e-5*(r + 1) AS mu FROM e JOIN lv ON dist <= r JOIN ps USING (i) GROUP BY i, r, possible),
pv AS (SELECT *, list_sum(list_transform(range(n, n + 80), lambda k: exp(k*ln(mu) - mu - lgamma(k + 1)))) AS p FROM ct),
rw AS (SELECT clone_idx AS i, lv.r, round(coalesce(p, 1.0), 15) AS p FROM su CROSS JOIN lv LEFT JOIN pv ON pv.i = clone_idx AND pv.r = lv.r),
bh AS (SELECT *, (count(*) OVER ())*p/(rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1) AS raw FROM rw), fd AS (SELECT i, min(q) AS fdr FROM (SELECT i, least(1, min(raw) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) AS q FROM bh) GROUP BY i),
rs AS (SELECT *, p*2*(SELECT count(*) FROM su) AS adj FROM pv WHERE p*2*(SELECT count(*) FROM su) <= 1), mx AS (SELECT i, max(r) AS r FROM rs GROUP BY i),
ln AS (SELECT e.i, e.j FROM e JOIN mx ON mx.i = e.i AND e.dist <= mx.r WHERE e.j IN (SELECT i FROM mx)), bo AS (SELECT i, j FROM ln UNION SELECT j, i FROM ln), re AS (SELECT i, i AS c FROM mx UNION SELECT bo.j, re.c FROM re JOIN bo ON bo.i = re.i),
co AS (SELECT i, min(c) AS c FROM re GROUP BY i), nb AS (SELECT c, row_number() OVER (ORDER BY count(*) DESC, c) AS g FROM co GROUP BY c)
"""


@query(f"{CLUMPS} SELECT 'global' AS clump_type, rs.i AS clone_index, rs.r::INTEGER AS nbr_radius, round(adj, 9) AS pvalue_adj, n AS num_nbrs, round(mu, 9) AS expected_num_nbrs, round(f*2500000000.0, 4) AS raw_count, su.va, su.cdr3b, round(fdr, 9) AS clonotype_fdr_value, g::INTEGER AS clumping_group FROM rs JOIN su ON su.clone_idx = rs.i JOIN fd ON fd.i = rs.i JOIN co ON co.i = rs.i JOIN nb ON nb.c = co.c")
def poisson_clumps(spark, sf_dir):
    """Neighbour counts against a background of one in a hundred thousand for each unit of distance."""
    c = clones(spark, sf_dir, "supplier")
    groups = graph.cut_lineage(dst.tcr_groups(c))
    edges = dst.linked(c.join(groups, F.col("clone_idx") == F.col("i")).drop("i"), 12, ["cdr3b"], groups=("agroup", "bgroup"))
    background = c.select(F.col("clone_idx").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(12))).alias("d")).withColumn("freq", 1e-5 * (F.col("d") + 1))
    found = enrichment.find_clumping(c, edges, groups, background, (6, 12))
    r = lambda x, n=9: F.round(x, n).alias(x)
    return found.select("clump_type", "clone_index", "nbr_radius", r("pvalue_adj"), "num_nbrs", r("expected_num_nbrs"), r("raw_count", 4), "va", "cdr3b", r("clonotype_fdr_value"), "clumping_group")


@query("SELECT clump_type, clone_index, nbr_radius, pvalue_adj, num_nbrs FROM (SELECT 'global' AS clump_type, 1::BIGINT AS clone_index, 1::INTEGER AS nbr_radius, 0.0::DOUBLE AS pvalue_adj, 1::BIGINT AS num_nbrs) WHERE false")
def clumps_of_none(spark, sf_dir):
    """Where nothing is above the background there is an empty table of the same columns."""
    c = clones(spark, sf_dir, "supplier")
    groups = dst.tcr_groups(c)
    background = c.select(F.col("clone_idx").alias("i"), F.lit(6).alias("d"), F.lit(1.0).alias("freq"))
    return enrichment.find_clumping(c, dst.linked(c, 6, ["cdr3b"]), groups, background, (6,)).select("clump_type", "clone_index", "nbr_radius", "pvalue_adj", "num_nbrs")


FUZZY = f"""
WITH RECURSIVE {BASE}, {seq_distances_sql()}, ps AS (SELECT p.clone_idx AS i, q.clone_idx AS j, CASE WHEN p.clone_idx = q.clone_idx THEN 1000.0 ELSE dist END AS dist FROM sd JOIN cl p ON p.cdr3b = x JOIN cl q ON q.cdr3b = y),
kn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS r FROM ps) WHERE r <= 10),
li AS (SELECT i, list(dist ORDER BY r) AS ds, coalesce(min(dist) FILTER (dist > 0), 0) AS rho, avg(dist) AS mean, (SELECT avg(dist) FROM kn) AS everywhere FROM kn GROUP BY i),
st AS (SELECT i, ds, rho, 0 AS k, 0.0::DOUBLE AS lo, 1e308::DOUBLE AS hi, 1.0::DOUBLE AS sigma, list_sum(list_transform(ds, lambda d: CASE WHEN d > rho THEN exp(-(d - rho)/1.0) ELSE 1.0 END)) AS total FROM li
UNION ALL SELECT i, ds, rho, k + 1, nlo, nhi, ns, list_sum(list_transform(ds, lambda d: CASE WHEN d > rho THEN exp(-(d - rho)/ns) ELSE 1.0 END)) FROM (SELECT *, CASE WHEN nhi >= 1e308 THEN 2*sigma ELSE (nlo + nhi)/2 END AS ns FROM (SELECT *, CASE WHEN total > log2(11) THEN lo ELSE sigma END AS nlo, CASE WHEN total > log2(11) THEN sigma ELSE hi END AS nhi FROM st WHERE k < 64 AND abs(total - log2(11)) >= 1e-5))),
sg AS (SELECT i, arg_max(sigma, k) AS sigma FROM st GROUP BY i), sc AS (SELECT li.i, rho, greatest(sigma, 1e-3*CASE WHEN rho > 0 THEN mean ELSE everywhere END) AS sigma FROM li JOIN sg USING (i)),
on_ AS (SELECT kn.i, kn.j, CASE WHEN dist <= rho THEN 1.0 ELSE exp(-(dist - rho)/sigma) END AS w FROM kn JOIN sc USING (i) WHERE kn.i <> kn.j), pr AS (SELECT least(i, j) AS a, greatest(i, j) AS b, sum(w) - CASE WHEN count(*) > 1 THEN min(w)*max(w) ELSE 0 END AS weight FROM on_ GROUP BY 1, 2)
"""


@query(f"{FUZZY} SELECT a AS i, b AS j, round(weight, 5) AS weight FROM pr UNION ALL SELECT b, a, round(weight, 5) FROM pr")
def fuzzy_graph(spark, sf_dir):
    """Symmetric weights of the ten nearest, with a scale for each clone."""
    return embedding.fuzzy_graph(dst.knn(clones(spark, sf_dir), 10, ["cdr3b"])).withColumn("weight", F.round("weight", 5))


@query(f"{FUZZY}, mx AS (SELECT i, max(r) AS k FROM kn GROUP BY i) SELECT i, round(sum((k - r + 1)/k*dist)/sum((k - r + 1)/k), 9) AS nndist FROM kn JOIN mx USING (i) GROUP BY i")
def nearest_density(spark, sf_dir):
    return embedding.nearest_density(dst.knn(clones(spark, sf_dir), 10, ["cdr3b"])).withColumn("nndist", F.round("nndist", 9))


@query(f"WITH {SUPPLIERS}, {seq_distances_sql('cdr3b', 'sd', 'su', 'su')}, k AS (SELECT p.clone_idx AS i, q.clone_idx AS j, 1 - dist/(SELECT max(dist) FROM sd) AS k FROM sd JOIN su p ON p.cdr3b = x JOIN su q ON q.cdr3b = y), m AS (SELECT i, avg(k) AS m FROM k GROUP BY i), g AS (SELECT avg(k) AS g FROM k) SELECT k.i - (SELECT min(clone_idx) FROM su) AS i, k.j - (SELECT min(clone_idx) FROM su) AS j, round(k.k - a.m - b.m + g, 9) + 0.0 AS value FROM k JOIN m a ON a.i = k.i JOIN m b ON b.i = k.j, g")
def centred_kernel(spark, sf_dir):
    """Similarities of all pairs, centred."""
    m = _supplier_matrix(spark, sf_dir)
    return m.cells(embedding.class_kernel(m)).withColumn("value", F.round("value", 9) + 0.0)


LINKS = f"WITH RECURSIVE {SUPPLIERS}, {seq_distances_sql('cdr3b', 'sd', 'su', 'su')}, e AS (SELECT p.clone_idx AS i, q.clone_idx AS j FROM sd JOIN su p ON p.cdr3b = x JOIN su q ON q.cdr3b = y WHERE dist <= 12), r AS (SELECT clone_idx AS i, clone_idx AS c FROM su UNION SELECT e.j, r.c FROM r JOIN e ON e.i = r.i), co AS (SELECT i, min(c) AS c FROM r GROUP BY i)"


@query(f"{LINKS} SELECT i - (SELECT min(clone_idx) FROM su) AS i, dense_rank() OVER (ORDER BY c)::INTEGER AS cluster FROM co")
def single_linkage(spark, sf_dir):
    """A tree of single linkage, cut at a height, numbered by first appearance."""
    c = _numbered(spark, sf_dir)
    return graph.single_linkage(c.select(F.col("clone_idx").alias("i")), dst.linked(c, 12, ["cdr3b"]))


@query(f"{LINKS}, s AS (SELECT c, row_number() OVER (ORDER BY count(*) DESC, c)::INTEGER AS cluster FROM co GROUP BY c) SELECT i, cluster FROM co JOIN s USING (c)")
def clusters_by_size(spark, sf_dir):
    c = clones(spark, sf_dir, "supplier")
    return graph.by_size(graph.connected_components(c.select(F.col("clone_idx").alias("i")), dst.linked(c, 12, ["cdr3b"])))


@query(f"WITH {SUPPLIERS}, {seq_distances_sql('cdr3b', 'sd', 'su', 'su')}, kt AS (SELECT dist FROM (SELECT dist, row_number() OVER (PARTITION BY p.clone_idx ORDER BY dist, q.clone_idx) AS r FROM sd JOIN su p ON p.cdr3b = x JOIN su q ON q.cdr3b = y WHERE p.clone_idx <> q.clone_idx) WHERE r = 6), o AS (SELECT dist, row_number() OVER (ORDER BY dist) AS n FROM kt), b AS (SELECT n, dist, dist*-2 + lag(dist) OVER (ORDER BY n) + lead(dist) OVER (ORDER BY n) AS bend FROM o) SELECT dist AS eps FROM b WHERE bend IS NOT NULL ORDER BY bend DESC, n LIMIT 1")
def automatic_eps(spark, sf_dir):
    """Where the sorted sixth distances bend most."""
    near = dst.knn(clones(spark, sf_dir, "supplier"), 6, ["cdr3b"]).filter("rank = 6")
    return spark.createDataFrame([(graph.auto_eps_of(near),)], "eps double")


@query(f"WITH {SUPPLIERS}, {BASE}, db AS (SELECT *, row_number() OVER (ORDER BY vb, cdr3b, epitope) - 1 AS at_ FROM (SELECT vb, cdr3b, epitope || '-' || clone_idx AS epitope FROM cl)), {seq_distances_sql('cdr3b', 'sd', 'su', 'db')}, e AS (SELECT p.clone_idx AS query_index, q.at_ AS db_index, dist AS distance, q.epitope AS db_epitope, 1e-9*(dist + 1)*(SELECT count(*) FROM su)*(SELECT count(*) FROM cl) AS adj FROM sd JOIN su p ON p.cdr3b = x JOIN db q ON q.cdr3b = y WHERE dist <= 60) SELECT query_index, db_index, distance, db_epitope, round(adj, 9) AS pvalue_adj FROM e WHERE adj <= 1")
def database_file_matches(spark, sf_dir):
    """A database in a file, numbered by its columns."""
    own, other = clones(spark, sf_dir, "supplier"), clones(spark, sf_dir)
    path = stored(other.select(F.col("vb").alias("vb_gene"), "cdr3b", F.concat_ws("-", "epitope", "clone_idx").alias("epitope")), "matches", "\t")
    background = own.select(F.col("clone_idx").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(200))).alias("d")).withColumn("freq", F.when(F.col("d") <= 60, 1e-9 * (F.col("d") + 1)).otherwise(1.0))
    found = enrichment.match_to_database(own, path, background, dst.DistanceSpec(("cdr3b",)))
    return found.select("query_index", "db_index", "distance", "db_epitope", F.round("pvalue_adj", 9).alias("pvalue_adj"))


@query(f"WITH {BASE}, u AS (SELECT DISTINCT clone_idx % 20 AS family, cdr3b[4:-3] AS s FROM cl), p AS (SELECT family, k - 1 AS position, substr(s, CAST(k AS INTEGER), 1) AS letter, count(*) AS n FROM u, range(1, 40) r(k) WHERE k <= length(s) GROUP BY ALL) SELECT family, position::INTEGER AS position, letter, round(n/sum(n) OVER (PARTITION BY family, position), 9) AS share FROM p")
def cdr3_profiles(spark, sf_dir):
    """Letters at each place of a family's CDR3s, which have one length."""
    rows = clones(spark, sf_dir).withColumn("family", F.col("clone_idx") % 20).select("family", "cdr3b").distinct()
    return plotdata.profiles(rows, "family", "cdr3b").withColumn("share", F.round("share", 9))


@query(f"{LINKS}, d AS (SELECT i, count(*) FILTER (i <> j) AS degree FROM e GROUP BY i) SELECT i, c AS component, degree FROM co JOIN d USING (i)")
def network_nodes(spark, sf_dir):
    c = clones(spark, sf_dir, "supplier")
    return graph.network(c.select(F.col("clone_idx").alias("i")), dst.linked(c, 12, ["cdr3b"]), 12.0)[0].select("i", "component", "degree")


@query(f"WITH {SUPPLIERS}, {seq_distances_sql('cdr3b', 'sd', 'su', 'su')}, d AS (SELECT p.clone_idx - (SELECT min(clone_idx) FROM su) AS i, q.clone_idx - (SELECT min(clone_idx) FROM su) AS j, dist FROM sd JOIN su p ON p.cdr3b = x JOIN su q ON q.cdr3b = y) SELECT i, j, dist, (SELECT median(dist) FROM d WHERE i < j) AS midpoint, (SELECT count(DISTINCT i) FROM d) AS places FROM d")
def heatmap_cells(spark, sf_dir):
    """The cells of an ordered heatmap, with the midpoint of its colours; the order itself is one of many."""
    m = _supplier_matrix(spark, sf_dir)
    midpoint, places = plotdata.class_heatmap(m)
    return m.cells(m.d).select("i", "j", F.col("value").alias("dist"), F.lit(midpoint).alias("midpoint"), F.lit(len(set(places))).cast("long").alias("places"))


# ---- tables behind figures ------------------------------------------------------------------------------


@query("WITH b AS (SELECT p_brand AS g FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 6), t AS (SELECT p_type AS g FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 6) SELECT CASE WHEN p_brand IN (FROM b) THEN p_brand ELSE 'Other' END AS source, CASE WHEN p_type IN (FROM t) THEN p_type ELSE 'Other' END AS target, count(*) AS \"count\", 0::INTEGER AS axis FROM part GROUP BY 1, 2")
def sankey_links(spark, sf_dir):
    return plotdata.sankey(table(spark, sf_dir, "part"), ["p_brand", "p_type"], 6)[1]


PLACES = f"{BASE}, pt AS (SELECT *, (clone_idx % 7)::DOUBLE AS x, (clone_idx % 5)::DOUBLE AS y FROM cl)"


def _places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = clones(spark, sf_dir)
    return c, c.select(F.col("clone_idx").alias("i"), F.array((F.col("clone_idx") % 7).cast("double"), (F.col("clone_idx") % 5).cast("double")).alias("embedding"))


@query(f"WITH {PLACES} SELECT clone_idx, x, y, epitope, va = 'A1' AS highlight FROM pt")
def scatter_points(spark, sf_dir):
    return plotdata.scatter(*_places(spark, sf_dir), "epitope", "va = 'A1'")[0]


@query(f"WITH {PLACES} SELECT epitope, round(avg(x), 9) AS x, round(avg(y), 9) AS y FROM pt GROUP BY epitope")
def scatter_centroids(spark, sf_dir):
    return plotdata.scatter(*_places(spark, sf_dir), "epitope")[1].select("epitope", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query(f"WITH {PLACES}, w AS (SELECT clone_idx AS i, x, y, count(*) OVER (PARTITION BY x, y) AS n, row_number() OVER (PARTITION BY x, y ORDER BY clone_idx) - 1 AS k FROM pt) SELECT i, round(CASE WHEN n > 1 THEN x + 0.3*cos(2*pi()*k/n) ELSE x END, 6) + 0.0 AS x, round(CASE WHEN n > 1 THEN y + 0.3*sin(2*pi()*k/n) ELSE y END, 6) + 0.0 AS y FROM w")
def spread_points(spark, sf_dir):
    """Points at one place, put on a circle around it."""
    p = _places(spark, sf_dir)[1].select("i", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    return plotdata.spread_coincident(p, 0.3).select("i", (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y"))


def _aligned_sql() -> str:
    letter = lambda s, k: f"substr({s}, CAST({k} AS INTEGER), 1)"
    before = f"coalesce(list_sum(list_transform(range(1, g + 1), lambda q: {_blosum_sql(letter('s', 'q'), letter('l', 'q'))})), 0)"
    after = f"coalesce(list_sum(list_transform(range(g + 1, length(s) + 1), lambda q: {_blosum_sql(letter('s', 'q'), letter('l', 'q + length(l) - length(s)'))})), 0)"
    return (
        f"WITH {SUPPLIERS}, u AS (SELECT DISTINCT cdr3b AS c FROM su), p AS (SELECT a.c AS s, b.c AS l FROM u a, u b WHERE length(a.c) < length(b.c)), "
        f"g AS (SELECT s, l, g, {before} + {after} AS score FROM p, range(1, 60) r(g) WHERE g < length(s)), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s, l ORDER BY score DESC, g) AS r FROM g) WHERE r = 1) "
        "SELECT s, l, substr(s, 1, CAST(g AS INTEGER)) || repeat('-', CAST(length(l) - length(s) AS INTEGER)) || substr(s, CAST(g + 1 AS INTEGER)) AS aligned FROM best"
    )


@query(_aligned_sql())
def aligned_pairs(spark, sf_dir):
    """The shorter of two sequences with its one gap."""
    u = clones(spark, sf_dir, "supplier").select(F.col("cdr3b").alias("s")).distinct()
    pairs = u.join(u.withColumnRenamed("s", "l"), F.length("s") < F.length("l"))
    return pairs.select("s", "l", _by_arrow(lambda a, b: kernel.align_one_gap(a, b)[0], "string", "s", "l").alias("aligned"))


@query(f"WITH {SUPPLIERS}, mem AS (SELECT * FROM su WHERE clone_idx % 4 = 1) SELECT 'va' AS field, va AS value, count(*) AS n FROM mem GROUP BY va UNION ALL SELECT 'vb', vb, count(*) FROM mem GROUP BY vb UNION ALL SELECT 'cdr3a length', CAST(length(cdr3a) AS VARCHAR), count(*) FROM mem GROUP BY 2 UNION ALL SELECT 'cdr3b length', CAST(length(cdr3b) AS VARCHAR), count(*) FROM mem GROUP BY 2 UNION ALL SELECT 'members', '', count(*) FROM mem")
def meta_clonotype_summary(spark, sf_dir):
    """Gene usage and lengths of one set of clones."""
    c = clones(spark, sf_dir, "supplier")
    members = [r.clone_idx for r in c.filter("clone_idx % 4 = 1").select("clone_idx").collect()]
    s = enrichment.summarize_meta_clonotype(c, members[0], members)
    rows = [(f, v, n) for f in ("va", "vb") for v, n in s[f"{f}_usage"]] + [("members", "", s["n_members"])]
    rows += [(f"{f} length", str(v), s[f"{f}_lengths"].count(v)) for f in ("cdr3a", "cdr3b") for v in sorted(set(s[f"{f}_lengths"]))]
    return spark.createDataFrame(rows, "field string, value string, n long")

