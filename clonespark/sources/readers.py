"""Clone tables from common export formats. Columns are strings unless a format says otherwise."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clonespark.functions.exprs import convert_adaptive_gene, ctaa_chain, ctgene_chain, first_listed, normalize_gene

GENES = ("va", "ja", "vb", "jb")
#: Column names of the formats.
COLUMN_MAPS = {
    "dash": {"v_a_gene": "va", "j_a_gene": "ja", "cdr3_a_aa": "cdr3a", "cdr3_a_nucseq": "cdr3a_nucseq", "v_b_gene": "vb", "j_b_gene": "jb", "cdr3_b_aa": "cdr3b", "cdr3_b_nucseq": "cdr3b_nucseq"},
    "scirpy": {"IR_VJ_1_v_call": "va", "IR_VJ_1_j_call": "ja", "IR_VJ_1_junction_aa": "cdr3a", "IR_VDJ_1_v_call": "vb", "IR_VDJ_1_j_call": "jb", "IR_VDJ_1_junction_aa": "cdr3b"},
    "dandelion": {"v_call_VJ": "va", "j_call_VJ": "ja", "junction_aa_VJ": "cdr3a", "v_call_VDJ": "vb", "j_call_VDJ": "jb", "junction_aa_VDJ": "cdr3b"},
}
CANONICAL = ("va", "cdr3a", "vb", "cdr3b")


def standardize(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename the columns that are there; others stay."""
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def normalized(df: DataFrame, normalize_genes: bool = True) -> DataFrame:
    return df.withColumns({c: normalize_gene(c) for c in GENES if c in df.columns}) if normalize_genes else df


def screpertoire_suffix(columns: list[str]) -> str | None:
    return next((s for s in ("_TCR", "_BCR", "") if {f"CTgene{s}", f"CTaa{s}"} <= set(columns)), None)


def from_screpertoire(df: DataFrame) -> DataFrame:
    """Chains of the combined gene and CDR3 columns; all other columns stay."""
    s = screpertoire_suffix(df.columns)
    if s is None:
        raise ValueError(f"no combined gene and CDR3 columns in {df.columns}")
    new = {}
    for c, chain in (("a", "A"), ("b", "B")):
        call = ctgene_chain(f"CTgene{s}", chain)
        new |= {f"v{c}": call.v, f"j{c}": call.j, f"cdr3{c}": ctaa_chain(f"CTaa{s}", chain)}
    return df.withColumns(new)


def detect_format(columns: list[str]) -> str:
    """canonical, screpertoire, scirpy, dandelion or dash."""
    if set(CANONICAL) <= set(columns):
        return "canonical"
    if screpertoire_suffix(columns) is not None:
        return "screpertoire"
    for name in ("scirpy", "dandelion", "dash"):
        if sum(c in columns for c in COLUMN_MAPS[name]) >= 4:
            return name
    raise ValueError(f"no known format has the columns {columns}")


def as_clone_table(df: DataFrame, names: Mapping[str, str] | None = None, format: str | None = None, normalize_genes: bool = True, drop_incomplete: bool = True) -> DataFrame:  # noqa: A002
    """df with canonical columns: by given names, by a named format, or by a detected one.

    drop_incomplete: rows with a null or empty chain column go.
    """
    if names:
        out = standardize(df, names)
    else:
        kind = format or detect_format(df.columns)
        if kind not in ("canonical", "screpertoire", *COLUMN_MAPS):
            raise ValueError(f"unknown format: {kind!r}")
        out = from_screpertoire(df) if kind == "screpertoire" else standardize(df, COLUMN_MAPS.get(kind, {}))
    out = normalized(out, normalize_genes)
    if drop_incomplete:
        for c in (c for c in CANONICAL if c in out.columns):
            out = out.filter(F.col(c).isNotNull() & (F.col(c) != ""))
    return out


def read_delimited(spark: SparkSession, path: str, sep: str) -> DataFrame:
    df = spark.read.option("sep", sep).option("header", True).csv(path)  # all columns are strings
    if df.isEmpty():
        raise ValueError(f"{path} has no rows")
    return df


def read_clone_table(spark: SparkSession, path: str, names: Mapping[str, str] | None = None, sep: str = "\t", normalize_genes: bool = True) -> DataFrame:
    return as_clone_table(read_delimited(spark, path, sep), names, None, normalize_genes, drop_incomplete=False)


def _true(c: Column) -> Column:
    return F.lower(c.cast("string")).isin("true", "t")


def pair_chains(alpha: DataFrame, beta: DataFrame, by: str) -> DataFrame:
    return alpha.join(beta, by).select(by, "va", "ja", "cdr3a", "vb", "jb", "cdr3b")


def paired_from_airr(rows: DataFrame, pair_by: str = "cell_id", productive_only: bool = True, normalize_genes: bool = True) -> DataFrame:
    """Alpha and beta rearrangements of each cell, paired: a cell with several of a chain gives several rows."""
    if productive_only:
        rows = rows.filter(_true(F.col("productive")))
    chain = lambda locus, c: rows.filter(F.col("locus") == locus).select(pair_by, first_listed("v_call").alias(f"v{c}"), first_listed("j_call").alias(f"j{c}"), F.col("junction_aa").alias(f"cdr3{c}"))
    return normalized(pair_chains(chain("TRA", "a"), chain("TRB", "b"), pair_by).withColumnRenamed(pair_by, "cell_id"), normalize_genes)


def read_airr(spark: SparkSession, path: str, pair_by: str = "cell_id", productive_only: bool = True, normalize_genes: bool = True) -> DataFrame:
    return paired_from_airr(read_delimited(spark, path, "\t"), pair_by, productive_only, normalize_genes)


def paired_from_10x(rows: DataFrame, pair_by: str = "barcode", normalize_genes: bool = True, order: list[str] | None = None) -> DataFrame:
    """Called cells' full-length productive contigs, the one with most UMIs for each chain, paired.

    Of equal UMIs the first by order is taken; without it the first in the frame's own order, which is that
    of the file when rows come straight from one.
    """
    for c in ("is_cell", "full_length", "productive"):
        if c in rows.columns:
            rows = rows.filter(_true(F.col(c)))
    umis = F.col("umis").cast("long") if "umis" in rows.columns else F.lit(0)
    rows = rows.withColumn("__umis", umis).withColumn("__order", F.monotonically_increasing_id())
    best = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(pair_by, "chain").orderBy(F.desc("__umis"), *(order or ["__order"])))).filter("__rank = 1")
    chain = lambda name, c: best.filter(F.col("chain") == name).select(pair_by, F.col("v_gene").alias(f"v{c}"), F.col("j_gene").alias(f"j{c}"), F.col("cdr3").alias(f"cdr3{c}"))
    return normalized(pair_chains(chain("TRA", "a"), chain("TRB", "b"), pair_by), normalize_genes)


def read_10x(spark: SparkSession, path: str, pair_by: str = "barcode", normalize_genes: bool = True) -> DataFrame:
    return paired_from_10x(read_delimited(spark, path, ","), pair_by, normalize_genes)


def from_adaptive(rows: DataFrame, normalize_genes: bool = True) -> DataFrame:
    """Beta chains with converted gene names; rows without a CDR3 go."""

    def first_of(*names: str) -> str | None:
        return next((n for n in names if n in rows.columns), None)

    v, j = first_of("vGeneName", "v_resolved", "vFamilyName"), first_of("jGeneName", "j_resolved", "jFamilyName")
    cdr3, n = first_of("aminoAcid", "amino_acid", "cdr3_amino_acid"), first_of("count", "templates", "reads")
    if not (v and j and cdr3):
        raise ValueError(f"gene or CDR3 columns are missing: {rows.columns}")
    out = rows.select(convert_adaptive_gene(v).alias("vb"), convert_adaptive_gene(j).alias("jb"), F.col(cdr3).alias("cdr3b"), *([F.col(n).cast("long").alias("count")] if n else []))
    return normalized(out.filter(F.col("cdr3b").isNotNull() & (F.col("cdr3b") != "")), normalize_genes)


def read_adaptive(spark: SparkSession, path: str, normalize_genes: bool = True) -> DataFrame:
    return from_adaptive(read_delimited(spark, path, "\t"), normalize_genes)


def read_tcr_database(spark: SparkSession, path: str) -> DataFrame:
    return standardize(read_delimited(spark, path, "\t"), {"va_gene": "va", "vb_gene": "vb"})


def write_clones(df: DataFrame, path: str, format: str = "parquet", partition_by: list[str] | None = None) -> None:  # noqa: A002
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).format(format).save(path)
