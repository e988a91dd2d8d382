"""Gene reference tables: parsing, V-region distances, representatives."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonespark.constants import AMINO_ACIDS, BLOSUM62
from clonespark.functions.exprs import loop_distance, translation, trim_allele

GENE_SCHEMA = "id string, organism string, chain string, region string, nucseq string, frame int, aligned_protseq string, cdr_columns string, cdrs string"


def gene_table(raw: DataFrame) -> DataFrame:
    """Genes with parsed loops: cdrs, cdr_columns (start, end), protseq, nucseq_offset, count_rep, valid.

    valid tells whether the translated nucleotides are the aligned protein without its gaps and each
    loop is the slice that its columns name.
    """
    cdrs = F.when(F.length("cdrs") > 0, F.split("cdrs", ";")).otherwise(F.array().cast("array<string>"))
    places = F.transform(F.when(F.length("cdr_columns") > 0, F.split("cdr_columns", ";")).otherwise(F.array().cast("array<string>")), lambda p: F.struct(F.substring_index(p, "-", 1).cast("int").alias("start"), F.substring_index(p, "-", -1).cast("int").alias("end")))
    read = F.when(F.col("frame") == 1, translation("nucseq", "+1")).when(F.col("frame") == 2, translation("nucseq", "+2")).otherwise(translation("nucseq", "+3"))
    parsed = raw.select("id", "organism", "chain", "region", "nucseq", "frame", "aligned_protseq", cdrs.alias("cdrs"), places.alias("cdr_columns"), (F.col("frame") - 1).alias("nucseq_offset"), read.alias("protseq"), trim_allele("id").alias("count_rep"))
    slices = F.transform("cdr_columns", lambda p: F.substring(F.col("aligned_protseq"), p.start, p.end - p.start + 1))
    return parsed.withColumn("valid", (F.regexp_replace("aligned_protseq", F.lit(r"\."), F.lit("")) == F.col("protseq")) & (F.col("cdrs") == slices))


def load_gene_table(spark: SparkSession, path: str, organism: str | None = None) -> DataFrame:
    """The table of a tab-separated file; a row that contradicts itself or an organism that isn't there is an error."""
    genes = gene_table(spark.read.option("sep", "\t").option("header", True).schema(GENE_SCHEMA).csv(path))
    wrong = genes.filter(~F.coalesce("valid", F.lit(False))).select("id").limit(5).collect()
    if wrong:
        raise ValueError(f"inconsistent genes: {[r['id'] for r in wrong]}")
    if organism is not None:
        found = list_organisms(genes)
        if organism not in found:
            raise ValueError(f"no genes of {organism!r}; there are {found}")
        genes = genes.filter(F.col("organism") == organism)
    return genes


def list_organisms(genes: DataFrame) -> list[str]:
    return [r["organism"] for r in genes.select("organism").distinct().orderBy("organism").collect()]


def loop_strings(genes: DataFrame) -> DataFrame:
    """(organism, chain, gene, loops) of V genes: all loops but the last, joined by a space."""
    return genes.filter("region = 'V'").select("organism", "chain", F.col("id").alias("gene"), F.array_join(F.slice("cdrs", F.lit(1), F.size("cdrs") - 1), " ").alias("loops"))


def v_distances(loops: DataFrame) -> DataFrame:
    """(organism, chain, g1, g2, vdist) for all pairs of genes of an organism and chain, a few hundred genes.

    Loop strings of one set must have equal lengths and their spaces at the same places.
    """
    shape = loops.groupBy("organism", "chain").agg(F.countDistinct(F.regexp_replace("loops", F.lit("[^ ]"), F.lit("x"))).alias("n")).filter("n > 1")
    if not shape.isEmpty():
        raise ValueError("loop strings are not aligned")
    left, right = loops.withColumnRenamed("gene", "g1").withColumnRenamed("loops", "l1"), loops.withColumnRenamed("gene", "g2").withColumnRenamed("loops", "l2")
    return left.join(right, ["organism", "chain"]).select("organism", "chain", "g1", "g2", loop_distance("l1", "l2").alias("vdist"))


def v_matrix(distances: DataFrame, organism: str | None = None, chain: str | None = None) -> tuple[dict[str, int], np.ndarray]:
    """Gene places and a matrix, for a kernel. A chain's genes number a few hundred."""
    for column, value in (("organism", organism), ("chain", chain)):
        if value is not None and column in distances.columns:
            distances = distances.filter(F.col(column) == value)
    rows = distances.select("g1", "g2", "vdist").collect()
    place = {g: i for i, g in enumerate(sorted({r["g1"] for r in rows}))}
    out = np.zeros((len(place), len(place)))
    for r in rows:
        out[place[r["g1"]], place[r["g2"]]] = r["vdist"]
    return place, out


def _loop_mismatches(a: str, b: str) -> tuple[int, list[tuple[str, str]]]:
    odd = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return sum(10 if "." in p else 1 for p in odd), odd


def v_representatives(genes: DataFrame) -> dict[str, tuple[str, str]]:
    """(rep, mm1_rep) of the V genes of one organism and chain.

    rep: the least gene of equal loops. mm1_rep: the least gene reachable over pairs with at most one
    mismatch in the first two loops, two with the later one, ten up to the last loop's start (a gap counts
    ten), and, of a single mismatch, a positive BLOSUM62 score.
    """
    rows = genes.filter("region = 'V'").select("id", "cdrs", "aligned_protseq", "cdr_columns").orderBy("id").collect()
    rep: dict[tuple, str] = {}
    near: dict[str, set[str]] = {r["id"]: {r["id"]} for r in rows}

    def alike(a, b) -> bool:
        pairs = list(zip(a["cdrs"][:-1], b["cdrs"][:-1], strict=False))
        if len(a["cdrs"]) != len(b["cdrs"]) or any(len(x) != len(y) for x, y in pairs):
            return False
        found = [_loop_mismatches(x, y) for x, y in pairs]
        early, every = sum(n for n, _ in found[:2]), sum(n for n, _ in found)
        if early > 1 or every > 2:
            return False
        end = a["cdr_columns"][-1]["start"] + 2
        if _loop_mismatches(a["aligned_protseq"][:end].ljust(end, "."), b["aligned_protseq"][:end].ljust(end, "."))[0] > 10:
            return False
        if every == 1:
            x, y = next(odd for _, odd in found if odd)[0]
            return x in AMINO_ACIDS and y in AMINO_ACIDS and BLOSUM62[AMINO_ACIDS.index(x), AMINO_ACIDS.index(y)] >= 1
        return True

    for r in rows:
        rep.setdefault(tuple(r["cdrs"][:-1]), r["id"])
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if alike(a, b):
                near[a["id"]].add(b["id"])
                near[b["id"]].add(a["id"])
    out = {}
    for r in rows:
        reached, front = {r["id"]}, [r["id"]]
        while front:
            new = near[front.pop()] - reached
            reached |= new
            front += new
        out[r["id"]] = (rep[tuple(r["cdrs"][:-1])], min(reached))
    return out


def j_representatives(genes: DataFrame) -> DataFrame:
    """(id, rep): the least J gene with the same residues through the third after the loop."""
    own = genes.filter("region = 'J'").withColumn("core", F.substring(F.col("protseq"), F.lit(1), F.length(F.regexp_replace(F.get("cdrs", F.lit(0)), F.lit(r"\."), F.lit(""))) + 3))
    return own.join(own.groupBy("organism", "chain", "core").agg(F.min("id").alias("rep")), ["organism", "chain", "core"]).select("id", "rep")


def junction_sequences(genes: DataFrame) -> dict[str, dict[str, str]]:
    """For V genes the nucleotides from the conserved cysteine on, for J genes those before the loop's end,
    for D genes all of them: {"V": {id: ...}, "J": {id: ...}, "D": {id: ...}}. Genes are few."""
    out: dict[str, dict[str, str]] = {"V": {}, "J": {}, "D": {}}
    for r in genes.select("id", "chain", "region", "nucseq", "nucseq_offset", "aligned_protseq", "cdrs", "cdr_columns").orderBy("id").collect():
        if r["region"] == "V" and r["cdr_columns"]:
            before = r["aligned_protseq"][: r["cdr_columns"][-1]["start"] - 1].replace(".", "")
            out["V"][r["id"]] = r["nucseq"][3 * len(before) + r["nucseq_offset"] :]
        elif r["region"] == "J" and r["cdrs"]:
            out["J"][r["id"]] = r["nucseq"][: 3 * len(r["cdrs"][0].replace(".", "")) + r["nucseq_offset"]]
        elif r["region"] == "D" and r["chain"] == "B":
            out["D"][r["id"]] = r["nucseq"]
    return out
