"""The tables behind the figures: usage, flows, lengths, profiles, ordered matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clonespark.constants import AMINO_ACIDS
from clonespark.functions.exprs import trim_allele
from clonespark.functions.kernel import align_one_gap, blosum62
from clonespark.operators.graph import dense, hierarchical, leaf_order, whole_tree

#: Prefixes that labels leave out.
GENE_PREFIXES = "TRAV TRAJ TRBV TRBJ TRGV TRGJ TRDV TRDJ IGHV IGHJ IGLV IGLJ IGKV IGKJ".split()
JUNCTION_SOURCES = ("V", "N", "N1", "D", "N2", "J")


def gene_usage(clones: DataFrame, gene: str, most: int = 20, strip_allele: bool = True) -> DataFrame:
    """(gene, count) of the most frequent genes; nulls and empty names don't count."""
    named = clones.filter(F.col(gene).isNotNull() & (F.col(gene) != "")).select((trim_allele(gene) if strip_allele else F.col(gene)).alias("gene"))
    return named.groupBy("gene").count().orderBy(F.desc("count"), "gene").limit(most)


def flows(clones: DataFrame, axes: list[str], most: int = 10, facet: str | None = None) -> DataFrame:
    """Counts by all axes, and by facet if given; on each axis the most frequent genes, the rest as Other."""
    rows = clones.select(*[trim_allele(a).alias(a) for a in axes], *([facet] if facet else [])).dropna()
    for a in axes:
        top = [r[a] for r in rows.groupBy(a).count().orderBy(F.desc("count"), a).limit(most).collect()]
        rows = rows.withColumn(a, F.when(F.col(a).isin(top), F.col(a)).otherwise("Other"))
    return rows.groupBy(*axes, *([facet] if facet else [])).agg(F.count("*").alias("count"))


def sankey(clones: DataFrame, axes: list[str], most: int = 10) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): stacked counts on each axis, and counts between neighbouring axes."""
    counted = flows(clones, axes, most)
    nodes = None
    for k, a in enumerate(axes):
        own = counted.groupBy(F.col(a).alias("gene")).agg(F.sum("count").alias("count")).withColumn("axis", F.lit(k))
        nodes = own if nodes is None else nodes.unionByName(own)
    upto = F.sum("count").over(Window.partitionBy("axis").orderBy(F.desc("count"), "gene").rowsBetween(Window.unboundedPreceding, 0))
    nodes = nodes.withColumn("y_top", upto).withColumn("y_bottom", F.col("y_top") - F.col("count"))
    links = None
    for k, (a, b) in enumerate(zip(axes, axes[1:], strict=False)):
        own = counted.groupBy(F.col(a).alias("source"), F.col(b).alias("target")).agg(F.sum("count").alias("count")).withColumn("axis", F.lit(k))
        links = own if links is None else links.unionByName(own)
    return nodes, links


def cdr3_lengths(clones: DataFrame) -> DataFrame:
    """(chain, length, count) of the CDR3 columns that are there."""
    parts = [clones.filter(F.col(c).isNotNull() & (F.col(c) != "")).select(F.lit(chain).alias("chain"), F.length(c).alias("length")) for c, chain in (("cdr3a", "alpha"), ("cdr3b", "beta")) if c in clones.columns]
    rows = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    return rows.groupBy("chain", "length").agg(F.count("*").alias("count"))


def gene_stack(clones: DataFrame, gene: str, genes: DataFrame | None = None, most: int = 10) -> DataFrame:
    """(gene, label, proportion, y_bottom, y_top): shares of all clones, stacked; alleles go by the gene
    table's count_rep where it has them."""
    rows = clones.filter(F.col(gene).isNotNull()).select(F.col(gene).alias("id"))
    if genes is not None:
        rows = rows.join(genes.select("id", "count_rep").distinct(), "id", "left")
    rep = F.coalesce(F.col("count_rep"), trim_allele("id")) if genes is not None else trim_allele("id")
    counts = rows.groupBy(rep.alias("gene")).count()
    shares = counts.crossJoin(counts.agg(F.sum("count").alias("n"))).withColumn("proportion", F.col("count") / F.col("n"))
    order = Window.orderBy(F.desc("proportion"), "gene")
    stacked = shares.withColumn("rank", F.row_number().over(order)).withColumn("y_top", F.sum("proportion").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("rank") <= most)
    return stacked.select("gene", F.regexp_replace("gene", F.lit("^(" + "|".join(GENE_PREFIXES) + ")"), F.lit("")).alias("label"), "proportion", (F.col("y_top") - F.col("proportion")).alias("y_bottom"), "y_top")


def distance_histogram(edges: DataFrame, bins: int = 30) -> DataFrame:
    """(low, high, count, density) of equal bins over the distances i < j, or over their counts (dist, n)."""
    pairs = edges if "n" in edges.columns else edges.filter("i < j").select("dist", F.lit(1).alias("n"))
    span = pairs.agg(F.min("dist").alias("a"), F.max("dist").alias("b"), F.sum("n").alias("n")).first()
    if not span["n"]:
        return edges.sparkSession.createDataFrame([], "low double, high double, count long, density double")
    width = (span["b"] - span["a"]) / bins or 1.0
    which = F.least(F.floor((F.col("dist") - span["a"]) / width), F.lit(bins - 1)).alias("bin")
    return pairs.groupBy(which).agg(F.sum("n").alias("count")).select((span["a"] + F.col("bin") * width).alias("low"), (span["a"] + (F.col("bin") + 1) * width).alias("high"), "count", (F.col("count") / (span["n"] * width)).alias("density"))


def ordered_heatmap(edges: DataFrame, n: int) -> tuple[DataFrame, float]:
    """((x, y, i, j, dist), midpoint): distances in the leaf order of average linkage; midpoint is their median."""
    d = dense(edges, n)
    order = {v: k for k, v in enumerate(leaf_order(hierarchical(d), n))}
    places = edges.sparkSession.createDataFrame(list(order.items()), "v long, place int")
    rows = edges.join(places.select(F.col("v").alias("i"), F.col("place").alias("x")), "i").join(places.select(F.col("v").alias("j"), F.col("place").alias("y")), "j")
    upper = d[np.triu_indices(n, 1)]
    return rows.select("x", "y", "i", "j", "dist"), float(np.median(upper)) if upper.size else 0.0


def class_heatmap(m) -> tuple[float, list[int]]:
    """(midpoint, order) of ordered_heatmap from the classes of equal points: the median of all distances, and
    the points in leaf order."""
    a, b = np.triu_indices(len(m.c))
    size = m.n.astype(float)
    many = np.where(a == b, size[a] * (size[a] - 1) / 2, size[a] * size[b])
    values, back = np.unique(m.d[a, b], return_inverse=True)
    upto = np.cumsum(np.bincount(back, many))
    total = upto[-1] if len(upto) else 0
    at = lambda k: float(values[np.searchsorted(upto, k, "right")])
    midpoint = (at((total - 1) // 2) + at(total // 2)) / 2 if total else 0.0
    steps, n = whole_tree(m)
    return midpoint, leaf_order(steps, n)


def dendrogram_segments(edges: DataFrame, n: int, method: str = "average") -> tuple[DataFrame, list[int]]:
    """((x0, y0, x1, y1), leaf order): the lines of a dendrogram."""
    return segments_of(edges.sparkSession, hierarchical(dense(edges, n), method), n)


def segments_of(spark, steps: np.ndarray, n: int) -> tuple[DataFrame, list[int]]:
    """dendrogram_segments of the steps of a tree."""
    order = leaf_order(steps, n)
    x = {v: float(k) for k, v in enumerate(order)}
    y = dict.fromkeys(order, 0.0)
    lines = []
    for k, (a, b, h, _) in enumerate(steps):
        a, b, h = int(a), int(b), float(h)
        lines += [(x[a], y[a], x[a], h), (x[a], h, x[b], h), (x[b], y[b], x[b], h)]
        x[n + k], y[n + k] = (x[a] + x[b]) / 2, h
    table = pa.table({x: np.array([line[k] for line in lines], float) for k, x in enumerate(("x0", "y0", "x1", "y1"))})
    return spark.createDataFrame(table), order


def scatter(clones: DataFrame, coordinates: DataFrame, colour: str | None = None, highlight: str | None = None, facet: str | None = None, idx: str = "clone_idx") -> tuple[DataFrame, DataFrame]:
    """(points, centroids): x and y with colour, facet and a highlight flag, and mean places of the colours."""
    columns = [c for c in dict.fromkeys((colour, facet)) if c]
    rows = clones.join(coordinates.select(F.col("i").alias(idx), F.get("embedding", F.lit(0)).alias("x"), F.get("embedding", F.lit(1)).alias("y")), idx)
    points = rows.select(idx, "x", "y", *columns, F.coalesce(F.expr(highlight), F.lit(False)).alias("highlight") if highlight else F.lit(False).alias("highlight"))
    return points, points.groupBy(*columns).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def spread_coincident(points: DataFrame, radius: float, idx: str = "i") -> DataFrame:
    """points (x, y) with those at one place put on a circle around it."""
    same = Window.partitionBy("x", "y")
    held = points.withColumn("__n", F.count("*").over(same)).withColumn("__k", F.row_number().over(same.orderBy(idx)) - 1)
    turn = 2 * np.pi * F.col("__k") / F.col("__n")
    moved = F.col("__n") > 1
    return held.withColumn("__x", F.when(moved, F.col("x") + radius * F.cos(turn)).otherwise(F.col("x"))).withColumn("y", F.when(moved, F.col("y") + radius * F.sin(turn)).otherwise(F.col("y"))).withColumn("x", F.col("__x")).drop("__n", "__k", "__x")


def network_figure(nodes: DataFrame, edges: DataFrame, colour: str = "component", radius: float = 0.05, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points, lines, centroids) of a network (its vertices and its weighted edges): places by a force-directed
    layout, points at one place spread around it, lines with both ends' places, and mean places by colour."""
    from clonespark.operators.embedding import layout, numbered

    placed = numbered(nodes.select(F.col("i").alias("v"), colour), "v")
    own = placed.select("v", F.col("i").alias("n"))
    links = edges.join(own.select(F.col("v").alias("i"), F.col("n").alias("a")), "i").join(own.select(F.col("v").alias("j"), F.col("n").alias("b")), "j")
    both = links.select(F.col("a").alias("i"), F.col("b").alias("j"), "weight").union(links.select("b", "a", "weight"))
    found = layout(both, placed.count(), seed=seed).select("i", F.get("embedding", F.lit(0)).alias("x"), F.get("embedding", F.lit(1)).alias("y"))
    points = spread_coincident(placed.join(found, "i").select(F.col("v").alias("i"), colour, "x", "y"), radius)
    ends = lambda v, n: points.select(F.col("i").alias(v), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
    lines = edges.join(ends("i", 0), "i").join(ends("j", 1), "j").select("i", "j", "weight", "x0", "y0", "x1", "y1")
    return points, lines, points.groupBy(colour).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def profile(sequences: list[str], sources: list[list[str] | None] | None = None, trim: bool = True) -> dict:
    """A position weight matrix of one motif's CDR3s, and one of nucleotide sources if given.

    The centre is the sequence of the most frequent length with the best total alignment score; all are
    aligned to it with one gap block, and columns where it has a gap are left out. trim: without the
    first three and the last two letters. Results: pwm {letter: shares}, aligned, center, junction.
    """
    if not sequences:
        raise ValueError("no sequences")
    if trim:
        sequences = [s if len(s) <= 5 else s[3:-2] for s in sequences]
        sources = None if sources is None else [s if s is None or len(s) <= 15 else s[9:-6] for s in sources]
    lengths = sorted(len(s) for s in sequences)
    usual = max(sorted(set(lengths)), key=lengths.count)
    candidates = [k for k, s in enumerate(sequences) if len(s) == usual]

    def score(a: str, b: str) -> int:
        return sum(blosum62(x, y) for x, y in zip(*align_one_gap(a, b), strict=True) if x in AMINO_ACIDS and y in AMINO_ACIDS)

    totals = [sum(score(sequences[k], s) for n, s in enumerate(sequences) if n != k) for k in candidates]
    center = candidates[int(np.argmax(totals))]
    width = len(sequences[center])
    pwm = {x: np.zeros(width) for x in AMINO_ACIDS + "-"}
    junction = {x: np.zeros(3 * width) for x in (*JUNCTION_SOURCES, "-")}
    aligned = []
    for s, source in zip(sequences, sources or [None] * len(sequences), strict=True):
        row, place, own = [], 0, 0
        for x, y in zip(*align_one_gap(sequences[center], s), strict=True):
            if x != "-":
                row.append(y)
                if y in pwm:
                    pwm[y][place] += 1
                for k in range(3) if source is not None else ():
                    mark = "-" if y == "-" else source[3 * own + k] if 3 * own + k < len(source) else None
                    if mark in junction:
                        junction[mark][3 * place + k] += 1
                place += 1
            own += y != "-"
        aligned.append("".join(row))
    for table in (pwm, junction):
        total = sum(table.values())
        for v in table.values():
            np.divide(v, total, out=v, where=total > 0)
    return {"pwm": pwm, "aligned": aligned, "center": center, "junction": junction if sources is not None else None}


def profiles(clones: DataFrame, group: str, cdr3: str, trim: bool = True) -> DataFrame:
    """(group, position, letter, share) of each group's profile; a group is one motif's members."""
    kind = clones.schema[group].dataType.simpleString()

    def one(pdf):
        import pandas as pd

        found = profile(pdf[cdr3].sort_values().tolist(), trim=trim)["pwm"]
        rows = [(pdf[group].iloc[0], k, x, float(v)) for x, shares in found.items() for k, v in enumerate(shares) if v > 0]
        return pd.DataFrame(rows, columns=[group, "position", "letter", "share"])

    return clones.filter(F.col(cdr3).isNotNull()).select(group, cdr3).groupBy(group).applyInPandas(one, f"{group} {kind}, position int, letter string, share double")
