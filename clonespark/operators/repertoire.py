"""Repertoires: a clone table with its parameters and computed edges."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonespark.constants import GAP_CDR3, GAP_V, WEIGHT_CDR3, WEIGHT_V
from clonespark.operators.distance import distance_matrix, hamming_matrix
from clonespark.plans.schema import REQUIRED, require_columns, validate_chains, with_index


def deduplicate_clones(clones: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row for each key: its first row by order, with the sum of count (1 where there is none).

    Rows with a null in a key go. Where no key repeats, the rows stay as they are, without a count
    column if they had none; else clone_id goes.
    """
    rows = clones.dropna(subset=keys)
    if rows.groupBy(*keys).count().filter("count > 1").isEmpty():
        return rows
    counted = rows if "count" in rows.columns else rows.withColumn("count", F.lit(1))
    rest = [c for c in counted.columns if c not in (*keys, "count", "clone_id")]
    first = F.min(F.struct(F.struct(*[F.col(c) for c in (order or [c for c in counted.columns if c not in keys])]).alias("o"), F.struct(*[F.col(c) for c in rest] or [F.lit(1).alias("none")]).alias("r"))).alias("f")
    merged = counted.groupBy(*keys).agg(first, F.sum("count").cast("long").alias("count"))
    out = merged.select(*keys, *[F.col(f"f.r.{c}").alias(c) for c in rest], "count")
    return out.select(*[c for c in counted.columns if c in out.columns])


@dataclass(frozen=True)
class Repertoire:
    """Clones of an organism. edges: distances (i, j, dist) of clone_idx, if computed; knn likewise."""

    clones: DataFrame
    organism: str
    chains: str = "AB"
    metric: str = "weighted"
    weights: dict = field(default_factory=lambda: {"cdr3": WEIGHT_CDR3, "v_region": WEIGHT_V})
    gap_penalties: dict = field(default_factory=lambda: {"cdr3": GAP_CDR3, "v_region": GAP_V})
    edges: DataFrame | None = None
    knn: DataFrame | None = None
    meta_clonotypes: DataFrame | None = None

    def __post_init__(self) -> None:
        if self.chains not in REQUIRED:
            raise ValueError(f"chains must be one of {sorted(REQUIRED)}")
        if not isinstance(self.organism, str) or not self.organism:
            raise ValueError("the organism must be a name")
        if self.metric not in ("weighted", "hamming"):
            raise ValueError("the metric must be weighted or hamming")
        for name in ("weights", "gap_penalties"):
            if not {"cdr3", "v_region"} <= set(getattr(self, name)):
                raise ValueError(f"{name} must name cdr3 and v_region")
        require_columns(self.clones, list(REQUIRED[self.chains]))

    def subset(self, condition: str | Column) -> Repertoire:
        """Clones for which the condition holds; a null doesn't."""
        return self._of(self.clones.filter(F.coalesce(F.expr(condition) if isinstance(condition, str) else condition, F.lit(False))))

    def take(self, positions: list[int]) -> Repertoire:
        """Clones at 0-based positions; one named twice comes twice."""
        spark = self.clones.sparkSession
        wanted = spark.createDataFrame([(p, n) for n, p in enumerate(positions)], "clone_idx long, new_idx long")
        missing = wanted.join(self.clones, "clone_idx", "left_anti").count()
        if missing:
            raise IndexError(f"{missing} positions are outside the table")
        return self._renumbered(wanted)

    def _of(self, kept: DataFrame) -> Repertoire:
        return self._renumbered(with_index(kept.select("clone_idx"), ["clone_idx"], "new_idx"))

    def _renumbered(self, places: DataFrame) -> Repertoire:
        clones = self.clones.join(places, "clone_idx").drop("clone_idx").withColumnRenamed("new_idx", "clone_idx")
        edges = None
        if self.edges is not None:
            a, b = places.select(F.col("clone_idx").alias("i"), F.col("new_idx").alias("ni")), places.select(F.col("clone_idx").alias("j"), F.col("new_idx").alias("nj"))
            edges = self.edges.join(a, "i").join(b, "j").select(F.col("ni").alias("i"), F.col("nj").alias("j"), "dist")
        return replace(self, clones=clones.select(*self.clones.columns), edges=edges, knn=None, meta_clonotypes=None)

    def __repr__(self) -> str:
        held = [n for n in ("edges", "knn", "meta_clonotypes") if getattr(self, n) is not None]
        return f"Repertoire(organism={self.organism}, chains={self.chains}, metric={self.metric}, columns={self.clones.columns}, computed={held})"


def build_repertoire(clones: DataFrame, organism: str, chains: str = "AB", metric: str = "weighted", deduplicate: bool | list[str] = True, compute_distances: bool = False, v_distances: DataFrame | None = None, order: list[str] | None = None, **parameters) -> Repertoire:
    """A repertoire: validated, deduplicated (by chains and subject, or by chains and the named columns),
    numbered by its columns, with all distances if asked for.

    Letters that are no amino acid are an error, and so are unknown V genes where V distances are given,
    whatever the components; rows with a null in a chain go with deduplication and are an error without.
    Weights of the V region are held and, like its gap penalty, not applied.
    """
    if chains not in REQUIRED:
        raise ValueError(f"chains must be one of {sorted(REQUIRED)}")
    require_columns(clones, list(REQUIRED[chains]))
    genes = None
    if v_distances is not None:  # a few hundred
        own = v_distances.filter(F.col("organism") == organism) if "organism" in v_distances.columns else v_distances
        genes = [r["g1"] for r in own.select("g1").distinct().collect()]
    chain_rows = clones.select(*REQUIRED[chains])
    validate_chains(chain_rows if deduplicate is False else chain_rows.dropna(), genes)
    if deduplicate is not False:
        extra = [c for c in ("subject",) if c in clones.columns] if deduplicate is True else list(deduplicate)
        keys = [*REQUIRED[chains], *extra]
        clones = deduplicate_clones(clones, keys, order)
    if "clone_idx" not in clones.columns:
        clones = with_index(clones, order or [c for c in clones.columns if c != "clone_id"])
    found = Repertoire(clones, organism, chains, metric, **parameters)
    if not compute_distances:
        return found
    if metric == "hamming":
        column = "cdr3a" if chains == "A" else "cdr3b"
        return replace(found, edges=hamming_matrix(clones, column))
    components = {"A": "alpha", "B": "beta"}.get(chains, "all")
    return replace(found, edges=distance_matrix(clones, components, v_distances, organism, found.weights["cdr3"], found.gap_penalties["cdr3"]))
