"""CD8 scores of paired clones by a linear model of each chain."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clonespark.constants import AMINO_ACIDS
from clonespark.functions.exprs import trim_allele
from clonespark.plans.schema import require_columns

#: Tags of a model file.
HEADERS = ("min_lenbin", "max_lenbin", "window_size", "NV", "NJ", "NL", "NC")


@dataclass(frozen=True)
class ChainModel:
    """Weights of V genes, J genes (the last of each for unknown ones), length bins and positions."""

    low: int
    high: int
    window: int
    v: dict[str, float]
    j: dict[str, float]
    lengths: list[float]
    positions: list[float]
    bias: float
    other_v: float
    other_j: float


def parse_model(lines: list[str]) -> ChainModel:
    """A model from lines of "tag value": seven headers, the weights, and the bias last."""
    rows = [(t, float(v)) for t, v in (line.split()[:2] for line in lines if line.strip())]
    if [t for t, _ in rows[:7]] != list(HEADERS) or rows[-1][0] != "BIAS":
        raise ValueError("not a model file: its headers or its bias are missing")
    low, high, window, nv, nj, nl, nc = (int(v) for _, v in rows[:7])
    weights = rows[7:-1]
    if len(weights) != nv + nj + nl + nc or nl != high - low + 1 or nc != 20 * (2 * window + 1):
        raise ValueError("the model's sizes don't fit its weights")
    v, j = weights[:nv], weights[nv : nv + nj]
    return ChainModel(low, high, window, dict(v[:-1]), dict(j[:-1]), [w for _, w in weights[nv + nj : nv + nj + nl]], [w for _, w in weights[nv + nj + nl :]], rows[-1][1], v[-1][1], j[-1][1])


def load_models(spark: SparkSession, paths: dict[str, str]) -> dict[str, ChainModel]:
    """Models of chains A and B from files of a few hundred lines."""
    return {chain: parse_model([r["value"] for r in spark.read.option("wholetext", False).text(path).coalesce(1).collect()]) for chain, path in paths.items()}


def chain_score(v: Column | str, j: Column | str, cdr3: Column | str, model: ChainModel) -> Column:
    """The linear score as built-in expressions: lookups in literal maps and arrays."""
    v, j, cdr3 = (F.col(c) if isinstance(c, str) else c for c in (v, j, cdr3))

    def gene(c: Column, weights: dict[str, float], other: float) -> Column:
        known = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.create_map().cast("map<string,double>")
        return F.coalesce(F.try_element_at(known, trim_allele(c)), F.lit(other))

    n = F.length(cdr3)
    by_length = F.get(F.array(*[F.lit(w) for w in model.lengths]), F.greatest(F.least(n, F.lit(model.high)), F.lit(model.low)) - model.low)
    weights = F.array(*[F.lit(w) for w in model.positions])
    head = F.least(F.lit(model.window), F.floor(n / 2).cast("int"))
    tail = F.least(F.lit(model.window), n - head)

    def at(place: Column) -> Column:
        letter = F.instr(F.lit(AMINO_ACIDS), F.substring(cdr3, place + 1, F.lit(1))) - 1
        block = F.when(place < head, place).when(n - 1 - place < tail, F.lit(model.window) + n - 1 - place).otherwise(2 * model.window)
        return F.when(letter >= 0, F.get(weights, 20 * block + letter)).otherwise(0.0)

    letters = F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, k: s + at(k))).otherwise(0.0)
    return gene(v, model.v, model.other_v) + gene(j, model.j, model.other_j) + by_length + letters + model.bias


def cd8_scores(clones: DataFrame, models: dict[str, ChainModel], sigmoid: bool = False, out: str = "cd8_score") -> DataFrame:
    """clones with the mean of both chains' scores, each through a sigmoid first if asked for."""
    require_columns(clones, ["va", "ja", "cdr3a", "vb", "jb", "cdr3b"])
    parts = [chain_score(f"v{c}", f"j{c}", f"cdr3{c}", models[c.upper()]) for c in "ab"]
    if sigmoid:
        parts = [1 / (1 + F.exp(-p)) for p in parts]
    return clones.withColumn(out, 0.5 * parts[0] + 0.5 * parts[1])
