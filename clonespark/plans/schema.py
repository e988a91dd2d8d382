"""Requirements on clone tables: chains, distance components, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clonespark.functions.exprs import VALID_CDR3

#: Names of chains, components and presets.
REQUIRED = {"AB": ("va", "cdr3a", "vb", "cdr3b"), "A": ("va", "cdr3a"), "B": ("vb", "cdr3b"), "GD": ("va", "cdr3a", "vb", "cdr3b")}
COMPONENTS = ("va", "cdr3a", "vb", "cdr3b")
PRESETS = {"all": COMPONENTS, "cdr3": ("cdr3a", "cdr3b"), "v_region": ("va", "vb"), "alpha": ("va", "cdr3a"), "beta": ("vb", "cdr3b")}


def resolve_components(components: str | list[str] | tuple[str, ...] = "all") -> tuple[str, ...]:
    """The active components of a preset name or of a list of names, in canonical order."""
    wanted = PRESETS.get(components, (components,)) if isinstance(components, str) else tuple(components)
    unknown = [c for c in wanted if c not in COMPONENTS]
    if unknown or not wanted:
        raise ValueError(f"unknown distance components: {unknown}")
    return tuple(c for c in COMPONENTS if c in wanted)


def active_for(df: DataFrame, components: str | list[str] | tuple[str, ...] = "all") -> tuple[str, ...]:
    """Components that count for df. A table with one complete chain is compared by that chain when all
    are asked for; what is asked of a chain that isn't there adds nothing."""
    has = {"A": {"va", "cdr3a"} <= set(df.columns), "B": {"vb", "cdr3b"} <= set(df.columns)}
    if not any(has.values()):
        raise ValueError(f"neither chain is complete: {df.columns}")
    active = resolve_components(components)
    return tuple(c for c in active if has["A" if c in ("va", "cdr3a") else "B"])


def require_columns(df: DataFrame, columns: tuple[str, ...] | list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def chain_columns(df: DataFrame) -> list[str]:
    """Columns of the complete chains of df."""
    return [c for pair in (("va", "cdr3a"), ("vb", "cdr3b")) if set(pair) <= set(df.columns) for c in pair]


def validate_chains(df: DataFrame, genes: list[str] | None = None) -> None:
    """One pass over the chain columns: nulls, letters outside the alphabet, unknown genes are errors."""
    columns = chain_columns(df)
    checks = [F.count_if(F.col(c).isNull()).alias(f"null {c}") for c in columns]
    checks += [F.count_if(~F.col(c).rlike(VALID_CDR3)).alias(f"letters {c}") for c in columns if c.startswith("cdr3")]
    found = df.agg(*checks).first().asDict()
    wrong = [k for k, n in found.items() if n]
    if wrong:
        raise ValueError(f"not valid in the clone table: {wrong}")
    if genes is not None:
        known = df.sparkSession.createDataFrame([(g,) for g in genes], "gene string")
        for c in (c for c in columns if c in ("va", "vb")):
            unknown = df.select(F.col(c).alias("gene")).distinct().join(known, "gene", "left_anti").orderBy("gene").limit(10).collect()
            if unknown:
                raise ValueError(f"unknown genes in {c}: {[r['gene'] for r in unknown]}")


def running(df: DataFrame, order: str, out: str, value: str, lowest_after: bool = False) -> DataFrame:
    """df with a running sum of value by order, as out; lowest_after: with the least value of the row and all
    that follow. Ranges of the order are summed apart and offset by those before (or after), so that no task
    takes everything. order has no ties and no nulls."""
    ranged = df.repartitionByRange(order).withColumn("__part", F.spark_partition_id())
    inside = Window.partitionBy("__part").orderBy(F.desc(order) if lowest_after else order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fold = F.min if lowest_after else F.sum
    held = ranged.withColumn("__own", fold(value).over(inside))
    others = Window.orderBy(F.desc("__part") if lowest_after else "__part").rowsBetween(Window.unboundedPreceding, -1)
    before = held.groupBy("__part").agg(fold(value).alias("__all")).withColumn("__before", fold("__all").over(others))  # a row for each partition
    joined = held.join(before.drop("__all"), "__part", "left")
    total = F.least("__own", "__before") if lowest_after else F.col("__own") + F.coalesce("__before", F.lit(0))
    return joined.withColumn(out, total).drop("__part", "__own", "__before")


def with_index(df: DataFrame, order: list[str] | None = None, name: str = "clone_idx", start: int = 0) -> DataFrame:
    """df with positions by an explicit order. Ranges of the order are numbered apart and offset by the
    sizes of those before, so that no task sorts everything."""
    if name in df.columns and order is None:
        return df
    columns = order or df.columns
    ranged = df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("__part", F.spark_partition_id())
    held = ranged.withColumn("__own", F.monotonically_increasing_id() - F.shiftleft(F.col("__part").cast("long"), 33))
    sizes = held.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return held.join(before.drop("__n"), "__part").withColumn(name, F.col("__own") + F.col("__before") + start).drop("__part", "__own", "__before")
