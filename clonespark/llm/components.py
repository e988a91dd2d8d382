"""Distributed connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonespark.llm.common import materialize


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, component) of every vertex of edges(a, b): component is its smallest reachable id.

    Loops and repeated edges are fine; no edges give no rows. Each round is
    written to the shared folder; vertices never reach the driver. A vertex of
    many edges is met by aggregation, and its join splits under adaptive
    execution.
    """

    def distinct(df: DataFrame) -> DataFrame:
        return df.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    vertices = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    now = materialize(distinct(edges), "edges")
    mark = state(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = distinct(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        large = materialize(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        now = materialize(distinct(small), "small")
        before, mark = mark, state(now)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return vertices.join(now, vertices.id == now.a, "left").select("id", F.coalesce("b", "id").alias("component"))
