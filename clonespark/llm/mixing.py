"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents, shuffled by a hash, are laid end to end and cut into
blocks of equal tokens. Slot n of the schedule is the n-th point of the golden
ratio's sequence, mapped through the cumulative weights to a source; a slot's
rank among its source's slots tells the block that it takes, round after round.
A source that has its share of slots passes further ones by, and one that is
short of a few gets them at the end, so each takes its target to the token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clonespark.llm.common import document_key, materialize

BLOCK_TOKENS = 256
CHUNK = 1 << 16
#: Copies of one row that one task writes out.
COPIES = 1 << 10
#: The golden ratio's fraction in 64 bits.
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def share_out(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Targets by weight that sum to all sizes, each at most `most` times its size; the excess is shared
    out by weight among the others until none is above."""
    targets, open_ones, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_ones:
        weight = sum(weights[i] for i in open_ones)
        full = sorted(i for i in open_ones if left * weights[i] / weight > most * sizes[i])
        if not full:
            for i in open_ones:
                targets[i] = left * weights[i] / weight
            break
        for i in full:
            targets[i] = float(most * sizes[i])
        left -= sum(targets[i] for i in full)
        open_ones -= set(full)
    return targets


def source_plan(documents: DataFrame, weights: tuple[float, ...], most: float, block: int) -> list[dict]:
    """A row for each source: its size, target, whole tokens to take, blocks and slots. Sources are few."""
    rows = [(r["source"], r["size"]) for r in documents.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size")).collect()]
    rows.sort(key=lambda r: (r[0] is None, [ord(c) for c in r[0] or ""]))
    sizes = [n for _, n in rows]
    targets = share_out(sizes, [weights[i % len(weights)] for i in range(len(rows))], most)
    plan = []
    for i, ((source, size), target) in enumerate(zip(rows, targets, strict=True)):
        take = min(round(target), int(most * size))
        rounds, rest = divmod(take, size) if size else (0, 0)
        plan.append({"s": i, "source": source, "source_size": size, "target": target, "take": take, "blocks": -(-size // block), "rounds": rounds, "rest": rest, "slots": rounds * -(-size // block) + -(-rest // block)})
    return plan


def schedule(spark, plan: list[dict]) -> DataFrame:
    """(slot, s, rank): the source of each slot and the slot's rank among that source's."""
    slots = np.array([p["slots"] for p in plan], np.int64)
    total = int(slots.sum())
    ends = np.cumsum(slots)
    # A point's 64 bits are compared to cumulative shares in 64 bits.
    limits = np.array([int(e) * ((1 << 64) - 1) // max(1, total) for e in ends], np.uint64)

    def sources(chunk: int) -> tuple[np.ndarray, np.ndarray]:
        slot = np.arange(chunk * CHUNK, min(total, (chunk + 1) * CHUNK), dtype=np.uint64)
        return slot.astype(np.int64), np.minimum(np.searchsorted(limits, (slot + np.uint64(1)) * GOLDEN, side="left"), len(slots) - 1)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.column("id").to_pylist():
                s, n = np.unique(sources(chunk)[1], return_counts=True)
                yield pa.RecordBatch.from_pydict({"chunk": pa.array(np.full(len(s), chunk)), "s": pa.array(s.astype(np.int32)), "n": pa.array(n)})

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, held in zip(batch.column("chunk").to_pylist(), batch.column("held").to_pylist(), strict=True):
                slot, s = sources(chunk)
                before = np.zeros(len(slots), np.int64)
                for h in held:
                    before[h["s"]] = h["before"]
                order = np.argsort(s, kind="stable")
                n = np.bincount(s, minlength=len(slots))
                rank = np.empty(len(s), np.int64)
                rank[order] = np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n)
                rank += before[s]
                used = rank < slots[s]
                yield pa.RecordBatch.from_pydict({"slot": pa.array(slot[used]), "s": pa.array(s[used].astype(np.int32)), "rank": pa.array(rank[used])})

    if not total:
        return spark.createDataFrame([], "slot long, s int, rank long")
    chunks = spark.range(-(-total // CHUNK), numPartitions=max(1, min(4096, -(-total // CHUNK))))
    counted = materialize(chunks.mapInArrow(counts, "chunk long, s int, n long"), "slots")
    sums = Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    held = counted.withColumn("before", F.coalesce(F.sum("n").over(sums), F.lit(0))).groupBy("chunk").agg(F.collect_list(F.struct("s", "before")).alias("held"))
    ranked = held.mapInArrow(ranks, "slot long, s int, rank long")
    # The few that are missing come after all others; they number less than the points' discrepancy.
    reached = {r["s"]: r["n"] for r in counted.groupBy("s").agg(F.sum("n").alias("n")).collect()}
    late = [(i, reached.get(i, 0), int(slots[i])) for i in range(len(slots)) if reached.get(i, 0) < slots[i]]
    if not late:
        return ranked
    more = spark.createDataFrame(late, "s int, first long, stop long").select("s", F.explode(F.sequence("first", F.col("stop") - 1)).alias("rank"))
    return ranked.unionByName(more.select((F.lit(total) + F.col("rank")).alias("slot"), "s", "rank"))


def measured(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """(doc_id, source, size, key, n): rows alike in all of these count as one with n copies, which stand for each other."""
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), words.alias("size"), document_key(doc_id, text).alias("key"))
    return rows.groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("n"))


def copies(classes: DataFrame) -> DataFrame:
    """classes with a row for each of their n copies, numbered from 0 as copy; many copies are dealt over tasks."""
    parts = classes.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))))
    dealt = parts.repartition("key", "part")
    return dealt.withColumn("copy", F.explode(F.sequence(F.col("part") * COPIES, F.least(F.col("n"), (F.col("part") + 1) * COPIES) - 1))).drop("part", "n")


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), most: float = 3, block: int = BLOCK_TOKENS, bucket_rows: int = 2_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, pieces, plan) of a mix.

    documents: row, key, doc_id, source, size (words), s, position (its place on its
    source's line); pieces: slot, s, row, first, last: the words of a document
    that a slot takes; plan: s, source, source_size, target, take. A null text
    has no words and is in no piece, a text of any length lies in as many
    blocks as it takes; sources go by code point, a null one last, with weights
    repeating. Rows of one id are documents of their own, and copies of one row
    are laid out by as many tasks as it takes. The same rows give the same mix
    whatever their order. Other columns, whatever their names, are left out.
    Empty tables give no rows. A row for each source, not for each document,
    comes to the driver.
    """
    spark = docs.sparkSession
    held = materialize(measured(docs, doc_id, text, source), "sizes")
    rows = source_plan(held, weights, most, block)
    plan = spark.createDataFrame([tuple(r[c] for c in ("s", "source", "source_size", "target", "take", "blocks", "rounds", "rest")) for r in rows], "s int, source string, source_size long, target double, take long, blocks long, rounds long, rest long")
    buckets = max(128, (held.agg(F.sum("n")).first()[0] or 0) // bucket_rows)
    known = held.join(plan.select("s", F.col("source").alias("of")), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    placed = known.filter("size > 0").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    sums = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("s", "bucket").agg(F.sum(F.col("size") * F.col("n")).alias("words")).select("s", "bucket", F.coalesce(F.sum("words").over(sums), F.lit(0)).alias("before"))
    own = Window.partitionBy("s", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    words = F.col("size") * F.col("n")
    line = placed.withColumn("upto", F.sum(words).over(own)).join(before, ["s", "bucket"]).select("key", "doc_id", "source", "size", "s", "n", (F.col("before") + F.col("upto") - words).alias("first"))
    line = copies(line.unionByName(known.filter("size = 0").select("key", "doc_id", "source", "size", "s", "n", F.lit(None).cast("long").alias("first"))))
    line = materialize(line.select(F.monotonically_increasing_id().alias("row"), "key", "doc_id", "source", "size", "s", (F.col("first") + F.col("copy") * F.col("size")).alias("position")), "line")
    # A document lies in one block or in several.
    lies = line.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("position") / block), F.floor((F.col("position") + F.col("size") - 1) / block))))
    lies = lies.select("s", "block", "row", "position", F.greatest("position", F.col("block") * block).alias("a"), F.least(F.col("position") + F.col("size"), (F.col("block") + 1) * block).alias("b"))
    takes = schedule(spark, rows).join(plan.select("s", "blocks", "rounds", "rest"), "s").select("slot", "s", (F.col("rank") % F.col("blocks")).alias("block"), F.when(F.floor(F.col("rank") / F.col("blocks")) < F.col("rounds"), F.lit(None)).otherwise(F.col("rest")).alias("stop"))
    pieces = takes.join(lies, ["s", "block"]).withColumn("b", F.least("b", "stop")).filter("b > a")
    return line, pieces.select("slot", "s", "row", (F.col("a") - F.col("position")).alias("first"), (F.col("b") - F.col("position")).alias("last")), plan


def taken_words(documents: DataFrame, pieces: DataFrame, plan: DataFrame) -> DataFrame:
    """row, key, doc_id, size, source_size, target, taken of every document."""
    taken = pieces.groupBy("row").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    return documents.join(plan.select("s", "source_size", "target"), "s").join(taken, "row", "left").select("row", "key", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
