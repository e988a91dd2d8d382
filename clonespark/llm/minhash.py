"""Near-duplicate documents by circulant MinHash.

A document's set is its distinct word shingles, told apart by 64-bit hashes: of
two texts some 1e-19 of the shingles they don't share are taken for shared. Two
permutations of the 32-bit numbers make all signature coordinates: the first
scatters the shingles, coordinate k shifts its result round by k, and the second
is applied before taking the minimum. Bands of coordinates give candidates.

Documents with the same set form a class and go on as one. A bucket's members
are first compared to its smallest member. A bucket whose members then still lie
in several components is compared whole, block against block: full sets meet as
matrices inside a task, and only what joins two components leaves it. No bucket
is capped and no group's pairs are listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonespark.llm.common import bounded_batches, coded, document_key, materialize, regrouped, with_least, words_of
from clonespark.llm.components import connected_components

#: 24 bands of 5: a pair at a Jaccard similarity of 0.8 is missed with a chance of 7e-5.
BANDS, ROWS = 24, 5
#: Members and shingles of a block that is compared with another in one task.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 19
#: Text bytes whose sets a worker makes at once.
SET_BYTES = 4 << 20


def _second(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def _first(x: np.ndarray) -> np.ndarray:
    """The other one, of the shingles' hashes folded to 32 bits."""
    x = (x ^ x >> np.uint64(32)).astype(np.uint32)
    x *= np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA77)
    x ^= x >> np.uint32(13)
    return x


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and the offsets of each one's."""
    words, offsets = words_of(texts)
    index, distinct = coded(words)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct))[index]
    n = np.diff(offsets)
    places = np.where(n > 0, np.maximum(1, n - size + 1), 0)
    doc = np.repeat(np.arange(len(n)), places)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(places) - places, places) + offsets[:-1][doc]
    h = np.zeros(len(doc), np.uint64)
    for k in range(size):
        inside = at + k < offsets[1:][doc]
        word = hashes[np.minimum(at + k, max(0, len(hashes) - 1))] if len(hashes) else h
        h = np.where(inside, (h ^ word) * np.uint64(0x9E3779B97F4A7C15), h)
        h ^= np.where(inside, h >> np.uint64(29), np.uint64(0))
    stops = np.concatenate([[0], np.cumsum(places)])
    sets = [np.unique(h[a:b]) for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]
    return np.concatenate([*sets, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int64)])


def signatures(sets: np.ndarray, offsets: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash signatures of non-empty sets, a row each."""
    out = np.empty((len(offsets) - 1, coordinates), np.uint32)
    start, room = 0, 1 << 16
    while start < len(out):  # as many sets at a time as the processor's cache holds
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + room, side="right")) - 1)
        x = _first(sets[offsets[start] : offsets[stop]])
        cuts = offsets[start:stop] - offsets[start]
        for k in range(coordinates):
            out[start:stop, k] = np.minimum.reduceat(_second(x + np.uint32(k)), cuts)
        start = stop
    return out


def bands_of(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash for each band, different between bands."""
    parts = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    h = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), 1))
    for k in range(rows):
        h = (h ^ parts[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


def sketch(docs: DataFrame, doc_id: str, text: str, size: int, bands: int, rows: int) -> DataFrame:
    """(row, key, doc_id, n_shingles, print, bands): print tells sets apart, null for an empty one, which has no bands."""
    bounded_batches(docs.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in regrouped(batches, "text", SET_BYTES):
            sets, offsets = shingle_sets(batch.column("text"), size)
            n = np.diff(offsets)
            full = n > 0
            starts = np.append(offsets[:-1][full], len(sets))
            hashes = bands_of(signatures(sets, starts, bands * rows), bands, rows).view(np.int64)
            raw = memoryview(sets.view(np.uint8))
            prints = [xxhash.xxh3_128_hexdigest(raw[8 * a : 8 * b]) if b > a else None for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            lists = np.concatenate([[0], np.cumsum(full)]).astype(np.int32) * np.int32(bands)
            held = pa.ListArray.from_arrays(pa.array(lists), pa.array(hashes.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(len(n))), batch.column("key"), batch.column("doc_id"), pa.array(n), pa.array(prints, pa.string()), held], ["row", "key", "doc_id", "n_shingles", "print", "bands"])
            row += len(n)

    rows_of = docs.select(document_key(doc_id, text).alias("key"), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows_of.mapInArrow(make, "row long, key struct<one: bigint, two: bigint>, doc_id long, n_shingles long, print string, bands array<long>")


def full_sets(docs: DataFrame, text: str, size: int) -> DataFrame:
    """Of docs(id, text): (id, shingles), the full set."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in regrouped(batches, "text", SET_BYTES):
            sets, offsets = shingle_sets(batch.column("text"), size)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(sets.view(np.int64)))], ["id", "shingles"])

    rows_of = docs.select("id", F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows_of.mapInArrow(make, "id long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach percent of Jaccard similarity. b may stand in many pairs: it is
    joined by parts, so that no set's pairs meet in one task."""
    parts = F.pmod(F.xxhash64("a"), F.lit(64))
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").withColumn("part", parts)
    wanted = pairs.select("b", parts.alias("part")).distinct()
    right = wanted.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return left.join(right, ["b", "part"]).filter(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b")


def split_buckets(placed: DataFrame) -> DataFrame:
    """(bucket, blocks) of those buckets of placed(bucket, id, n, component) that lie in several components
    and have members that were not compared yet; of buckets with the same members, one."""
    found = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members"), F.sum("n").alias("shingles"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("mark"))
    found = found.filter("low < high and members > 2").groupBy("members", "shingles", "mark").agg(F.min("bucket").alias("bucket"))
    return found.select("bucket", F.ceil(F.greatest(F.col("members") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))


def late_links(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the components of each bucket of members(bucket, blocks, id, component, shingles).

    Full sets are intersected as matrix products inside a task, large buckets block against block; of the
    links between two components one leaves the task, and none between components joined by others.
    """
    placed = members.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "component", "shingles")

    def compare(group: pa.Table) -> pa.Table:
        ids, component, own = (group.column(c).to_numpy() for c in ("id", "component", "own"))
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        lists = group.column("shingles").combine_chunks()
        n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        _, column, times = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        shared = times[column] > 1  # what one member alone has meets nothing
        row, column = np.repeat(np.arange(len(ids)), n)[shared], (np.cumsum(times > 1) - 1)[column[shared]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        both = np.zeros((len(left), len(right)), np.float32)
        width = 2048
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, [first, first + width])
            has = np.zeros((len(ids), width), np.float32)
            has[row[a:b], column[a:b] - first] = 1
            both += has[left] @ has[right].T
        near = 100 * both >= percent * (n[left][:, None] + n[right][None, :] - both)
        near &= component[left][:, None] != component[right][None, :]
        p, q = (x[y] for x, y in zip((left, right), np.nonzero(near), strict=True))
        root = {int(c): int(c) for c in np.unique(component)}

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        _, code = np.unique(component, return_inverse=True)
        _, first_of = np.unique(np.minimum(code[p], code[q]) * len(ids) + np.maximum(code[p], code[q]), return_index=True)
        kept = []
        for at in first_of.tolist():
            one, two = top(int(component[p[at]])), top(int(component[q[at]]))
            if one != two:
                root[one] = two
                kept.append(at)
        return pa.table({"a": pa.array(ids[p[kept]], pa.int64()), "b": pa.array(ids[q[kept]], pa.int64())})

    return dealt.groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 2, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each row of docs: row, key, doc_id, n_shingles, component_id, kept, first.

    Documents link if their sets' Jaccard similarity reaches percent; a
    component takes its smallest doc_id. Whole texts count, however long; other
    columns, whatever their names, are left out. A null text or one without words has
    an empty set and links with nothing; one of fewer words than a shingle is
    one shingle. kept holds where doc_id is the component's; rows of one id
    and text share it, and first is true for just one row of a component. A
    null doc_id counts as larger than all others. Empty tables give no rows.
    """
    held = materialize(sketch(docs, doc_id, text, shingle, bands, rows), "sketch")
    full = held.filter("print is not null")
    # Copies: one class for each set, told by one of its rows.
    classes = full.groupBy("print").agg(F.min("row").alias("id"), F.min_by("key", "row").alias("key"), F.min_by("bands", "row").alias("bands"), F.first("n_shingles").alias("n"), F.count("*").alias("rows"))
    classes = materialize(classes, "classes")
    member = materialize(classes.select("id", "n", F.explode("bands").alias("bucket")), "bands")
    shared = member.groupBy("bucket").agg(F.min("id").alias("b"), F.max("id").alias("top")).filter("b < top").select("bucket", "b")
    shared = materialize(member.join(shared, "bucket"), "buckets")
    wanted = classes.select("id", "key").join(shared.select("id").distinct(), "id")
    keyed = docs.select(document_key(doc_id, text).alias("key"), F.col(text).alias("text"))
    sets = materialize(full_sets(keyed.join(wanted, "key").select("id", "text"), "text", shingle).dropDuplicates(["id"]), "sets")
    firsts = shared.filter("id <> b").select(F.col("id").alias("a"), "b").distinct()
    star = materialize(confirmed(firsts, sets, percent), "stars")
    reached = materialize(connected_components(star), "reached")
    placed = materialize(shared.join(reached, "id", "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("component")), "placed")
    split = materialize(split_buckets(placed), "split")
    late = materialize(late_links(placed.join(split, "bucket").join(sets, "id").select("bucket", "blocks", "id", "component", "shingles"), percent), "late")
    found = connected_components(star.union(late)).withColumnRenamed("id", "class")
    found = materialize(found, "found")
    # A class of one row is found by that row, a larger one by its print, by many tasks where it has many rows.
    dealt = F.explode(F.sequence(F.lit(0), F.lit(15)))
    several = classes.filter("rows > 1").select("print", F.col("id").alias("class")).join(found, "class", "left").select("print", F.coalesce("component", "class").alias("of_print")).withColumn("part", dealt)
    placed = full.select("row", "key", "doc_id", "n_shingles", "print", F.pmod(F.xxhash64("row"), F.lit(16)).cast("int").alias("part"))
    linked = placed.join(several, ["print", "part"], "left").join(found.withColumnRenamed("class", "row"), "row", "left")
    linked = materialize(linked.select("row", "key", "doc_id", "n_shingles", F.coalesce("of_print", "component", "row").alias("component")), "grouped")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    linked = with_least(linked, "component", order, "row").select("row", "key", "doc_id", "n_shingles", F.col("least.doc_id").alias("component_id"), (F.col("row") == F.col("least.row")).alias("first"))
    # An empty set is a component of its own.
    alone = held.filter("print is null").select("row", "key", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    return linked.union(alone).select("row", "key", "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "first")
