"""Near-duplicate embeddings by random-hyperplane sign hashes.

Several tables of sign hashes give candidates; a pair that meets in a bucket is
confirmed by its cosine in double precision. First only ids and hashes go to the
buckets: a vector stays in a bucket where some other's hashes, over all tables,
differ from its own in no more bits than those of a pair at the threshold may.
Then these alone bring their vectors along. Buckets are compared as blocks,
large ones block against block in different tasks; what leaves a task is a sum
and a spanning edge for each vector, never a pair. A pair is counted in the
first table in which it meets. Equal vectors go on as one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonespark.llm.common import materialize, with_least
from clonespark.llm.components import connected_components

BLOCK = 1024
#: Chance that a pair just at the threshold meets in no table.
MISS = 1e-3
SEED = 7


def tables_for(rows: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """(tables, bits): buckets of about 64 vectors, and as many tables as the miss rate asks for."""
    bits = int(np.clip(round(math.log2(max(1, rows) / 64)), 4, 24))
    same = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return max(1, math.ceil(math.log(miss) / math.log(1 - same))) if same < 1 else 1, bits


def unit(values: np.ndarray) -> np.ndarray:
    values = values.astype(np.float64)
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def vectors_of(column: pa.Array, zero: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, values) for each length of the usable vectors: not null, nor zero unless so asked, all components finite."""
    flat = column.flatten().cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False)  # a null component comes as not a number
    offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    n = np.diff(offsets)
    for length in np.unique(n[n > 0]):
        rows = np.flatnonzero(n == length)
        found = values[offsets[rows][:, None] + np.arange(length)]
        good = np.isfinite(found).all(axis=1) & (zero | (found != 0).any(axis=1))
        if good.any():
            yield rows[good], found[good]


def raw_of(values: np.ndarray) -> list[bytes]:
    """A vector's bytes, as floats where these hold it exactly, after their size."""
    with np.errstate(over="ignore"):
        short = values.astype(np.float32)
    exact = (short == values).all(axis=1)
    return [b"\x04" + a.tobytes() if e else b"\x08" + b.tobytes() for e, a, b in zip(exact, short, values, strict=True)]


def values_of(raw: list[bytes]) -> np.ndarray:
    """The doubles of vectors of one length."""
    dims = (len(raw[0]) - 1) // raw[0][0]
    out = np.empty((len(raw), dims))
    short = np.array([r[0] == 4 for r in raw])
    for kind, rows in ((np.float32, np.flatnonzero(short)), (np.float64, np.flatnonzero(~short))):
        out[rows] = np.frombuffer(b"".join([raw[i][1:] for i in rows]), kind).reshape(len(rows), dims)
    return out


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(row, vec_id, raw): every row; raw, the values' bytes, is null where nothing may link."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            raw: list[bytes | None] = [None] * batch.num_rows
            for rows, values in vectors_of(batch.column("v")):
                for r, v in zip(rows.tolist(), raw_of(values + 0.0), strict=True):
                    raw[r] = v
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(batch.num_rows)), batch.column("vec_id"), pa.array(raw, pa.binary())], ["row", "vec_id", "raw"])
            row += batch.num_rows

    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v")).mapInArrow(read, "row long, vec_id long, raw binary")


def _components(linked: np.ndarray) -> np.ndarray:
    """For each vertex of a symmetric matrix: the first vertex that it reaches."""
    label = np.full(len(linked), -1)
    for v in range(len(linked)):
        if label[v] < 0:
            reached = np.zeros(len(linked), bool)
            reached[v] = True
            front = np.array([v])
            while len(front):
                new = linked[front].any(axis=0) & ~reached
                reached |= new
                front = np.flatnonzero(new)
            label[reached] = v
    return label


def links_in(units: np.ndarray, weight: np.ndarray, codes: np.ndarray, at: int, left: np.ndarray, right: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights linked to each vector and the first vector that it reaches, by the pairs of left with right,
    or of left alone, that no table before this one brings together."""
    other = left if right is None else right
    near = units[left] @ units[other].T >= threshold
    if right is None:
        np.fill_diagonal(near, False)
    links, root = np.zeros(len(units), np.int64), np.arange(len(units))
    if not near.any():
        return links, root
    _forget_met(near, codes, at, left, other)
    links[left] += near @ weight[other]
    if right is not None:
        links[other] += near.T @ weight[left]
    whole = np.zeros((len(units), len(units)), bool)
    whole[np.ix_(left, other)] = near
    root = _components(whole | whole.T)
    return links, root


def _forget_met(near: np.ndarray, codes: np.ndarray, at: int, left: np.ndarray, other: np.ndarray) -> None:
    """Unmark the pairs that a table before this one brings together."""
    p, q = np.nonzero(near)
    for t in range(at):
        met = codes[left[p], t] == codes[other[q], t]
        near[p[met], q[met]] = False
        p, q = p[~met], q[~met]


def likely_in(sides: np.ndarray, codes: np.ndarray, at: int, left: np.ndarray, right: np.ndarray | None, most: int) -> np.ndarray:
    """Which vectors have, among those pairs, one whose hashes differ in at most `most` bits."""
    other = left if right is None else right
    apart = np.zeros((len(left), len(other)), np.uint16)
    for word in range(sides.shape[1]):
        apart += np.bitwise_count(sides[left, word][:, None] ^ sides[other, word][None, :])
    near = apart <= most
    if right is None:
        np.fill_diagonal(near, False)
    likely = np.zeros(len(sides), bool)
    if near.any():
        _forget_met(near, codes, at, left, other)
        likely[left] |= near.any(axis=1)
        likely[other] |= near.any(axis=0)
    return likely


def bits_apart(bits: int, threshold: float) -> int:
    """Of so many sign bits, how many differ at most for a pair just at the threshold, but for one in a billion."""
    p = math.acos(min(1.0, threshold)) / math.pi
    return math.ceil(bits * p + 6 * math.sqrt(bits * p * (1 - p)))


def runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[list[int], pa.RecordBatch]]:
    """(values of names, rows) of each group; groups come sorted one after the other, and the last of a
    batch may go on in the next."""
    rest = None
    for batch in _and_none(batches):
        if batch is not None and not batch.num_rows:
            continue
        held = rest if batch is None else batch if rest is None else pa.concat_batches([rest, batch])
        if held is None:
            return
        key = [held.column(c).to_numpy() for c in names]
        cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
        starts, stops = np.concatenate([[0], cuts]).tolist(), np.append(cuts, held.num_rows).tolist()
        if batch is not None:
            rest = held.slice(starts[-1])
            starts, stops = starts[:-1], stops[:-1]
        for a, b in zip(starts, stops, strict=True):
            yield [int(k[a]) for k in key], held.slice(a, b - a)


def _and_none(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def near_duplicate_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.95, miss: float = MISS) -> DataFrame:
    """One row for each row of vectors: vec_id, n_links, component_id, kept.

    Vectors link where they meet in a table and their cosine reaches the
    threshold; of pairs just at it a share of miss is lost, of closer ones
    less. Vectors that are null, empty or zero, or hold a null or a non-finite
    component, link with nothing; vectors of different lengths don't link. A
    component takes its smallest vec_id; null ids count as larger than all.
    Rows with the same id stand each for themselves. Empty tables give no rows.
    """
    rows = materialize(usable(vectors, vec_id, embedding).withColumn("print", F.sha2("raw", 256)), "vectors")
    classes = rows.filter("print is not null").groupBy("print").agg(F.min("row").alias("id"), F.count("*").alias("weight"), F.min(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id")).alias("least"), F.first("raw").alias("raw"))
    classes = materialize(classes, "classes")
    tables, bits = tables_for(rows.count(), threshold, miss)
    most = bits_apart(tables * bits, threshold)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            raw = batch.column("raw").to_pylist()
            codes: list[bytes] = [b""] * len(raw)
            dims = np.array([(len(r) - 1) // r[0] for r in raw])
            for d in np.unique(dims).tolist():
                if d not in planes:
                    planes[d] = np.random.default_rng([SEED, d]).standard_normal((d, tables * bits))
                at = np.flatnonzero(dims == d)
                side = np.packbits(unit(values_of([raw[i] for i in at])) @ planes[d] > 0, axis=1)
                for i, c in zip(at.tolist(), side, strict=True):
                    codes[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(dims), pa.array(codes, pa.binary())], ["id", "dims", "codes"])

    def numbers(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All sign bits as 64-bit words, and each table's code."""
        packed = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
        side = np.unpackbits(packed, axis=1, count=tables * bits).reshape(len(codes), tables, bits)
        words = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))
        return np.ascontiguousarray(words).view(np.uint64), side @ (1 << np.arange(bits))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code = numbers(batch.column("codes").to_pylist())[1]
                ids = np.repeat(np.arange(batch.num_rows), tables)
                bucket = (batch.column("dims").to_numpy()[ids] % (1 << 16)) << 44 | np.tile(np.arange(tables), batch.num_rows) << 32 | code.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(bucket), *(batch.column(c).take(pa.array(ids)) for c in ("id", "codes"))], ["bucket", "id", "codes"])

    def blocked(members: DataFrame) -> DataFrame:
        """members, sorted, with the blocks i and j that they are to be compared in; own is a member's block."""
        large = materialize(members.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "large")
        placed = members.join(large, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", *[c for c in members.columns if c != "bucket"])
        return dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def sides_of(key: list[int], group: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray | None]:
        own = group.column("own").to_numpy()
        return np.flatnonzero(own == key[1]), None if key[1] == key[2] else np.flatnonzero(own == key[2])

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, group in runs(batches, ["bucket", "i", "j"]):
            if group.num_rows > 1:
                words, codes = numbers(group.column("codes").to_pylist())
                ids = group.column("id").to_numpy()[likely_in(words, codes, key[0] >> 32 & 0xFFF, *sides_of(key, group), most)]
                if len(ids):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), key[0])), pa.array(ids)], ["bucket", "id"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, group in runs(batches, ["bucket", "i", "j"]):
            if group.num_rows > 1:
                units, codes = unit(values_of(group.column("raw").to_pylist())), numbers(group.column("codes").to_pylist())[1]
                ids = group.column("id").to_numpy()
                links, root = links_in(units, group.column("weight").to_numpy(), codes, key[0] >> 32 & 0xFFF, *sides_of(key, group), threshold)
                got = np.flatnonzero(links)
                if len(got):
                    yield pa.RecordBatch.from_pydict({"id": pa.array(ids[got]), "links": pa.array(links[got]), "root": pa.array(ids[root[got]])})

    # First by the hashes alone, then by their vectors those that have a likely partner in a bucket.
    signed = materialize(classes.select("id", "raw").mapInArrow(hashes, "id long, dims long, codes binary"), "hashes")
    members = signed.mapInArrow(deal, "bucket long, id long, codes binary")
    kept = materialize(blocked(members).mapInArrow(likely, "bucket long, id long").distinct(), "likely")
    near = kept.join(classes.select("id", "weight", "raw"), "id").join(signed.select("id", "codes"), "id").select("bucket", "id", "weight", "raw", "codes")
    found = materialize(blocked(near).mapInArrow(compare, "id long, links long, root long"), "links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    reached = connected_components(found.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    of_class = classes.select("id", "print", "weight", "least").join(counts, "id", "left").join(reached, "id", "left")
    of_class = materialize(of_class.select("print", "id", "weight", F.coalesce("component", "id").alias("component"), F.col("least").alias("own"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "of-class")
    named = materialize(with_least(of_class, "component", F.col("own"), "id").select("print", "id", "weight", "n_links", F.col("least.vec_id").alias("component_id")), "named")
    # A class of one row is found by that row, a larger one by its print, by many tasks where it has many rows.
    own = rows.filter("print is not null").select("row", "vec_id", "print", F.pmod(F.xxhash64("row"), F.lit(16)).cast("int").alias("part"))
    single = own.join(named.filter("weight = 1").select(F.col("id").alias("row"), "n_links", "component_id"), "row")
    several = named.filter("weight > 1").select("print", "n_links", "component_id").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(15))))
    columns = ["vec_id", "n_links", "component_id"]
    linked = single.select(*columns).union(own.join(several, ["print", "part"]).select(*columns))
    alone = rows.filter("print is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
