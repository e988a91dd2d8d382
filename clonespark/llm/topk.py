"""Exact top-k by inner product with Fagin's threshold algorithm.

Each block of candidates has a sorted list of every dimension. A query reads
each list from the end that its component favours, round after round to twice
the depth; a candidate met in any list is scored in full, once. No candidate
still unmet can score above the sum of the products with the next values of the
lists, so reading stops as soon as that bound is below the kth score: a
candidate that ties with the kth could still have the smaller id.

A query first searches the block of its own row. Its kth score there goes along
to all other blocks, which it leaves unread where the bound at the lists' heads
is below that already. There is no other path to a result than the lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clonespark.llm.common import materialize
from clonespark.llm.embeddings import vectors_of

#: Candidates of a block: as many as these bytes of components hold (at 12 bytes: value, place, list), and no more than ROWS.
BLOCK_BYTES, ROWS = 64 << 20, 1 << 16
#: Queries that one task answers for one block.
QUERIES = 1 << 13
FIRST_DEPTH = 32


class Lists:
    """A block of candidates, in the order that decides ties, with a sorted list of each dimension."""

    def __init__(self, candidates: np.ndarray, largest_query: int):
        self.n, self.dims = candidates.shape
        most = max(1, int(np.abs(candidates).max(initial=0))) * max(1, largest_query) * max(1, self.dims)
        # A type that holds all sums of products exactly, in whatever order they are added.
        self.kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object
        self.candidates = candidates.astype(self.kind)
        order = np.argsort(candidates, axis=0, kind="stable")
        self.order = np.ascontiguousarray(order.T)
        self.values = np.ascontiguousarray(np.take_along_axis(self.candidates, order, axis=0).T)

    def search(self, query: np.ndarray, own: int, k: int, floor: float | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, scores) of the k best candidates but own, and how many were scored.

        Candidates below floor, a kth score reached elsewhere, may be left out.
        """
        n, q = self.n, query.astype(self.kind)
        favours_high, favours_low = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        high, low = q[favours_high], q[favours_low]
        met, scored = np.zeros(n, bool), np.zeros(n, bool)
        if own >= 0:
            met[own] = scored[own] = True
        at, score = np.zeros(0, np.int64), np.zeros(0, self.kind)
        kth, depth, total = floor, 0, 0
        while depth < n and not scored.all():
            bound = high @ self.values[favours_high, n - 1 - depth] + low @ self.values[favours_low, depth]
            if kth is not None and bound < kth:
                break
            to = min(n, max(FIRST_DEPTH, 2 * depth))
            if len(high) + len(low):
                met[self.order[favours_high, n - to : n - depth]] = True
                met[self.order[favours_low, depth:to]] = True
            else:  # all score 0, so the order of ties is the only list
                met[depth:to] = True
            depth = to
            new = np.flatnonzero(met & ~scored)
            scored[new] = True
            total += len(new)
            at, score = np.concatenate([at, new]), np.concatenate([score, self.candidates.take(new, axis=0) @ q])
            if len(at) >= k:
                least = np.partition(score, len(score) - k)[len(score) - k]
                kth = least if kth is None else max(kth, least)
                good = score >= kth
                at, score = at[good], score[good]
                if not len(high) + len(low):
                    break
        best = np.lexsort((at, -score))[:k] if self.kind is not object else np.array(sorted(range(len(at)), key=lambda i: (-score[i], at[i]))[:k], np.int64)
        return at[best], score[best], total


def integer_vectors(vectors: DataFrame, vec_id: str, embedding: str, scale: float) -> DataFrame:
    """(vec_id, raw) of the usable rows: floor(scale * x) as 8-byte integers; beyond 2**62 it is an error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, values in vectors_of(batch.column("v"), zero=True):
                whole = np.floor(scale * values)
                if np.abs(whole).max() >= 2.0**62:
                    raise OverflowError("a component times the scale is not below 2**62")
                whole = whole.astype(np.int64)
                kind = np.int16 if np.abs(whole).max() < 1 << 15 else np.int64
                raw = [bytes([whole.astype(kind).itemsize]) + v.tobytes() for v in whole.astype(kind)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), pa.array(raw, pa.binary())], ["vec_id", "raw"])

    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v")).mapInArrow(read, "vec_id long, raw binary")


def _matrix(raw: list[bytes], dims: int) -> np.ndarray:
    out = np.zeros((len(raw), dims), np.int64)
    for row, r in enumerate(raw):
        values = np.frombuffer(r, np.int16 if r[0] == 2 else np.int64, offset=1)
        out[row, : len(values)] = values
    return out


RESULT = "query_row long, query_id long, vec_id long, row long, score long"


def search_blocks(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """RESULT of queries(block, set, row, vec_id, raw, floor) against candidates(block, set, row, vec_id, raw)."""

    def search(key: tuple, own: pa.Table, wanted: pa.Table) -> pa.Table:
        found: dict[str, list] = {c: [] for c in ("query_row", "query_id", "vec_id", "row", "score")}
        if own.num_rows and wanted.num_rows:
            own = own.sort_by([("vec_id", "ascending"), ("row", "ascending")])  # nulls at the end
            a, b = own.column("raw").to_pylist(), wanted.column("raw").to_pylist()
            dims = max((len(r) - 1) // r[0] for r in (*a, *b))
            asked = _matrix(b, dims)
            lists = Lists(_matrix(a, dims), int(np.abs(asked).max(initial=0)))
            rows, ids = own.column("row").to_numpy(), own.column("vec_id").combine_chunks()
            place = {r: i for i, r in enumerate(rows.tolist())}
            for q, row, query_id, floor in zip(asked, *(wanted.column(c).to_pylist() for c in ("row", "vec_id", "floor")), strict=True):
                at, score, _ = lists.search(q, place.get(row, -1), k, floor)
                if len(at):
                    found["query_row"].append(np.full(len(at), row))
                    found["query_id"].append(np.full(len(at), query_id))
                    found["vec_id"].append(at)
                    found["row"].append(rows[at])
                    found["score"].append(score)
        if not found["score"]:
            return pa.table({c: pa.array([], pa.int64()) for c in found})
        whole = {c: np.concatenate(x) for c, x in found.items()}
        score = whole["score"]
        if score.dtype == object and max(map(abs, score.tolist())) >= 1 << 63:
            raise OverflowError("a score needs more than 64 bits")
        return pa.table({c: pa.array(x.astype(np.int64)) if c != "vec_id" else ids.take(pa.array(x)) for c, x in whole.items()})

    # New names, since both sides may come of one table.
    one, two = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (candidates, queries))
    return one.groupBy("block", "set").cogroup(two.groupBy("block", "set")).applyInArrow(search, RESULT)


def exact_top_k(vectors: DataFrame, query: str | Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 20, scale: float = 64.0, tasks: int = 12) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that the condition query on vec_id picks, its k best others.

    Every row but the query's own is a candidate, those of the same id too;
    ties go to the smaller vec_id, a null one counting as the largest. Vectors
    that are null or hold a null or non-finite component take no part; a
    shorter vector counts as ending in zeros. Repeated rows stand each for
    themselves. Components beyond 2**62 and scores beyond 64 bits are errors.
    An empty table gives no rows. Candidates go in blocks bounded in rows and
    bytes and queries in sets, so every pair of them is a task of bounded memory.
    """
    held = materialize(integer_vectors(vectors, vec_id, embedding, scale).withColumn("row", F.monotonically_increasing_id()), "integers")
    asked = held.filter(F.expr(query) if isinstance(query, str) else query)
    n, widest = held.agg(F.count("*"), F.max(F.octet_length("raw"))).first()
    m = asked.count()
    dims = max(1, (widest or 0) // 2)  # at least so many components have two bytes each
    blocks = max(1, -(-n // max(1, min(ROWS, BLOCK_BYTES // (12 * dims)))))
    sets = max(1, -(-m // (blocks * QUERIES)), min(tasks, m // 64) // blocks)
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    homes = asked.withColumn("block", block).withColumn("set", F.pmod(F.xxhash64("row", F.lit(3)), F.lit(sets)).cast("int"))
    near = search_blocks(held.withColumn("block", block).withColumn("set", every(sets)), homes.withColumn("floor", F.lit(None).cast("long")), k)
    if blocks > 1:
        near = materialize(near, "near")
        kth = near.groupBy(F.col("query_row").alias("row")).agg(F.count("*").alias("n"), F.min("score").alias("least")).select("row", F.when(F.col("n") >= k, F.col("least")).alias("floor"))
        sets = max(1, -(-m // QUERIES), min(tasks, m // 64) // blocks)
        others = homes.withColumnRenamed("block", "home").withColumn("set", F.pmod(F.xxhash64("row", F.lit(3)), F.lit(sets)).cast("int")).join(kth, "row", "left").withColumn("block", every(blocks)).filter("block <> home").drop("home")
        near = near.union(search_blocks(held.withColumn("block", block).withColumn("set", every(sets)), others, k))
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
