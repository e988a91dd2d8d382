"""Packing documents into sequences of a fixed window.

Documents are cut into whole windows and a rest. The rests' histogram is all
the planning needs: combinations of few lengths that fill a window exactly are
the columns of a non-negative least-squares problem whose solution says how
often to repeat each; the repeats are rounded, and what is left is packed
greedily. The plan has a bounded number of rows whatever the input; pieces find
their places in it by their rank among pieces of the same length, and ranks are
counted bucket by bucket, so no length's pieces meet in one task.
"""

from __future__ import annotations

import logging
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clonespark.llm.common import bounded_batches, materialize, plain, regrouped
from clonespark.llm.tokens import default_tokenizer, encoder

WINDOW = 1024
#: Text bytes that are tokenized at once.
PIECE_BYTES = 4 << 20
log = logging.getLogger(__name__)


def combinations(lengths: np.ndarray, window: int, limit: int = 20_000) -> np.ndarray:
    """Rows of up to three of the lengths (0: none) that together fill the window.

    All pairs; of the triples, where there are more than limit, every so-manieth
    in the order of their lengths. Fewer columns cost padding alone: every piece
    finds its place, by the greedy part if by no column.
    """
    lengths = np.unique(lengths[(lengths > 0) & (lengths < window)])
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    pairs = lengths[have[window - lengths] & (lengths <= window - lengths)]
    rows = [np.stack([pairs, window - pairs, np.zeros_like(pairs)], 1)]
    a, b = np.meshgrid(lengths, lengths, indexing="ij")
    c = window - a - b
    fits = (a <= b) & (b <= c) & (c > 0)
    fits[fits] = have[c[fits]]
    triples = np.stack([a[fits], b[fits], c[fits]], 1)
    rows.append(triples[:: max(1, -(-len(triples) // limit))])
    return np.concatenate(rows).astype(np.int64)


def nnls(columns: np.ndarray, histogram: np.ndarray, steps: int = 20_000, least: float = 0.5) -> np.ndarray:
    """x >= 0 that brings sum over columns of x to the histogram, by greedy coordinate descent.

    Each step takes the coordinate whose exact line search lowers the squared
    error most, and stops when no step gains, or after so many steps with a
    warning: the rest is then packed greedily. A column's entry for a length
    counts how often the length stands in it.
    """
    window = len(histogram) - 1
    left = histogram.astype(np.float64).copy()
    left[0] = 0
    x = np.zeros(len(columns))
    if not len(columns):
        return x
    places = [np.flatnonzero((columns == v).any(axis=1)) for v in range(window + 1)]
    # Squared norm of a column: repeats of a length add up before squaring.
    norm = np.array([sum(k * k for v, k in zip(*np.unique(r[r > 0], return_counts=True), strict=True)) for r in columns], float)
    slope = left[columns].sum(axis=1)
    for _ in range(steps):
        move = np.maximum(slope / norm, -x)
        gain = move * (2 * slope - move * norm)
        best = int(np.argmax(gain))
        if move[best] < least and gain[best] < least:
            break
        x[best] += move[best]
        for v, k in zip(*np.unique(columns[best][columns[best] > 0], return_counts=True), strict=True):
            left[v] -= k * move[best]
            near = places[v]
            slope[near] -= (columns[near] == v).sum(axis=1) * k * move[best]
    else:
        log.warning("least squares over %d columns stopped after %d steps", len(columns), steps)
    return x


def plan(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats): sequences that hold each piece of the histogram exactly once."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[tuple[int, ...], int]] = []
    if left[window]:
        out.append(((window,), int(left[window])))
        left[window] = 0
    columns = combinations(np.flatnonzero(left), window)
    x = np.rint(nnls(columns, left)).astype(np.int64)
    for j in np.argsort(-x, kind="stable"):
        if x[j] <= 0:
            break
        lengths, need = np.unique(columns[j][columns[j] > 0], return_counts=True)
        times = int(min(x[j], (left[lengths] // need).min()))
        if times > 0:
            left[lengths] -= need * times
            out.append((tuple(int(v) for v in columns[j] if v), times))
    while (there := np.flatnonzero(left)).size:  # each turn uses up at least one length
        lengths, room = [], window
        taken: dict[int, int] = {}
        while (fit := there[(there <= room) & (left[there] > np.array([taken.get(int(v), 0) for v in there]))]).size:
            v = int(fit[-1])
            taken[v] = taken.get(v, 0) + 1
            lengths.append(v)
            room -= v
        times = min(int(left[v]) // k for v, k in taken.items())
        for v, k in taken.items():
            left[v] -= k * times
        out.append((tuple(lengths), times))
    return out


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Slots of the plan, sorted by length and rank: ranks low to high of a length go to sequences from base at offset."""
    rows, seen, base = [], {}, 0
    for lengths, times in patterns:
        at = 0
        for v in lengths:
            low = seen.get(v, 0)
            rows.append((v, low, base, at))
            seen[v] = low + times
            at += v
        base += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("length", "low", "base", "offset"), table.T, strict=True))


def piece_table(docs: DataFrame, doc_id: str, text: str, tokenizer: str, end_id: int, window: int) -> DataFrame:
    """Pieces of every document: whole windows and a rest. Ids are told by their checksum."""
    bounded_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, row = encoder(tokenizer), TaskContext.get().partitionId() << 40
        for batch in regrouped(batches, "text", PIECE_BYTES):
            ids, offsets = own.ids(plain(batch.column("text")))
            n = np.diff(offsets)
            total = np.full(len(ids) + len(n), end_id, np.uint32)
            total[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
            n = n + 1
            first = np.cumsum(n) - n
            pieces = -(-n // window)
            doc = np.repeat(np.arange(len(n)), pieces)
            start = (np.arange(len(doc)) - (np.cumsum(pieces) - pieces)[doc]) * window
            length = np.minimum(window, n[doc] - start)
            raw = memoryview(total.view(np.uint8))
            begin = (first[doc] + start).tolist()
            crc = [zlib.crc32(raw[4 * b : 4 * (b + k)]) for b, k in zip(begin, length.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"row": pa.array(row + doc), "doc_id": batch.column("doc_id").take(pa.array(doc)), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(n[doc])})
            row += len(n)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 0, window: int = WINDOW, bucket_rows: int = 20_000) -> DataFrame:
    """Every piece of every document with its sequence_id and its offset there.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    A null or empty text is the end id alone; a text of any length is cut into
    whole windows and a rest. Rows with the same or a null doc_id are packed
    each by itself, and copies of one row are dealt over all buckets. Other
    columns, whatever their names, are left out. An empty table gives no row.
    The histogram, at most window counts, is all that reaches the driver.
    """
    pieces = materialize(piece_table(docs, doc_id, text, tokenizer or default_tokenizer(), end_id, window), "pieces")
    histogram = np.zeros(window + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        histogram[length] = n
    slots = places(plan(histogram, window))
    buckets = max(16, int(histogram.sum()) // bucket_rows)

    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("row", "start"), F.lit(buckets)))
    sums = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = keyed.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(sums), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "bucket").orderBy("row", "start")
    ranked = keyed.withColumn("own", F.row_number().over(own) - 1).join(bases, ["length", "bucket"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = slots["length"] << 45 | slots["low"]
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(key, batch.column("length").to_numpy() << 45 | rank, side="right") - 1
            sequence, offset = slots["base"][at] + rank - slots["low"][at], slots["offset"][at]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")} | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)})

    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("own")).alias("rank")).mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
