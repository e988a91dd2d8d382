"""Token ids in files of patched frame-of-reference blocks.

A file image is a sequence of little-endian 32-bit words:

* head: magic, format version, ids per block, number of documents, number of
  blocks, number of ids;
* documents: 8-byte ids, a word that is 1 for a null id, and a length each;
* index: for each block the word at which it starts, and one more for the end;
* blocks: minimum, width | exceptions << 8, number of ids; the differences to
  the minimum, each cut to width bits, 32 of them in width words; the places of
  the exceptions, two to a word; the exceptions' whole differences.

The width is the least that holds a given percentile of a block's differences;
what needs more bits is an exception. A block is read alone through the index.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonespark.llm.common import bounded_batches, materialize, partitions_for, regrouped
from clonespark.llm.tokens import default_tokenizer, encoder

MAGIC, VERSION, BLOCK, PERCENTILE = 0x524F4650, 1, 512, 0.9
HEAD, DOC = 6, 4


def bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of a multiple of 32 values under 2**width each as rows of words."""
    rows, n = values.shape
    lanes = values.reshape(rows, n // 32, 32)
    out = np.zeros((rows, n // 32, width), np.uint32)
    for lane in range(32):
        word, shift = divmod(lane * width, 32)
        out[:, :, word] |= lanes[:, :, lane] << np.uint32(shift)
        if shift + width > 32:
            out[:, :, word + 1] |= lanes[:, :, lane] >> np.uint32(32 - shift)
    return out.reshape(rows, -1)


def unpack(words: np.ndarray, width: int, n: int) -> np.ndarray:
    rows = len(words)
    packed = words.reshape(rows, n // 32, width)
    out = np.zeros((rows, n // 32, 32), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for lane in range(32):
        word, shift = divmod(lane * width, 32)
        value = packed[:, :, word] >> np.uint32(shift)
        if shift + width > 32:
            value = value | packed[:, :, word + 1] << np.uint32(32 - shift)
        out[:, :, lane] = value & mask
    return out.reshape(rows, n)


def encode_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """A file image of the documents' ids, which follow each other in ids."""
    blocks = -(-len(ids) // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.uint32)
    padded[: len(ids)] = ids
    if len(ids) % BLOCK:
        padded[len(ids) :] = ids[-1]
    grid = padded.reshape(blocks, BLOCK)
    least = grid.min(axis=1) if blocks else np.zeros(0, np.uint32)
    over = grid - least[:, None]
    at = min(BLOCK - 1, int(percentile * BLOCK))
    width = np.clip(bits(np.partition(over, at, axis=1)[:, at]), 1, 32) if blocks else np.zeros(0, np.int64)
    limit = (np.uint64(1) << width.astype(np.uint64))[:, None]
    odd = over >= limit
    n_odd = odd.sum(axis=1)
    count = np.full(blocks, BLOCK, np.int64)
    if len(ids) % BLOCK:
        count[-1] = len(ids) % BLOCK
    size = 3 + BLOCK // 32 * width + (n_odd + 1) // 2 + n_odd
    docs = len(doc_ids)
    first = HEAD + DOC * docs + blocks + 1
    starts = first + np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    out = np.zeros(int(starts[-1]), np.uint32)
    out[:HEAD] = MAGIC, VERSION, BLOCK, docs, blocks, len(ids)
    keys = np.array([0 if d is None else d for d in doc_ids], np.int64)
    heads = out[HEAD : HEAD + DOC * docs].reshape(docs, DOC)
    heads[:, :2] = keys.view(np.uint32).reshape(docs, 2)
    heads[:, 2] = [d is None for d in doc_ids]
    heads[:, 3] = lengths
    out[HEAD + DOC * docs : first] = starts
    begin = starts[:-1]
    out[begin], out[begin + 1], out[begin + 2] = least, width | n_odd << 8, count
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        cut = over[rows] & np.uint32((1 << int(w)) - 1)
        out[begin[rows][:, None] + 3 + np.arange(BLOCK // 32 * w)] = pack(cut, int(w))
    row, place = np.nonzero(odd)
    rank = np.arange(len(row)) - (np.cumsum(n_odd) - n_odd)[row]
    lists = begin + 3 + BLOCK // 32 * width
    np.bitwise_or.at(out, lists[row] + rank // 2, (place << 16 * (rank % 2)).astype(np.uint32))
    out[lists[row] + (n_odd[row] + 1) // 2 + rank] = over[row, place]
    return out.tobytes()


def decode_blocks(image: bytes | np.ndarray, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids of blocks start to stop; only those are read."""
    words = np.frombuffer(image, np.uint32) if not isinstance(image, np.ndarray) else image
    magic, version, block, docs, blocks, _ = (int(x) for x in words[:HEAD])
    if (magic, version) != (MAGIC, VERSION):
        raise ValueError("not a file of this format")
    stop = blocks if stop is None else min(stop, blocks)
    index = HEAD + DOC * docs
    begin = words[index + start : index + stop].astype(np.int64)
    width, n_odd = (words[begin + 1] & 255).astype(np.int64), (words[begin + 1] >> 8).astype(np.int64)
    out = np.zeros((len(begin), block), np.uint32)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        out[rows] = unpack(words[begin[rows][:, None] + 3 + np.arange(block // 32 * w)], int(w), block)
    row = np.repeat(np.arange(len(begin)), n_odd)
    rank = np.arange(len(row)) - (np.cumsum(n_odd) - n_odd)[row]
    lists = begin + 3 + block // 32 * width
    place = words[lists[row] + rank // 2] >> (16 * (rank % 2)).astype(np.uint32) & 0xFFFF
    out[row, place] = words[lists[row] + (n_odd[row] + 1) // 2 + rank]
    out += words[begin][:, None]
    count = words[begin + 2].astype(np.int64)
    return out[np.arange(block) < count[:, None]]


def decode_file(image: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, lengths, and all ids."""
    words = np.frombuffer(image, np.uint32)
    docs = int(words[3])
    heads = words[HEAD : HEAD + DOC * docs].reshape(docs, DOC)
    keys = np.ascontiguousarray(heads[:, :2]).view(np.int64).ravel()
    return [None if n else int(k) for k, n in zip(keys, heads[:, 2], strict=True)], heads[:, 3].astype(np.int64), decode_blocks(words)


def write_token_files(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 2, file_bytes: int = 4 << 20) -> DataFrame:
    """Token files of docs in ascending doc_id order, written to the shared folder.

    Returns the table of written files: file_part, file_seq (their order),
    part_before (ids of the part's files before), n_ids, n_docs and image, the
    file itself. Each document's ids end with
    end_id. A null text is empty, a null id sorts first, rows of one id sort by
    a hash of their text, so any run writes the same ids in the same order;
    files are cut by these, so no id's rows need meet in one task. A text goes
    into one file whatever its length. Other columns, whatever their names, are
    left out. An empty table gives no file. file_bytes: text bytes of one file.
    """
    bounded_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, part, before = encoder(path), TaskContext.get().partitionId(), 0
        for seq, batch in enumerate(regrouped(batches, "text", file_bytes)):
            ids, offsets = own.ids(batch.column("text"))
            n = np.diff(offsets)
            total = np.full(len(ids) + len(n), end_id, np.uint32)
            total[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
            image = encode_file(batch.column("doc_id").to_pylist(), n + 1, total)
            yield pa.RecordBatch.from_pydict({"file_part": pa.array([part], pa.int64()), "file_seq": pa.array([seq], pa.int64()), "part_before": pa.array([before], pa.int64()), "n_ids": pa.array([len(total)], pa.int64()), "n_docs": pa.array([len(n)], pa.int64()), "image": pa.array([image], pa.binary())})
            before += len(total)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = rows.withColumn("of_text", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = ["doc_id", "of_text", "row"]  # rows alike in the first two are alike
    ordered = keyed.repartitionByRange(partitions_for(rows, "text", 16 << 20), *order).sortWithinPartitions(*order).select("doc_id", "text")
    return materialize(ordered.mapInArrow(write, "file_part long, file_seq long, part_before long, n_ids long, n_docs long, image binary"), "token-files")


def part_starts(files: DataFrame) -> dict[int, int]:
    """For each part of the files, the ids of all parts before."""
    sizes = sorted(map(tuple, files.groupBy("file_part").agg(F.sum("n_ids")).collect()))
    return dict(zip((p for p, _ in sizes), np.cumsum([0, *(n for _, n in sizes)]).tolist(), strict=False))


def read_ids(files: DataFrame, start: int, stop: int) -> DataFrame:
    """(start, ids): the ids from place start to stop over all files, a row for each file that has some.

    Only parts that reach into the range are loaded, and of their files only the
    blocks that do are unpacked, through the index. An empty range has no rows.
    """
    starts = part_starts(files)
    before = [p for p, first in starts.items() if first <= start]
    within = [p for p, first in starts.items() if first < stop]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, in_part, n, image in zip(*(batch.column(c).to_pylist() for c in ("file_part", "part_before", "n_ids")), batch.column("image"), strict=True):
                first = starts[part] + in_part
                low, high = max(0, start - first), min(n, stop - first)
                if low >= high:
                    continue
                words = np.frombuffer(image.as_buffer(), np.uint32)
                size = int(words[2])
                block = low // size
                ids = decode_blocks(words, block, -(-high // size))[low - block * size : high - block * size]
                yield pa.RecordBatch.from_pydict({"start": pa.array([first + low]), "ids": pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))})

    wanted = files.filter(F.col("file_part").between(before[-1] if before else 0, within[-1] if within and stop > start else -1))
    return wanted.select("file_part", "part_before", "n_ids", "image").mapInArrow(read, "start long, ids array<long>")


def read_token_files(files: DataFrame) -> DataFrame:
    """What the files hold, a row for each document: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before, over all files: the parts'
    sums, of which there are as many as partitions were written (200,000 at
    most), come to the driver and go to every task; the images stay in place.
    """
    starts = part_starts(files)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, in_part, image in zip(batch.column("file_part").to_pylist(), batch.column("part_before").to_pylist(), batch.column("image"), strict=True):
                before = starts[part] + in_part
                doc_ids, n, ids = decode_file(image.as_buffer())
                stop = np.cumsum(n)
                raw = memoryview(np.ascontiguousarray(ids).view(np.uint8))
                crc = [zlib.crc32(raw[4 * (b - k) : 4 * b]) for b, k in zip(stop.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(before + stop - n), "n_tokens": pa.array(n), "ids_crc32": pa.array(crc, pa.int64())})

    return files.select("file_part", "part_before", "image").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
