"""Helpers shared by the operators: shared folder, partition counts, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one step of an Arrow kernel works on.
STEP_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return what this worker has freed to the system: workers live on, and the next stage's need room."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as by rows, so long texts don't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only where the session names none and runs in one process."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return str(held.get()).rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="clonespark-"))
    return str(sc._jsc.sc().getCheckpointDir().get()).rstrip("/")


#: What this process has written to shared folders.
_written: list[str] = []


def written() -> int:
    """How many intermediate tables there are, as a mark for release."""
    return len(_written)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Delete the intermediate tables written since a mark, but for the last keep ones.

    Results that still read them must be stored before.
    """
    done, stop = 0, max(since, len(_written) - keep)
    for name in _written[since:stop]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        done += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    del _written[since:stop]
    return done


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder as Parquet and reread it: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/clonespark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame, text: str) -> int:
    """The planner's size estimate of df (file sizes for a scan); where it has none, text bytes by a count."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 60:
        return size
    return df.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0


def partitions_for(df: DataFrame, text: str, bytes_each: int = 32 << 20) -> int:
    """Shuffle partitions that keep each near bytes_each, never under the session's number."""
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(200_000, input_bytes(df, text) // bytes_each + 1))


def text_slices(texts: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """(start, stop) row ranges of about limit text bytes each; a row is never cut."""
    if len(texts) == 0:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield start, stop
        start = stop


def plain(texts: pa.Array) -> pa.Array:
    """Null texts as empty ones, as one array."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        texts = texts if isinstance(texts, pa.Array) else pa.concat_arrays(texts.chunks)
    return pc.fill_null(texts, "")


def regrouped(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches with about limit bytes of text each: small ones joined, large ones cut."""
    held: list[pa.RecordBatch] = []
    held_bytes = 0
    for batch in batches:
        for start, stop in text_slices(batch.column(column), limit):
            part = batch.slice(start, stop - start)
            size = pc.sum(pc.binary_length(part.column(column))).as_py() or 0
            if held and held_bytes + size > limit:
                yield pa.concat_batches(held)
                held, held_bytes = [], 0
            held.append(part)
            held_bytes += size
    if held:
        yield pa.concat_batches(held)
        held.clear()
    give_back()


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased (A-Z) words between ASCII white space, and offsets of each text's words."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(plain(texts)))
    words, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if not full.all():  # white space at an end leaves an empty piece
        before = np.concatenate([[0], np.cumsum(full)])
        words, offsets = words.filter(pa.array(full)), before[offsets]
    return words, offsets


def coded(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each word's place among the distinct ones, and these as Python strings."""
    encoded = words.dictionary_encode()
    return encoded.indices.to_numpy().astype(np.int64), encoded.dictionary.to_numpy(zero_copy_only=False)


def document_key(doc_id: str, text: str) -> Column:
    """128 bits that tell rows apart unless both their id and their text are the same."""
    of = (F.col(doc_id).cast("long"), F.coalesce(F.col(text), F.lit("")))
    return F.struct(F.xxhash64(*of).alias("one"), F.xxhash64(F.lit(11), *of).alias("two"))


def with_least(df: DataFrame, group: str, order: Column, by: str, parts: int = 16) -> DataFrame:
    """df with the least value of order in each row's group, as least.

    Groups of several rows are aggregated before they meet, and their rows join the result in parts, dealt
    by a hash of column by, so a group that holds many rows is read by many tasks.
    """
    found = df.groupBy(group).agg(F.min(order).alias("least"), F.count("*").alias("__n")).filter("__n > 1").drop("__n")
    dealt = found.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    held = df.withColumn("__part", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int")).withColumn("__own", order)
    return held.join(dealt, [group, "__part"], "left").withColumn("least", F.coalesce("least", "__own")).drop("__part", "__own")
