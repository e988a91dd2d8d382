"""Scoring texts by prediction by partial matching.

A text is a space, its lower-cased words, each followed by a space, and an end.
A byte is predicted in the context of the ORDER bytes before it, which reach over
the space into the words before: the count of the byte among those that followed
the longest known context; for a byte not seen there an escape (method C: as
likely as the number of distinct bytes seen), then the next shorter context
without the bytes already ruled out, down to all bytes alike. A byte's code
length depends on its gram alone, the context of ORDER bytes and the byte: each
distinct gram is coded once.

All grams and words of the training texts are counted, distributed. The trie is
whole at any size: a gram's nodes of all orders share the end of its context, so
grams are dealt by their last LOW + 1 context bytes and each task has all it
needs, but for the nodes up to order LOW (at most 256 ** (LOW + 1)), which go
along. The code lengths of the most frequent grams (at most `nodes`) and the
counts of the most frequent words (at most `common`) go to the workers as a
cache; all other grams and words of the texts are joined by a shuffle, so both
scores are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonespark.llm.common import bounded_batches, coded, materialize, regrouped, words_of

ORDER = 5
NODES = 1 << 20
COMMON = 1 << 17
SPACE, END = 0x20, 0x0A
LOW = 2
#: Grams of a task that codes some; text bytes whose grams are in memory at once; grams that a counting task holds.
PART_GRAMS = 1 << 18
GRAM_BYTES = 2 << 20
HELD_GRAMS = 1 << 20


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of the column text, null texts empty; each batch counts before the shuffle."""
    bounded_batches(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in regrouped(batches, "text"):
            found = pc.value_counts(words_of(batch.column("text"))[0])
            yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts")], ["word", "n"])

    return texts.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def symbols(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all words with a space after each and one before all, depth of each byte since
    the space before its word, and the words' bounds among those bytes."""
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    data = b" " + pc.binary_join(pa.array([words.cast(pa.binary()).to_pylist()], pa.list_(pa.binary())), b" ")[0].as_py() + b" " if len(words) else b" "
    stream = np.frombuffer(data, np.uint8)
    first = np.concatenate([[0], np.cumsum(lengths + 1)])
    depth = np.arange(len(stream) - 1) - np.repeat(first[:-1], lengths + 1) + 1
    return stream, depth, first


def keys(stream: np.ndarray, order: int) -> np.ndarray:
    """For each byte but the first: its node of this order, as order, context and byte in one number."""
    n = len(stream) - 1
    key = np.full(n, order, np.uint64) << np.uint64(56)
    for back in range(order + 1):
        part = np.zeros(n, np.uint64)
        if back == 0:
            part[:] = stream[1:]
        elif back <= n:
            part[back - 1 :] = stream[: n + 1 - back]
        key |= part << np.uint64(8 * back)
    return key


def grams(words: pa.Array, offsets: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of all texts, ends too: its node of the highest order and its text's number.

    A text's first contexts are filled up with ends, so the node determines those of all lower orders.
    """
    before = bytes([END]) * (order - 1) + bytes([SPACE])
    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), words.cast(pa.binary()))
    after = pa.array(np.where(np.diff(offsets) > 0, bytes([SPACE]), b"").tolist(), pa.binary())
    texts = pc.binary_join_element_wise(pa.scalar(before, pa.binary()), pc.binary_join(lists, bytes([SPACE])), after, pa.scalar(bytes([END]), pa.binary()), pa.scalar(b"", pa.binary()))
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    size = int(lengths.sum())
    if not size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    stream = np.frombuffer(texts.buffers()[2], np.uint8, size)
    key = keys(stream, order)
    place = np.arange(size)
    inside = place - np.repeat(np.cumsum(lengths) - lengths, lengths) >= len(before)
    return key[inside[1:]], np.repeat(np.arange(len(lengths)), lengths - len(before))


def lower(gram: np.ndarray, order: int) -> np.ndarray:
    """The nodes of a lower order that end as these do."""
    return gram & np.uint64((1 << 8 * (order + 1)) - 1) | np.uint64(order << 56)


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of n."""
    if not len(key):
        return key, n
    at = np.argsort(key)
    key, n = key[at], n[at]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(n, first)


def gram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, n) of the column text, null texts empty; each task counts before the shuffle."""
    bounded_batches(texts.sparkSession)

    def out(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["gram", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in regrouped(batches, "text", GRAM_BYTES):
            found = pc.value_counts(pa.array(grams(*words_of(batch.column("text")), order)[0]))
            held.append((found.field("values").to_numpy(), found.field("counts").to_numpy()))
            size += len(found)
            if size > HELD_GRAMS:
                held = [summed(*map(np.concatenate, zip(*held, strict=True)))]
                size = len(held[0][0])
                if size > HELD_GRAMS // 2:
                    yield out(*held[0])
                    held, size = [], 0
        if held:
            yield out(*summed(*map(np.concatenate, zip(*held, strict=True))))

    return texts.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def low_nodes(counts: DataFrame, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and counts of the orders up to LOW, of all grams."""
    top = min(order, LOW)
    end = F.col("gram").bitwiseAND(F.lit((1 << 8 * (top + 1)) - 1))
    found = counts.groupBy(end.alias("end")).agg(F.sum("n").alias("n")).toArrow()
    end, n = found["end"].to_numpy().astype(np.uint64), found["n"].to_numpy().astype(np.int64)
    parts = [summed(lower(end, k), n) for k in range(top + 1)]
    return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])


def gram_log10(asked: DataFrame, counts: DataFrame, low: tuple[np.ndarray, np.ndarray], parts: int, order: int = ORDER) -> DataFrame:
    """(gram, log) of the distinct grams asked for, by the whole trie of the counted ones."""
    held = asked.sparkSession.sparkContext.broadcast(low)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches, pa.schema([("gram", pa.int64()), ("n", pa.int64())]))
        gram, n = rows["gram"].to_numpy().view(np.uint64), rows["n"].to_numpy()
        wanted = gram[n == 0]
        if not len(wanted):
            return
        gram, n = gram[n > 0], n[n > 0]
        node, count = held.value
        nodes = [(node, count), *(summed(lower(gram, k), n) for k in range(LOW + 1, order + 1))]
        trie = Trie(np.concatenate([x for x, _ in nodes]), np.concatenate([x for _, x in nodes]), order)
        for start in range(0, len(wanted), PART_GRAMS):
            part = wanted[start : start + PART_GRAMS]
            yield pa.RecordBatch.from_arrays([pa.array(part.view(np.int64)), pa.array(trie.grams_log10(part))], ["gram", "log"])

    both = counts.select("gram", "n").unionByName(asked.select("gram", F.lit(0).cast("long").alias("n")))
    end = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * (LOW + 1)) - 1))
    return both.repartition(parts, end).mapInArrow(code, "gram long, log double")


def most_frequent(counts: DataFrame, limit: int) -> DataFrame:
    """The rows of the highest n, at most limit; rows of about the same n stay or go together.

    One histogram of a few hundred bins decides.
    """
    level = F.floor(F.log2(F.col("n").cast("double")) * 16)
    bins = {r["level"]: r["rows"] for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("rows")).collect()}
    kept, least = 0, 1 << 20
    for at in sorted(bins, reverse=True):
        kept += bins[at]
        if kept > limit:
            break
        least = at
    return counts.filter(level >= least)


class Trie:
    """Log probabilities from node counts."""

    def __init__(self, node: np.ndarray, n: np.ndarray, order: int = ORDER):
        at = np.argsort(node)
        self.order, self.node, n = order, node[at], n[at].astype(np.float64)
        self.log_n = np.log10(n)
        context = self.node >> np.uint64(8)  # the order stays above it
        self.context, first = np.unique(context, return_index=True)
        ends = np.append(first[1:], len(self.node))
        total = np.add.reduceat(n, first) if len(n) else np.zeros(0)
        distinct = (ends - first).astype(np.float64)
        self.log_all = np.log10(total + distinct)
        self.log_escape = np.log10(distinct) - self.log_all
        # What the next shorter context has besides the bytes seen here.
        owner = np.repeat(np.arange(len(self.context)), ends - first)
        level = (self.node >> np.uint64(56)).astype(np.int64)
        shorter = self._shorter(self.node, level, 1)
        there, found = self._find(self.node, shorter)
        taken = np.bincount(owner, np.where(found & (level > 0), n[there], 0), len(self.context)) if len(n) else np.zeros(0)
        seen = np.bincount(owner, found & (level > 0), len(self.context)) if len(n) else np.zeros(0)
        up = (self.context >> np.uint64(48)).astype(np.int64)
        parent, has = self._find(self.context, self._shorter(self.context, up, 0))
        has &= up > 0
        rest = np.where(has, total[parent] - taken, 0) if len(n) else np.zeros(0)
        more = np.where(has, distinct[parent] - seen, 0) if len(n) else np.zeros(0)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.log_rest = np.log10(rest + more)
            # Nothing is left there: it is passed over at no cost.
            self.log_further = np.where(rest + more > 0, np.log10(np.maximum(more, 0)) - self.log_rest, 0.0)
        zero = np.searchsorted(self.context, np.uint64(0))
        known = distinct[zero] if len(self.context) and self.context[0] == 0 else 0
        self.log_none = -np.log10(max(1.0, 256 - known))

    @staticmethod
    def _shorter(key: np.ndarray, level: np.ndarray, tail: int) -> np.ndarray:
        """The key without its context's first byte; tail: bytes after the context."""
        level = np.maximum(level, 1).astype(np.uint64)
        keep = (np.uint64(1) << np.uint64(8) * (level - np.uint64(1) + np.uint64(tail))) - np.uint64(1)
        return (level - np.uint64(1)) << np.uint64(48 + 8 * tail) | key & keep

    @staticmethod
    def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
        return at, table[at] == wanted

    def bytes_log10(self, stream: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """log10 probability of each byte but the first."""
        return self._log10(depth, lambda k, rows: keys(stream, k)[rows])

    def grams_log10(self, gram: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each node of the highest order."""
        return self._log10(np.full(len(gram), self.order), lambda k, rows: lower(gram[rows], k))

    def _log10(self, depth: np.ndarray, node_of: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
        n = len(depth)
        out, spent = np.zeros(n), np.zeros(n)
        began = np.full(n, -1, np.int64)  # the context escaped from last
        todo = np.arange(n)
        for k in range(self.order, -1, -1):
            rows = todo[depth[todo] >= k]
            if not len(rows):
                continue
            node = node_of(k, rows)
            at, hit = self._find(self.node, node)
            context, here = self._find(self.context, node >> np.uint64(8))
            before = began[rows]
            escaped = before >= 0
            got = rows[hit]
            out[got] = spent[got] + self.log_n[at[hit]] - np.where(escaped[hit], self.log_rest[before[hit]], self.log_all[context[hit]])
            miss = ~hit & here
            lost = rows[miss]
            spent[lost] += np.where(escaped[miss], self.log_further[before[miss]], self.log_escape[context[miss]])
            began[lost] = context[miss]
            done = np.zeros(n, bool)
            done[got] = True
            todo = todo[~done[todo]]
        out[todo] = spent[todo] + self.log_none
        return out

    def words_log10(self, words: pa.Array) -> np.ndarray:
        if not len(words):
            return np.zeros(0)
        stream, depth, first = symbols(words)
        return np.add.reduceat(self.bytes_log10(stream, depth), first[:-1])

    def end_log10(self) -> float:
        return float(self.bytes_log10(np.array([SPACE, END], np.uint8), np.array([1]))[0])


def score_texts(docs: DataFrame, training: DataFrame, doc_id: str = "doc_id", text: str = "text", nodes: int = NODES, common: int = COMMON, order: int = ORDER, add: float = 1.0) -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    training has the texts to learn from in the same column. A null text is
    empty: an end alone. Rows with the same id or text are scored each by
    itself. An empty table gives no row; without training every byte is as
    likely as any other. base_score adds log10((c + add) / (N + add * (V + 1)))
    over the tokens, which are the words and an end.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    learnt = training.select(F.col(text).alias("text"))
    counts = materialize(word_counts(learnt), "words")
    texts = training.count()
    found = counts.agg(F.count("*").alias("v"), F.sum("n").alias("n")).first()
    train_tokens, distinct = (found["n"] or 0) + texts, found["v"] + (texts > 0)
    frequent = most_frequent(counts, common).select("word", "n").toArrow()
    log_all = float(np.log10(train_tokens + add * (distinct + 1)))
    end_base = float(np.log10(texts + add)) - log_all
    trie = materialize(gram_counts(learnt, order), "trie")
    low = low_nodes(trie, order)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), trie.count() // PART_GRAMS + 1)
    cached = gram_log10(most_frequent(trie, nodes), trie, low, parts, order).toArrow().sort_by("gram")
    base = dict(zip(frequent["word"].to_pylist(), (np.log10(frequent["n"].to_numpy().astype(np.float64) + add) - log_all).tolist(), strict=True))
    held = spark.sparkContext.broadcast((cached["gram"].to_numpy().view(np.uint64), cached["log"].to_numpy(), base))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        gram, log, base = held.value
        row = TaskContext.get().partitionId() << 40
        for batch in regrouped(batches, "text", GRAM_BYTES):
            words, offsets = words_of(batch.column("text"))
            index, distinct_words = coded(words)
            plain_words = np.fromiter((base.get(w, np.nan) for w in distinct_words), float, len(distinct_words))[index]
            of, n = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), np.diff(offsets)
            rare = np.isnan(plain_words)
            found, text_of = grams(words, offsets, order)
            encoded = pa.array(found).dictionary_encode()
            several = encoded.dictionary.to_numpy()
            place, hit = Trie._find(gram, several)
            bits = np.where(hit, log[place], np.nan)[encoded.indices.to_numpy()] if len(gram) else np.full(len(found), np.nan)
            new = np.isnan(bits)
            ends = lambda of, x: np.concatenate([[0], np.cumsum(np.bincount(of, x, len(n)))]).astype(np.int32)
            rare_n = ends(of, rare)
            yield pa.RecordBatch.from_pydict({
                "row": pa.array(row + np.arange(len(n))),
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array(n + 1),
                "n_known": pa.array(n - np.diff(rare_n) + (texts > 0)),
                "base_score": pa.array(np.bincount(of, np.where(rare, 0, plain_words), len(n)) + end_base),
                "score": pa.array(np.bincount(text_of, np.where(new, 0, bits), len(n))),
                "rare": pa.ListArray.from_arrays(pa.array(rare_n), words.filter(pa.array(rare))),
                "grams": pa.ListArray.from_arrays(pa.array(ends(text_of, new)), pa.array(found[new].view(np.int64))),
            })
            row += len(n)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = materialize(rows.mapInArrow(score, f"row long, doc_id {kind}, n_tokens long, n_known long, base_score double, score double, rare array<string>, grams array<long>"), "scored")
    joined = scored.select("row", F.explode("rare").alias("word")).join(counts, "word", "left")
    of_words = joined.select("row", (F.log10(F.coalesce("n", F.lit(0)) + F.lit(add)) - F.lit(log_all)).alias("b"), F.col("n").isNotNull().cast("long").alias("k"), F.lit(0.0).alias("s"))
    rest = scored.select("row", F.explode("grams").alias("gram"))
    of_grams = rest.join(gram_log10(rest.select("gram").distinct(), trie, low, parts, order), "gram").select("row", F.lit(0.0).alias("b"), F.lit(0).cast("long").alias("k"), F.col("log").alias("s"))
    more = of_words.unionByName(of_grams).groupBy("row").agg(F.sum("b").alias("b"), F.sum("k").alias("k"), F.sum("s").alias("s"))
    out = scored.drop("rare", "grams").join(more, "row", "left")
    add_to = lambda c, x, none: (F.col(c) + F.coalesce(x, F.lit(none))).alias(c)
    return out.select("doc_id", "n_tokens", add_to("n_known", "k", 0), F.lit(train_tokens).cast("long").alias("train_tokens"), add_to("base_score", "b", 0.0), add_to("score", "s", 0.0))
