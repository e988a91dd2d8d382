"""Language identification by language-bitmask n-gram filters.

A slot of a bit-sliced Bloom filter holds one bit for each language; the AND of
an n-gram's slots is the set of languages that contain it. A text's n-grams are
looked up at once for all languages, each language's hits are counted by its
bit, and the count is corrected for the hits that its filter's fill makes alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clonespark.llm.common import bounded_batches, give_back, plain, text_slices

UNDECIDED = "und"
SIZES = (3, 4)
_STEP = 1 << 20


@cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter, and the lower case of letters, else a space."""
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    lower = np.full(len(letter), 32, np.uint32)
    places = np.flatnonzero(letter)
    lower[places] = np.fromiter((ord(s) if len(s := chr(c).lower()) == 1 else c for c in places.tolist()), np.uint32, len(places))
    return letter, lower


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def ngrams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each n-gram size: hashes at all places of all texts, whether they count, and each text's bounds.

    Letters are lower-cased, all else is one space; a text begins and ends with one.
    """
    letter, lower = _characters()
    texts = plain(texts).to_pylist()
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    points = lower[codes]
    space = points == 32
    keep = ~space
    keep[0] = True
    keep[1:] |= ~space[:-1]
    place = np.cumsum(keep) - 1
    points = points[keep].astype(np.uint64)
    first = np.concatenate([[0], np.cumsum(n + 1)])  # the space before each text, and the last one
    bounds = place[first]
    for size in SIZES:
        count = max(0, len(points) - size + 1)
        h = np.full(count, size, np.uint64)
        for k in range(size):
            h *= np.uint64(0x100000001B3)
            h += points[k : k + count]
        counts = np.ones(count, bool)
        for back in range(1, size - 1):  # those that reach over a text's last space
            over = bounds[1:] - back
            counts[over[(over >= 0) & (over < count)]] = False
        yield _mixed(h), counts, np.minimum(bounds, count)


@dataclass
class LanguageModel:
    languages: list[str]
    #: A word of up to 64 languages' bits in each slot; one row for each 64 languages.
    slots: np.ndarray
    #: Of an n-gram in no language, the share that each language's filter claims.
    false_rate: np.ndarray

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Corrected hits by text and language, and all n-grams by text."""
        hits, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        top = np.uint64(self.slots.shape[1] - 1)
        for h, valid, bounds in ngrams(texts):
            sums = np.concatenate([[0], np.cumsum(valid, dtype=np.int64)])
            total += sums[bounds[1:]] - sums[bounds[:-1]]
            one, two = (h & top).astype(np.int64), (h >> np.uint64(32) & top).astype(np.int64)
            for row, slots in enumerate(self.slots):
                mask = slots[one] & slots[two]
                mask[~valid] = 0
                for bit in range(min(64, len(self.languages) - 64 * row)):
                    sums = np.concatenate([[0], np.cumsum(mask >> slots.dtype.type(bit) & slots.dtype.type(1), dtype=np.int64)])
                    hits[:, 64 * row + bit] += sums[bounds[1:]] - sums[bounds[:-1]]
        return np.maximum(0, (hits - total[:, None] * self.false_rate) / (1 - self.false_rate)), total

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (its share of all languages' hits) and known share of n-grams, by text."""
        hits, total = self.counts(texts)
        if not self.languages:
            return [UNDECIDED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        best = hits.argmax(axis=1)
        most = hits[np.arange(len(hits)), best]
        everything = hits.sum(axis=1)
        score = np.divide(most, everything, out=np.zeros(len(hits)), where=everything > 0)
        known = np.divide(most, total, out=np.zeros(len(hits)), where=total > 0)
        return [self.languages[b] if t else UNDECIDED for b, t in zip(best, total, strict=True)], np.clip(score, 0, 1), np.clip(known, 0, 1)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", docs_per_language: int = 2000, share: float = 0.2) -> LanguageModel:
    """A model from labelled rows: those with a null label or text don't count.

    docs_per_language bounds the sample: rows of a language that has more are
    drawn by a hash of their id, at the rate that leaves so many. An n-gram
    belongs to a language if it is there at least twice and at no less than
    share of the rate that it has in the language where it is most frequent.
    """
    bounded_batches(docs.sparkSession)
    labelled = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter("lang is not null and text is not null")
    rows = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    languages = sorted(rows, key=lambda s: s.encode())
    if not languages:
        return LanguageModel([], np.zeros((1, 64), np.uint64), np.zeros(0))
    known = F.create_map(*[F.lit(x) for i, l in enumerate(languages) for x in (l, F.struct(F.lit(i).alias("i"), F.lit(min(1.0, docs_per_language / rows[l])).alias("rate")))])
    drawn = labelled.withColumn("l", known[F.col("lang")]).filter(F.pmod(F.xxhash64(F.coalesce("id", F.lit("")), F.lit(5)), F.lit(1 << 20)) < F.col("l.rate") * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column("i").to_numpy()
            for a, b in text_slices(batch.column("text"), _STEP):
                found = []
                for h, valid, bounds in ngrams(batch.column("text").slice(a, b - a)):
                    row = np.searchsorted(bounds, np.arange(len(h)), side="right") - 1
                    row = np.minimum(row, b - a - 1)
                    found.append((h[valid], of[a + row[valid]]))
                h, l = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
                for i in np.unique(l):
                    key, n = np.unique(h[l == i], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"i": pa.array(np.full(len(key), i), pa.int32()), "h": pa.array(key.view(np.int64)), "n": pa.array(n)})
        give_back()

    grams = drawn.select(F.col("l.i").alias("i"), "text").mapInArrow(count, "i int, h long, n long").groupBy("i", "h").agg(F.sum("n").alias("n"))
    total = {r["i"]: r["n"] for r in grams.groupBy("i").agg(F.sum("n").alias("n")).collect()}
    if not total:
        return LanguageModel(languages, np.zeros((1, 64), np.uint64), np.zeros(len(languages)))
    all_of = F.create_map(*[F.lit(x) for i, n in total.items() for x in (i, float(n))])
    rated = grams.withColumn("rate", F.col("n") / all_of[F.col("i")])
    kept = rated.withColumn("most", F.max("rate").over(Window.partitionBy("h"))).filter((F.col("n") >= 2) & (F.col("rate") >= share * F.col("most"))).select("i", "h").toArrow()
    size = 1 << max(10, int(np.ceil(np.log2(8 * max(1, len(kept["h"].unique()))))))
    kind = np.uint8 if len(languages) <= 8 else np.uint64
    slots = np.zeros((-(-len(languages) // 64), size), kind)
    h, i = kept["h"].to_numpy().astype(np.int64).view(np.uint64), kept["i"].to_numpy()
    top = np.uint64(size - 1)
    for at in (h & top, h >> np.uint64(32) & top):
        for row in range(len(slots)):
            own = i // 64 == row
            np.bitwise_or.at(slots[row], at[own].astype(np.int64), np.left_shift(np.ones(own.sum(), kind), (i[own] % 64).astype(kind)))
    fill = np.array([np.mean(slots[l // 64] >> kind(l % 64) & kind(1)) for l in range(len(languages))])
    return LanguageModel(languages, slots, np.minimum(fill**2, 0.99))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "known")) -> DataFrame:
    """docs with lang_pred, score and known added, or other names for these.

    lang_pred is a learned language, or "und" where the text is null or has no
    letter; score is that language's share of the hits of all, 0 to 1; known is
    the share of the text's n-grams that the language has. Each row stands by
    itself, whatever repeats; whole texts are read. Columns of these names are
    replaced. No shuffle.
    """
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("struct<lang: string, score: double, known: double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            lang, score, known = [], [], []
            for a, b in text_slices(plain(texts), _STEP):
                l, s, k = model.predict(texts.slice(a, b - a))
                lang += l
                score.append(s)
                known.append(k)
            empty = [np.zeros(0)]
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(np.concatenate(score or empty)), pa.array(np.concatenate(known or empty))], ["lang", "score", "known"])
        give_back()

    held = docs.withColumn("__found", predict(F.col(text)))
    return held.withColumns({name: F.col(f"__found.{part}") for name, part in zip(names, ("lang", "score", "known"), strict=True)}).drop("__found")


def remainder(doc_id: str, by: int) -> "F.Column":
    """crc32 of the id as text, modulo by; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(by))
