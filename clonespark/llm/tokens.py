"""Token ids and counts of whole texts with a public byte-level BPE vocabulary.

A byte-level BPE cuts a text into pre-tokens by a pattern before it merges
bytes, so a text may be cut wherever the pattern always starts a new pre-token
and the parts be encoded apart with the same result. An ASCII space is such a
place unless white space stands on both sides of it: a run of white space gives
up its last character to what follows. Texts are cut at those places, in Arrow,
and each distinct part is encoded once by the tokenizers library; long texts
thus never reach it whole. Special strings hold no white space and stay whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonespark.llm.common import bounded_batches, give_back, plain, text_slices

#: White space in any sense that a tokenizer's pattern may use.
_SPACE = r"\s\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_TIGHT = f"[{_SPACE}] (?:[{_SPACE}]|$)"
_SAFE = re.compile(r"(?<=\S)(?= )|(?= \S)")

#: Letters in every edition of Unicode since these were settled.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_WORD = re.compile(f" ?[{_LETTERS}]+")
_STEM = r"^[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+$"
_ENDS = ".,;:!?)"
#: Around a single line feed, and between a letter and a mark that follows it.
_LINES = re.compile(rf"(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)|(?<=[{_LETTERS}])(?=[.,;:!?)])")

#: Distinct parts that a worker remembers before it starts afresh.
CACHE_PARTS = 1 << 19


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """Byte-level BPE writes bytes as printable letters: those that print as themselves, the rest from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(rest)}


class PartEncoder:
    """Encodes texts part by part and remembers the ids of parts seen before."""

    def __init__(self, path: str, keep: int = CACHE_PARTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.keep, self.letters = Tokenizer.from_file(path), keep, byte_letters()
        self._reset()

    def _reset(self) -> None:
        self.place: dict[str, int] = {}
        self.length, self.start = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used = np.zeros(4096, np.uint32), 0

    def _ids(self, parts: list[str]) -> list[list[int]]:
        """A part of letters alone is one pre-token, so the model takes it as it is."""
        model, out = self.tokenizer.model, [None] * len(parts)
        for n, part in enumerate(parts):
            if _WORD.fullmatch(part):
                out[n] = [t.id for t in model.tokenize(part.encode().decode("latin-1").translate(self.letters))]
        rest = [n for n, x in enumerate(out) if x is None]
        for n, e in zip(rest, self.tokenizer.encode_batch_fast([parts[n] for n in rest], add_special_tokens=False), strict=True):
            out[n] = e.ids
        return out

    def _add(self, parts: list[str]) -> None:
        for at in range(0, len(parts), 65536):
            some = parts[at : at + 65536]
            ids = self._ids(some)
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            first, total = len(self.place), int(n.sum())
            while first + len(some) > len(self.length):
                self.length, self.start = np.resize(self.length, 2 * len(self.length)), np.resize(self.start, 2 * len(self.start))
            while self.used + total > len(self.flat):
                self.flat = np.resize(self.flat, 2 * len(self.flat))
            self.length[first : first + len(some)] = n
            self.start[first : first + len(some)] = self.used + np.cumsum(n) - n
            self.flat[self.used : self.used + total] = np.fromiter((i for x in ids for i in x), np.uint32, total)
            self.used += total
            self.place.update(zip(some, range(first, first + len(some)), strict=True))

    def places(self, parts: list[str]) -> np.ndarray:
        """Where each part's ids are kept; parts may repeat."""
        new = list(dict.fromkeys(p for p in parts if p not in self.place))
        if new:
            self._add(new)
        return np.fromiter(map(self.place.__getitem__, parts), np.int64, len(parts))

    def _cut(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places of the parts of distinct pieces that a space precedes, and the offsets of each one's."""
        stems = pc.ascii_rtrim(pieces, characters=_ENDS)
        easy = pc.match_substring_regex(stems, _STEM).to_numpy(zero_copy_only=False)
        whole, short = pieces.to_numpy(zero_copy_only=False), stems.to_numpy(zero_copy_only=False)
        parts: list[str] = []
        n = np.empty(len(whole), np.int64)
        for k, (piece, stem, plain_word) in enumerate(zip(whole, short, easy, strict=True)):
            if plain_word:
                parts.append(" " + stem)
                n[k] = 1
                if len(stem) < len(piece):
                    parts.append(piece[len(stem) :])
                    n[k] = 2
            else:
                found = _LINES.split(" " + piece)
                parts += found
                n[k] = len(found)
        return self.places(parts), np.concatenate([[0], np.cumsum(n)])

    def parts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places of all parts of all texts in order, and the offsets of each text's parts."""
        if len(self.place) > self.keep:
            self._reset()
        texts = plain(texts)
        tight = pc.match_substring_regex(texts, _TIGHT).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.if_else(pa.array(tight), "", texts), " ")
        pieces, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        encoded = pieces.dictionary_encode()
        index, distinct = encoded.indices.to_numpy().astype(np.int64), encoded.dictionary
        known, bounds = self._cut(distinct)
        # The first piece of a text has no space before it; it stands after the others' parts.
        heads = offsets[:-1]
        head_cuts = [_LINES.split(p) for p in distinct.take(pa.array(index[heads])).to_pylist()]
        head_places = self.places([x for p in head_cuts for x in p])
        bounds = np.concatenate([bounds, bounds[-1] + np.cumsum([len(p) for p in head_cuts], dtype=np.int64)])
        known = np.concatenate([known, head_places])
        index[heads] = len(distinct) + np.arange(len(heads))
        n = bounds[index + 1] - bounds[index]
        total = np.concatenate([[0], np.cumsum(n)])
        at = known[np.repeat(bounds[index] - total[:-1], n) + np.arange(total[-1])]
        offsets = total[offsets]
        if not tight.any():
            return at, offsets
        own = {int(r): self.places(_SAFE.split(texts[int(r)].as_py())) for r in np.flatnonzero(tight)}
        rows = [own[r] if r in own else at[offsets[r] : offsets[r + 1]] for r in range(len(texts))]
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])])

    def counts(self, texts: pa.Array) -> np.ndarray:
        at, offsets = self.parts(texts)
        total = np.concatenate([[0], np.cumsum(self.length[at])])
        return total[offsets[1:]] - total[offsets[:-1]]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids as one array, and the offsets of each text's ids."""
        at, offsets = self.parts(texts)
        n = self.length[at]
        total = np.concatenate([[0], np.cumsum(n)])
        where = np.repeat(self.start[at] - total[:-1], n) + np.arange(total[-1])
        return self.flat[where], total[offsets]


_encoders: dict[str, PartEncoder] = {}


def encoder(path: str) -> PartEncoder:
    if path not in _encoders:
        _encoders[path] = PartEncoder(path)
    return _encoders[path]


def token_counts(docs: DataFrame, text: str = "text", tokenizer: str | None = None, limit: int = 512) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (more than limit tokens) added.

    Only lengths come back from the Arrow function. A null text counts as an
    empty one: no bytes, no tokens. Columns of these names are replaced; rows
    are neither merged nor dropped, whatever repeats. No shuffle.
    """
    bounded_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(path)
        for texts in batches:
            texts = plain(texts)
            steps = [own.counts(texts.slice(a, b - a)) for a, b in text_slices(texts)]
            yield pa.array(np.concatenate(steps) if steps else np.zeros(0, np.int64), pa.int64())
        give_back()

    return (
        docs.withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
        .withColumn("n_tokens", count(F.col(text)))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
