"""Texts longer than any step of the kernels, language sets against plain ones, planted links and odd ids."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clonespark.llm import chat, common, embeddings, language, minhash, mixing, packing, pfor, ppm, tokens
from clonespark.llm.components import connected_components

WORDS = "the quick brown fox jumps over the lazy dog while rain falls on plain fields".split()


@pytest.fixture(scope="module")
def long_text():
    """More than 8 MB, with no repeated line and a word that stands across each place where steps end."""
    lines = [f"{' '.join(WORDS[k % 7 :])} {k:x}" for k in range(200_000)]
    text = "\n".join(lines)
    assert len(text) > common.STEP_BYTES + (1 << 20)
    return text


@pytest.fixture(scope="module")
def docs(spark, long_text):
    return spark.createDataFrame([(1, long_text, "en", "a"), (2, "a short one", "en", "b"), (3, None, None, None)], "doc_id long, text string, lang string, source string")


def test_long_texts_are_tokenized_whole(docs, long_text):
    ids = Tokenizer.from_file(tokens.default_tokenizer()).encode(long_text, add_special_tokens=False).ids
    assert tokens.token_counts(docs).filter("doc_id = 1").first().n_tokens == len(ids)
    files = pfor.write_token_files(docs)
    assert {r.doc_id: r.n_tokens for r in pfor.read_token_files(files).collect()}[1] == len(ids) + 1
    first = 1_000_001
    start = {r.doc_id: r.start for r in pfor.read_token_files(files).collect()}[1]
    assert [i for r in pfor.read_ids(files, start + first, start + first + 700).collect() for i in r.ids] == ids[first : first + 700]
    pieces = packing.pack_documents(docs).filter("doc_id = 1").agg(F.sum("length"), F.count("*"), F.max("start")).first()
    n = len(ids) + 1
    assert tuple(pieces) == (n, -(-n // 1024), (n - 1) // 1024 * 1024)


def test_long_texts_are_read_whole(spark, docs, long_text):
    words = long_text.split()
    held = minhash.near_duplicates(docs).filter("doc_id = 1").first()
    assert held.n_shingles == len(set(itertools.pairwise(words)))
    assert mixing.measured(docs, "doc_id", "text", "source").filter("doc_id = 1").first()["size"] == len(words)
    scored = ppm.score_texts(docs, docs.filter("doc_id = 2")).filter("doc_id = 1").first()
    assert scored.n_tokens == len(words) + 1 and scored.score < 0
    model = language.train(spark.createDataFrame([(k, " ".join(WORDS), "en") for k in range(4)], "doc_id long, text string, lang string"))
    assert language.identify(docs, model).filter("doc_id = 1").first().lang_pred == "en"
    turns = docs.filter("doc_id = 1").select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("assistant").alias("role"), "text")
    r = chat.chat_digest(chat.format_conversations(turns)).first()
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (1, len(long_text), hashlib.sha256(long_text.encode()).hexdigest())


def plain_grams(text):
    lower = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text)
    s = re.sub(" +", " ", f" {lower} ")
    return [s[k : k + n] for n in language.SIZES for k in range(len(s) - n + 1)]


def test_language_sets_against_plain_ones(spark):
    """Sets of n-grams without hashes or filters, and counts of hits, give the same languages and nearly the same scores."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    learnt = table.filter(language.remainder("doc_id", 4) != 2)
    counts = defaultdict(Counter)
    for r in learnt.filter("lang is not null and text is not null").collect():
        counts[r.lang].update(plain_grams(r.text))
    rate = {l: {g: n / c.total() for g, n in c.items()} for l, c in counts.items()}
    most = Counter()
    for rates in rate.values():
        for g, x in rates.items():
            most[g] = max(most[g], x)
    sets = {l: {g for g, n in c.items() if n >= 2 and rate[l][g] >= 0.2 * most[g]} for l, c in counts.items()}
    model = language.train(learnt)
    assert model.languages == sorted(sets)
    for r in language.identify(table, model).collect():
        grams = plain_grams(r.text or "")
        hits = {l: sum(g in s for g in grams) for l, s in sets.items()}
        if not any(c.isalpha() for c in r.text or ""):
            assert r.lang_pred == "und"
            continue
        best, total = max(hits.values()), sum(hits.values())
        assert hits[r.lang_pred] >= best - 0.02 * len(grams)
        assert abs(r.score - hits[r.lang_pred] / max(1, total)) < 0.05 and abs(r.known - hits[r.lang_pred] / len(grams)) < 0.03


def test_planted_links_are_found(spark):
    """1,000 pairs from 0.95 to 0.97 and from 0.93 to 0.95 among 4,000 others."""
    rng = np.random.default_rng(12)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    base = unit(rng.normal(size=(6000, 48)))
    aside = rng.normal(size=(2000, 48))
    aside = unit(aside - (aside * base[:2000]).sum(axis=1, keepdims=True) * base[:2000])
    cosine = np.where(np.arange(2000) < 1000, rng.uniform(0.9501, 0.97, 2000), rng.uniform(0.93, 0.9499, 2000))[:, None]
    base[4000:] = cosine * base[:2000] + np.sqrt(1 - cosine**2) * aside
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(base)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embeddings.near_duplicate_vectors(table).collect()}
    found = sum(got[4000 + k].component_id == k and got[k].n_links == 1 for k in range(1000))
    assert found >= 995
    assert all(got[i].n_links == 0 and got[i].kept for i in (*range(1000, 4000), *range(5000, 6000)))


def test_null_ids_of_vectors(spark):
    rows = [(None, [1.0, 0.0]), (None, [1.0, 0.01]), (5, [0.0, 1.0]), (4, [0.01, 1.0]), (None, [-1.0, 0.0])]
    got = embeddings.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert Counter(map(tuple, got)) == Counter([(None, 1, None, True), (None, 1, None, True), (5, 1, 4, False), (4, 1, 4, True), (None, 0, None, True)])


def test_components_of_loops_and_of_nothing(spark):
    edges = spark.createDataFrame([(3, 3), (1, 2), (2, 1), (1, 2)], "a long, b long")
    assert sorted(map(tuple, connected_components(edges).collect())) == [(1, 1), (2, 1), (3, 3)]
    assert connected_components(edges.limit(0)).count() == 0


def test_scores_do_not_depend_on_the_cache(spark):
    """With no room for frequent grams and words all are joined, and nothing changes."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id < 60")
    training = table.filter("doc_id % 3 > 0")
    want = {r.doc_id: (r.n_known, r.base_score, r.score) for r in ppm.score_texts(table, training).collect()}
    for nodes, common_words in ((1, 1), (500, 20)):
        got = {r.doc_id: (r.n_known, r.base_score, r.score) for r in ppm.score_texts(table, training, nodes=nodes, common=common_words).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-9) for k in want)


def test_scores_depend_on_the_order_of_words(spark):
    """Contexts reach into the word before: shuffled words score lower than those of a learned text."""
    rows = [(k, " ".join(WORDS)) for k in range(30)] + [(100, " ".join(WORDS)), (101, " ".join(sorted(WORDS)))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in ppm.score_texts(table, table.filter("doc_id < 100")).collect()}
    assert abs(got[100].base_score - got[101].base_score) < 1e-9 and got[100].score > got[101].score + 1
