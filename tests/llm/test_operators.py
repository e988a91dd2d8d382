"""Each operator against a brute-force version, with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clonespark.llm import chat, embeddings, language, minhash, mixing, packing, pfor, ppm, tokens, topk
from clonespark.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "the quick brown fox jumps over the lazy dog. " * 4000
TEXTS = [
    (1, "the cat sat on the mat and the dog lay by the door of the old house", "en", "a"),
    (2, "the cat sat on the mat and the dog lay by the door of the old house", "en", "a"),
    (3, "THE cat sat on the mat and the dog lay by the door of the old barn", "en", None),
    (4, None, "en", "b"),
    (5, "", None, "b"),
    (6, " \n\t ", "de", "c"),
    (7, "one", "de", "a"),
    (8, "one", "de", "z"),
    (9, LONG, "en", "z"),
    (10, "x  y\n\n z <|endoftext|> é　w \x85 12 don't 日本 語", "fr", "z"),
    (10, "a repeated id with another text", "fr", "z"),
    (10, "a repeated id with another text", "fr", "z"),
    (None, "no id at all here", "de", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def docs_of(spark, rows=TEXTS):
    clash = ["row", "key", "id", "n", "size", "taken", "score", "lang_pred", "component", "bucket", "rank", "known"]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokens.default_tokenizer())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, np.uint32).tobytes())


def test_token_counts(spark, tokenizer):
    got = tokens.token_counts(docs_of(spark), limit=20).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    want = [(d, len((t or "").encode()), n := len(ids_of(tokenizer, t)), n > 20) for d, t, *_ in TEXTS]
    assert Counter(map(tuple, got)) == Counter(want)
    assert tokens.token_counts(docs_of(spark, [])).count() == 0


def test_token_files(spark, tokenizer):
    files = pfor.write_token_files(docs_of(spark), file_bytes=50_000)
    got = sorted(map(tuple, pfor.read_token_files(files).collect()), key=lambda r: r[1])
    start, want = 0, []
    hashes = {r.t: r.h for r in docs_of(spark).select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    for d, t, *_ in sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1] or ""])):
        ids = [*ids_of(tokenizer, t), 2]
        want.append((d, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want
    everything = [i for d, t, *_ in sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1] or ""])) for i in [*ids_of(tokenizer, t), 2]]
    for a, b in ((0, len(everything)), (5, 6), (700, 12_345), (start - 3, start + 10), (9, 9), (start, start + 1)):
        parts = sorted(pfor.read_ids(files, a, b).collect())
        assert [i for r in parts for i in r.ids] == everything[a:b] and all(r.start >= a for r in parts)
    assert pfor.read_ids(pfor.write_token_files(docs_of(spark, [])), 0, 5).count() == 0
    assert pfor.read_token_files(pfor.write_token_files(docs_of(spark, []))).count() == 0


def test_copies_of_one_row_are_dealt_over_tasks(spark):
    """A third of all rows is one row; no partition of files, no bucket and no part of the mix holds them all."""
    rows = [(7, "the same text again and again", "en", "a")] * 4000 + [(k, f"text number {k}", "en", "b") for k in range(8000)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(8)
    files = pfor.write_token_files(table)
    docs = [r.n for r in files.groupBy("file_part").agg(F.sum("n_docs").alias("n")).collect()]
    assert sum(docs) == len(rows) and max(docs) < 4000
    packed = packing.pack_documents(table, bucket_rows=500)
    assert packed.count() == len(rows) and packed.groupBy("sequence_id", "offset").count().filter("count > 1").count() == 0
    taken = mixing.taken_words(*mixing.mix_sources(table)).collect()
    assert len(taken) == len(rows) and sum(r.taken for r in taken if r.doc_id == 7) >= 4000
    classes = mixing.measured(table, "doc_id", "text", "source")
    assert classes.filter("n > 1").count() == 1
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    dealt = mixing.copies(classes.filter("n > 1")).withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(dealt) > 1 and sum(r["count"] for r in dealt) == 4000
    found = minhash.near_duplicates(table.filter("source = 'a' or doc_id < 50"))
    assert found.count() == 4050 and found.filter("kept").select("doc_id").distinct().count() == 50


def test_packing(spark, tokenizer):
    rows = packing.pack_documents(docs_of(spark)).collect()
    pieces = Counter()
    for d, t, *_ in TEXTS:
        ids = [*ids_of(tokenizer, t), 0]
        for s in range(0, len(ids), 1024):
            pieces[(d, s, len(ids[s : s + 1024]), crc(ids[s : s + 1024]), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == pieces
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in group:
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert packing.pack_documents(docs_of(spark, [])).count() == 0


def test_packing_plan_uses_each_piece_once():
    rng = np.random.default_rng(3)
    for n in (0, 1, 40, 20_000):
        histogram = np.bincount(rng.integers(1, 1025, n), minlength=1025)
        used, padding, total = np.zeros(1025, int), 0, 0
        for lengths, times in packing.plan(histogram):
            size = sum(lengths)
            assert size <= 1024
            for v in lengths:
                used[v] += times
            padding += 0 if size & (size - 1) == 0 else times * (1024 - size)
            total += times * size
        assert (used == histogram).all()
        assert n < 20_000 or padding < 0.03 * total


def test_chat(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "user", "hi <|end|> <\\|x|>"), (1, 2, "user", None), (1, 3, "assistant", "</s>[INST] ok [/INST]"), (1, 4, "assistant", "[\\INST] \\"), (1, 100, "user", "bye"), (1, 101, "assistant", "<|turn|>é"),
        (2, 5, "assistant", ""), (2, 5, "assistant", ""), (2, None, "user", "first"), (3, 0, None, "x"), (None, 0, "user", "y"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ts", F.lit(1)).repartition(3)
    formatted = chat.format_conversations(turns)
    got = {r.conv_id: r for r in chat.chat_digest(formatted).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or ""))
        text = "".join(f"{role or ''}\n{t or ''}\n" for _, role, t in own)
        loss = "".join(t or "" for _, role, t in own if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(text.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    whole = {r.conv_id: r.formatted for r in formatted.collect()}
    assert whole[1].count("<|message|>") == 5 and "[INST]" not in whole[1]  # adjacent turns are merged
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_embedding_duplicates(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 16))
    rows = [(i, [float(x) for x in base[i % 12] + rng.normal(scale=(0.02, 0.1, 0.3)[i % 3], size=16)]) for i in range(400)]
    rows += [(400 + k, rows[0][1]) for k in range(5)] + [(500, None), (501, [0.0] * 16), (502, [float("nan")] * 16), (503, [None] + [1.0] * 15), (504, []), (505, [1.0, 2.0]), (505, [1.0, 2.0]), (None, rows[1][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("bucket", F.lit(1)).repartition(4)
    got = sorted(map(tuple, embeddings.near_duplicate_vectors(table).collect()), key=str)
    v = [(i, np.array([np.float32(x) for x in e], float)) if e and all(x is not None for x in e) and np.isfinite(e).all() and any(e) else (i, None) for i, e in rows]
    links = {k: [] for k in range(len(v))}
    for a, b in itertools.combinations(range(len(v)), 2):
        x, y = v[a][1], v[b][1]
        if x is not None and y is not None and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.95:
            links[a].append(b)
            links[b].append(a)
    want = []
    for k in range(len(v)):
        seen, front = {k}, [k]
        while front:
            new = set(links[front.pop()]) - seen
            seen |= new
            front += new
        least = min((v[s][0] for s in seen if v[s][0] is not None), default=None)
        want.append((v[k][0], len(links[k]), least, v[k][0] == least))
    wrong = sum(a != b for a, b in zip(got, sorted(want, key=str), strict=True))
    assert sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in want) and wrong <= 8
    assert embeddings.near_duplicate_vectors(table.limit(0)).count() == 0


def test_blocks_of_a_large_bucket_agree(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in np.ones(8) + rng.normal(scale=0.2, size=8)]) for i in range(300)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, embeddings.near_duplicate_vectors(table).collect()))
    monkeypatch.setattr(embeddings, "BLOCK", 32)
    assert sorted(map(tuple, embeddings.near_duplicate_vectors(table).collect())) == whole


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = language.remainder("doc_id", 4) == 2
    model = language.train(docs.filter(~held))
    found = language.identify(docs, model).filter(held & F.col("lang").isNotNull())
    assert found.filter("lang = lang_pred").count() >= 0.95 * found.count()
    odd = {r.text: (r.lang_pred, r.score) for r in language.identify(docs_of(spark), model).collect()}
    assert odd[None] == odd[""] == odd[" \n\t "] == ("und", 0.0)
    assert odd["one"][0] in model.languages and all(0 <= s <= 1 for _, s in odd.values())
    assert language.identify(docs.limit(0), model).count() == 0
    nothing = language.train(docs.limit(0))
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}
    cut = language.train(docs.filter(~held), docs_per_language=20)
    assert language.identify(docs, cut).filter("lang = lang_pred").count() >= 0.9 * docs.count()


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(8)
    scale = np.concatenate([[3.0, 2.0], np.full(10, 0.02)])
    rows = [(i, [float(x) for x in rng.normal(size=12) * (scale if i < 200 else 0.2)]) for i in range(500)]
    rows += [(600, None), (601, [float("inf")] * 12), (602, [None] * 12), (620, [0.0] * 12), (40, rows[3][1]), (None, rows[0][1]), (604, [1.0, 2.0]), (7, rows[7][1]), (7, rows[7][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).repartition(3)
    usable = [(i, np.pad(np.floor(64 * np.array(e)), (0, 12 - len(e))).astype(int)) for i, e in rows if e and all(x is not None for x in e) and np.isfinite(e).all()]
    want = Counter()
    for n, (i, q) in enumerate(usable):
        if i is not None and i % 20 == 0:
            best = sorted((-int(q @ v), j is None, j or 0) for m, (j, v) in enumerate(usable) if m != n)[:7]
            want.update((i, r, None if none else j, -s) for r, (s, none, j) in enumerate(best, 1))
    for rows_a_block in (topk.ROWS, 60):
        monkeypatch.setattr(topk, "ROWS", rows_a_block)
        assert Counter(map(tuple, topk.exact_top_k(table, "vec_id % 20 = 0", k=7).collect())) == want
    assert topk.exact_top_k(table.limit(0), "vec_id % 20 = 0").count() == 0


def test_threshold_search_stops_early_and_reads_on():
    rng = np.random.default_rng(9)
    few = np.zeros((5000, 6), np.int64)
    few[:, 0], few[:, 1] = rng.integers(-1000, 1000, 5000), rng.integers(-3, 3, 5000)
    zero = np.zeros((300, 4), np.int64)
    for c, share in ((few, 0.4), (rng.integers(-30, 30, (5000, 6)), 0.8), (np.full((50, 2), 1 << 40), 1), (zero, 0.2), (np.abs(few), 0.1)):
        lists = topk.Lists(c, int(np.abs(c).max()))
        scored = []
        for r in range(20):
            at, score, n = lists.search(c[r], r, 10)
            own = sorted((-sum(int(x) * int(y) for x, y in zip(c[r], v, strict=True)), i) for i, v in enumerate(c) if i != r)[:10]
            assert [(-int(s), int(a)) for a, s in zip(at, score, strict=True)] == own
            scored.append(n)
            # A floor from elsewhere loses nothing that reaches it, and reads no more.
            floor = -own[4][0]
            at, score, less = lists.search(c[r], r, 10, floor)
            assert less <= n and {(-int(s), int(a)) for a, s in zip(at, score, strict=True)} >= {x for x in own if -x[0] >= floor}
        assert np.mean(scored) <= share * len(c)
    assert topk.Lists(few, 1000).search(few[0], -1, 3, 10**9)[2] == 0  # the heads of the lists are below the floor


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 2]) for k in range(max(1, len(w) - 1))} if w else set()


def brute_duplicates(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            parent[top(a)] = top(b)
    out = []
    for k, (d, _) in enumerate(rows):
        least = min((rows[j][0] for j in range(len(rows)) if top(j) == top(k) and rows[j][0] is not None), default=None)
        out.append((d, len(sets[k]), least, d == least))
    return Counter(out)


def test_near_duplicates(spark):
    got = minhash.near_duplicates(docs_of(spark)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute_duplicates([r[:2] for r in TEXTS])
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = minhash.near_duplicates(docs)
    want = brute_duplicates([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()) == want
    assert got.filter("first").count() == got.filter("n_shingles > 0").select("component_id").distinct().count() + got.filter("n_shingles = 0").count()
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_near_copies_in_blocks(spark, monkeypatch):
    """A chain of edits: neighbours are near copies, its ends are not."""
    rng = np.random.default_rng(11)
    words, rows = [f"w{k}" for k in range(80)], []
    for i in range(160):
        words[int(rng.integers(80))] = f"e{i}"
        rows.append((i, " ".join(words)))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_duplicates(rows)
    for block in (2048, 8):
        monkeypatch.setattr(minhash, "BLOCK", block)
        got = minhash.near_duplicates(table).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1200)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    label = {v: v for e in edges for v in e}
    for _ in range(300):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_mixing(spark):
    rows = [(i, " ".join(["w"] * (i * 7 % 50)), "en", f"s{i % 5}" if i % 5 else None) for i in range(600)] + [(i, "tiny text", "en", "zz") for i in range(600, 603)] + TEXTS
    table = docs_of(spark, rows)
    got = mixing.taken_words(*mixing.mix_sources(table, block=16)).collect()
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = dict(zip(names, itertools.cycle((5, 2, 1)), strict=False))
    total, target, open_ones = sum(sizes.values()), {}, set(names)
    left = total
    while open_ones:
        part = {s: left * weights[s] / sum(weights[x] for x in open_ones) for s in open_ones}
        full = {s for s in open_ones if part[s] > 3 * sizes[s]}
        target |= {s: 3 * sizes[s] for s in full} if full else part
        left -= sum(3 * sizes[s] for s in full)
        open_ones -= full or open_ones
    assert Counter(r.size for r in got) == Counter(len(WORD.findall(t or "")) for _, t, *_ in rows)
    assert all(r.taken <= 3 * r.size for r in got)
    by_target = Counter()
    for r in got:
        by_target[round(r.target, 6), r.source_size] += r.taken
    assert by_target == Counter({(round(t, 6), sizes[s]): min(round(t), 3 * sizes[s]) for s, t in target.items()})
    again = mixing.taken_words(*mixing.mix_sources(table.repartition(7), block=16)).collect()
    pick = lambda rows: sorted((str(r.doc_id), r.size, r.taken) for r in rows)
    assert pick(again) == pick(got)
    assert mixing.taken_words(*mixing.mix_sources(table.limit(0))).count() == 0


def test_schedule_is_even(spark):
    plan = [{"slots": 500}, {"slots": 300}, {"slots": 200}]
    slots = sorted(map(tuple, mixing.schedule(spark, plan).collect()))
    assert Counter(s for _, s, _ in slots) == {0: 500, 1: 300, 2: 200}
    first = Counter(s for n, s, _ in slots if n < 100)
    assert abs(first[0] - 50) <= 3 and abs(first[1] - 30) <= 3
    assert all([r for _, s, r in slots if s == k] == list(range(n)) for k, n in ((0, 500), (1, 300), (2, 200)))


def test_scores(spark):
    rows = TEXTS + [(20 + k, f"word{k % 7} the cat sat on w{k}", "en", "a") for k in range(60)]
    table = docs_of(spark, rows)
    training = table.filter("doc_id % 3 = 0")
    got = ppm.score_texts(table, training, common=5).collect()
    words = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    count = Counter(w for d, t, *_ in rows if d is not None and d % 3 == 0 for w in [*words(t), ""])
    n, v = sum(count.values()), len(count)
    want = Counter()
    for d, t, *_ in rows:
        ws = [*words(t), ""]
        want[d, len(ws), sum(w in count for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 6)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert ppm.score_texts(table.limit(0), training).count() == 0
    none = ppm.score_texts(table, table.limit(0)).filter("doc_id = 7").first()
    assert none.base_score == 0 and abs(none.score + 4 * math.log10(256) + math.log10(256)) < 1e-9


def test_intermediate_tables_can_be_released(spark):
    from clonespark.llm import common

    kept = common.materialize(spark.range(3), "probe")
    mark = common.written()
    more = [common.materialize(spark.range(n), "probe") for n in (1, 2)]
    assert common.release(spark, mark, keep=1) == 1 and more[1].count() == 2 and kept.count() == 3
    assert common.release(spark) >= 2 and common.release(spark) == 0
