"""The whole trie, whatever goes to the workers as a cache."""

import random
from collections import Counter, defaultdict

from clonespark.llm import ppm
from tests.llm.test_ppm import brute_log10


def texts(spark, n, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 12)))) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None), (n + 1, "zz zz qq")], "doc_id long, text string")


def test_score_does_not_depend_on_the_cache(spark):
    docs, training = texts(spark, 40, 1), texts(spark, 60, 2).filter("doc_id < 60")
    whole = {r.doc_id: r.score for r in ppm.score_texts(docs, training).collect()}
    for nodes in (0, 20):
        for r in ppm.score_texts(docs, training, nodes=nodes).collect():
            assert abs(r.score - whole[r.doc_id]) < 1e-9, (nodes, r.doc_id)


def test_contexts_reach_into_the_word_before(spark):
    rows = [(0, "ab cd ab cd ef"), (1, "cd ab ef"), (2, "xé ab"), (3, "ab"), (4, None), (5, "AB  cd\nef g")]
    asked = [*rows, (6, "ab cd ef"), (7, "ef cd ab"), (8, "zz ab qé cd")]
    stream = lambda t: b"\n" * (ppm.ORDER - 1) + "".join(f" {w}" for w in [*(t or "").lower().split(), ""]).encode() + b"\n"
    seen = defaultdict(Counter)
    for _, t in rows:
        line = stream(t)
        for p in range(ppm.ORDER, len(line)):
            for k in range(ppm.ORDER + 1):
                seen[line[p - k : p]][line[p]] += 1
    schema = "doc_id long, text string"
    for nodes in (0, ppm.NODES):
        got = {r.doc_id: r.score for r in ppm.score_texts(spark.createDataFrame(asked, schema), spark.createDataFrame(rows, schema), nodes=nodes).collect()}
        for d, t in asked:
            line = stream(t)
            assert abs(got[d] - sum(brute_log10(seen, line[:p], line[p], ppm.ORDER) for p in range(ppm.ORDER, len(line)))) < 1e-9, d
        assert abs(got[6] - got[7]) > 0.01  # the same words in another order
