import importlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clonespark.llm import mixing
from tests.llm.test_operators import SCHEMA, TEXTS, WORD, brute_duplicates

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    spoken = pipeline.language_stage(spark, docs, sf).cache()
    assert spoken.columns == docs.columns and spoken.count() >= 0.95 * docs.count()
    kept = pipeline.duplicates_stage(spark, spoken, sf).cache()
    want = sorted(r[0] for r in brute_duplicates([tuple(r) for r in spoken.select("doc_id", "text").collect()]) if r[3])
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == want
    mixed = pipeline.mixing_stage(spark, kept, sf).cache()
    assert mixed.columns == docs.columns and 0 < mixed.count()
    taken = mixing.taken_words(*mixing.mix_sources(kept)).collect()
    rows = mixed.select("doc_id", "text", "n_chars").collect()
    size = lambda t: len(WORD.findall(t))
    assert all(r.n_chars == len(r.text) for r in rows)
    got = Counter()
    for r in rows:
        got[r.doc_id] += size(r.text)
    assert got == Counter({r.doc_id: r.taken for r in taken if r.taken})
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert all(texts[r.doc_id].startswith(r.text) for r in rows)
    packed = pipeline.packing_stage(spark, mixed, sf)
    tokens = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert tokens.filter("n > 1024 or n <> end").count() == 0
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in mixed.select("doc_id").distinct().collect()}


def test_odd_rows(spark):
    docs = spark.createDataFrame(TEXTS, SCHEMA).withColumns({c: F.lit("clash") for c in ("score", "known", "times", "key", "kept_key", "copy")})
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
    kept = pipeline.duplicates_stage(spark, docs, "").collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(["1", "4", "5", "6", "7", "9", "10", "10", "None"])
    empty = docs.limit(0)
    assert all(stage(spark, empty, "").count() == 0 for _, stage in pipeline.STAGES)


def test_registered():
    entry = importlib.import_module("__spark_entry__")
    names = list(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
