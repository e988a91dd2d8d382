import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clonespark.functions import kernel
from clonespark.operators import distance as dst
from clonespark.operators import genes
from clonespark.operators.repertoire import Repertoire, build_repertoire, deduplicate_clones
from clonespark.plans import schema
from clonespark.streaming.joins import join_stream
from tests.test_kernel import random_sequences

LOOPS = [("synthetic", "A", f"A{g}", x) for g, x in enumerate(("ACD EF.", "ACE EFA", "WCD EYA"))] + [("synthetic", "B", f"B{g}", x) for g, x in enumerate(("KLM NPQ", "KLM NPR", "KL. SPQ"))]


@pytest.fixture(scope="module")
def clones(spark):
    a, b = random_sequences(60, 4, 9, 5), random_sequences(60, 4, 9, 6)
    rows = [(k, f"A{k % 3}", a[k % 20], f"B{k % 2}", b[k % 30], f"s{k % 4}") for k in range(60)]
    return spark.createDataFrame(rows, "clone_idx long, va string, cdr3a string, vb string, cdr3b string, subject string").cache()


@pytest.fixture(scope="module")
def v(spark):
    return genes.v_distances(spark.createDataFrame(LOOPS, "organism string, chain string, gene string, loops string")).cache()


def brute(clones, components=("va", "cdr3a", "vb", "cdr3b")):
    loops = {g: x for *_, g, x in LOOPS}
    rows = clones.collect()
    out = {}
    for p, q in itertools.product(rows, rows):
        d = 0.0
        for c in components:
            d += kernel.cdr3_distance(p[c], q[c]) if c.startswith("cdr3") else kernel.loop_distance(loops[p[c]], loops[q[c]])
        out[p.clone_idx, q.clone_idx] = d
    return out


def pairs(df):
    return {(r.i, r.j): r.dist for r in df.collect()}


def test_components():
    assert schema.resolve_components("beta") == ("vb", "cdr3b") and schema.resolve_components(["cdr3b", "va"]) == ("va", "cdr3b")
    for bad in ("gamma", ["va", "x"], []):
        with pytest.raises(ValueError):
            schema.resolve_components(bad)


def test_range_join(clones, v):
    want = brute(clones)
    for t in (0, 12, 60, 150, math.inf):
        assert pairs(dst.distance_sparse(clones, t, v_distances=v)) == {k: d for k, d in want.items() if d <= t and k[0] != k[1]}
    with pytest.raises(ValueError):
        dst.distance_sparse(clones, -1)


def test_components_add_up(clones, v):
    parts = [pairs(dst.distance_rect(clones, clones, [c], v)) for c in schema.COMPONENTS]
    whole = pairs(dst.distance_rect(clones, clones, "all", v))
    assert all(abs(sum(p[k] for p in parts) - d) < 1e-9 for k, d in whole.items()) and whole == brute(clones)


def test_matrix_diagonal(clones, v):
    whole, matrix = brute(clones), pairs(dst.distance_matrix(clones, v_distances=v))
    assert matrix == {k: 0.0 if k[0] == k[1] else d for k, d in whole.items()}
    assert any(whole[k, k] > 0 for k in range(60))  # short sequences cost their price against themselves


def test_blocks(clones, v, monkeypatch):
    monkeypatch.setattr(dst, "BLOCK", 7)
    want = brute(clones, ("cdr3b",))
    assert pairs(dst.distance_sparse(clones, 24, ["cdr3b"])) == {k: d for k, d in want.items() if d <= 24 and k[0] != k[1]}
    assert dst.knn(clones, 5, ["cdr3b"]).count() == 300


def test_neighbours(clones):
    want = brute(clones, ("cdr3b",))
    got = dst.knn(clones, 6, ["cdr3b"], agroup="va").collect()
    va = {r.clone_idx: r.va for r in clones.collect()}
    for i in range(60):
        own = sorted((1000.0 if j == i or va[j] == va[i] else want[i, j], j) for j in range(60))[:6]
        assert [(r.dist, r.j) for r in sorted(got, key=lambda r: r.rank) if r.i == i] == own
    near = pairs(dst.radius_neighbours(clones, 48, ["cdr3b"], agroup="va", bgroup="vb"))
    vb = {r.clone_idx: r.vb for r in clones.collect()}
    assert near == {(i, j): d for (i, j), d in want.items() if d <= 48 and va[i] != va[j] and vb[i] != vb[j]}
    for k in (0, 60):
        with pytest.raises(ValueError):
            dst.knn(clones, k, ["cdr3b"])


def test_unknown_gene(clones, v):
    with pytest.raises(Exception, match="unknown genes"):
        dst.distance_sparse(clones.withColumn("va", F.lit("A9")), 10, v_distances=v).count()
    with pytest.raises(ValueError, match="unknown genes"):
        schema.validate_chains(clones, ["A0", "A1", "B0", "B1"])
    with pytest.raises(ValueError, match="letters"):
        schema.validate_chains(clones.withColumn("cdr3a", F.lit("CAXF")))
    with pytest.raises(ValueError, match="null"):
        schema.validate_chains(clones.withColumn("vb", F.lit(None).cast("string")))


def test_single_chain(spark):
    beta = spark.createDataFrame([(0, "B0", "CASSIRSSYEQYF"), (1, "B0", "CASSIRSYEQYF")], "clone_idx long, vb string, cdr3b string")
    assert pairs(dst.distance_sparse(beta, 100, "cdr3")) == {(0, 1): 12.0, (1, 0): 12.0}
    with pytest.raises(ValueError, match="neither chain"):
        dst.distance_sparse(beta.drop("vb"), 100)


def test_missing_v_distances_and_wrong_rows_are_errors(spark, clones, tmp_path):
    beta = spark.createDataFrame([(0, "B0", "CASSIRSSYEQYF"), (1, "B0", "CASSIRSYEQYF")], "clone_idx long, vb string, cdr3b string")
    for call in (lambda: dst.distance_sparse(beta, 100), lambda: dst.knn(beta, 1), lambda: dst.distance_join(beta, beta, 10), lambda: dst.radius_neighbours(beta, 10, ["vb", "cdr3b"])):
        with pytest.raises(ValueError, match="V distances"):
            call()
    with pytest.raises(ValueError, match="V distances"):
        build_repertoire(clones, "human", compute_distances=True)
    with pytest.raises(ValueError, match="letters"):
        build_repertoire(clones.withColumn("cdr3b", F.lit("CAXF")), "human")
    with pytest.raises(ValueError, match="null"):
        build_repertoire(clones.withColumn("va", F.lit(None).cast("string")), "human", deduplicate=False)
    known = spark.createDataFrame([("human", "A", "A0", "A0", 0.0)], "organism string, chain string, g1 string, g2 string, vdist double")
    with pytest.raises(ValueError, match="unknown genes"):
        build_repertoire(clones, "human", v_distances=known)


def test_pairs_of_many_blocks(spark, monkeypatch):
    """Blocks so small that each length class takes several meet once each, and lose and repeat no pair."""
    rng = np.random.default_rng(4)
    rows = [(k, "B0", "CAS" + "".join(rng.choice(list("ACDEFGHIKL"), rng.integers(3, 9))) + "QYF") for k in range(300)]
    table = spark.createDataFrame(rows, "clone_idx long, vb string, cdr3b string")
    want = {(a, b): d for a in range(300) for b in range(a + 1, 300) if (d := kernel.cdr3_distance(rows[a][2], rows[b][2])) <= 40}
    for dealt, block in ((8192, 1024), (17, 5)):
        monkeypatch.setattr(dst, "DEALT", dealt)
        monkeypatch.setattr(dst, "BLOCK", block)
        got = dst.range_pairs(table, table, 40, dst.DistanceSpec(("cdr3b",)), same=True).collect()
        assert len(got) == len(want) and {(r.i, r.j): r.dist for r in got} == want
        other = dst.range_pairs(table.filter("clone_idx < 50"), table, 40, dst.DistanceSpec(("cdr3b",))).collect()
        assert len(other) == len({(r.i, r.j) for r in other}) and {(r.i, r.j): r.dist for r in other if r.i < r.j} == {k: v for k, v in want.items() if k[0] < 50}


def test_join(clones):
    left, right = clones.filter("clone_idx < 10"), clones.filter("clone_idx >= 5")
    want = brute(clones, ("cdr3b",))
    got = dst.distance_join(left, right, 40, 2, components=["cdr3b"])
    for i in range(10):
        own = sorted((want[i, j], j) for j in range(5, 60) if want[i, j] <= 40)[:2]
        assert [(r.distance, r.clone_idx_y) for r in got.filter(F.col("clone_idx_x") == i).orderBy("distance", "clone_idx_y").collect()] == own
    outer = dst.distance_join(left, right.filter("clone_idx = 59"), 0, 2, "left", components=["cdr3b"])
    assert outer.select("clone_idx_x").distinct().count() == 10
    assert dst.distance_join(left, right.limit(0), 40, 2, "left", components=["cdr3b"]).count() == 0
    with pytest.raises(ValueError):
        dst.distance_join(left, right, 40, how="outer")


def test_strict_matches(clones, spark):
    queries = clones.filter("clone_idx < 3").select("cdr3a", "cdr3b").union(spark.createDataFrame([(None, "x")], "cdr3a string, cdr3b string"))
    database = clones.select("clone_idx", "cdr3a", "cdr3b").union(spark.createDataFrame([(99, None, None)], "clone_idx long, cdr3a string, cdr3b string"))
    a, b = dst.strict_matches(queries, database)
    assert {r.clone_idx for r in a.collect()} == {99} | {k for k in range(60) if k % 20 < 3}
    assert {r.clone_idx for r in b.collect()} == {k for k in range(60) if k % 30 < 3}


def test_groups(clones):
    got = dst.tcr_groups(clones.withColumn("ja", F.lit("J")).withColumn("jb", F.lit("J"))).collect()
    rows = {r.clone_idx: r for r in clones.collect()}
    for chain, group in (("a", "agroup"), ("b", "bgroup")):
        key = {i: (r[f"v{chain}"], "J", r[f"cdr3{chain}"]) for i, r in rows.items()}
        rank = {k: n for n, k in enumerate(sorted(set(key.values())))}
        assert {r.i: r[group] for r in got} == {i: rank[k] for i, k in key.items()}


def test_dedup(spark):
    rows = [("a", 2, "x", 1), ("a", 3, "y", 0), ("b", 1, "z", 2), (None, 9, "n", 3)]
    df = spark.createDataFrame(rows, "k string, count long, extra string, clone_id long")
    got = {r.k: (r["count"], r.extra) for r in deduplicate_clones(df, ["k"], ["clone_id"]).collect()}
    assert got == {"a": (5, "y"), "b": (1, "z")}
    plain = df.filter("k = 'b'").drop("count")
    assert deduplicate_clones(plain, ["k"]).columns == plain.columns


def test_repertoire(clones, v):
    rep = build_repertoire(clones, "synthetic", deduplicate=False, compute_distances=True, v_distances=v)
    some = rep.take([3, 0, 3])
    assert some.clones.count() == 3 and pairs(some.edges)[1, 0] == brute(clones)[0, 3]
    few = rep.subset("va = 'A1'")
    assert few.clones.count() == 20 and few.edges.count() == 400 and few.clones.agg(F.max("clone_idx")).first()[0] == 19
    assert "synthetic" in repr(rep)
    with pytest.raises(IndexError):
        rep.take([60])
    for bad in ({"chains": "X"}, {"metric": "x"}, {"weights": {"cdr3": 3}}, {"organism": ""}):
        with pytest.raises(ValueError):
            Repertoire(**({"clones": clones, "organism": "synthetic"} | bad))
    ham = build_repertoire(clones.drop("va", "cdr3a"), "synthetic", "B", "hamming", deduplicate=False, compute_distances=True)
    assert ham.edges.count() == 3600


def test_index(spark):
    df = spark.range(500).selectExpr("id * 7919 % 500 as x")
    got = schema.with_index(df, ["x"]).collect()
    assert all(r.x == r.clone_idx for r in got) and len(got) == 500


def test_stream(spark, clones, tmp_path):
    clones.select("clone_idx", "vb", "cdr3b").repartition(2).write.parquet(str(tmp_path / "in"))
    found = []
    stream = spark.readStream.schema("clone_idx long, vb string, cdr3b string").parquet(str(tmp_path / "in"))
    query = join_stream(stream, clones.select("clone_idx", "vb", "cdr3b"), 0, lambda df, n: found.extend(df.collect()), str(tmp_path / "cp"), components=["cdr3b"], max_n=100)
    query.awaitTermination(120)
    assert query.exception() is None
    want = {k for k, d in brute(clones, ("cdr3b",)).items() if d <= 0}
    assert {(r.clone_idx_x, r.clone_idx_y) for r in found} == want
