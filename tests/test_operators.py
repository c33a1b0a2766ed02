"""Operators against brute force, and their edge cases."""

import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tessera.functions import vectors
from tessera.operators import catalog, differences, fusion, ingest, lexical, metrics, semantic


def bm25_by_hand(docs, terms):
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    out = {}
    for t in terms:
        tf = {i: sum(d[k : k + len(t)] == t for k in range(len(d))) for i, d in docs.items()}
        df = sum(v > 0 for v in tf.values())
        idf = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)
        for i, f in tf.items():
            if f:
                out[i] = out.get(i, 0) + idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(docs[i]) / avg))
    return out


def test_bm25_with_phrases(spark):
    rng = random.Random(1)
    docs = {i: rng.choices(["red", "green", "blue", "dark", "light", "sky"], k=rng.randint(1, 30)) for i in range(60)}
    p = spark.createDataFrame([(i, " ".join(d)) for i, d in docs.items()] + [(99, None), (98, "")], "chunk_id long, text string")
    q = spark.createDataFrame([(1, "dark-blue sky"), (2, "--- red"), (3, "nothing"), (4, None), (5, "red red RED")], "qid long, text string")
    got = {(r.qid, r.chunk_id): r.score for r in lexical.bm25_texts(p, q).collect()}
    docs[98] = []
    for qid, terms in ((1, [["dark", "blue"], ["sky"]]), (2, [["red"]]), (5, [["red"], ["red"]])):
        want = bm25_by_hand(docs, terms)
        assert {k[1]: pytest.approx(v, abs=1e-9) for k, v in got.items() if k[0] == qid} == want
    assert not [k for k in got if k[0] in (3, 4)]
    strict = {(r.qid, r.chunk_id) for r in lexical.bm25_texts(p, q, require_all=True).collect()}
    assert not [k for k in strict if k[0] == 2], "a term without tokens can't be met"
    assert {k[1] for k in strict if k[0] == 1} == {i for i, d in docs.items() if "sky" in d and any(d[k : k + 2] == ["dark", "blue"] for k in range(len(d)))}


def test_bm25_of_nothing(spark):
    p, q = spark.createDataFrame([], "chunk_id long, text string"), spark.createDataFrame([(1, "a")], "qid long, text string")
    assert lexical.bm25_texts(p, q).count() == 0


def test_best_of_files_ties(spark):
    hits = spark.createDataFrame([(1, c, s) for c, s in ((5, 1.0), (4, 1.0), (3, 0.5), (7, 1.0), (8, 9.0), (9, 1.0))], "qid long, chunk_id long, score double")
    p = spark.createDataFrame([(3, 1), (4, 1), (5, 1), (7, 2), (8, 3), (9, None)], "chunk_id long, file_id long")
    f = spark.createDataFrame([(1, "/b"), (2, "/a"), (3, "/x/build/c")], "file_id long, path string").withColumns({"kind": F.lit("text"), "mtime": F.lit(1.0), "mime": F.lit("m")})
    assert rows(lexical.best_of_files(hits, p, f, 10), "path", "chunk_id", "rk") == [("/a", 7, 1), ("/b", 4, 2)]
    assert rows(lexical.best_of_files(hits, p, f, 1), "path") == [("/a",)]


def test_one_long_document_leaves_room_for_others(spark):
    hits = spark.range(1001).select(F.lit(1).alias("qid"), F.col("id").alias("chunk_id"), (F.lit(5000.0) - F.col("id")).alias("score"))
    p = spark.range(1001).select(F.col("id").alias("chunk_id"), F.when(F.col("id") < 1000, 1).otherwise(2).cast("long").alias("file_id"))
    f = spark.createDataFrame([(1, "/a"), (2, "/b")], "file_id long, path string").withColumns({"kind": F.lit("text"), "mtime": F.lit(1.0), "mime": F.lit("m")})
    assert rows(lexical.best_of_files(hits, p, f, 2), "path") == [("/a",), ("/b",)]


def test_cosine_scan_against_numpy(spark):
    rng = np.random.default_rng(2)
    m, q = rng.normal(size=(300, 8)), rng.normal(size=(3, 8))
    m[7], m[8] = 0, m[9]
    data = spark.createDataFrame([(i, i % 20, v.tolist()) for i, v in enumerate(m)], "chunk_id long, file_id long, v array<double>").repartition(5)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid long, q array<double>")
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    cos = np.round(unit(q) @ unit(m).T, 6)
    want = {(i, int(c)) for i in range(3) for c in sorted(range(300), key=lambda c: (-cos[i, c], c))[:5]}
    assert {(r.qid, r.chunk_id) for r in semantic.top_passages(semantic.cosine_scan(data, queries, dim=8, keep=5), 5).collect()} == want
    best = semantic.cosine_scan(data, queries, dim=8, keep=3, group="file_id").join(data.select("chunk_id", "file_id"), "chunk_id").groupBy("qid", "file_id").agg(F.max("score").alias("s"))
    for i in range(3):
        top = sorted(range(20), key=lambda f: -max(cos[i, f::20]))[:3]
        got = {r.file_id: r.s for r in best.where(F.col("qid") == i).collect()}
        assert all(abs(got[f] - max(cos[i, f::20])) < 1e-9 for f in top)


def test_cosine_scan_without_queries_or_rows(spark):
    data = spark.createDataFrame([], "chunk_id long, file_id long, v array<double>")
    none = spark.createDataFrame([], "qid long, q array<double>")
    one = spark.createDataFrame([(1, [1.0, 0.0]), (2, [float("nan"), 1.0]), (3, None)], "qid long, q array<double>")
    assert semantic.cosine_scan(data, none, dim=2, keep=3).count() == 0
    assert semantic.cosine_scan(data, one, dim=2, keep=3).count() == 0


@pytest.mark.parametrize(("vector", "ok"), [([1.0, 2.0], True), ([0.0, 0.0], True), ([1.0], False), (None, False), ([float("nan"), 1.0], False), ([float("inf"), 1.0], False), ([None, 1.0], False)])
def test_valid_vectors(spark, vector, ok):
    assert spark.createDataFrame([(vector,)], "v array<float>").select(vectors.is_valid(F.col("v"), 2)).first()[0] is ok


def test_quantize_and_pack(spark):
    df = spark.createDataFrame([([0.5, -1.0, 2.5 / 7, 0.0], [1.0, 0.5, 1.0, 1.0])], "u array<double>, s array<double>")
    codes = vectors.quantize(F.col("u"), F.col("s"), 7)
    r = df.select(codes.alias("c"), vectors.pack_nibbles(codes).alias("p"), vectors.unpack_nibbles(vectors.pack_nibbles(codes)).alias("b")).first()
    assert list(r.c) == [4, -7, 2, 0], "half to even, and clipped"
    assert list(r.b) == list(r.c)
    assert list(r.p) == [(4 + 7) * 16 + 0, (2 + 7) * 16 + 7]


def test_fuse_and_dedup(spark):
    lists = [(1, 0, "keyword", "/a", 1, 1), (1, 0, "keyword", "/b", 2, 2), (1, 1, "semantic", "/b", 9, 1), (1, 1, "semantic", "/c", 3, 2), (1, 2, "semantic", "/b", 8, 1)]
    df = spark.createDataFrame(lists, "qid long, list_no int, source string, path string, chunk_id long, rk int").withColumns({"kind": F.lit("text"), "mtime": F.lit(1.0), "mime": F.lit("m")})
    fused = {r.path: r for r in fusion.fuse(df).collect()}
    assert fused["/b"].score == pytest.approx(1 / 62 + 2 / 61) and fused["/b"].chunk_id == 9 and fused["/b"].match == "hybrid"
    assert fused["/a"].match == "keyword" and fused["/c"].semantic_rank == 2
    files = spark.createDataFrame([("/a", "h", 5.0, 1), ("/b", "h", 1.0, 1), ("/c", None, 1.0, None), ("/z/build/d", "h", 9.0, 2)], "path string, content_hash string, mtime double, source_device long")
    top = fusion.dedup(fusion.fuse(df), files, 12)
    assert rows(top, "path", "place") == [("/b", 1), ("/c", 2)]
    scopes = [{"name": "s", "root": "/a", "priority": 5}]
    copies = fusion.copies(top, files, scopes)
    assert rows(copies.where("path = '/b'"), "copy_path", "is_canonical") == [("/a", True), ("/b", False), ("/z/build/d", False)]
    assert rows(copies.where("path = '/c'"), "copy_path", "is_canonical") == [("/c", True)]


def test_delta_replay(spark):
    s = "result_id string, place int, path string, score double"
    a = spark.createDataFrame([("x", 1, "/x", 1.0), ("y", 2, "/y", 0.5), ("n", 3, None, None)], s)
    b = spark.createDataFrame([("y", 1, "/y", 0.5), ("z", 2, "/z", 0.7), ("n", 3, None, 0.1)], s)
    d = fusion.delta(a, b, ["path", "score"])
    assert rows(d, "result_id", "change") == [("n", "updated"), ("x", "removed"), ("y", "unchanged"), ("z", "added")]
    assert rows(fusion.replay(a, d, b, ["path", "score"]), *b.columns) == rows(b)


def test_rerank_mix(spark):
    base = spark.createDataFrame([(1, "/a", 1), (1, "/b", 2)], "qid long, path string, place int")
    scores = spark.createDataFrame([(1, "/b", 4, 0.9), (1, "/b", 3, 0.9), (1, "/a", 1, 0.1)], "qid long, path string, chunk_id long, relevance double")
    assert rows(fusion.rerank_blend(base, scores, 0.0, 5), "new_place", "path") == [(1, "/a"), (2, "/b")]
    assert rows(fusion.rerank_blend(base, scores, 1.0, 5), "new_place", "path", "chunk_id") == [(1, "/b", 3), (2, "/a", 1)]


def test_agreement_of_empty_lists(spark):
    s = "qid long, result_id string, place int"
    a, b = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], s), spark.createDataFrame([(1, "y", 1), (2, "z", 1)], s)
    assert rows(fusion.agreement(a, b), "qid", "both", "either", "jaccard", "same_first") == [(1, 1, 2, 0.5, False), (2, 0, 1, 0.0, False)]


class TestDifferences:
    schema = "path string, root string, size long, indexed_at double, extra string"

    def found(self, spark, a, b):
        df = lambda r: spark.createDataFrame(r, self.schema)
        out = differences.differences(df(a), df(b).drop("extra"), F.col("path"), {"root": F.col("root"), "size": F.col("size")}, version=F.col("indexed_at"))
        return rows(out)

    def test_cells(self, spark):
        a = [("/a", "r", 1, 1.0, ""), ("/b", "r", None, 1.0, ""), ("/c", "r", 2, 1.0, ""), (None, "r", 2, 1.0, ""), ("/A", "r", 1, 1.0, "")]
        b = [("/a", "r", 1, 9.0, ""), ("/b", None, 3, 1.0, ""), ("/d", "r", 2, 1.0, ""), ("/a", "r", 1, 9.0, "")]
        assert self.found(spark, a, b) == [("/A", "only_first"), ("/b", "root"), ("/b", "size"), ("/c", "only_first"), ("/d", "only_second")]

    def test_latest_row_counts(self, spark):
        a = [("/a", "old", 1, 1.0, ""), ("/a", "new", 1, 2.0, ""), ("/a", "none", 1, None, ""), ("/a", "nan", 1, float("nan"), "")]
        assert self.found(spark, a, [("/a", "new", 1, 0.0, "")]) == []

    def test_empty(self, spark):
        assert self.found(spark, [], []) == []
        assert self.found(spark, [("/a", None, None, None, None)], []) == [("/a", "only_first")]

    def test_a_hot_key(self, spark):
        a = [("/hot", f"r{i}", i, float(i), "") for i in range(3000)] + [(f"/{i}", "r", 1, 1.0, "") for i in range(20)]
        assert self.found(spark, a, a[1:]) == []

    @pytest.mark.parametrize(("x", "y"), [("1", "01"), ("1", "1.0"), ("-0", "0"), ("0.50", ".50"), ("1e3", "1e3"), ("10", "1"), ("-1.20", "-01.2"), ("0.0", "-0.00"), ("abc", "ABC"), ("", "0"), ("100", "1"), ("1.", "1")])
    def test_numbers(self, spark, x, y):
        import re

        same = float(x) == float(y) if all(re.fullmatch(r"-?[0-9]+(\.[0-9]+)?", v) for v in (x, y)) else x == y
        r = spark.createDataFrame([(x, y)], "x string, y string").select(differences.canonical_number(F.col("x")) == differences.canonical_number(F.col("y"))).first()[0]
        assert r is same


def test_numbered_is_gapless(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    got = ingest.numbered(df, ["k"], 50).orderBy("k").collect()
    assert [r.chunk_id for r in got] == list(range(51, 1051))
    assert ingest.numbered(df.limit(0), ["k"], 5).count() == 0


def test_vanished_keeps_junk_and_other_roots(spark):
    c = spark.createDataFrame([("/a/x",), ("/a/build/y",), ("/b/z",), ("/a/k",), ("/ab/q",)], "path string")
    assert rows(ingest.vanished(c, spark.createDataFrame([("/a/k",)], "path string"), ["/a"])) == [("/a/x",)]


def test_deltas_are_monotonic(spark):
    s = spark.createDataFrame([(1, 1, 2.0), (1, 2, 1.0), (1, 3, 4.0), (1, 4, None), (2, 1, -1.0), (2, 2, 3.0)], "run long, at long, v double")
    assert rows(metrics.observation_deltas(s, "run", "at", "v"), "run", "at", "delta") == [(1, 1, 2.0), (1, 2, 0.0), (1, 3, 2.0), (1, 4, 0.0), (2, 1, 0.0), (2, 2, 3.0)]
    assert rows(metrics.observation_deltas(s, "run", "at", "v", span=1)) == rows(metrics.observation_deltas(s, "run", "at", "v"))


def test_latency_bounds(spark):
    df = spark.createDataFrame([(0.05,), (0.051,), (300.0,), (301.0,), (None,)], "s double").select(metrics.latency_bucket(F.col("s")))
    assert [r[0] for r in df.collect()] == [0, 1, 11, 12, None]


def test_run_summaries_put_failures_first(spark):
    runs = spark.createDataFrame([(1, 1.0, 0, False), (2, None, 0, False), (3, 1.0, 2, False), (4, 1.0, 0, True)], "run_id long, finished double, errors long, limited boolean")
    fails = spark.createDataFrame([(3, "io"), (3, "io")], "run_id long, category string")
    got = metrics.run_summaries(runs, fails).collect()
    assert [r.run_id for r in got] == [3, 2, 4, 1]
    assert got[0].failures == {"io": 2} and [r.coverage_complete for r in got] == [False, False, False, True]


def test_closed_vocabulary(spark):
    c = spark.createDataFrame([("m", "a", 1.0), ("m", "x", 1.0), ("n", "a", 1.0), ("m", "a", float("nan")), ("m", "a", -1.0), ("m", "a", None), ("m", "a", float("inf"))], "mode string, metric string, value double")
    assert rows(metrics.accepted(c, ["m"], ["a"])) == [("m", "a", 1.0)]


def test_epoch_of_days():
    assert catalog.epoch("1970-01-02") == 86400 and catalog.epoch("1970-01-01", end=True) == 86399 and catalog.epoch("1970-01-01T00:00:05", end=True) == 5


def test_current_takes_the_last_row(spark):
    f = spark.createDataFrame([(1, "/a", 1.0), (1, "/a", 2.0), (1, "/a", None), (2, None, 3.0), (3, "/a", 2.0)], "file_id long, path string, indexed_at double")
    assert rows(catalog.current(f)) == [(1, "/a", 2.0)]


def test_cells_reach_the_recall(spark):
    rng = np.random.default_rng(8)
    m, q = rng.normal(size=(3000, 16)), rng.normal(size=(5, 16))
    data = spark.createDataFrame([(i + 1, i % 7, v.tolist()) for i, v in enumerate(m)], "chunk_id long, file_id long, v array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid long, q array<double>")
    exact = semantic.top_passages(semantic.cosine_scan(data, queries, dim=16, keep=50), 50)
    cells = semantic.build_cells(data, dim=16, cell_rows=50)
    assert cells.rows.count() == 3000 and cells.centres.count() == 60
    mean = lambda found: semantic.recall(exact, found).agg(F.avg("recall")).first()[0]
    found = semantic.cell_candidates(cells, queries, dim=16, keep=50)
    assert mean(found) >= 0.9 and rows(found) == rows(semantic.cell_candidates(semantic.build_cells(data.orderBy(F.desc("chunk_id")), dim=16, cell_rows=50), queries, dim=16, keep=50))
    assert rows(semantic.cell_candidates(cells, queries, dim=16, keep=50, recall=1.0)) == rows(exact, "qid", "chunk_id", "score")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    centroids = np.array([r.centre for r in cells.centres.orderBy("cell").collect()])
    few, many = (semantic.probes_for(u[:5], centroids, u, 3000, keep=10, recall=r) for r in (0.3, 0.9))
    assert (few <= many).all() and many.max() < 60
    one = spark.createDataFrame([(3,)], "file_id long")
    assert rows(semantic.cell_candidates(cells, queries, dim=16, keep=3000, recall=1.0, allowed=one).select("chunk_id").distinct()) == sorted(((i + 1,) for i in range(3000) if i % 7 == 3), key=repr)
    nothing = semantic.build_cells(data.limit(0), dim=16)
    assert semantic.cell_candidates(nothing, queries, dim=16, keep=5).count() == 0 and semantic.cell_candidates(cells, queries.limit(0), dim=16, keep=5).count() == 0
    # The same visits in SQL.
    semantic.register_cells(spark, "nearest_cells", centroids)
    cells.rows.createOrReplaceTempView("cell_rows")
    queries.createOrReplaceTempView("cell_queries")
    met = spark.sql("select qid, chunk_id from cell_queries, lateral nearest_cells(q, 60) n join cell_rows using (cell)")
    assert met.count() == 5 * 3000
    near = rows(spark.sql("select qid, n.cell from cell_queries, lateral nearest_cells(q, 2) n"))
    assert near == sorted(((i, int(c)) for i in range(5) for c in np.argsort(-np.round(centroids @ (q[i] / np.linalg.norm(q[i])), 6), kind="stable")[:2]), key=repr)


def test_half_precision_and_bytes(spark):
    from tessera.functions import vectors

    df = spark.createDataFrame([(1, [3.0, 4.0], "x"), (2, [0.0, -1.0], None)], "chunk_id long, v array<double>, note string")
    back = {r.chunk_id: r.v for r in semantic.dequantized(semantic.quantized(df, None, "fp16"), None, "fp16").collect()}
    assert back[1] == pytest.approx([0.6, 0.8], abs=1e-3) and back[2] == [0.0, -1.0]
    data = spark.createDataFrame([(1, [1.5, -2.0]), (2, None), (3, [])], "k long, v array<float>")
    packed = vectors.packed(data, "v", "blob")
    assert {r.k: r.blob and bytes(r.blob) for r in packed.collect()} == {1: np.array([1.5, -2.0], "<f4").tobytes(), 2: None, 3: b""}
    assert {r.k: r.v for r in vectors.unpacked(packed, "blob", "v").collect()} == {1: [1.5, -2.0], 2: None, 3: []}
    odd = spark.createDataFrame([(1, b"abc")], "k long, blob binary")
    assert vectors.unpacked(odd, "blob", "v").first().v is None


def test_many_queries_of_names_come_in_blocks(spark):
    files = spark.createDataFrame([(f"/a/file{i}.txt", "text", 1.0, "m") for i in range(50)], "path string, kind string, mtime double, mime string")
    queries = spark.createDataFrame([(i, f"file{i % 50}.txt") for i in range(4500)], "qid long, text string")
    found = catalog.filename_hits(files, queries, limit=5)
    assert found.count() == 4500 and found.where("path <> concat('/a/file', qid % 50, '.txt')").count() == 0
    assert catalog.filename_hits(files, queries.limit(0), limit=5).count() == 0


def test_relevance_figures(spark):
    ranks = spark.createDataFrame([(1, 1), (2, 3), (3, 4), (4, None), (5, 2)], "case_id long, place int")
    r = metrics.relevance(ranks).first()
    assert (r.cases, r.top1, r.top3) == (5, 1, 3) and r.mrr3 == pytest.approx((1 + 1 / 3 + 1 / 2) / 5)


def test_images_have_their_own_list(spark):
    f = spark.createDataFrame([(1, "image", [1.0, 0.0]), (2, "image", None), (3, "text", [1.0, 0.0]), (4, "image", [0.0, 1.0])], "file_id long, kind string, image_embedding array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.2])], "qid long, q array<double>")
    assert rows(semantic.image_hits(f, q, dim=2, k=5), "qid", "file_id", "rk") == [(7, 1, 1), (7, 4, 2)]


def test_listed_and_joined_tokens_give_the_same_scores(spark, monkeypatch):
    p = spark.createDataFrame([(1, "the old lamp"), (2, "lamp-post and lamp"), (3, None), (4, "post lamp"), (5, "")], "chunk_id long, text string")
    q = spark.createDataFrame([(1, "lamp"), (2, "lamp-post old"), (3, "___ lamp"), (4, None), (None, "lamp"), (5, "")], "qid long, text string")
    for strict in (False, True):
        listed = rows(lexical.bm25_texts(p, q, require_all=strict))
        with monkeypatch.context() as m:
            m.setattr(lexical, "MOST_TOKENS", 0)
            assert rows(lexical.bm25_texts(p, q, require_all=strict)) == listed and listed
    assert {r[0] for r in listed} == {1}
    assert lexical.bm25_texts(p, q.limit(0)).count() == 0 and lexical.bm25_texts(p.limit(0), q).count() == 0
