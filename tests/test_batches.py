"""Keyword scans of a batch of queries against the postings, and what they exchange."""

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tessera.operators import batches, lexical
from tessera.plans import retrieval
from tessera.runtime import stage


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(5)
    words = ["red", "Green", "blue", "dark", "light", "sky", "résumé"]
    texts = [" ".join(rng.choice(words, rng.integers(1, 25))) for _ in range(300)] + [None, "", "--"]
    p = spark.createDataFrame([(i, i % 40 if i % 50 else None, t) for i, t in enumerate(texts)], "chunk_id long, file_id long, text string").repartition(3)
    f = spark.createDataFrame([(i, f"/x/{'build/' if i % 9 == 0 else ''}{97 * i % 40}") for i in range(38)], "file_id long, path string").withColumns({"kind": F.lit("text"), "mtime": F.lit(1.0), "mime": F.lit("m")})
    q = [(1, "dark-blue sky"), (2, "--- red"), (3, "nothing"), (4, None), (None, "red"), (5, "red RED Red"), (6, "sky dark-blue"), (7, "resume light"), (8, "blue"), (9, "___"), (10, "light-sky-red green dark blue")]
    return p, f, spark.createDataFrame(q, "qid long, text string")


@pytest.mark.parametrize("cells", [4_000_000, 100])
@pytest.mark.parametrize("strict", [False, True])
def test_hits_are_those_of_the_postings(corpus, strict, cells, monkeypatch):
    p, _, q = corpus
    monkeypatch.setattr(batches, "CELLS", cells)
    monkeypatch.setattr(batches, "BLOCK", 3)
    want = rows(lexical.bm25_texts(p, q, require_all=strict), "qid", "chunk_id", "score")
    assert rows(batches.KeywordBatch(p, q).hits(require_all=strict), "qid", "chunk_id", "score") == want and want


@pytest.mark.parametrize("pool", [1, 4, 50])
def test_best_files_are_those_of_all_hits(corpus, pool, monkeypatch):
    p, f, q = corpus
    monkeypatch.setattr(batches, "CELLS", 200)
    want = lexical.best_of_files(lexical.bm25_texts(p, q), p, f, pool)
    assert rows(batches.KeywordBatch(p, q).best_of_files(f, pool), *want.columns) == rows(want)


def test_no_queries_or_passages(corpus):
    p, f, q = corpus
    for a, b in ((p.limit(0), q), (p, q.limit(0))):
        batch = batches.KeywordBatch(a, b)
        assert batch.hits().count() == batch.hits(require_all=True).count() == batch.best_of_files(f, 3).count() == 0


def test_gathered_candidates_lose_no_winner(monkeypatch):
    monkeypatch.setattr(batches, "GATHERED", 50)
    rng = np.random.default_rng(1)
    best, all_rows = batches.Best(4, 3), []
    for n in range(30):
        part = (rng.integers(0, 4, 20), rng.integers(0, 25, 20), np.arange(20) + 20 * n, rng.integers(0, 40, 20) / 4)
        best.add(*part)
        all_rows += list(zip(*part, strict=True))
    got = set(zip(*best.rows(), strict=True))
    for q in range(4):
        of_group = {}
        for _, g, c, s in sorted((r for r in all_rows if r[0] == q), key=lambda r: (-r[3], r[2])):
            of_group.setdefault(g, (s, c))
        least = sorted((s for s, _ in of_group.values()), reverse=True)[2]
        assert {(g, c, s) for w, g, c, s in got if w == q} == {(g, c, s) for g, (s, c) in of_group.items() if s >= least}


def exchanges(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x and "Broadcast" not in x]


@pytest.mark.parametrize("name", ["bm25_any", "bm25_all"])
def test_hits_are_made_without_an_exchange(name, spark, data):
    assert not exchanges(getattr(retrieval, name)(spark, data))


def test_a_task_hands_on_its_best_only(corpus, spark):
    from tessera.operators import semantic

    v = spark.range(0, 25_000, 1, 1).select(F.col("id").alias("chunk_id"), (F.col("id") % 5000).alias("file_id"), F.array(F.cos(F.col("id") / 3e4), F.sin(F.col("id") / 3e4)).alias("v"))
    q = spark.createDataFrame([(1, [0.0, 1.0])], "qid long, q array<double>")
    assert semantic.cosine_scan(v, q, dim=2, keep=10, group="file_id", digits=12).count() == 10, "not ten of each of its three batches"


def test_staged_tables_leave_no_shuffle_files(spark, tmp_path):
    jvm = spark.sparkContext._jvm
    shuffles = lambda: jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    jvm.System.gc()
    before = shuffles()
    assert stage(spark.range(1000).repartition(3, "id"), "t").count() == 1000
    assert shuffles() <= before + 1, "only that of the count"


def test_both_rankings_of_identities_share_an_exchange(spark):
    from tessera.operators import fusion

    fused = spark.createDataFrame([(1, "/a", 0.5), (1, "/b", 0.5), (2, "/b", 0.1)], "qid long, path string, score double")
    files = spark.createDataFrame([("/a", "h"), ("/b", "h")], "path string, content_hash string")
    top = fusion.dedup(fused, files, 12)
    assert sum("hashpartitioning(qid" in x for x in exchanges(top)) == 1
    assert rows(top, "qid", "path", "place") == [(1, "/a", 1), (2, "/b", 1)]


@pytest.mark.parametrize("pool", [1, 4, 50])
def test_numbered_files_are_ranked_as_their_paths(corpus, pool, monkeypatch):
    from tessera.operators import fusion

    p, f, q = corpus
    monkeypatch.setattr(batches, "RANKED", 2)
    n = stage(fusion.numbered(f.withColumn("content_hash", F.when(F.col("file_id") % 3 == 0, "h").otherwise(F.when(F.col("file_id") % 3 == 1, "")))), "n")
    want = rows(lexical.best_of_files(lexical.bm25_texts(p, q), p, f, pool), "qid", "path", "chunk_id", "rk")
    batch = batches.KeywordBatch(p, q)
    assert rows(batch.best_of_numbers(n, pool).join(n, "number"), "qid", "path", "chunk_id", "rk") == want and want
    hits = batch.hits().join(p.select("chunk_id", "file_id"), "chunk_id").join(n.select("file_id"), "file_id")
    assert rows(batches.ranked_numbers(hits, n, pool).join(n, "number"), "qid", "path", "chunk_id", "rk") == want
    first = n.join(n.select(F.col("number").alias("ident"), F.col("path").alias("first")), "ident").collect()
    same = min(r.path for r in first if r.file_id % 3 == 0)
    assert all(r.first == (same if r.file_id % 3 == 0 else r.path) for r in first)


def test_rows_that_are_not_in_order_of_their_files(corpus):
    p, f, q = corpus
    batch = batches.KeywordBatch(p, q)
    met = batch.met.where("size(unit) > 0").join(f.select("file_id"), "file_id").coalesce(1).sortWithinPartitions("chunk_id")
    rows_of = lambda df: rows(batch._scans(df, keep=50), "qid", "file_id", "chunk_id", "score")
    assert rows_of(met) == rows_of(met.sortWithinPartitions("file_id", "chunk_id")) != []


def ranking_exchanges(name, spark, data, monkeypatch):
    """Exchanges of the lists and of what is ranked from them."""
    from tessera.operators import fusion

    seen = []

    def noted(df, label):
        seen.extend(exchanges(df) if label in ("words", "near", "base", "snapshot", "results") else ())
        return stage(df, label)

    for module in (retrieval, batches, fusion):
        monkeypatch.setattr(module, "stage", noted)
    df = getattr(retrieval, name)(spark, data)
    return seen + (exchanges(df) if name != "rerank_blend" else [])  # whose last steps call the number path


@pytest.mark.parametrize("name", ["rerank_blend", "rrf_hybrid", "rrf_multi_variant", "snapshot_delta", "delta_replay", "jaccard_overlap", "dedup_identity"])
def test_lists_are_ranked_and_fused_without_paths(name, spark, data, monkeypatch):
    found = ranking_exchanges(name, spark, data, monkeypatch)
    assert found and not [x for x in found if "path" in x]


HYBRID = ["rrf_hybrid", "delta_replay", "dedup_identity", "jaccard_overlap", "rrf_multi_variant", "snapshot_delta"]


@pytest.mark.parametrize("name", HYBRID)
def test_hybrid_queries_store_no_texts(name, spark, data, tmp_path, monkeypatch):
    """A new folder, for which there is no index yet: no passages are stored, and what led to the lists is gone."""
    import shutil
    from pathlib import Path

    from tessera.operators import fusion
    from tessera.plans import prepared
    from tessera.runtime import discard, scratch

    shutil.copytree(data, tmp_path / "t")
    labels = []

    def noted(df, label):
        labels.append(label)
        return stage(df, label)

    for module in (retrieval, batches, fusion, prepared):
        monkeypatch.setattr(module, "stage", noted)
    with scratch([]) as paths:
        got = rows(getattr(retrieval, name)(spark, str(tmp_path / "t")))
    assert {"met", "inside", "words", "searchable"} <= set(labels) and "passages" not in labels
    left = {Path(p).name.rpartition("-")[0] for _, p in paths}
    assert not left & {"asked", "met", "inside"} and {"words", "near"} <= left
    discard(paths)
    monkeypatch.undo()
    assert got == rows(getattr(retrieval, name)(spark, data)) != []


def test_passages_once_moves_repeated_rows_only(spark):
    from tessera.operators import catalog

    given = [(1, 0, "a"), (2, 5, "b"), (2, 1, "c"), (3, 0, "d"), (3, 0, "d"), (None, 0, "e"), (4, None, None)]
    chunks = spark.createDataFrame(given, "chunk_id long, ordinal int, text string")
    ids = stage(catalog.repeated(chunks), "repeated")
    assert rows(ids) == [(2,), (3,)]
    assert rows(catalog.passages_once(chunks, ids), "chunk_id", "text") == [(1, "a"), (2, "c"), (3, "d"), (4, None)] == rows(catalog.passages(chunks), "chunk_id", "text")


def test_many_repeated_passages(spark, data, monkeypatch):
    from tessera.plans import prepared

    index = prepared.prepared(spark, data)
    want = rows(index.once("chunk_id", "text"))
    monkeypatch.setattr(prepared, "MOST_REPEATED", -1)
    assert rows(index.once("chunk_id", "text")) == want == rows(index.passages, "chunk_id", "text")


def test_ties_are_cut_by_the_order_of_the_files(spark):
    best = batches.Best(1, 3, ordered=True)
    for a in (20, 0, 10):
        best.add(np.zeros(10, int), np.arange(a, a + 10), np.arange(a, a + 10), np.ones(10))
        best.rows()
    assert best.rows()[1].tolist() == [0, 1, 2], "not all thirty"
