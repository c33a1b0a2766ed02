"""The index from files on disk to results, and what must survive failures."""

import io
import json
import os
import random
import threading
import time
import zipfile

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tessera.engine import HashEncoder, Index, Request, guidance
from tessera.operators import lexical
from tessera.sources import files as sources
from tessera.sources import imports
from tessera.sources.store import MOST_PARTS, Conflict, Delta, Store
from tessera.streaming import live

DIM = 32


def docx(*paragraphs, head=""):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    xml = f'<?xml version="1.0"?>{head}<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
    return out.getvalue()


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    a, b = root / "a", root / "a-extra"
    for p in (a / "docs", a / "node_modules", a / "build", b):
        p.mkdir(parents=True)
    (a / "docs" / "lamp.txt").write_text("The lamp stands near the window of the old harbour house. " * 3)
    (b / "copy.txt").write_text("The lamp stands near the window of the old harbour house. " * 3)
    (a / "docs" / "boat.md").write_text("A boat left the harbour before the storm, and nobody saw it again. " * 40)
    (a / "docs" / "note.docx").write_bytes(docx("A note on the storm that took the boat away from the harbour."))
    (a / "docs" / "bad.docx").write_bytes(b"not a zip")
    (a / "docs" / "picture.png").write_bytes(b"\x89PNG")
    (a / "node_modules" / "x.js").write_text("harbour " * 20)
    (a / "build" / "y.txt").write_text("harbour " * 20)
    os.symlink(a / "docs" / "lamp.txt", a / "docs" / "link.txt")
    return root


@pytest.fixture(scope="module")
def index(spark, tree, tmp_path_factory):
    scopes = {"version": 1, "collections": {"main": {"root": str(tree / "a"), "priority": 20}, "extra": {"root": str(tree / "a-extra"), "priority": 10}, "off": {"root": "/x", "searchable": False}}}
    i = Index(spark, "file://" + str(tmp_path_factory.mktemp("index")), dim=DIM, scopes=scopes, scorer=lambda pairs: [float(t.count("storm")) for _, t in pairs])
    i.update([str(tree / "a"), str(tree / "a-extra")])
    return i


def names(results):
    return [os.path.basename(r["path"]) for r in results]


def test_walk(spark, tree):
    found = {os.path.basename(r.path): r for r in sources.walk(spark, [str(tree / "a")]).collect()}
    assert set(found) == {"lamp.txt", "boat.md", "note.docx", "bad.docx", "picture.png", "y.txt"}
    assert found["picture.png"].kind == "image" and found["note.docx"].kind == "text"
    one = sources.walk(spark, [str(tree / "a" / "docs" / "lamp.txt")]).collect()
    assert len(one) == 1
    assert sources.walk(spark, [str(tree / "a")], excluded=[str(tree / "a" / "docs")]).count() == 1
    assert sources.walk(spark, [str(tree / "a")], devices=[-1]).count() == 0
    missing = sources.walk(spark, [str(tree / "none")]).collect()
    assert [r.error for r in missing] == ["FileNotFoundError"]


def test_extraction():
    assert sources.extract("x.docx", docx("one", "two")) == "one\n\ntwo"
    assert sources.extract("x.txt", b"ab\xffc") == "abc"
    for content in (docx("x", head='<!DOCTYPE d [<!ENTITY e "x">]>'), b"", b"junk"):
        with pytest.raises(sources.ExtractionError):
            sources.extract("x.docx", content)
    with pytest.raises(sources.ExtractionError):
        sources.extract("x.txt", None)


def test_update_catalogue(index):
    got = {os.path.basename(r.path): r for r in index.files().collect()}
    assert "y.txt" not in got and "x.js" not in got, "junk is not catalogued"
    assert got["bad.docx"].content_sig is None, "a file that can't be read stays by name and is tried again"
    assert got["lamp.txt"].content_hash == got["copy.txt"].content_hash
    status = index.status()
    assert status["files"] == 6 and status["runs"][0]["run_id"] == 1 and status["chunk_high_water"] == status["chunks"]


def test_search_stages_and_copies(index):
    events = list(index.stream(Request("harbour lamp", deep=True)))
    assert [e["stage"] for e in events] == ["keyword", "encoding", "semantic", "deep", "done"] and events[-1]["complete"]
    assert events[2]["progress"]["visited"] == index.chunks().count()
    assert names(events[-1]["results"]).count("lamp.txt") + names(events[-1]["results"]).count("copy.txt") == 1
    assert [e["sequence"] for e in events] == [1, 2, 3, 4, 5]
    assert [e["stage"] for e in index.stream(Request("harbour lamp", deep=True, emit_seconds=600.0))] == ["keyword", "done"]


def test_early_candidates(spark, index):
    assert "candidates" not in [e["stage"] for e in index.stream(Request("harbour lamp", early=True))], "none have been built"
    assert index.build_candidates()["rows"] == index.chunks().count()
    events = list(index.stream(Request("harbour lamp", early=True, rerank=True)))
    assert [e["stage"] for e in events] == ["keyword", "encoding", "candidates", "reranked_early", "semantic", "reranked", "done"] and events[2]["results"]
    with pytest.raises(ValueError, match="candidates_identity"):
        Index(spark, index.root, dim=DIM + 1).search(Request("boat", early=True))


def test_a_search_that_fails_says_so(spark, index):
    bad = Index(spark, index.root, dim=DIM, scorer=lambda pairs: [])
    events = []
    with pytest.raises(Exception, match="invalid_reranker_scores"):
        for e in bad.stream(Request("harbour", rerank=True)):
            events.append(e)
    assert events[-1]["stage"] == "failed" and events[-1]["results"] == events[-2]["results"] and not events[-1]["complete"]


def test_searches_leave_nothing_staged(index, monkeypatch):
    from tessera import runtime

    paths, own = [], runtime.stage_path
    monkeypatch.setattr(runtime, "stage_path", lambda spark, label: paths.append(own(spark, label)) or paths[-1])
    list(index.stream(Request("harbour lamp", deep=True, rerank=True)))
    index.update([index.root.removeprefix("file://")])
    assert len(paths) > 5 and not any(index.store.exists(p) for p in paths)


def test_cancelling_a_job(spark, index):
    slow = Index(spark, index.root, dim=DIM, scorer=lambda pairs: [time.sleep(20) or 0.0 for _ in pairs])
    job = slow.start(Request("harbour", rerank=True))
    end = time.time() + 240
    while len(slow.poll(job)["events"]) < 2 and time.time() < end:
        time.sleep(0.1)
    time.sleep(1)
    slow.cancel(job)
    while slow.poll(job)["state"] == "running" and time.time() < end:
        time.sleep(0.1)
    p = slow.poll(job)
    assert p["state"] == "cancelled" and p["events"][-1]["reason"] == "cancelled" and p["events"][-1]["results"] == p["events"][-2]["results"]


def test_deltas_rebuild_every_snapshot(index):
    full = list(index.stream(Request("harbour storm", deep=True)))
    state: dict = {}
    for f, d in zip(full, index.stream(Request("harbour storm", deep=True, deltas=True)), strict=True):
        for k in d["changes"]["removed"]:
            del state[k]
        state |= {r["result_id"]: r for r in d["results"]}
        assert [state[k] for k in d["changes"]["order"]] == f["results"]


def test_filters_and_scopes(index):
    assert names(index.search(Request("harbour", keyword_only=True, scopes=("extra",)))) == ["copy.txt"]
    assert set(names(index.search(Request("harbour", keyword_only=True, scopes=("main",))))) == {"lamp.txt", "boat.md", "note.docx"}
    assert index.search(Request("harbour absentword", keyword_only=True, require_all=True)) == []
    assert index.search(Request("harbour", keyword_only=True, before="1980-01-01")) == []
    assert set(names(index.search(Request("DOCX", names_only=True)))) == {"note.docx", "bad.docx"}
    assert index.search(Request("harbour", kind="image")) == []
    for bad in ("off", "nowhere"):
        with pytest.raises(ValueError, match="scope"):
            index.search(Request("harbour", scopes=(bad,)))


def test_rerank(index):
    plain = index.search(Request("harbour"))
    assert names(index.search(Request("harbour", rerank=True, rerank_mix=0.0))) == names(plain)
    assert names(index.search(Request("harbour", rerank=True)))[0] == "boat.md"


def test_requests_are_checked():
    for bad in ({"top_k": 0}, {"kind": "x"}, {"rerank_mix": 2.0}, {"expansions": tuple("abcdefgh")}):
        with pytest.raises(ValueError, match="invalid_request|too_many_variants"):
            Request("q", **bad)
    assert Request("q", expansions=("q", "r")).variants("lexical") == ["q", "r"]
    assert Request("q", lexical_queries=("x",)).variants("lexical") == ["x"] and Request("q", lexical_queries=("x",)).variants("semantic") == ["q"]
    assert guidance("w " * 13) and guidance("two words") is None


def test_budget_and_cancel_keep_results(index):
    events = list(index.stream(Request("harbour", max_seconds=0.0)))
    assert [e["stage"] for e in events] == ["keyword", "done"] and events[-1]["reason"] == "budget_exhausted"
    assert events[-1]["results"] == events[0]["results"] and not events[-1]["complete"]
    events = list(index.stream(Request("harbour"), cancelled=lambda: True))
    assert events[-1]["reason"] == "cancelled" and events[-1]["results"]


def test_jobs(index):
    job = index.start(Request("harbour", keyword_only=True))
    end = time.time() + 60
    while (p := index.poll(job))["state"] in ("starting", "running") and time.time() < end:
        time.sleep(0.2)
    p = index.poll(job)
    assert p["state"] == "done" and [e["stage"] for e in p["events"]] == ["keyword", "done"]
    assert [e["sequence"] for e in index.poll(job, after=1)["events"]] == [2] and index.poll(job, limit=1)["next"] == 1
    assert index.job_events(job).count() == 2
    for bad in ("../x", "f" * 32):
        with pytest.raises(ValueError, match="job"):
            index.poll(bad)


def test_matrix_tail_and_identity(spark, index, tree):
    made = index.build_matrix("int8")
    assert made["rows"] == index.status()["chunks"] and not made["continued"]
    assert [e["stage"] for e in index.stream(Request("boat storm"))] == ["keyword", "encoding", "semantic", "refined", "done"]
    assert index.verify(every=1)["recall"] >= 0.9
    (tree / "a" / "docs" / "tail.txt").write_text("A zeppelin passed over the harbour in the evening of that day.")
    index.update([str(tree / "a"), str(tree / "a-extra")])
    assert "tail.txt" in names(index.search(Request("zeppelin")))
    more = index.build_matrix("int8")
    assert more["continued"] and more["rows"] == made["rows"] + 1 and more["db_max_rowid"] > made["db_max_rowid"]
    assert not index.build_matrix("fp16")["continued"] and index.verify(every=1)["recall"] >= 0.99
    assert index.build_matrix("int8", full=True)["rows"] == more["rows"]
    assert "tail.txt" in names(index.search(Request("zeppelin")))
    other = Index(spark, index.root, dim=DIM + 1)
    with pytest.raises(ValueError, match="matrix_identity"):
        other.search(Request("boat"))


def test_unchanged_changed_and_vanished(index, tree):
    roots = [str(tree / "a"), str(tree / "a-extra")]
    before = index.status()
    again = index.update(roots)
    assert again["changed"] == 1, "only the file that can't be read is tried again"
    assert index.status()["chunks"] == before["chunks"]
    high = index.status()["chunk_high_water"]
    (tree / "a-extra" / "copy.txt").write_text("Another text about a lighthouse, which is long enough to count as one.")
    (tree / "a" / "docs" / "tail.txt").unlink()
    index.update(roots)
    got = {os.path.basename(r.path): r.file_id for r in index.files().collect()}
    assert "tail.txt" not in got
    new = index.chunks().where(F.col("file_id") == got["copy.txt"]).collect()
    assert len(new) == 1 and new[0].chunk_id > high, "ids are never used again"
    assert index.chunks().join(index.files(), "file_id", "left_anti").count() == 0


def test_limited_walks_prune_nothing(index, tree):
    before = index.status()["files"]
    assert index.update([str(tree / "a")], max_files=1)["limited"] and index.status()["files"] == before


def test_replicate_and_compare(spark, index, tmp_path):
    target = "file://" + str(tmp_path / "replica")
    index.store.replicate(target)
    other = Index(spark, target, dim=DIM, scopes=index.scopes)
    assert other.store.is_replica_of(index.store) and rows(other.files()) == rows(index.files())
    assert index.compare(other) == {"shared": index.files().count(), "only_first": 0, "only_second": 0}
    counters = {r.metric: r.value for r in index.shadow(other, Request("harbour", keyword_only=True)).collect()}
    assert counters["overlap_sum"] == 1.0 and counters["same_first"] == 1.0 and counters["first_outcome_ok"] == counters["second_outcome_ok"] == 1.0
    assert sum(v for k, v in counters.items() if "_latency_bucket_" in k) == 2.0
    for _ in range(2):
        index.record(index.shadow(other, Request("harbour", keyword_only=True)))
    assert {r.metric: r.value for r in index.counters().collect()}["paired"] == 2.0
    late = {r.metric for r in index.shadow(other, Request("harbour", deep=True), timeout=0.0).collect()}
    assert late == {"first_outcome_timeout", "second_outcome_timeout"}
    time.sleep(2)
    index.upgrade_metadata()
    assert not other.store.is_replica_of(index.store)


def test_failed_publish_leaves_the_version(spark, tmp_path):
    store = Store(spark, "file://" + str(tmp_path))
    store.publish({"t": spark.range(3)})
    with pytest.raises(Exception, match="boom|DIVIDE"):
        store.publish({"t": spark.range(3).select((F.lit(1) / (F.col("id") - F.col("id"))).alias("id"))})
    assert store.manifest()["version"] == 1 and store.table("t").count() == 3
    store.publish({"t": spark.range(4)})
    assert store.vacuum() >= 1 and store.table("t").count() == 4


def test_a_killed_writer_leaves_the_version(spark, tmp_path, monkeypatch):
    store = Store(spark, "file://" + str(tmp_path))
    store.publish({"t": spark.range(3)})
    for step in ("_write", "write_text", "_rename"):
        with monkeypatch.context() as m:
            m.setattr(Store, step, lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt()))
            with pytest.raises(KeyboardInterrupt):
                store.publish({"t": spark.range(9)})
        fresh = Store(spark, store.root)
        assert fresh.manifest()["version"] == 1 and fresh.table("t").count() == 3
    store.publish({"t": spark.range(4)})
    assert store.manifest()["version"] == 2 and store.table("t").count() == 4 and store.table("t", store.manifest(1)).count() == 3


def test_of_two_writers_one_is_refused(spark, tmp_path):
    one, two = (Store(spark, "file://" + str(tmp_path)) for _ in range(2))
    base = one.publish({"t": spark.range(3)})
    two.publish({"u": spark.range(1)}, base=base)
    with pytest.raises(Conflict):
        one.publish({"t": spark.range(5)}, base=base)
    # Both have seen the same last version, and only the rename tells.
    number = two._version_path(two.manifest()["version"] + 1)
    two.write_text(number, json.dumps({**two.manifest(), "version": 3}), overwrite=False)
    with pytest.raises(Conflict):
        one.write_text(number, "{}", overwrite=False)
    assert one.manifest()["version"] == 3 and one.table("t").count() == 3 and not list(tmp_path.glob("versions/*.new"))


def test_small_files_can_be_read_while_they_are_replaced(spark, tmp_path):
    store = Store(spark, "file://" + str(tmp_path))
    path = f"{store.root}/state.json"
    store.write_text(path, "0" * 50)
    stop = threading.Event()

    def write() -> None:
        i = 0
        while not stop.is_set():
            i += 1
            store.write_text(path, str(i % 10) * 50)

    t = threading.Thread(target=write, daemon=True)
    t.start()
    try:
        for _ in range(300):
            text = store.read_text(path)
            assert text is not None and len(text) == 50 and len(set(text)) == 1
    finally:
        stop.set()
        t.join()


def test_deltas_of_tables(spark, tmp_path):
    store = Store(spark, "file://" + str(tmp_path))
    rng = random.Random(1)
    want: dict = {}
    for step in range(2 * MOST_PARTS):
        gone, new = [rng.randrange(40) for _ in range(rng.randrange(3))], {rng.randrange(40): step for _ in range(rng.randrange(4))}
        want = {k: v for k, v in want.items() if k not in gone and k not in new} | new
        store.publish(deltas={"t": Delta("k", spark.createDataFrame([(k,) for k in (*gone, *new)], "k long"), spark.createDataFrame(list(new.items()), "k long, v long"))})
        if step % 5 == 4:
            assert rows(store.table("t")) == sorted(want.items(), key=repr)
    entry = store.manifest()["tables"]["t"]
    assert len(entry["parts"]) + len(entry["gone"]) <= MOST_PARTS
    store.compact("t", ["k"])
    assert rows(store.table("t")) == sorted(want.items(), key=repr) and store.vacuum() > 1 and rows(store.table("t")) == sorted(want.items(), key=repr)


def test_batches_and_repair(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    for i in range(7):
        (src / f"f{i}.txt").write_text(f"Text number {i} tells of the old harbour and of the boats in it, at some length.")
    (src / "bad.docx").write_bytes(b"junk")
    index = Index(spark, "file://" + str(tmp_path / "ix"), dim=DIM)
    assert index.update([str(src)], batch_files=3)["changed"] == 8 and index.store.manifest()["version"] >= 3
    assert index.status()["chunks"] == 7 and index.update([str(src)], batch_files=3)["changed"] == 1
    stored = index.store.table("postings")
    assert rows(stored.select("term", "chunk_id", "tf")) == rows(lexical.postings(index.chunks()).select("term", "chunk_id", "tf"))
    # A changed file among the hits, one in the rotating sample, one that isn't admitted, one that has gone.
    (src / "f1.txt").write_text("A zeppelin passed over the harbour, which nobody had seen before that evening.")
    (src / "f6.txt").unlink()
    events = list(index.search_with_refresh(Request("number 1 harbour")))
    again = [e for e in events if e.get("refreshed")]
    assert again and again[-1]["results"][-1]["path"] and any("zeppelin" in r["snippet"] for r in again[-1]["results"])
    assert index.files().where("path like '%f6.txt'").count() == 1, "a repair prunes nothing"
    assert int(index.state()["refresh_cursor"]) > 0
    (src / "f2.txt").write_text("Another zeppelin passed over the harbour, on the evening after that one.")
    assert index.repair([str(src / "f2.txt")], admit=lambda p: "f2" not in p) == []
    first = int(index.state()["refresh_cursor"])
    assert str(src / "f2.txt") in index.repair([str(src / "f2.txt")])
    assert int(index.state()["refresh_cursor"]) != first or index.files().count() <= 6
    assert rows(index.store.table("postings").select("term", "chunk_id", "tf")) == rows(lexical.postings(index.chunks()).select("term", "chunk_id", "tf"))
    # A first passage that is missing.
    late = index.chunks().where("ordinal = 0").orderBy("chunk_id").limit(1).select("chunk_id", "file_id", F.lit(3).alias("ordinal"), "text", "embedding")
    index.store.publish(deltas={"chunks": Delta("chunk_id", late.select("chunk_id"), late)})
    assert index.repair_truncated() == 1 and index.repair_truncated() == 0
    assert index.update([str(src)])["changed"] == 2


def test_importing_a_bundle(spark, tmp_path):
    texts = ["A lighthouse stands on the cliff above the bay, and its lamp is never lit.", "Nobody has been up there for many years.", "The bay is calm."]
    (tmp_path / "index.json").write_text(json.dumps({"model": "m", "embedding_dim": DIM}))
    (tmp_path / "chunks.json").write_text(json.dumps([{"file": "a.txt"}, {"file": "a.txt"}, {"file": "b.txt"}]))
    (tmp_path / "texts.json").write_text(json.dumps(texts))
    np.save(tmp_path / "embeddings.npy", HashEncoder(DIM).text_vecs(texts))
    index = Index(spark, "file://" + str(tmp_path / "ix"), dim=DIM)
    assert index.import_bundle(str(tmp_path), model="m", root="/r") == {"files": 2, "chunks": 3}
    assert index.import_bundle(str(tmp_path), model="m", root="/r") == {"files": 0, "chunks": 0}
    assert names(index.search(Request("lighthouse lamp"))) [0] == "a.txt" and index.chunks().count() == 3


def test_bundle(spark, tmp_path):
    emb = HashEncoder(DIM).text_vecs(["one two", "three", "four"])
    (tmp_path / "index.json").write_text(json.dumps({"model": "m", "embedding_dim": DIM}))
    (tmp_path / "chunks.json").write_text(json.dumps([{"file": "a.txt", "chunk_id": 0}, {"file": "a.txt", "chunk_id": 1}, {"file": "b.txt", "chunk_id": 0}]))
    (tmp_path / "texts.json").write_text(json.dumps(["one two", "three", "four"]))
    np.save(tmp_path / "embeddings.npy", emb)
    b = imports.bundle(spark, str(tmp_path), model="m", dim=DIM)
    assert rows(b, "path", "ordinal", "text") == [("a.txt", 0, "one two"), ("a.txt", 1, "three"), ("b.txt", 0, "four")]
    f = spark.createDataFrame([("/r/a.txt",)], "path string")
    assert rows(imports.new_of_bundle(b, f, "/r/"), "path") == [("/r/b.txt",)]
    with pytest.raises(ValueError, match="bundle_model"):
        imports.bundle(spark, str(tmp_path), model="other", dim=DIM)
    (tmp_path / "chunks.json").write_text(json.dumps([{"file": "../a"}] * 3))
    with pytest.raises(ValueError, match="bundle_path"):
        imports.bundle(spark, str(tmp_path), model="m", dim=DIM)


def test_older_index(spark, tmp_path):
    src, target = str(tmp_path / "old"), str(tmp_path / "new")
    spark.createDataFrame([(1, "/a")], "file_id long, path string").write.parquet(f"{src}/files.parquet")
    spark.createDataFrame([(1, 1, 0, "t", [1.0] * DIM)], "chunk_id long, file_id long, ordinal int, text string, embedding array<float>").write.parquet(f"{src}/chunks.parquet")
    imports.older_index(spark, src, target, DIM)
    assert spark.read.parquet(f"{target}/files.parquet").first().content_hash is None
    with pytest.raises(Exception, match="exist"):
        imports.older_index(spark, src, target, DIM)
    with pytest.raises(ValueError, match="vector_dimension"):
        imports.older_index(spark, src, str(tmp_path / "x"), DIM + 1)


def test_scope_files(tmp_path):
    at = str(tmp_path / "s.json")
    assert imports.load_scopes(at)["collections"] == {}
    imports.save_scopes({"version": 1, "collections": {"ok": {"root": "/a"}}}, at)
    assert imports.load_scopes(at)["collections"]["ok"]["root"] == "/a"
    for bad in ({"version": 2}, {"version": 1, "collections": {"Bad": {"root": "/a"}}}, {"version": 1, "collections": {"a": {"root": "x"}}}, {"version": 1, "collections": {"a": {"root": "/", "priority": "1"}}}):
        with pytest.raises(ValueError, match="invalid"):
            imports.check_scopes(bad)


def test_counter_stream_is_idempotent(spark, tmp_path):
    src, at = str(tmp_path / "src"), "file://" + str(tmp_path / "store")
    schema = "mode string, metric string, value double"
    spark.createDataFrame([("m", "a", 1.0), ("m", "a", 2.0)], schema).write.parquet(src)
    store = Store(spark, at)
    df = spark.read.parquet(src)
    for checkpoint in ("c1", "c2"):  # the second run sees the same batch number again
        live.follow_counters(spark, src, df.schema, store, str(tmp_path / checkpoint)).awaitTermination()
    assert rows(store.table("counters")) == [("m", "a", 3.0)]


def test_throttle(spark):
    e = spark.createDataFrame([(1, 0.1), (2, 0.5), (3, 1.2), (4, 1.9), (5, 5.0)], "sequence long, elapsed_seconds double")
    assert rows(live.throttled(e, 1.0), "sequence") == [(2,), (4,), (5,)]
