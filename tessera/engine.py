"""The index as an object: update, search in stages, jobs, status, verification, replication.

Everything is expressed by the operators of this package over versioned tables.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress
from dataclasses import asdict, dataclass, field, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from .functions import paths
from .functions.text import chunks as cut
from .operators import catalog, fusion, ingest, lexical, metrics, semantic
from .runtime import discard, scratch, ship, stage
from .sources import files as sources
from .sources.imports import CHUNKS, FILES, admitted, bundle, conform, new_of_bundle
from .sources.store import Delta, Store

STATES = ("starting", "running", "done", "cancelled", "failed")
POSTINGS = "term string, chunk_id long, file_id long, dl int, tf int, positions array<int>"
LENGTHS = "chunk_id long, file_id long, dl int"
COUNTERS = "mode string, metric string, value double"
#: The format of a stored matrix: 2 for int8 and int4 with a scale, 1 for fp16.
FORMATS = {"int8": 2, "int4": 2, "fp16": 1}
#: Changes with the lists of what is junk, as the matrix holds no vectors of junk.
FILTER_VERSION = hashlib.sha256(repr((paths.JUNK_FOLDERS, paths.JUNK_NAMES, paths.JUNK_SUFFIXES)).encode()).hexdigest()[:16]
#: Files that a search repairs at most, and how large they may be.
REPAIRED_FILES, REPAIRED_BYTES = 12, 65_536
#: Query vectors of a check of the compression.
VERIFIED_QUERIES = 2048
RUNS = "run_id long, started double, finished double, roots array<string>, files long, changed long, errors long, limited boolean"
FAILURES = "run_id long, phase string, category string, target string"
EVENT = "sequence long, stage string, elapsed_seconds double, complete boolean, reason string, results array<struct<place:int,result_id:string,path:string,chunk_id:long,score:double,match:string,snippet:string>>, changes struct<added:array<string>,updated:array<string>,removed:array<string>,order:array<string>>"


class HashEncoder:
    """Unit vectors from hashed words; a stand-in for a language model with the same interface."""

    def __init__(self, dim: int):
        self.dim = dim

    def text_vecs(self, texts: list[str]) -> np.ndarray:
        import re

        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in enumerate(texts):
            for word in re.findall(r"[^\W_]+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[row, h % self.dim] += 1.0 if h >> 63 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class Request:
    """A query and how it is to be answered."""

    query: str
    top_k: int = 12
    kind: str = "all"
    after: str | None = None
    before: str | None = None
    path: str | None = None
    scopes: tuple[str, ...] = ()
    keyword_only: bool = False
    names_only: bool = False
    require_all: bool = False
    expansions: tuple[str, ...] = ()
    lexical_queries: tuple[str, ...] = ()
    semantic_queries: tuple[str, ...] = ()
    early: bool = False
    deep: bool = False
    rerank: bool = False
    rerank_limit: int = 36
    rerank_mix: float = 1.0
    deltas: bool = False
    max_seconds: float | None = None
    emit_seconds: float = 0.0

    def __post_init__(self) -> None:
        if not 1 <= self.top_k <= 200 or not 0 <= self.rerank_mix <= 1 or not 1 <= self.rerank_limit <= 200 or self.kind not in ("all", "text", "image", "file"):
            raise ValueError("invalid_request")
        for v in (self.variants("lexical"), self.variants("semantic")):
            if len(v) > 8:
                raise ValueError("too_many_variants")

    def variants(self, route: str) -> list[str]:
        """The wordings of one route: those given for it, or else the query and its expansions; each once."""
        own = self.lexical_queries if route == "lexical" else self.semantic_queries
        return [v for v in dict.fromkeys(own or (self.query, *self.expansions)) if v.strip()]

    @classmethod
    def of(cls, values: dict) -> Request:
        known = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known})


@dataclass
class Index:
    """One index below ``root``, a folder that the driver and all executors share."""

    spark: SparkSession
    root: str
    dim: int = 384
    encoder: object | None = None
    scorer: Callable[[list[tuple[str, str]]], list[float]] | None = None
    scopes: dict = field(default_factory=lambda: {"version": 1, "collections": {}})

    def __post_init__(self) -> None:
        ship(self.spark)
        self.store = Store(self.spark, self.root)
        self.encoder = self.encoder or HashEncoder(self.dim)

    # Tables

    def _empty(self, schema) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def _table(self, name: str, schema, manifest: dict) -> DataFrame:
        return self.store.table(name, manifest) if name in manifest["tables"] else self._empty(schema)

    def files(self, manifest: dict | None = None) -> DataFrame:
        return self._table("files", FILES, manifest or self.store.manifest())

    def chunks(self, manifest: dict | None = None) -> DataFrame:
        return self._table("chunks", CHUNKS, manifest or self.store.manifest())

    def state(self, manifest: dict | None = None) -> dict[str, str]:
        rows = self._table("state", "key string, value string", manifest or self.store.manifest()).collect()  # a few keys of this one index
        return {r.key: r.value for r in rows}

    # Upkeep

    def _encoded(self, passages: DataFrame) -> DataFrame:
        """``passages`` with vectors where they have none yet."""
        encoder = self.encoder

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = np.asarray(encoder.text_vecs(batch.column("text").to_pylist()), np.float32)
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(list(v), pa.list_(pa.float32()))], names=[*names, "embedding"])

        names = [c for c in passages.columns if c != "embedding"]
        todo = passages.where("embedding is null").drop("embedding")
        schema = StructType([*todo.schema.fields, StructField("embedding", ArrayType(FloatType()))])
        return passages.where("embedding is not null").select(*names, "embedding").unionByName(todo.mapInArrow(run, schema))

    def update(self, roots: list[str], *, names_only: bool = False, max_files: int = 0, excluded: tuple[str, ...] = (), devices: tuple[int, ...] | None = None, batch_files: int = 0) -> dict:
        """Brings the index up to date with the files below the roots; returns the run's figures.

        Unchanged files are left alone; vectors of identical twins are reused;
        files that can't be read stay in the catalogue by name; files that have
        vanished go, unless the walk had errors or was limited.  What has
        changed is published as one new version, or, with ``batch_files``, as
        one for so many files at a time: an update that is cut off goes on
        where it was, as what it has published is unchanged then.
        """
        staged: list = []
        try:
            with scratch(staged):
                walked = sources.walk(self.spark, roots, excluded=excluded, devices=devices, every=names_only)
                walked = stage(walked.orderBy("path").limit(max_files) if max_files else walked, "walk")
                figures = self._apply(walked, roots, names_only=names_only, limited=bool(max_files), most=batch_files)
                total = figures["changed"]
                while batch_files and figures["more"]:
                    figures = self._apply(walked, roots, names_only=names_only, limited=bool(max_files), most=batch_files, skip=figures["tried"])
                    total += figures["changed"]
        finally:
            discard(staged)
        return {k: v for k, v in {**figures, "changed": total}.items() if k not in ("more", "tried", "paths")}

    def _apply(self, walked: DataFrame, roots: list[str], *, names_only: bool = False, limited: bool = False, prune: bool = True, most: int = 0, skip: tuple[str, ...] = (), state_more: dict | None = None) -> dict:
        """Takes the changes of a walk in, or the first ``most`` of them that aren't to be skipped, and publishes them."""
        began = time.time()
        manifest = self.store.manifest()
        old_files, old_chunks = self.files(manifest), self.chunks(manifest)
        failed = walked.where("error is not null")
        seen = walked.where("error is null").dropDuplicates(["path"])
        todo = ingest.changed(seen.where(~paths.is_junk(F.col("path"))), old_files)
        more, tried = False, skip
        if most:
            todo = stage(todo.where(~F.col("path").isin(list(skip)) if skip else F.lit(True)).orderBy("path").limit(most + 1), "todo")
            more = todo.count() > most
            todo = todo.orderBy("path").limit(most)
        texts = todo.where(F.col("kind") == "text") if not names_only else todo.limit(0)
        read = stage(sources.texts(texts), "texts")
        rest = todo.join(read.select("path"), "path", "left_anti").drop("error", "errno")
        every = read.select("path", "root", "kind", "mime", "size", "mtime", F.when(F.col("error").isNull(), F.col("content_sig")).alias("content_sig"), "source_device", "content_hash").unionByName(
            rest.withColumn("content_sig", F.when(F.lit(names_only) & (F.col("kind") == "text"), None).otherwise(F.col("content_sig"))).withColumn("content_hash", F.lit(None).cast("string")).select("path", "root", "kind", "mime", "size", "mtime", "content_sig", "source_device", "content_hash")
        )
        known = every.join(old_files.select("path", "file_id"), "path", "left")
        state = self.state(manifest)
        high_file = max(int(state.get("file_high_water", 0)), old_files.agg(F.max("file_id")).first()[0] or 0)
        fresh = ingest.numbered(known.where("file_id is null").drop("file_id"), ["path"], high_file, "file_id")
        now = known.where("file_id is not null").unionByName(fresh).withColumn("indexed_at", F.lit(began)).withColumn("extractor", F.lit("text-v1"))
        now = stage(now.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in FILES)), "files")
        if most:
            # Files that can't be read would come again and again within this run; there are few of them.
            tried = (*skip, *(r.path for r in now.where("content_sig is null").select("path").collect()))

        cutter = read.where("error is null").join(now.select("path", "file_id"), "path")
        pieces = stage(cutter.select("file_id", F.posexplode(cut(F.col("text"))).alias("ordinal", "text")).withColumn("embedding", F.lit(None).cast("array<float>")), "pieces")
        high = max(int(state.get("chunk_high_water", 0)), old_chunks.agg(F.max("chunk_id")).first()[0] or 0)
        new_chunks = ingest.numbered(self._reused(pieces, now, old_files, old_chunks), ["file_id", "ordinal"], high)
        new_chunks = stage(self._encoded(new_chunks).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in CHUNKS)), "chunks")

        errors = failed.count()
        lost_files = old_files.limit(0)
        if prune and not errors and not limited and not more:
            lost_files = ingest.vanished(old_files, seen, list(map(str, roots)))
        lost_files = stage(lost_files.select("file_id", "path"), "vanished")
        refreshed = now.where((F.col("kind") == "text") & F.col("content_sig").isNotNull()).select("file_id")
        gone_ids = refreshed.unionByName(lost_files.select("file_id"))
        runs = self._table("runs", RUNS, manifest)
        run_id = (runs.agg(F.max("run_id")).first()[0] or 0) + 1
        lost = failed.select(F.lit(run_id).cast("long").alias("run_id"), F.lit("walk").alias("phase"), metrics.error_category(F.lit("OSError"), F.col("errno")).alias("category"), F.col("path").alias("target"))
        unread = read.where("error is not null").select(F.lit(run_id).cast("long").alias("run_id"), F.lit("extract").alias("phase"), F.col("error").alias("category"), F.col("path").alias("target"))
        figures = {"run_id": run_id, "files": seen.count(), "changed": now.count(), "errors": errors, "limited": limited}
        row = [(run_id, began, time.time(), list(map(str, roots)), figures["files"], figures["changed"], errors, limited)]
        top = new_chunks.agg(F.max("chunk_id")).first()[0] or high
        top_file = now.agg(F.max("file_id")).first()[0] or high_file
        kept = {**state, "index_id": state.get("index_id") or uuid.uuid4().hex, "chunk_high_water": str(max(high, top)), "file_high_water": str(max(high_file, top_file)), "last_build_started": str(began), "last_build_finished": str(time.time()), "last_build_errors": str(errors), **(state_more or {})}
        tokenised = stage(lexical.tokenized(new_chunks, "file_id"), "tokens")
        self.store.publish(
            {"state": self.spark.createDataFrame(sorted(kept.items()), "key string, value string")},
            deltas={
                "files": Delta("path", now.select("path").unionByName(lost_files.select("path")), now),
                "chunks": Delta("file_id", gone_ids, new_chunks),
                "postings": Delta("file_id", gone_ids, lexical.by_term(lexical.postings_of(tokenised, "file_id")).select(*_names(POSTINGS))),
                "lengths": Delta("file_id", gone_ids, tokenised.select(*_names(LENGTHS))),
                "runs": Delta("run_id", None, self.spark.createDataFrame(row, RUNS)),
                "failures": Delta("run_id", None, lost.unionByName(unread)),
            },
            base=manifest,
        )
        return {**figures, "more": more, "tried": tried, "paths": [r.path for r in now.where("content_sig is not null").select("path").limit(REPAIRED_FILES + 1).collect()]}

    @staticmethod
    def _reused(pieces: DataFrame, now: DataFrame, old_files: DataFrame, old_chunks: DataFrame) -> DataFrame:
        """The new passages with the vectors of a file that has the same bytes, extractor and passages, where there is one."""
        twins = old_files.join(now.select("content_hash").where("content_hash is not null").distinct(), "content_hash", "left_semi").join(now.select("file_id"), "file_id", "left_anti")
        own = now.select("file_id", "content_hash", "extractor")
        passages = pieces.select("file_id", "ordinal", "text", "embedding").unionByName(old_chunks.join(twins, "file_id", "left_semi").select("file_id", "ordinal", "text", "embedding"))
        donors = ingest.reusable_vectors(own.unionByName(twins.select("file_id", "content_hash", "extractor")), passages).join(own.select("file_id"), "file_id", "left_semi")
        given = donors.join(old_chunks.select(F.col("file_id").alias("donor_id"), "ordinal", F.col("embedding").alias("given")), "donor_id").select("file_id", "ordinal", "given")
        return pieces.join(given, ["file_id", "ordinal"], "left").select("file_id", "ordinal", "text", F.col("given").alias("embedding"))

    def import_bundle(self, source: str, *, model: str, root: str) -> dict:
        """Adds the passages and vectors of a bundle as files below ``root``; paths that are in the catalogue already are left alone."""
        staged: list = []
        try:
            with scratch(staged):
                manifest = self.store.manifest()
                state = self.state(manifest)
                rows = stage(new_of_bundle(bundle(self.spark, source, model=model, dim=self.dim), self.files(manifest), root), "bundle")
                p = F.col("path")
                named = rows.select("path").distinct()
                fresh = ingest.numbered(named, ["path"], int(state.get("file_high_water", 0)), "file_id")
                files = fresh.withColumn("root", F.lit(root)).withColumn("kind", F.lit("text")).withColumn("mime", paths.mime_of(p)).withColumn("indexed_at", F.lit(time.time())).withColumn("extractor", F.lit("bundle"))
                files = stage(conform(files, FILES), "files")
                chunks = ingest.numbered(rows.join(files.select("path", "file_id"), "path").select("file_id", "ordinal", "text", "embedding"), ["file_id", "ordinal"], int(state.get("chunk_high_water", 0)))
                chunks = stage(conform(chunks, CHUNKS), "chunks")
                tokenised = stage(lexical.tokenized(chunks, "file_id"), "tokens")
                tops = [files.agg(F.max("file_id")).first()[0] or int(state.get("file_high_water", 0)), chunks.agg(F.max("chunk_id")).first()[0] or int(state.get("chunk_high_water", 0))]
                kept = {**state, "index_id": state.get("index_id") or uuid.uuid4().hex, "file_high_water": str(tops[0]), "chunk_high_water": str(tops[1])}
                figures = {"files": files.count(), "chunks": chunks.count()}
                self.store.publish(
                    {"state": self.spark.createDataFrame(sorted(kept.items()), "key string, value string")},
                    deltas={
                        "files": Delta("path", None, files), "chunks": Delta("file_id", None, chunks),
                        "postings": Delta("file_id", None, lexical.by_term(lexical.postings_of(tokenised, "file_id")).select(*_names(POSTINGS))), "lengths": Delta("file_id", None, tokenised.select(*_names(LENGTHS))),
                    },
                    base=manifest,
                )
                return figures
        finally:
            discard(staged)

    def repair_truncated(self) -> int:
        """Clears the signature of files whose first passage is missing, so that the next update reads them; returns how many."""
        manifest = self.store.manifest()
        files = self.files(manifest)
        fixed = ingest.repaired(files, self.chunks(manifest)).join(files.where("content_sig is not null").select("path"), "path", "left_semi").where("content_sig is null")
        n = fixed.count()
        if n:
            self.store.publish(deltas={"files": Delta("path", fixed.select("path"), fixed.select(FILES.fieldNames()))}, base=manifest)
        return n

    def build_matrix(self, dtype: str = "int8", *, full: bool = False) -> dict:
        """Compresses the valid vectors of files that aren't junk, as the tables ``matrix``, ``scale`` and ``matrix_head``.

        A matrix of the same kind is continued with the vectors that are newer
        than it, by its own scale; otherwise, or with ``full``, it is made anew.
        """
        manifest = self.store.manifest()
        rows = self._vectors(manifest)
        head = self.store.table("matrix_head", manifest).first() if "matrix_head" in manifest["tables"] else None
        identity = (dtype, self.dim, self.state(manifest).get("index_id", ""), FORMATS[dtype], FILTER_VERSION)
        mark = int(rows.agg(F.max("chunk_id")).first()[0] or 0)
        onward = not full and head is not None and tuple(head[1:]) == identity
        new_head = self.spark.createDataFrame([(max(mark, head.db_max_rowid if onward else 0), *identity)], "db_max_rowid long, dtype string, dim int, index_id string, format int, filter_version string")
        if onward:
            added = rows.where(F.col("chunk_id") > head.db_max_rowid)
            codes = semantic.quantized(added, semantic.scale_vector(self.store.table("scale", manifest)), dtype)
            codes = codes.select("chunk_id", "file_id", "codes" if dtype == "fp16" else F.col("codes").cast("array<tinyint>").alias("codes"))
            m = self.store.publish({"matrix_head": new_head}, deltas={"matrix": Delta("chunk_id", None, codes)}, base=manifest)
        else:
            codes, _ = semantic.matrix(rows, mark, dtype, self.dim)
            m = self.store.publish({"matrix": codes, "scale": semantic.scale_of(rows, self.dim), "matrix_head": new_head}, base=manifest)
        return {"rows": sum(part["rows"] for part in m["tables"]["matrix"]["parts"]), "dtype": dtype, "db_max_rowid": max(mark, head.db_max_rowid if onward else 0), "continued": onward}

    def build_candidates(self) -> dict:
        """Fits the cells of the early tier and stores the vectors by cell, with the identity of the index."""
        staged: list = []
        try:
            with scratch(staged):
                manifest = self.store.manifest()
                cells = semantic.build_cells(self._vectors(manifest), dim=self.dim)
                head = self.spark.createDataFrame([(self.dim, self.state(manifest).get("index_id", ""))], "dim int, index_id string")
                m = self.store.publish({"cells": cells.rows, "cell_centres": cells.centres, "cell_sample": cells.sample, "cell_head": head}, base=manifest)
                return {"rows": m["tables"]["cells"]["parts"][0]["rows"], "cells": m["tables"]["cell_centres"]["parts"][0]["rows"]}
        finally:
            discard(staged)

    def upgrade_metadata(self) -> dict:
        """Fills unknown devices in by the main device of the file's root; returns the counts."""
        files, counts = ingest.backfill_device(self.files(), ingest.main_device(self.files()))
        figures = counts.first().asDict()
        self.store.publish({"files": files.select(FILES.fieldNames())})
        return figures

    def record(self, counters: DataFrame) -> None:
        """Adds counters (``mode, metric, value``) to those that are stored."""
        manifest = self.store.manifest()
        self.store.publish({"counters": metrics.merge_counters(self._table("counters", COUNTERS, manifest), counters.select("mode", "metric", "value"))}, base=manifest)

    def counters(self) -> DataFrame:
        return self._table("counters", COUNTERS, self.store.manifest())

    def failures(self, run_id: int | None = None) -> DataFrame:
        """``run_id, phase, category, target`` of one run, or of all."""
        rows = self._table("failures", FAILURES, self.store.manifest())
        return rows if run_id is None else rows.where(F.col("run_id") == run_id)

    # Search

    def _vectors(self, manifest: dict) -> DataFrame:
        kept = self.files(manifest).where(~paths.is_junk(F.col("path"))).select("file_id")
        return semantic.valid_vectors(self.chunks(manifest), self.dim).join(kept, "file_id", "left_semi")

    def _matrix(self, manifest: dict, allowed: DataFrame) -> DataFrame | None:
        """Compressed vectors with the tail of newer ones; None without a matrix. A matrix of another index or shape is refused."""
        if "matrix" not in manifest["tables"]:
            return None
        head = self.store.table("matrix_head", manifest).first()
        if head.dim != self.dim or head.index_id != self.state(manifest).get("index_id", ""):
            raise ValueError("matrix_identity")
        if FORMATS.get(head.dtype) != head.format or head.filter_version != FILTER_VERSION:
            raise ValueError("matrix_format")
        scale = semantic.scale_vector(self.store.table("scale", manifest))
        live = self.chunks(manifest).select("chunk_id", "file_id").join(allowed, "file_id", "left_semi")
        old = semantic.dequantized(self.store.table("matrix", manifest).join(live.select("chunk_id"), "chunk_id", "left_semi"), scale, head.dtype).select("chunk_id", "file_id", "v")
        new = self._vectors(manifest).where(F.col("chunk_id") > head.db_max_rowid).join(allowed, "file_id", "left_semi").select("chunk_id", "file_id", "v")
        return old.unionByName(new)

    def _cells(self, manifest: dict) -> semantic.Cells | None:
        """The early tier as it was built; None without one. That of another index or dimension is refused."""
        if "cells" not in manifest["tables"]:
            return None
        head = self.store.table("cell_head", manifest).first()
        if head.dim != self.dim or head.index_id != self.state(manifest).get("index_id", ""):
            raise ValueError("candidates_identity")
        return semantic.Cells(*(self.store.table(n, manifest) for n in ("cells", "cell_centres", "cell_sample")))

    def _reranked(self, request: Request, fused: DataFrame, lists: DataFrame, files: DataFrame, passages: DataFrame) -> DataFrame:
        base = fusion.dedup(fused, files, request.rerank_limit)
        brought = lists.where("chunk_id is not null").select("qid", "path", "chunk_id").distinct().join(base.select("qid", "path"), ["qid", "path"], "left_semi")
        few = brought.withColumn("nth", F.row_number().over(Window.partitionBy("qid", "path").orderBy("chunk_id"))).where("nth <= 4").join(passages.select("chunk_id", "text"), "chunk_id")
        scorer, query = self.scorer, request.query

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pairs = [(query, t) for t in batch.column("text").to_pylist()]
                scores = [float(s) for s in scorer(pairs)] if pairs else []
                if len(scores) != len(pairs) or not all(map(np.isfinite, scores)):
                    raise ValueError("invalid_reranker_scores")
                yield pa.RecordBatch.from_arrays([batch.column("qid"), batch.column("path"), batch.column("chunk_id"), pa.array(scores, pa.float64())], names=["qid", "path", "chunk_id", "relevance"])

        scored = few.select("qid", "path", "chunk_id", "text").mapInArrow(run, "qid long, path string, chunk_id long, relevance double")
        new = fusion.rerank_blend(base, scored, request.rerank_mix, request.top_k).select("qid", "path", F.col("chunk_id").alias("cid"), F.col("new_place").alias("np"), "ranking_score")
        out = base.join(new, ["qid", "path"])
        return out.withColumn("chunk_id", F.col("cid")).withColumn("place", F.col("np")).withColumn("score", F.col("ranking_score")).drop("cid", "np", "ranking_score")

    def stream(self, request: Request, *, cancelled: Callable[[], bool] = lambda: False, tag: str | None = None) -> Iterator[dict]:
        """Events with ever better results, as _stages gives them.

        A search whose running jobs were ended by its tag because it was
        cancelled keeps the results that it had.
        """
        tag = tag or f"search-{uuid.uuid4().hex}"
        last: dict = {"sequence": 0, "results": [], "elapsed_seconds": 0.0}
        staged: list = []
        self.spark.sparkContext.addJobTag(tag)
        stages = self._stages(request, cancelled)
        end = lambda stage, reason: {**last, "sequence": last["sequence"] + 1, "stage": stage, "complete": False, "reason": reason, "changes": {"added": [], "updated": [], "removed": [], "order": [r["result_id"] for r in last["results"]]}}
        try:
            while True:
                with scratch(staged):
                    e = next(stages, None)
                if e is None:
                    return
                last = e
                yield e
        except Exception as x:
            if cancelled():
                yield end("cancelled", "cancelled")
            else:
                yield end("failed", type(x).__name__)
                raise
        finally:
            discard(staged)
            self.spark.sparkContext.removeJobTag(tag)

    def _stages(self, request: Request, cancelled: Callable[[], bool]) -> Iterator[dict]:
        """Events with ever better results: keyword, encoding, candidates, reranked_early, semantic, refined, deep, reranked,
        and at last done, or cancelled.  With ``emit_seconds``, stages that come sooner after the one before are left out.

        All stages read one version of the tables.  When the search is
        cancelled or its time is over, the last results stay and are said to be
        incomplete.
        """
        began, sequence, previous, shown_at = time.time(), 0, {}, -1e9
        results: list[dict] = []
        progress: dict[str, int] = {}
        manifest = self.store.manifest()
        top = request.top_k
        pool = fusion.pool_size(max(top, request.rerank_limit if request.rerank else top))
        scopes = admitted(list(request.scopes), self.scopes) if request.scopes else []
        files = self.files(manifest)
        allowed = catalog.filtered(files, kind=request.kind, after=catalog.epoch(request.after) if request.after else None, before=catalog.epoch(request.before, end=True) if request.before else None, prefix=request.path)
        allowed = catalog.scoped(allowed, scopes) if scopes else allowed
        passages = self.chunks(manifest)

        def why() -> str | None:
            if cancelled():
                return "cancelled"
            return "budget_exhausted" if request.max_seconds is not None and time.time() - began > request.max_seconds else None

        def event(name: str, *, complete: bool = False, reason: str | None = None) -> dict:
            nonlocal sequence, previous, shown_at
            shown_at = time.time()
            sequence += 1
            now = {r["result_id"]: r for r in results}
            changes = {"added": [k for k in now if k not in previous], "updated": [k for k in now if k in previous and now[k] != previous[k]], "removed": [k for k in previous if k not in now], "order": list(now)}
            shown = results if not request.deltas else [now[k] for k in (*changes["added"], *changes["updated"])]
            previous = now
            return {"sequence": sequence, "stage": name, "elapsed_seconds": round(time.time() - began, 3), "complete": complete, "reason": reason, "results": shown, "changes": changes, "progress": dict(progress)}

        def due() -> bool:
            return time.time() - shown_at >= request.emit_seconds

        def last_event(complete: bool, reason: str | None) -> dict:
            return event("cancelled" if reason == "cancelled" else "done", complete=complete, reason=reason)

        def collect(df: DataFrame) -> list[dict]:
            """At most top_k rows, with their text; one whose passage has gone since is left out, after it has stood for its identity."""
            rows = df.where(F.col("place") <= top).join(passages.select("chunk_id", F.col("text").alias("snippet"), F.lit(True).alias("there")), "chunk_id", "left").where("chunk_id is null or there").orderBy("place")
            return [{k: r[k] for k in ("place", "result_id", "path", "chunk_id", "score", "match", "snippet")} for r in rows.collect()]

        def lists(df: DataFrame, first: int, source: str) -> DataFrame:
            numbered = df.withColumn("list_no", F.lit(first) + F.col("qid").cast("int")).withColumn("source", F.lit(source)).withColumn("qid", F.lit(0).cast("long"))
            return numbered.select("qid", "list_no", "source", "chunk_id", "path", "kind", "mtime", "mime", "rk")

        wordings = request.variants("lexical")
        queries = self.spark.createDataFrame([(i, w) for i, w in enumerate(wordings)], "qid long, text string")
        if request.names_only:
            hits = catalog.filename_hits(allowed, queries, limit=pool, require_all=request.require_all)
            ranked = hits.withColumn("chunk_id", F.lit(None).cast("long")).withColumn("rk", F.row_number().over(Window.partitionBy("qid").orderBy("path")))
        else:
            stats = lexical.corpus_stats(self._table("lengths", LENGTHS, manifest)).first()
            scored = lexical.bm25(self._table("postings", POSTINGS, manifest), stats, queries, require_all=request.require_all)
            ranked = lexical.best_of_files(scored, passages, allowed, pool)
        words = stage(lists(ranked, 0, "keyword"), "keyword")
        results = collect(fusion.dedup(fusion.fuse(words), files, top))
        yield event("keyword")
        if request.names_only or request.keyword_only or (reason := why()):
            only_words = request.names_only or request.keyword_only
            yield last_event(only_words, None if only_words else reason)
            return
        meant = request.variants("semantic")
        if due():
            yield event("encoding")
        q = np.asarray(self.encoder.text_vecs(meant), np.float64)
        if q.shape != (len(meant), self.dim) or not np.isfinite(q).all():
            raise ValueError("invalid_query_vectors")
        vqs = self.spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "qid long, q array<double>")
        ids = allowed.select("file_id")
        exact = self._vectors(manifest).join(ids, "file_id", "left_semi")
        scan = lambda rows: semantic.cosine_scan(rows, vqs, dim=self.dim, keep=pool, group="file_id")
        best = lambda scores: lexical.best_of_files(scores, passages, allowed, pool)

        def watched(rows: DataFrame, name: str) -> DataFrame:
            """``rows``, whose number is noted as the stage's progress once it has run."""
            seen = Observation(name)
            observations[name] = seen
            return rows.observe(seen, F.count("*").alias("visited"))

        observations: dict[str, Observation] = {}
        cells = self._cells(manifest) if request.early and not why() else None
        if cells is not None:
            early = semantic.cell_candidates(cells, vqs, dim=self.dim, keep=max(500, 4 * pool), allowed=ids).join(passages.select("chunk_id"), "chunk_id", "left_semi")
            near = stage(lists(best(early), len(wordings), "semantic"), "near")
            both = words.unionByName(near)
            results = collect(fusion.dedup(fusion.fuse(both), files, top))
            if due():
                yield event("candidates")
            if request.rerank and self.scorer and not why():
                results = collect(self._reranked(request, fusion.fuse(both), both, files, passages))
                if due():
                    yield event("reranked_early")
        matrix = self._matrix(manifest, ids)
        scores = stage(scan(watched(matrix if matrix is not None else exact, "semantic")), "semantic")
        progress["visited"] = observations["semantic"].get["visited"]
        near = stage(lists(best(scores), len(wordings), "semantic"), "near")
        both = words.unionByName(near)
        results = collect(fusion.dedup(fusion.fuse(both), files, top))
        if due():
            yield event("semantic")
        if matrix is not None and not why():
            scores = stage(semantic.refined(exact, vqs, both.select("chunk_id"), dim=self.dim, keep=pool, group="file_id"), "refined")
            near = stage(lists(best(scores), len(wordings), "semantic"), "near")
            both = words.unionByName(near)
            results = collect(fusion.dedup(fusion.fuse(both), files, top))
            if due():
                yield event("refined")
        if request.deep and not why():
            scores = scores.unionByName(scan(exact)).distinct()
            both = words.unionByName(stage(lists(best(scores), len(wordings), "semantic"), "near"))
            results = collect(fusion.dedup(fusion.fuse(both), files, top))
            if due():
                yield event("deep")
        if request.rerank and self.scorer and not why():
            results = collect(self._reranked(request, fusion.fuse(both), both, files, passages))
            if due():
                yield event("reranked")
        reason = why()
        yield last_event(reason is None, reason)

    def search(self, request: Request) -> list[dict]:
        """The final results."""
        last: list[dict] = []
        for e in self.stream(Request.of({**asdict(request), "deltas": False})):
            last = e["results"]
        return last

    # Jobs

    def submit(self, request: Request) -> str:
        """Writes a search down as a job, which work() runs, here or in another process; its events are kept one file each, under its folder."""
        job = uuid.uuid4().hex
        self.store.write_text(f"{self.root}/jobs/{job}/request.json", json.dumps(asdict(request)))
        self.store.write_text(f"{self.root}/jobs/{job}/state.json", json.dumps({"state": "starting"}))
        return job

    def work(self, job: str) -> None:
        """Runs a job that submit() wrote down."""
        base = self._job(job)
        request = Request.of(json.loads(self.store.read_text(f"{base}/request.json")))
        state = "done"
        try:
            self.store.write_text(f"{base}/state.json", json.dumps({"state": "running"}))
            for e in self.stream(request, cancelled=lambda: self.store.exists(f"{base}/cancel"), tag=f"job-{job}"):
                self.store.write_text(f"{base}/events/{e['sequence']:06d}.json", json.dumps(e) + "\n")
                state = "cancelled" if e["reason"] == "cancelled" else "failed" if e["stage"] == "failed" else "done"
        except Exception as x:  # noqa: BLE001  the job's state tells it
            state = "failed"
            self.store.write_text(f"{base}/error.json", json.dumps({"error": type(x).__name__}))
        self.store.write_text(f"{base}/state.json", json.dumps({"state": state}))

    def start(self, request: Request) -> str:
        """Runs a search in the background of this process."""
        job = self.submit(request)
        threading.Thread(target=self.work, args=(job,), daemon=True).start()
        return job

    def _job(self, job: str) -> str:
        if len(job) != 32 or not all(c in "0123456789abcdef" for c in job):
            raise ValueError("invalid_job")
        base = f"{self.root}/jobs/{job}"
        if not self.store.exists(f"{base}/state.json"):
            raise ValueError("unknown_job")
        return base

    def poll(self, job: str, after: int = 0, limit: int = 32) -> dict:
        """The next events of a job after a cursor, its state, and the next cursor."""
        base = self._job(job)
        state = json.loads(self.store.read_text(f"{base}/state.json") or '{"state": "running"}')["state"]
        found: list[dict] = []
        while len(found) < min(limit, 100) and (text := self.store.read_text(f"{base}/events/{after + len(found) + 1:06d}.json")):
            found.append(json.loads(text))
        return {"state": state, "events": found, "next": after + len(found)}

    def cancel(self, job: str) -> None:
        """Durable, also for a job of another driver; jobs that run on this one are ended at once."""
        self.store.write_text(f"{self._job(job)}/cancel", "1")
        self.spark.sparkContext.cancelJobsWithTag(f"job-{job}")

    def job_events(self, job: str) -> DataFrame:
        """All events of a job as a table; an event that is cut off is left out."""
        return self.spark.read.schema(EVENT).option("mode", "DROPMALFORMED").json(f"{self._job(job)}/events")

    # Reports

    def status(self) -> dict:
        """Counts of the current version and whether the last update was complete."""
        m = self.store.manifest()
        state = self.state(m)
        runs = metrics.run_summaries(self._table("runs", RUNS, m), self._table("failures", FAILURES, m)).collect()
        return {"version": m["version"], "files": self.files(m).count(), "chunks": self.chunks(m).count(), "index_id": state.get("index_id"), "chunk_high_water": int(state.get("chunk_high_water", 0)), "runs": [r.asDict() for r in runs]}

    def stats(self) -> dict:
        """Sizes: files by kind, passages, tokens, vectors, and the bytes below the index's folder."""
        m = self.store.manifest()
        kinds = {r.kind: r.n for r in self.files(m).groupBy("kind").agg(F.count("*").alias("n")).collect()}
        words = lexical.corpus_stats(self._table("lengths", LENGTHS, m)).first()
        vectors = self.chunks(m).agg(F.count("embedding")).first()[0]
        space = sources.footprint(self.spark, self.root).first()
        return {"files": kinds, "passages": words.n, "tokens": words.tokens or 0, "vectors": vectors, "stored_files": space.files, "stored_bytes": space.bytes}

    def verify(self, every: int = 50, k: int = 30, least: float = 0.9) -> dict:
        """Recall of the compressed vectors against the stored ones, with every so-manieth stored vector as a query, VERIFIED_QUERIES of them at most."""
        m = self.store.manifest()
        exact = self._vectors(m)
        matrix = self._matrix(m, self.files(m).select("file_id"))
        if matrix is None:
            raise ValueError("no_matrix")
        chosen = exact.where(F.col("chunk_id") % every == 0).orderBy(F.xxhash64("chunk_id")).limit(VERIFIED_QUERIES)
        queries = chosen.select(F.col("chunk_id").alias("qid"), F.col("v").alias("q"))
        top = lambda rows: semantic.top_passages(semantic.cosine_scan(rows, queries, dim=self.dim, keep=k), k)
        mean = semantic.recall(top(exact), top(matrix)).agg(F.avg("recall")).first()[0]
        return {"recall": mean, "passed": mean is None or mean >= least}

    def compare(self, other: Index) -> dict:
        """Shared paths and paths of one side only."""
        return ingest.overlap(self.files(), other.files(), "path").first().asDict()

    def shadow(self, other: Index, request: Request, *, timeout: float | None = None) -> DataFrame:
        """``mode, metric, value``: the same search on two indexes at once, as additive counters without any text or path.

        Each side has an outcome (ok, failed, timeout) and, if it is ok, its
        seconds and the class of latency they are in; what concerns both is
        counted only if both are ok.
        """
        seconds, ids, outcome = {}, {}, {"first": "timeout", "second": "timeout"}
        tags = {name: f"shadow-{uuid.uuid4().hex}" for name in outcome}
        late: set[str] = set()

        def run(name: str, index: Index) -> None:
            began = time.time()
            found: list[dict] = []
            try:
                for e in index.stream(request, cancelled=lambda: name in late, tag=tags[name]):
                    found = e["results"]
                if name not in late:
                    ids[name], seconds[name], outcome[name] = [r["result_id"] for r in found], time.time() - began, "ok"
            except Exception:  # noqa: BLE001  the outcome tells it
                outcome[name] = "failed"

        threads = {name: threading.Thread(target=run, args=(name, index), daemon=True) for name, index in (("first", self), ("second", other))}
        end = time.time() + timeout if timeout is not None else None
        for t in threads.values():
            t.start()
        for name, t in threads.items():
            t.join(None if end is None else max(0.0, end - time.time()))
            if t.is_alive():
                late.add(name)
                self.spark.sparkContext.cancelJobsWithTag(tags[name])
        values = {f"{n}_outcome_{o}": 1.0 for n, o in outcome.items()}
        for n in ids:
            bucket = next((i for i, bound in enumerate(metrics.LATENCY_BOUNDS) if seconds[n] <= bound), len(metrics.LATENCY_BOUNDS))
            values |= {f"{n}_seconds_sum": seconds[n], f"{n}_count_sum": float(len(ids[n])), f"{n}_latency_bucket_{bucket}": 1.0}
        if len(ids) == 2:
            a, b = set(ids["first"]), set(ids["second"])
            values |= {"paired": 1.0, "overlap_sum": len(a & b) / len(a | b) if a | b else 1.0, "same_first": float(bool(a and b and ids["first"][0] == ids["second"][0]))}
        return self.spark.createDataFrame([("hybrid", k, v) for k, v in values.items()], COUNTERS)

    def repair(self, hits: list[str], *, limit: int = REPAIRED_FILES, admit: Callable[[str], bool] = lambda path: True, encoder: object | None = None) -> list[str]:
        """Reads a bounded number of files again and takes in what has changed; returns the paths of those.

        Half of them are among the hits of a search, half come from a sample that
        rotates through the catalogue, by a cursor that the index keeps; small
        text files on their known device only, and only those that ``admit``
        lets pass.  Nothing is pruned.  ``encoder`` stands in for the index's own.
        """
        staged: list = []
        worker = self if encoder is None else Index(self.spark, self.root, self.dim, encoder, self.scorer, self.scopes)
        try:
            with scratch(staged):
                manifest = self.store.manifest()
                cursor = int(self.state(manifest).get("refresh_cursor", 0))
                chosen, following = ingest.refresh_candidates(self.files(manifest), hits, cursor, limit, REPAIRED_BYTES)
                known = {r.path: r for r in chosen.collect() if admit(r.path)}
                if not known:
                    return []
                walked = stage(sources.walk(self.spark, list(known)).where("error is null").drop("root").join(F.broadcast(self.spark.createDataFrame([(r.path, r.root, r.source_device) for r in known.values()], "path string, root string, device long")), "path").where(f"size <= {REPAIRED_BYTES} and (device is null or device = source_device)").drop("device"), "walk")
                return worker._apply(walked, sorted({r.root for r in known.values() if r.root}), prune=False, state_more={"refresh_cursor": str(following)})["paths"]
        finally:
            discard(staged)

    def search_with_refresh(self, request: Request, *, limit: int = REPAIRED_FILES, admit: Callable[[str], bool] = lambda path: True, encoder: object | None = None) -> Iterator[dict]:
        """A search, beside which a bounded number of files is repaired, and the search again if that changed anything.

        The repair begins with the hits of the keyword stage and runs while the
        search goes on; if it fails, the search's own results stand.
        """
        changed: list[str] = []

        def work(hits: list[str]) -> None:
            with suppress(Exception):
                changed.extend(self.repair(hits, limit=limit, admit=admit, encoder=encoder))

        thread = None
        for e in self.stream(request):
            if thread is None:
                thread = threading.Thread(target=work, args=([r["path"] for r in e["results"]],), daemon=True)
                thread.start()
            yield e
        if thread is not None:
            thread.join()
        if changed:
            for e in self.stream(request):
                yield {**e, "refreshed": True}


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def guidance(query: str) -> str | None:
    """A hint for long queries: keywords and meaning are better asked apart."""
    import re

    return "split_lexical_and_semantic" if len(re.findall(r"[\w-]+", query)) > 12 else None


__all__ = ["HashEncoder", "Index", "Request", "guidance"]
