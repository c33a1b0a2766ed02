"""Vector retrieval: exhaustive and compressed cosine scans, refinement, calibration of the compression, recall."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..runtime import stage
from .batches import Best

#: Query vectors that go to the executors at once.
BLOCK = 2048
SCALE_MARGIN = 1.10
LEVELS = {"int8": 127, "int4": 7}


def valid_vectors(passages: DataFrame, dim: int) -> DataFrame:
    """``chunk_id, file_id, v``: the vectors of the right length with finite values only, as doubles."""
    return passages.where(vectors.is_valid(F.col("embedding"), dim)).select("chunk_id", "file_id", vectors.as_doubles(F.col("embedding")).alias("v"))


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), vectors.NORM_FLOOR)


def cosine_scan(rows: DataFrame, queries: DataFrame, *, dim: int, keep: int, group: str | None = None, digits: int = 6, named: bool = False) -> DataFrame:
    """``qid, chunk_id, score``: cosines of a stated set of queries (``qid, q``) with all rows (``chunk_id, v`` and ``group``).

    One pass over the rows serves a block of queries.  Every task hands on the
    best ``keep`` groups (or rows, without ``group``) of each query only, ties
    included, so that the exchange doesn't grow with the rows that can't win.
    ``named``: with the group as ``file_id``.
    """
    shape = "qid long, chunk_id long, score double" + ", file_id long" * named
    columns = ["chunk_id", "v"] + ([group] if group else [])
    parts: list[DataFrame] = []
    block: list = []

    def scan(block: list) -> DataFrame:
        ids = np.array([r.qid for r in block], np.int64)
        q = rows.sparkSession.sparkContext.broadcast(_unit(np.array([r.q for r in block], np.float64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top = Best(len(ids), keep)
            for batch in batches:
                if not batch.num_rows:
                    continue
                m = _unit(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
                score = np.round(m @ q.value.T, digits).T
                best, chunk = score, batch.column("chunk_id").to_numpy(zero_copy_only=False)
                groups = batch.column(group).to_numpy(zero_copy_only=False) if group else chunk
                if group:
                    owner, at = np.unique(groups, return_inverse=True)
                    order = np.argsort(at, kind="stable")
                    best = np.maximum.reduceat(score[:, order], np.searchsorted(at[order], np.arange(len(owner))), axis=1)
                n = min(keep, best.shape[1])
                least = -np.partition(-best, n - 1, axis=1)[:, n - 1]
                good = score >= np.maximum(least, top.least)[:, None]
                if group:
                    good &= score == best[:, at]
                which, row = np.nonzero(good)
                top.add(which, groups[row], chunk[row], score[which, row])
            which, file, chunk, score = top.rows()
            for a in range(0, len(which), 100_000):
                z = slice(a, a + 100_000)
                columns = {"qid": ids[which[z]], "chunk_id": chunk[z], "score": score[z], "file_id": file[z]}
                yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items() if named or k != "file_id"})

        return rows.select(*columns).mapInArrow(run, shape)

    for row in queries.select(F.col("qid").cast("long"), vectors.as_doubles(F.col("q")).alias("q")).where(vectors.is_valid(F.col("q"), dim)).toLocalIterator():
        block.append(row)
        if len(block) == BLOCK:
            parts.append(scan(block))
            block = []
    if block or not parts:
        parts.append(scan(block) if block else rows.sparkSession.createDataFrame([], shape))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def top_passages(scores: DataFrame, k: int) -> DataFrame:
    """``qid, chunk_id, score, rk``: the k best passages of each query, ties by the smaller id."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")
    return scores.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k)


def scale_of(rows: DataFrame, dim: int) -> DataFrame:
    """``dim, scale``: per dimension the greatest absolute value of the unit vectors with a margin, 1 for none."""
    peak = rows.select(F.posexplode(vectors.normalized(F.col("v"))).alias("dim", "x")).groupBy("dim").agg(F.max(F.abs("x")).alias("m"))
    return peak.select("dim", F.when(F.col("m") == 0, 1.0).otherwise(F.col("m") * SCALE_MARGIN).alias("scale"))


def scale_vector(scale: DataFrame) -> DataFrame:
    """The scale as one array in one row."""
    return scale.agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "scale"))), lambda x: x["scale"]).alias("scale"))


def _half(rows: DataFrame, source: str, target: str, packing: bool) -> DataFrame:
    """Vectors as bytes of 16-bit floats, the format of the first version, and back."""
    names = [c for c in rows.columns if c not in (source, target)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(source).to_pylist()
            if packing:
                out = pa.array([None if x is None else np.asarray(x, "<f2").tobytes() for x in given], pa.binary())
            else:
                out = pa.array([None if x is None else np.frombuffer(x, "<f2").astype(np.float64) for x in given], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), out], names=[*names, target])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema)
    return rows.select(*names, source).mapInArrow(run, f"{kept}, {target} {'binary' if packing else 'array<double>'}")


def quantized(rows: DataFrame, scale: DataFrame, dtype: str) -> DataFrame:
    """``rows`` with ``codes``: the unit vector in int8 or int4 levels of the scale (a one-row DataFrame), or as fp16, which needs none."""
    if dtype == "fp16":
        return _half(rows.withColumn("v", vectors.normalized(F.col("v"))), "v", "codes", True)
    with_scale = rows.withColumn("__scale", scale.select("scale").scalar())
    return with_scale.withColumn("codes", vectors.quantize(vectors.normalized(F.col("v")), F.col("__scale"), LEVELS[dtype])).drop("__scale")


def dequantized(rows: DataFrame, scale: DataFrame, dtype: str) -> DataFrame:
    if dtype == "fp16":
        return _half(rows, "codes", "v", False)
    return rows.withColumn("__scale", scale.select("scale").scalar()).withColumn("v", vectors.dequantize(F.col("codes"), F.col("__scale"), LEVELS[dtype])).drop("__scale")


def matrix(rows: DataFrame, watermark: int, dtype: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """The compressed vectors up to the watermark (``chunk_id, file_id, codes``) and their scale, as an index stores them."""
    old = rows.where(F.col("chunk_id") <= watermark)
    scale = scale_vector(scale_of(old, dim))
    codes = quantized(old, scale, dtype).select("chunk_id", "file_id", "codes")
    return codes if dtype == "fp16" else codes.withColumn("codes", F.col("codes").cast("array<tinyint>")), scale


def with_tail(codes: DataFrame, scale: DataFrame, dtype: str, rows: DataFrame, watermark: int) -> DataFrame:
    """``chunk_id, file_id, v``: the compressed vectors, and the stored ones of ids after the watermark."""
    cached = dequantized(codes, scale, dtype).select("chunk_id", "file_id", "v")
    return cached.unionByName(rows.where(F.col("chunk_id") > watermark).select("chunk_id", "file_id", "v"))


def refined(rows: DataFrame, queries: DataFrame, candidates: DataFrame, *, dim: int, keep: int, group: str, named: bool = False) -> DataFrame:
    """Full-precision scores for every query of all candidate passages, whichever query brought them."""
    pool = candidates.select("chunk_id").distinct()
    return cosine_scan(rows.join(pool, "chunk_id", "left_semi"), queries, dim=dim, keep=keep, group=group, named=named)


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """``qid, expected, hit, recall``: the share of each query's exact results that were found."""
    hits = exact.select("qid", "chunk_id").join(found.select("qid", "chunk_id", F.lit(1).alias("hit")), ["qid", "chunk_id"], "left")
    out = hits.groupBy("qid").agg(F.count("*").alias("expected"), F.count("hit").alias("hit"))
    return out.withColumn("recall", F.round(F.col("hit") / F.col("expected"), 6))


# An early tier: vectors in the cells of fitted centroids, of which a query visits the nearest


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids of a spherical k-means and the centroid of each row."""
    k = max(1, min(k, len(x)))
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), centres).astype(np.float32)
    return centres, (x @ centres.T).argmax(axis=1)


@dataclass
class Cells:
    """What an index keeps of its early tier: the vectors by cell (``cell, chunk_id, file_id, v``, in order of the cell), and two
    small tables, the centroids (``cell, centre``) and a sample of the vectors (``v``), by which it is told how far a query must look."""

    rows: DataFrame
    centres: DataFrame
    sample: DataFrame


def _stack(df: DataFrame, column: str, dim: int) -> np.ndarray:
    """A bounded table of vectors as unit rows on the driver."""
    return _unit(df.select(column).toArrow().column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64))


def _nearest_cell(m: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.round(m @ centroids.T, 6).argmax(axis=1)


def build_cells(rows: DataFrame, *, dim: int, cell_rows: int = 400, most_cells: int = 4096, sample_rows: int = 20_000) -> Cells:
    """Cells of about ``cell_rows`` vectors (``chunk_id, file_id, v``), but no more than ``most_cells``, by k-means on about ``sample_rows`` of them.

    Every vector is in the cell of its nearest centroid.  The sample doesn't
    hang on the order of the rows.  An empty table has one empty cell.
    """
    spark = rows.sparkSession
    total = rows.count()
    drawn = F.pmod(F.xxhash64("chunk_id", F.lit(1)), F.lit(max(1, total)))
    some = rows.select("chunk_id", "v", drawn.alias("drawn"))
    if total > sample_rows:
        some = some.where(F.col("drawn") < sample_rows).orderBy("drawn", "chunk_id").limit(2 * sample_rows)
    sample = stage(some.orderBy("chunk_id").select("v").coalesce(1), "cell-sample")
    m = _stack(sample, "v", dim)
    k = max(1, min(most_cells, total // cell_rows, len(m) // 8))
    centroids = _unit(kmeans(m.astype(np.float32), k, np.random.default_rng(42))[0].astype(np.float64)) if len(m) else np.zeros((1, dim))
    shared = spark.sparkContext.broadcast(centroids)  # most_cells rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = _nearest_cell(_unit(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)), shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *(batch.column(c) for c in ("chunk_id", "file_id", "v"))], names=["cell", "chunk_id", "file_id", "v"])

    placed = rows.select("chunk_id", "file_id", "v").mapInArrow(run, "cell int, chunk_id long, file_id long, v array<double>")
    centres = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centre array<double>")
    return Cells(placed.repartitionByRange("cell", "chunk_id").sortWithinPartitions("cell", "chunk_id"), centres, sample)


def probes_for(q: np.ndarray, centroids: np.ndarray, m: np.ndarray, total: int, *, keep: int, recall: float) -> np.ndarray:
    """How many cells each query must visit, so that ``recall`` of its best ``keep`` lie in them, as far as the sample ``m`` tells."""
    # Few of the best are in a small sample; a few more, which are farther off, tell enough.
    n = min(len(m), keep, max(30, -(-keep * len(m) // max(1, total))))
    home = _nearest_cell(m, centroids)
    out = np.ones(len(q), np.int64)
    for i, x in enumerate(q):
        place = np.empty(len(centroids), np.int64)
        place[np.argsort(-np.round(centroids @ x, 6), kind="stable")] = np.arange(len(centroids))
        if n:
            out[i] = 1 + int(np.quantile(place[home[np.argsort(-(m @ x), kind="stable")[:n]]], recall, method="higher"))
    return out


def cell_candidates(cells: Cells, queries: DataFrame, *, dim: int, keep: int, recall: float = 0.95, allowed: DataFrame | None = None) -> DataFrame:
    """``qid, chunk_id, score``: full-precision scores of the passages in the nearest cells of each query, the best ``keep``.

    Each of a stated set of queries visits as many cells as ``recall`` needs for
    it; only those cells are read.  Filters (``allowed``, by file_id) come after
    the cells are chosen, so a filtered search may get fewer than it asked for.
    """
    spark = cells.rows.sparkSession
    asked = queries.select(F.col("qid").cast("long"), vectors.as_doubles(F.col("q")).alias("q")).where(vectors.is_valid(F.col("q"), dim)).toArrow().sort_by("qid")
    empty = spark.createDataFrame([], "qid long, chunk_id long, score double")
    m = _stack(cells.sample, "v", dim) if asked.num_rows else np.empty((0, dim))
    if not len(m):
        return empty
    centroids = _stack(cells.centres.orderBy("cell"), "centre", dim)
    q = _unit(asked.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
    ids = asked.column("qid").to_numpy()
    probes = probes_for(q, centroids, m, cells.rows.count(), keep=keep, recall=recall)
    visited = [np.argsort(-np.round(centroids @ x, 6), kind="stable")[:n] for x, n in zip(q, probes, strict=True)]
    by_cell: dict[int, list[int]] = {}
    for i, at in enumerate(visited):
        for c in at.tolist():
            by_cell.setdefault(c, []).append(i)
    shared = spark.sparkContext.broadcast((ids, q, {c: np.array(v) for c, v in by_cell.items()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, by_cell = shared.value
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            v = _unit(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)) if len(cell) else None
            for c in np.unique(cell):
                at = np.flatnonzero(cell == c)
                score = np.round(v[at] @ q[by_cell[int(c)]].T, 6).T
                least = -np.partition(-score, min(keep, len(at)) - 1, axis=1)[:, min(keep, len(at)) - 1]
                which, row = np.nonzero(score >= least[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(ids[by_cell[int(c)]][which]), batch.column("chunk_id").take(pa.array(at[row])), pa.array(score[which, row])], names=["qid", "chunk_id", "score"])

    rows = cells.rows.where(F.col("cell").isin([int(c) for c in sorted(by_cell)]))
    if allowed is not None:
        rows = rows.join(allowed, "file_id", "left_semi")
    return top_passages(rows.select("cell", "chunk_id", "v").mapInArrow(run, "qid long, chunk_id long, score double"), keep).drop("rk")


def register_cells(spark: SparkSession, name: str, centroids: np.ndarray) -> None:
    """A table function for SQL: ``name(vector, n)`` has the n nearest cells of a vector as rows ``cell, cosine``.

    With ``lateral`` it brings queries and the stored cells together.
    """
    from pyspark.sql.functions import udtf

    centres = _unit(np.asarray(centroids, np.float64))

    class NearestCells:
        def eval(self, vector, n: int):
            cosines = np.round(centres @ _unit(np.array([vector], np.float64))[0], 6)
            for c in np.argsort(-cosines, kind="stable")[:n]:
                yield int(c), float(cosines[c])

    spark.udtf.register(name, udtf(NearestCells, returnType="cell int, cosine double"))


def image_hits(files: DataFrame, queries: DataFrame, *, dim: int, k: int) -> DataFrame:
    """``qid, file_id, score, rk``: the k best images of each query vector, in a list of their own."""
    images = files.where((F.col("kind") == "image") & vectors.is_valid(F.col("image_embedding"), dim))
    rows = images.select(F.col("file_id").alias("chunk_id"), vectors.as_doubles(F.col("image_embedding")).alias("v"))
    return top_passages(cosine_scan(rows, queries, dim=dim, keep=k), k).withColumnRenamed("chunk_id", "file_id")
