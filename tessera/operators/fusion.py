"""Reciprocal-rank fusion, identities and copies, deltas of snapshots, reranking."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..runtime import stage

RRF_K = 60


def pool_size(top_k: int) -> int:
    """Files of each list that take part in fusion."""
    return max(150, 15 * top_k)


def fuse(lists: DataFrame, *, group: str = "qid", digits: int = 12) -> DataFrame:
    """One row per group and path, of ranked lists with ``<group>, list_no, source, path, chunk_id, kind, mtime, mime, rk``.

    ``score`` is the sum of 1 / (60 + rank); ``keyword_rank`` and
    ``semantic_rank`` are the best ranks by source; the evidence columns are
    those of the list with the best rank, of equal ranks the list with the
    smaller number.
    """
    best = lambda source: F.min(F.when(F.col("source") == source, F.col("rk")))
    evidence = F.min_by(F.struct("chunk_id", "kind", "mtime", "mime"), F.struct("rk", "list_no")).alias("e")
    fused = lists.groupBy(group, "path").agg(
        F.round(F.sum(1.0 / (RRF_K + F.col("rk"))), digits).alias("score"),
        best("keyword").alias("keyword_rank"),
        best("semantic").alias("semantic_rank"),
        evidence,
    )
    match = F.when(F.col("e.chunk_id").isNull(), "filename").when(F.col("keyword_rank").isNotNull() & F.col("semantic_rank").isNotNull(), "hybrid").when(F.col("keyword_rank").isNotNull(), "keyword").otherwise("semantic")
    return fused.select(group, "path", "score", "keyword_rank", "semantic_rank", "e.*", match.alias("match"))


def identity(content_hash: Column, path: Column) -> Column:
    """Files with the same known bytes are one; a file without a hash is only itself."""
    return F.when(content_hash.isNotNull() & (content_hash != ""), F.concat(F.lit("bytes:"), content_hash)).otherwise(F.concat(F.lit("path:"), path))


def result_id(content_hash: Column, path: Column) -> Column:
    return F.sha2(identity(content_hash, path), 256)


def dedup(fused: DataFrame, files: DataFrame, top_k: int | None, *, group: str = "qid") -> DataFrame:
    """The best file of each identity, and of those the best ``top_k``, with ``result_id`` and ``place``."""
    # One exchange by group serves both rankings; the id, which doesn't compress, is made after it.
    rows = fused.join(files.select("path", "content_hash"), "path", "left").repartition(group).withColumn("result_id", result_id(F.col("content_hash"), F.col("path")))
    one = Window.partitionBy(group, "result_id").orderBy(F.desc("score"), "path")
    order = Window.partitionBy(group).orderBy(F.desc("score"), "path")
    rows = rows.withColumn("nth", F.row_number().over(one)).where("nth = 1").drop("nth").withColumn("place", F.row_number().over(order))
    return rows.where(F.col("place") <= top_k) if top_k else rows


def numbered(files: DataFrame) -> DataFrame:
    """``file_id, number, ident, path, kind, mtime, content_hash`` of the files that aren't junk.

    ``number`` has the order of the paths, and ``ident`` is the least number
    among the files of the same identity, so that lists can be ranked, fused
    and deduplicated without their paths and hashes.
    """
    rows = files.where(~paths.is_junk(F.col("path"))).select("file_id", "path", "kind", "mtime", "content_hash")
    # Range partitions are in order, and so are the numbers; written, as the order of a second run could differ.
    rows = stage(rows.repartitionByRange("path").sortWithinPartitions("path").withColumn("number", F.monotonically_increasing_id()), "ordered")
    known = F.col("content_hash").isNotNull() & (F.col("content_hash") != "")
    several = rows.where(known).groupBy(F.col("content_hash").alias("__hash")).agg(F.min("number").alias("__first"), F.count("*").alias("__n")).where("__n > 1")
    # A file without a hash meets nothing, and goes by its path.
    rows = rows.withColumn("__identity", identity(F.col("content_hash"), F.col("path"))).join(several.select(F.concat(F.lit("bytes:"), "__hash").alias("__identity"), "__first"), "__identity", "left")
    return rows.select("file_id", "number", F.coalesce("__first", "number").alias("ident"), "path", "kind", "mtime", "content_hash")


def fuse_numbers(lists: DataFrame, *, group: str = "qid", digits: int = 12) -> DataFrame:
    """``fuse`` of lists of numbered files (``<group>, list_no, source, number, ident, chunk_id, rk``), with the best passage by source; one exchange by group also serves ``best_numbers``."""
    by = lambda source, x: F.min_by(x, F.when(F.col("source") == source, F.struct("rk", "list_no")))
    fused = lists.repartition(group).groupBy(group, "number").agg(
        F.min("ident").alias("ident"),
        F.round(F.sum(1.0 / (RRF_K + F.col("rk"))), digits).alias("score"),
        by("keyword", "rk").alias("keyword_rank"),
        by("semantic", "rk").alias("semantic_rank"),
        F.min_by("chunk_id", F.struct("rk", "list_no")).alias("chunk_id"),
        by("keyword", "chunk_id").alias("keyword_chunk"),
        by("semantic", "chunk_id").alias("semantic_chunk"),
    )
    match = F.when(F.col("keyword_rank").isNotNull() & F.col("semantic_rank").isNotNull(), "hybrid").when(F.col("keyword_rank").isNotNull(), "keyword").otherwise("semantic")
    return fused.withColumn("match", match)


def best_numbers(fused: DataFrame, top_k: int | None, *, group: str = "qid") -> DataFrame:
    """``dedup`` of numbered files, with ``place``."""
    one = Window.partitionBy(group, "ident").orderBy(F.desc("score"), "number")
    order = Window.partitionBy(group).orderBy(F.desc("score"), "number")
    rows = fused.withColumn("nth", F.row_number().over(one)).where("nth = 1").drop("nth").withColumn("place", F.row_number().over(order))
    return rows.where(F.col("place") <= top_k) if top_k else rows


def named(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """Numbered results with ``path, kind, mtime, content_hash`` and ``result_id``."""
    return rows.join(numbers.select("number", "path", "kind", "mtime", "content_hash"), "number").withColumn("result_id", result_id(F.col("content_hash"), F.col("path")))


def copies(results: DataFrame, files: DataFrame, scopes: Iterable[dict] = (), *, group: str = "qid") -> DataFrame:
    """Every copy of each result among ``files`` (the active filter applied, junk included), with ``is_canonical``.

    The canonical copy has the least scope priority, then the latest mtime,
    then the first path; it is found by an aggregate and not by ranking, as one
    hash may belong to a large share of all files.  A result without a hash is
    its own copy.
    """
    rows = _copy_rows(results, files, list(scopes))
    best = canonical(rows, group=group).select(group, "result_id", F.col("path").alias("__best"))
    return rows.join(best, [group, "result_id"]).withColumn("is_canonical", F.col("copy_path") == F.col("__best")).drop("__best")


def _copy_rows(results: DataFrame, files: DataFrame, scopes: list[dict]) -> DataFrame:
    known = files.select(F.col("path").alias("copy_path"), F.col("mtime").alias("copy_mtime"), F.col("source_device").alias("copy_device"), F.col("content_hash").alias("h"))
    hashed = results.where("content_hash is not null and content_hash <> ''").join(known, F.col("content_hash") == F.col("h"))
    alone = results.where("content_hash is null or content_hash = ''").join(known.withColumn("p", F.col("copy_path")), F.col("path") == F.col("p")).drop("p")
    rows = hashed.unionByName(alone).drop("h")
    return rows.withColumn("priority", paths.scope_priority(F.col("copy_path"), F.col("copy_device"), scopes)).withColumn("copy_scopes", paths.scope_names(F.col("copy_path"), F.col("copy_device"), scopes) if scopes else F.array().cast("array<string>"))


def canonical(copies: DataFrame, *, group: str = "qid") -> DataFrame:
    """``<group>, result_id, path, mtime, priority, copies``: the canonical copy of each result, and how many there are."""
    order = F.struct("priority", (-F.coalesce("copy_mtime", F.lit(0.0))).alias("age"), "copy_path", "copy_mtime")
    best = copies.groupBy(group, "result_id").agg(F.min(order).alias("b"), F.count("*").alias("copies"))
    return best.select(group, "result_id", F.col("b.copy_path").alias("path"), F.col("b.copy_mtime").alias("mtime"), F.col("b.priority").alias("priority"), "copies")


def results(top: DataFrame, files: DataFrame, passages: DataFrame, scopes: Iterable[dict] = (), *, group: str = "qid") -> DataFrame:
    """Full results of deduplicated ones: with the canonical path, the number of copies, and the text of the evidence, which is joined last."""
    top = stage(top, "results")
    best = canonical(_copy_rows(top, files, list(scopes)), group=group).drop("priority")
    rows = top.withColumnRenamed("path", "evidence_path").drop("mtime").join(best, [group, "result_id"]).join(passages.select("chunk_id", F.col("text").alias("snippet"), F.lit(True).alias("__there")), "chunk_id", "left")
    # A result whose passage has gone since is left out, after it has stood for its identity.
    return rows.where("chunk_id is null or __there").drop("__there")


def delta(before: DataFrame, after: DataFrame, fields: list[str], *, key: str = "result_id", place: str = "place") -> DataFrame:
    """``<key>, change, place``: what turns one snapshot into the next: added, updated, removed or unchanged rows and their new places."""
    old = before.select(F.col(key), F.struct(*fields).alias("old"))
    new = after.select(F.col(key), F.struct(*fields).alias("new"), F.col(place).alias("place"))
    both = old.join(new, key, "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("updated")
    return both.select(key, change.alias("change"), "place")


def replay(before: DataFrame, changes: DataFrame, after: DataFrame, fields: list[str], *, key: str = "result_id") -> DataFrame:
    """The next snapshot from the previous one, the changes, and the rows of what was added or updated."""
    kept = before.select(key, *fields).join(changes.where("change = 'unchanged'").select(key, "place"), key)
    sent = after.select(key, *fields).join(changes.where("change in ('added', 'updated')").select(key, "place"), key)
    return kept.unionByName(sent)


def rerank_blend(base: DataFrame, scores: DataFrame, mix: float, top_k: int, *, group: str = "qid", digits: int = 8) -> DataFrame:
    """``base`` (``<group>, path, place``) ordered anew by a blend of its places and the ranks of learned scores.

    ``scores`` has ``<group>, path, chunk_id, relevance``, for some passages of
    each file; the file's best counts, of equal ones the smaller chunk_id.
    """
    best = Window.partitionBy(group, "path").orderBy(F.desc("relevance"), "chunk_id")
    learned = Window.partitionBy(group).orderBy(F.desc("relevance"), "path")
    one = scores.withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth").withColumn("learned", F.row_number().over(learned))
    both = base.select(group, "path", "place").join(one, [group, "path"])
    combined = (1.0 - mix) / (RRF_K + F.col("place")) + mix / (RRF_K + F.col("learned"))
    both = both.withColumn("ranking_score", F.round(combined, digits))
    order = Window.partitionBy(group).orderBy(F.desc("ranking_score"), "path")
    return both.withColumn("new_place", F.row_number().over(order)).where(F.col("new_place") <= top_k).select(group, "path", "chunk_id", "place", "learned", "relevance", "ranking_score", "new_place")


def agreement(a: DataFrame, b: DataFrame, *, group: str = "qid", key: str = "result_id") -> DataFrame:
    """``<group>, both, either, jaccard, same_first`` of two result lists per group; two empty lists agree wholly."""
    gathered = lambda df, n: df.groupBy(group).agg(F.collect_set(key).alias(n), F.min_by(key, "place").alias(f"{n}_first"))
    both = gathered(a, "a").join(gathered(b, "b"), group, "full_outer")
    empty = F.array().cast("array<string>")
    left, right = F.coalesce("a", empty), F.coalesce("b", empty)
    inter, union = F.size(F.array_intersect(left, right)), F.size(F.array_union(left, right))
    jaccard = F.when(union == 0, 1.0).otherwise(F.round(inter / union, 6))
    return both.select(group, inter.alias("both"), union.alias("either"), jaccard.alias("jaccard"), F.coalesce(F.col("a_first") == F.col("b_first"), F.lit(False)).alias("same_first"))
