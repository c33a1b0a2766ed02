"""The catalogue: its current rows, filters, scopes, browsing, census, and the names of files."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.text import FILENAME_TERM, query_terms


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of the rows of each key the first by ``order``; rows with a null in a key are left out.

    Spark cuts each key to one row before the exchange, so repeated rows of
    one key cost nothing.
    """
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.dropna(subset=keys).withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def current(files: DataFrame) -> DataFrame:
    """One row per path: the last indexed one, then the smaller file_id. Rows without a path are left out."""
    return first_by(files, ["path"], [F.desc_nulls_last("indexed_at"), F.asc("file_id")])


def passages(chunks: DataFrame) -> DataFrame:
    """One row per chunk_id."""
    return first_by(chunks, ["chunk_id"], [F.asc("ordinal")])


def repeated(chunks: DataFrame) -> DataFrame:
    """``chunk_id`` of the passages that have several rows; only ids are exchanged."""
    return chunks.dropna(subset=["chunk_id"]).groupBy("chunk_id").count().where("count > 1").select("chunk_id")


def passages_once(chunks: DataFrame, repeated: DataFrame) -> DataFrame:
    """What ``passages`` gives where few passages have several rows: their ids (``repeated``) go to all executors, and all other rows stay where they are."""
    ids = F.broadcast(repeated)
    alone = chunks.dropna(subset=["chunk_id"]).join(ids, "chunk_id", "left_anti")
    return alone.unionByName(passages(chunks.join(ids, "chunk_id", "left_semi")))


def scoped(files: DataFrame, scopes: Iterable[dict]) -> DataFrame:
    """Files of any of the scopes; a file without a known device is in no scope that names devices."""
    return files.where(paths.in_any_scope(F.col("path"), F.col("source_device"), scopes))


def filtered(files: DataFrame, *, kind: str = "all", after: float | None = None, before: float | None = None, prefix: str | None = None) -> DataFrame:
    """Files of a kind, with an mtime within both bounds (inclusive), and below a literal path prefix."""
    if kind != "all":
        files = files.where(F.col("kind") == kind)
    if after is not None:
        files = files.where(F.col("mtime") >= after)
    if before is not None:
        files = files.where(F.col("mtime") <= before)
    if prefix is not None:
        files = files.where(paths.under(F.col("path"), F.col("root"), prefix))
    return files


def epoch(day: str, *, end: bool = False) -> float:
    """Seconds of an ISO date or time in UTC; the end of a plain date is its last whole second."""
    from datetime import UTC, datetime

    t = datetime.fromisoformat(day)
    t = t if t.tzinfo else t.replace(tzinfo=UTC)
    return t.timestamp() + (86399 if end and len(day) == 10 else 0)


def browse(files: DataFrame, *, after: str = "", contains: str = "", limit: int = 100) -> DataFrame:
    """The next page of paths after a path, of those that contain a text in any letter case."""
    page = files.where(F.col("path") > after)
    if contains:
        page = page.where(F.contains(F.lower("path"), F.lit(contains.lower())))
    return page.orderBy("path").limit(limit)


def filename_hits(files: DataFrame, queries: DataFrame, *, limit: int, require_all: bool = False, drop_junk_first: bool = False, most_terms: int = 32) -> DataFrame:
    """``qid, path, kind, mtime, mime, score``: per query the first ``limit`` paths that contain its terms literally.

    As the limit comes before the junk filter, a query may get fewer rows;
    ``drop_junk_first`` turns the order round.  Queries (``qid, text``) are a
    stated set that is compared with every path.
    """
    terms = queries.select("qid", F.slice(query_terms(F.lower("text"), FILENAME_TERM), 1, most_terms).alias("terms")).where(F.size("terms") > 0)
    rows = files if not drop_junk_first else files.where(~paths.is_junk(F.col("path")))
    low = F.lower("path")
    test = F.forall if require_all else F.exists
    first = Window.partitionBy("qid").orderBy("path")
    out: DataFrame | None = None
    for block in _blocks(terms):
        hits = rows.join(F.broadcast(block), test("terms", lambda t: F.contains(low, t)))
        hits = hits.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= limit)
        hits = hits.where(~paths.is_junk(F.col("path"))).select("qid", "path", "kind", "mtime", "mime", F.lit(1.0).alias("score"))
        out = hits if out is None else out.unionByName(hits)
    return out


def _blocks(queries: DataFrame, size: int = 2000) -> Iterator[DataFrame]:
    """A stated set of queries in blocks that can be sent to every executor; one empty block of none."""
    spark, block, given = queries.sparkSession, [], False
    for row in queries.toLocalIterator():
        block.append(row)
        if len(block) == size:
            yield spark.createDataFrame(block, queries.schema)
            block, given = [], True
    if block or not given:
        yield spark.createDataFrame(block, queries.schema)


def census(files: DataFrame, by: Column, name: str, top: int | None = None) -> DataFrame:
    """Files by an expression, most frequent first, ties by the value."""
    counted = files.groupBy(by.alias(name)).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return counted.orderBy(F.desc("files"), name).limit(top) if top else counted


def health_flags(state: DataFrame) -> DataFrame:
    """One row per index: its keys as columns, and whether an update or the index is incomplete."""
    number = F.expr("try_cast(value as double)")
    key = lambda k: F.max(F.when(F.col("key") == k, number)).alias(k)
    keys = ["chunk_high_water", "last_build_started", "last_build_finished", "last_build_errors", "last_build_walk_errors", "last_build_changed", "last_build_unchanged"]
    wide = state.where("index_name is not null").groupBy("index_name").agg(*map(key, keys))
    errors = F.coalesce("last_build_errors", F.lit(0.0)) + F.coalesce("last_build_walk_errors", F.lit(0.0))
    return wide.select(
        "*",
        F.coalesce(F.col("last_build_started") > F.coalesce("last_build_finished", F.lit(0.0)), F.lit(False)).alias("update_incomplete"),
        (F.col("last_build_finished").isNotNull() & (errors == 0)).alias("coverage_complete"),
    )
