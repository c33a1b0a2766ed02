"""Queries that run their operator as a stream over the stored tables, or give what the stream must arrive at."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import read, stage_path
from ..sources.store import Store
from ..streaming import live
from .catalog import COMMON
from .retrieval import DIM, SQL as RETRIEVAL_SQL, TOP_K, vector_queries


def stream_catalog(spark: SparkSession, d: str) -> DataFrame:
    """The current catalogue as the stream leaves it."""
    at = stage_path(spark, "live")
    store = Store(spark, f"{at}/store")
    schema = read(spark, d, "files").schema
    live.follow_catalog(spark, f"{d}/files.parquet", schema, store, f"{at}/checkpoint").awaitTermination()
    return store.table("files").select("path", "file_id", "indexed_at", "content_sig")


def stream_topk(spark: SparkSession, d: str) -> DataFrame:
    """The best passages of each query vector after all blocks have come."""
    at = stage_path(spark, "live")
    store = Store(spark, f"{at}/store")
    schema = read(spark, d, "chunks").schema
    live.follow_vectors(spark, f"{d}/chunks.parquet", schema, vector_queries(spark, d), store, f"{at}/checkpoint", dim=DIM, k=TOP_K).awaitTermination()
    return store.table("best").select("qid", "chunk_id", "score", "rk")


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    out = live.event_windows(read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select(F.unix_timestamp("window_start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = live.sessions(read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


QUERIES = {f.__name__: f for f in (stream_catalog, stream_topk, event_windows, event_sessions)}
SQL = {
    "stream_catalog": COMMON + "select path, file_id, indexed_at, content_sig from catalog",
    "stream_topk": RETRIEVAL_SQL["cosine_topk"],
    "event_windows": "select cast(epoch(time_bucket(interval 1 hour, ts)) as bigint) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "event_sessions": "with s as (select user_id, ts, case when ts < lag(ts) over (partition by user_id order by ts) + interval 30 minutes then 0 else 1 end as new from events) select user_id, sum(new) as sessions, count(*) as events from s group by user_id",
}
