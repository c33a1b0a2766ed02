"""Structured Streaming: incremental catalogue, block-wise top-k, counters, and windows over events.

Each sink is idempotent: a batch's number is part of what it writes, so that a
batch that is run again after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import catalog, ingest, metrics, semantic
from ..sources.store import Delta, Store


def _arriving(spark: SparkSession, source: str, schema: StructType, most: int) -> DataFrame:
    """The Parquet files of a folder as a stream; a source that is one file is a stream of that file."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", most)
    if fs.getFileStatus(p).isDirectory():
        return reader.parquet(source)
    return reader.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())


def _marked(store: Store, name: str) -> int:
    """The number of the last batch that a sink has published, or -1."""
    m = store.manifest()
    return store.table(f"{name}_batch", m).first()[0] if f"{name}_batch" in m["tables"] else -1


def _mark(df: DataFrame, name: str, batch: int) -> dict[str, DataFrame]:
    return {f"{name}_batch": df.sparkSession.createDataFrame([(batch,)], "batch long")}


def _publish(store: Store, name: str, df: DataFrame, batch: int) -> None:
    store.publish({name: df, **_mark(df, name, batch)})


def follow_catalog(spark: SparkSession, source: str, schema: StructType, store: Store, checkpoint: str, *, files_per_trigger: int = 100) -> StreamingQuery:
    """Takes new Parquet files of catalogue rows into the table ``files`` of a store: per path the last indexed row stays."""

    def merge(batch: DataFrame, number: int) -> None:
        if number <= _marked(store, "files"):
            return
        m = store.manifest()
        old = store.table("files", m) if "files" in m["tables"] else ingest.empty_like(batch.sparkSession, batch)
        arrived = batch.select(old.columns)
        # Only paths of the batch can change; the rest of the table isn't written again.
        touched = old.join(arrived.select("path"), "path", "left_semi").select(old.columns)
        store.publish(_mark(batch, "files", number), deltas={"files": Delta("path", arrived.select("path"), catalog.current(touched.unionByName(arrived)))}, base=m)

    rows = _arriving(spark, source, schema, files_per_trigger)
    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_vectors(spark: SparkSession, source: str, schema: StructType, queries: DataFrame, store: Store, checkpoint: str, *, dim: int, k: int, files_per_trigger: int = 1, on_snapshot: Callable[[int, DataFrame], None] | None = None) -> StreamingQuery:
    """The k best passages of each query, better with every block of vectors that arrives.

    The state is the table ``best`` of the store, k rows per query; each block's
    own best are merged into it.
    """

    def merge(batch: DataFrame, number: int) -> None:
        if number <= _marked(store, "best"):
            return
        block = semantic.cosine_scan(semantic.valid_vectors(batch, dim), queries, dim=dim, keep=k)
        m = store.manifest()
        scores = block if "best" not in m["tables"] else block.unionByName(store.table("best", m).select("qid", "chunk_id", "score"))
        _publish(store, "best", semantic.top_passages(scores.distinct(), k), number)
        if on_snapshot:
            on_snapshot(number, store.table("best"))

    rows = _arriving(spark, source, schema, files_per_trigger)
    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_counters(spark: SparkSession, source: str, schema: StructType, store: Store, checkpoint: str) -> StreamingQuery:
    """Adds arriving counters (``mode, metric, value``) to the table ``counters`` of a store."""

    def merge(batch: DataFrame, number: int) -> None:
        if number <= _marked(store, "counters"):
            return
        m = store.manifest()
        new = batch.select("mode", "metric", "value")
        old = store.table("counters", m) if "counters" in m["tables"] else ingest.empty_like(new.sparkSession, new)
        _publish(store, "counters", metrics.merge_counters(old, new), number)

    rows = _arriving(spark, source, schema, 100)
    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, *, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events per type and window of event time, with a watermark: a capability of the platform, for streams and tables alike."""
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    counted = seen.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user that end after a gap."""
    seen = events.withWatermark("ts", gap) if events.isStreaming else events
    out = seen.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def throttled(events: DataFrame, seconds: float, *, at: str = "elapsed_seconds", key: str = "sequence") -> DataFrame:
    """Snapshots at most once per interval: of each interval the last one, and always the very last."""
    slot = F.floor(F.col(at) / seconds)
    last = F.row_number().over(Window.partitionBy("slot").orderBy(F.desc(key)))
    return events.withColumn("slot", slot).withColumn("nth", last).where("nth = 1").drop("slot", "nth")
