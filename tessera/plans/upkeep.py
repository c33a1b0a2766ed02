"""Queries on keeping an index current, and on its metrics.

The replica's catalogue plays the newly walked files; the ``events`` table plays
the feed of observations (user: run, type: mode, value: seconds).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import chunks as cut
from ..operators import catalog, ingest, metrics
from ..runtime import read
from .catalog import COMMON, JUNK_SQL, current_files, current_passages, scope_sql
from .retrieval import SQL as RETRIEVAL_SQL

FIELDS = ["path", "kind", "size", "mtime", "content_sig"]
MODES = ["click", "view", "purchase"]


def walked(spark: SparkSession, d: str) -> DataFrame:
    return catalog.current(read(spark, d, "replica_files"))


def changed_files_anti(spark: SparkSession, d: str) -> DataFrame:
    return ingest.changed(walked(spark, d), current_files(spark, d)).select("path", "content_sig")


def prune_vanished(spark: SparkSession, d: str) -> DataFrame:
    return ingest.vanished(current_files(spark, d), walked(spark, d), ["/corpus", "/archive"]).select("file_id", "path")


def upsert_catalog(spark: SparkSession, d: str) -> DataFrame:
    return ingest.upsert(current_files(spark, d).select(FIELDS), walked(spark, d).select(FIELDS), "path")


def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    return ingest.insert_absent(current_files(spark, d).select(FIELDS), walked(spark, d).select(FIELDS), "path")


def assign_chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids for the passages of all documents, above the greatest id in use."""
    docs = read(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(cut(F.col("text"))).alias("ordinal", "passage")).select("doc_id", "ordinal")
    high = read(spark, d, "chunks").agg(F.max("chunk_id")).first()[0] or 0
    return ingest.numbered(docs, ["doc_id", "ordinal"], high)


def replace_by_file(spark: SparkSession, d: str) -> DataFrame:
    """Passages after every tenth file has been replaced by one new passage."""
    old = current_passages(spark, d).where("file_id is not null").select("chunk_id", "file_id", "ordinal", "text")
    high = read(spark, d, "chunks").agg(F.max("chunk_id")).first()[0] or 0
    new = current_files(spark, d).where("file_id % 10 = 0").select((F.col("file_id") + high).alias("chunk_id"), "file_id", F.lit(0).alias("ordinal"), F.col("path").alias("text"))
    return ingest.replace_passages(old, new).select("chunk_id", "file_id", "ordinal", F.length("text").alias("chars"))


def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Passages that remain after the vanished files have gone."""
    f = current_files(spark, d)
    left = f.join(ingest.vanished(f, walked(spark, d), ["/corpus", "/archive"]).select("file_id"), "file_id", "left_anti")
    return ingest.cascade(current_passages(spark, d), left).select("chunk_id", "file_id", "ordinal")


def embedding_reuse(spark: SparkSession, d: str) -> DataFrame:
    return ingest.reusable_vectors(current_files(spark, d), current_passages(spark, d))


def resume_points(spark: SparkSession, d: str) -> DataFrame:
    p = current_passages(spark, d).where("file_id is not null")
    progress = current_files(spark, d).where("file_id % 7 = 0").select("file_id", F.col("content_sig").alias("source_sig"), F.lit(2).alias("next_ordinal"))
    return ingest.resume_points(p, progress)


def metadata_upgrade(spark: SparkSession, d: str) -> DataFrame:
    f = current_files(spark, d)
    return ingest.backfill_device(f, ingest.main_device(f))[0].select("file_id", "path", "source_device")


def metadata_upgrade_counts(spark: SparkSession, d: str) -> DataFrame:
    f = current_files(spark, d)
    return ingest.backfill_device(f, ingest.main_device(f))[1]


def rotating_sample(spark: SparkSession, d: str) -> DataFrame:
    return ingest.rotating_sample(current_files(spark, d), 250, 6).select("file_id", "path")


def rotating_sample_wrapped(spark: SparkSession, d: str) -> DataFrame:
    return ingest.rotating_sample(current_files(spark, d), 10**12, 6).select("file_id", "path")


def _hit_paths(spark: SparkSession, d: str) -> list[str]:
    """Eight files that stand for a search's hits."""
    return [r.path for r in current_files(spark, d).where("file_id % 20 = 7").orderBy("path").limit(8).collect()]


def refresh_candidates(spark: SparkSession, d: str) -> DataFrame:
    """What a search would repair beside itself, from the cursor 250."""
    return ingest.refresh_candidates(current_files(spark, d), _hit_paths(spark, d), 250)[0].select("file_id", "path")


def refresh_cursor(spark: SparkSession, d: str) -> DataFrame:
    """Where the next repair goes on."""
    following = ingest.refresh_candidates(current_files(spark, d), _hit_paths(spark, d), 250)[1]
    return spark.createDataFrame([(following,)], "refresh_cursor long")


def storage_estimate(spark: SparkSession, d: str) -> DataFrame:
    return ingest.storage_estimate(current_passages(spark, d))


def content_overlap(spark: SparkSession, d: str) -> DataFrame:
    hashes = lambda df: df.where("content_hash is not null")
    return ingest.overlap(hashes(current_files(spark, d)), hashes(walked(spark, d)), "content_hash")


def observations(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", F.col("user_id").alias("run_id"), F.col("event_type").alias("mode"), F.col("value").alias("seconds"), "ts")


def latency_histogram(spark: SparkSession, d: str) -> DataFrame:
    return metrics.histogram(observations(spark, d), "mode", "seconds")


def counter_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Stored counters (the first half of the events) with the rest added."""
    o = observations(spark, d)
    each = F.array(F.struct(F.lit("attempts").alias("metric"), F.lit(1.0).alias("value")), F.struct(F.lit("seconds_sum").alias("metric"), F.col("seconds").cast("double").alias("value")))
    long = o.where("seconds is not null").select("event_id", "mode", F.explode(each).alias("c")).select("event_id", "mode", "c.*")
    part = lambda rest: long.where(f"event_id % 2 = {rest}").groupBy("mode", "metric").agg(F.sum("value").alias("value"))
    return metrics.merge_counters(part(0), part(1)).select("mode", "metric", F.round("value", 4).alias("value"))


def counter_means(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d).where("seconds is not null").groupBy("mode").agg(F.count("*").alias("attempts"), F.sum("seconds").alias("total"))
    return o.select("mode", "attempts", F.round(F.col("total") / F.col("attempts"), 6).alias("mean_seconds"))


def counter_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d).groupBy("mode").agg(F.sum("seconds").alias("value")).withColumn("metric", F.lit("seconds_sum"))
    kept = metrics.accepted(o, MODES, ["seconds_sum"])
    return kept.select("mode", "metric", F.round("value", 4).alias("value"))


def monotonic_deltas(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.observation_deltas(observations(spark, d), "run_id", "event_id", "seconds")
    return out.select("event_id", "run_id", F.round("peak", 6).alias("peak"), F.round("delta", 6).alias("delta"))


def event_poll_page(spark: SparkSession, d: str) -> DataFrame:
    return metrics.poll(observations(spark, d), 100, 32, key="event_id").select("event_id", "mode", "seconds")


def events_json(spark: SparkSession, d: str) -> DataFrame:
    return metrics.events_as_json(observations(spark, d), ["event_id", "run_id", "mode"])


def latest_event(spark: SparkSession, d: str) -> DataFrame:
    return metrics.latest(observations(spark, d), "run_id", "event_id", ["mode", "seconds"])


def median_seconds(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d).where("seconds is not null").groupBy("mode").agg(F.round(F.percentile("seconds", F.lit(0.5)), 6).alias("median_seconds"), F.round(F.max("seconds"), 6).alias("longest"))


def failure_rows(spark: SparkSession, d: str) -> DataFrame:
    """Failures of indexing, one for every event of a run whose number is odd, with codes by its number."""
    code = F.element_at(F.array(*map(F.lit, [13, 2, 5, 1, 28, 116])), (F.col("event_id") % 6 + 1).cast("int"))
    name = F.when(F.col("event_id") % 6 == 4, F.when(F.col("event_id") % 4 == 0, "ValueError").otherwise("OSError")).otherwise("OSError")
    return observations(spark, d).where("run_id % 2 = 1").select("run_id", metrics.error_category(name, code).alias("category"))


def failure_categories(spark: SparkSession, d: str) -> DataFrame:
    return failure_rows(spark, d).groupBy("category").agg(F.count("*").alias("n"))


def run_health(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d)
    runs = o.groupBy("run_id").agg(F.min("event_id").alias("started"), F.max("event_id").alias("finished"))
    errors = failure_rows(spark, d).groupBy("run_id").agg(F.count("*").alias("errors"))
    runs = runs.join(errors, "run_id", "left").withColumn("finished", F.when(F.col("run_id") % 5 != 0, F.col("finished"))).withColumn("limited", F.col("run_id") % 3 == 0)
    out = metrics.run_summaries(runs, failure_rows(spark, d))
    return out.select("run_id", "errors", "finished", "coverage_complete", F.col("failures")["permission"].alias("permission"), F.col("failures")["io"].alias("io"))


QUERIES = {
    f.__name__: f
    for f in (
        changed_files_anti, prune_vanished, upsert_catalog, insert_if_absent, assign_chunk_ids, replace_by_file, cascade_delete, embedding_reuse, resume_points, metadata_upgrade,
        metadata_upgrade_counts, rotating_sample, rotating_sample_wrapped, refresh_candidates, refresh_cursor, storage_estimate, content_overlap, latency_histogram, counter_rollup, counter_means, counter_vocabulary,
        monotonic_deltas, event_poll_page, events_json, latest_event, median_seconds, failure_categories, run_health,
    )
}

_WALKED = COMMON + ", walked as (select * exclude (nth) from (select *, row_number() over (partition by path order by indexed_at desc nulls last, file_id) as nth from replica_files where path is not null) where nth = 1)"
_BELOW = "(" + " or ".join(scope_sql({"root": r}) for r in ("/corpus", "/archive")) + ")"
_GONE = f"gone as (select * from catalog where {_BELOW} and not {JUNK_SQL.format(p='path')} and path not in (select path from walked))"
_F = ", ".join(FIELDS)
_OBS = "with o as (select event_id, user_id as run_id, event_type as mode, value as seconds from events)"
_BUCKET = "case " + " ".join(f"when seconds <= {b} then {i}" for i, b in enumerate(metrics.LATENCY_BOUNDS)) + f" else {len(metrics.LATENCY_BOUNDS)} end"
_DEVICE = COMMON + ", known as (select root, source_device as device from (select root, source_device, row_number() over (partition by root order by count(*) desc, source_device) as nth from catalog where source_device is not null and root is not null group by root, source_device) where nth = 1)"
_FAIL = _OBS + ", failures as (select run_id, case event_id % 6 when 0 then 'permission' when 1 then 'disappeared' when 2 then 'io' when 3 then 'permission' when 5 then 'disappeared' else case when event_id % 4 = 0 then 'unknown' else 'other' end end as category from o where run_id % 2 = 1)"

_REPAIR = COMMON + f""", ok as (select * from catalog where kind = 'text' and size <= 65536 and not {JUNK_SQL.format(p="path")}),
    hits as (select path from (select path from catalog where file_id % 20 = 7 order by path limit 8) order by path limit 6),
    sample as (select file_id, path from ok where file_id > 250 or (select max(file_id) from ok) <= 250 order by file_id limit 6)"""

SQL = {
    "refresh_candidates": _REPAIR + " select file_id, path from ok where path in (select path from hits) union select file_id, path from sample",
    "refresh_cursor": _REPAIR + " select coalesce(max(file_id), 0) as refresh_cursor from sample",
    "events_json": _OBS + " select event_id, cast(to_json(struct_pack(event_id := event_id, run_id := run_id, mode := mode)) as varchar) as line from o",
    "changed_files_anti": _WALKED + " select path, content_sig from walked w where not exists (select 1 from catalog c where c.path = w.path and c.content_sig = w.content_sig)",
    "prune_vanished": _WALKED + f", {_GONE} select file_id, path from gone",
    "upsert_catalog": _WALKED + f" select {_F} from walked union all select {_F} from catalog where path not in (select path from walked)",
    "insert_if_absent": _WALKED + f" select {_F} from catalog union all select {_F} from walked where path not in (select path from catalog)",
    "assign_chunk_ids": RETRIEVAL_SQL["chunk_documents"].replace("select doc_id, row_number() over (partition by doc_id order by i) - 1 as ordinal, passage from p", "select doc_id, row_number() over (partition by doc_id order by i) - 1 as ordinal, (select max(chunk_id) from chunks) + row_number() over (order by doc_id, i) as chunk_id from p"),
    "replace_by_file": COMMON + """select chunk_id, file_id, ordinal, length(text) as chars from passages where file_id is not null and file_id not in (select file_id from catalog where file_id % 10 = 0)
        union all select file_id + (select max(chunk_id) from chunks), file_id, 0, length(path) from catalog where file_id % 10 = 0""",
    "cascade_delete": _WALKED + f", {_GONE} select chunk_id, file_id, ordinal from passages where file_id in (select file_id from catalog where file_id not in (select file_id from gone))",
    "embedding_reuse": COMMON + """, shape as (select file_id, md5(string_agg(md5(coalesce(text, chr(1))), ',' order by ordinal, md5(coalesce(text, chr(1))))) as shape, count(*) filter (embedding is null) as missing from passages where file_id is not null group by file_id),
        known as (select c.file_id, content_hash, extractor, shape, missing from catalog c join shape using (file_id) where content_hash is not null)
        select a.file_id, min(b.file_id) as donor_id from known a join known b on a.content_hash = b.content_hash and a.extractor = b.extractor and a.shape = b.shape where a.missing > 0 and b.missing = 0 group by a.file_id""",
    "resume_points": COMMON + "select c.file_id, c.content_sig as source_sig, 2 as next_ordinal, count(distinct p.ordinal) filter (p.ordinal < 2) as stored from catalog c left join passages p on p.file_id = c.file_id where c.file_id % 7 = 0 group by c.file_id, c.content_sig",
    "metadata_upgrade": _DEVICE + " select file_id, path, coalesce(source_device, device) as source_device from catalog left join known using (root)",
    "metadata_upgrade_counts": _DEVICE + " select count(*) filter (source_device is null) as checked, count(*) filter (source_device is null and device is not null) as updated, count(*) filter (source_device is null and device is null) as unavailable from catalog left join known using (root)",
    "rotating_sample": COMMON + "select file_id, path from catalog where file_id > 250 or (select max(file_id) from catalog) <= 250 order by file_id limit 6",
    "rotating_sample_wrapped": COMMON + "select file_id, path from catalog order by file_id limit 6",
    "storage_estimate": COMMON + "select sum((4 * strlen(coalesce(text, '')) + 4096) * 4) as estimated_bytes from passages",
    "content_overlap": _WALKED + """, a as (select distinct content_hash as h from catalog where content_hash is not null), b as (select distinct content_hash as h from walked where content_hash is not null)
        select (select count(*) from a join b using (h)) as shared, (select count(*) from a where h not in (select h from b)) as only_first, (select count(*) from b where h not in (select h from a)) as only_second""",
    "latency_histogram": _OBS + f" select mode, {_BUCKET} as bucket, count(*) as n from o where seconds is not null group by 1, 2",
    "counter_rollup": _OBS + " select mode, 'attempts' as metric, round(cast(count(*) as double), 4) as value from o where seconds is not null group by mode union all select mode, 'seconds_sum', round(sum(seconds), 4) from o where seconds is not null group by mode",
    "counter_means": _OBS + " select mode, count(*) as attempts, round(sum(seconds) / count(*), 6) as mean_seconds from o where seconds is not null group by mode",
    "counter_vocabulary": _OBS + " select mode, 'seconds_sum' as metric, round(sum(seconds), 4) as value from o where mode in ('click', 'view', 'purchase') group by mode having sum(seconds) >= 0",
    "monotonic_deltas": _OBS + """, w as (select *, max(seconds) over (partition by run_id order by event_id rows unbounded preceding) as peak, coalesce(max(seconds) over (partition by run_id order by event_id rows between unbounded preceding and 1 preceding), 0) as before from o)
        select event_id, run_id, round(peak, 6) as peak, round(greatest(0, coalesce(seconds, 0) - greatest(before, 0)), 6) as delta from w""",
    "event_poll_page": _OBS + " select event_id, mode, seconds from o where event_id > 100 order by event_id limit 32",
    "latest_event": _OBS + " select run_id, event_id, mode, seconds from (select *, row_number() over (partition by run_id order by event_id desc) as nth from o) where nth = 1",
    "median_seconds": _OBS + " select mode, round(quantile_cont(seconds, 0.5), 6) as median_seconds, round(max(seconds), 6) as longest from o where seconds is not null group by mode",
    "failure_categories": _FAIL + " select category, count(*) as n from failures group by category",
    "run_health": _FAIL + """, e as (select run_id, count(*) as errors, count(*) filter (category = 'permission') as permission, count(*) filter (category = 'io') as io from failures group by run_id),
        r as (select run_id, case when run_id % 5 <> 0 then max(event_id) end as finished, run_id % 3 = 0 as limited from o group by run_id)
        select run_id, errors, finished, finished is not null and not limited and coalesce(errors, 0) = 0 as coverage_complete, nullif(permission, 0) as permission, nullif(io, 0) as io from r left join e using (run_id) order by (coalesce(errors, 0) > 0 or finished is null) desc, run_id desc limit 20""",
}
