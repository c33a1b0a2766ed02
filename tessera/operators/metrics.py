"""Run health, counters, histograms, observations and event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of the latency classes in seconds (fixed values).
LATENCY_BOUNDS = [0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0]


def latency_bucket(seconds: Column) -> Column:
    """The index of the first class whose bound isn't exceeded, or the number of classes."""
    out = F.when(seconds.isNull(), None)
    for i, bound in enumerate(LATENCY_BOUNDS):
        out = out.when(seconds <= bound, i)
    return out.otherwise(len(LATENCY_BOUNDS))


def histogram(observations: DataFrame, group: str, seconds: str) -> DataFrame:
    bucket = latency_bucket(F.col(seconds)).alias("bucket")
    return observations.where(F.col(seconds).isNotNull()).groupBy(group, bucket).agg(F.count("*").alias("n"))


def accepted(counters: DataFrame, modes: list[str], metrics: list[str]) -> DataFrame:
    """Counters of a closed vocabulary with a finite value that isn't negative."""
    v = F.col("value")
    return counters.where(F.col("mode").isin(modes) & F.col("metric").isin(metrics) & v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf")))


def merge_counters(stored: DataFrame, more: DataFrame) -> DataFrame:
    """``mode, metric, value``: the sums of both; missing counters start at 0."""
    return stored.unionByName(more).groupBy("mode", "metric").agg(F.sum("value").alias("value"))


def observation_deltas(series: DataFrame, run: str, at: str, value: str, *, span: int = 100_000) -> DataFrame:
    """``series`` with ``peak`` (the greatest value of the run so far) and ``delta`` (what it has risen by).

    Values of a run may only add to its total, so a fall counts as nothing; the
    deltas of a run sum up to its greatest value, if that is above 0.  A run is
    cut into stretches of ``span`` of the order ``at``, whose greatest values
    are carried on, so that a run with very many rows isn't sorted by one task.
    """
    cut = series.withColumn("__part", F.floor(F.col(at) / span))
    earlier = Window.partitionBy(run).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = cut.groupBy(run, "__part").agg(F.max(value).alias("__top")).withColumn("__carried", F.max("__top").over(earlier)).drop("__top")
    both = cut.join(carried, [run, "__part"])
    order = Window.partitionBy(run, "__part").orderBy(at)
    so_far = F.greatest("__carried", F.max(value).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    before = F.coalesce(F.greatest("__carried", F.max(value).over(order.rowsBetween(Window.unboundedPreceding, -1))), F.lit(0))
    out = both.withColumn("peak", so_far).withColumn("delta", F.greatest(F.lit(0), F.coalesce(F.col(value), F.lit(0)) - F.greatest(before, F.lit(0))))
    return out.select(*series.columns, "peak", "delta")


def error_category(name: Column, code: Column) -> Column:
    """The category of a failure by the name of its error and its system code (fixed values of POSIX)."""
    permission, disappeared, io = [1, 13], [2, 116], [5, 19]
    return F.when(code.isin(permission), "permission").when(code.isin(disappeared), "disappeared").when(code.isin(io), "io").when(name == "OSError", "other").otherwise("unknown")


def run_summaries(runs: DataFrame, failures: DataFrame, limit: int = 20) -> DataFrame:
    """Runs that failed or didn't end first, then the newest, with failures by category and whether the coverage is complete."""
    by_category = failures.groupBy("run_id", "category").agg(F.count("*").alias("n"))
    gathered = by_category.groupBy("run_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "n")))).alias("failures"))
    rows = runs.join(gathered, "run_id", "left")
    complete = F.col("finished").isNotNull() & ~F.coalesce("limited", F.lit(False)) & (F.coalesce("errors", F.lit(0)) == 0)
    bad = (F.coalesce("errors", F.lit(0)) > 0) | F.col("finished").isNull()
    return rows.withColumn("coverage_complete", complete).withColumn("failed", bad).orderBy(F.desc("failed"), F.desc("run_id")).limit(limit)


def poll(events: DataFrame, after: int, limit: int = 32, *, key: str = "sequence") -> DataFrame:
    """The next events after a cursor."""
    return events.where(F.col(key) > after).orderBy(key).limit(min(limit, 100))


def latest(events: DataFrame, group: str, key: str, fields: list[str]) -> DataFrame:
    """The last event of each group."""
    return events.groupBy(group).agg(F.max_by(F.struct(*fields), key).alias("e"), F.max(key).alias(key)).select(group, key, "e.*")


def relevance(ranks: DataFrame, k: int = 3) -> DataFrame:
    """One row about cases (``case_id, place``; null for what wasn't found): how many, found first, found within k, and the mean reciprocal rank within k."""
    near = F.col("place") <= k
    return ranks.agg(F.count("*").alias("cases"), F.count_if(F.col("place") == 1).alias("top1"), F.count_if(near).alias(f"top{k}"), (F.sum(F.when(near, 1.0 / F.col("place")).otherwise(0.0)) / F.count("*")).alias(f"mrr{k}"))


def events_as_json(events: DataFrame, fields: list[str]) -> DataFrame:
    """``event_id, line``: events as the lines of a log."""
    return events.select("event_id", F.to_json(F.struct(*fields)).alias("line"))
