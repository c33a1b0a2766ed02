"""Classes of linked records: connected components of a table of links, in rounds over written tables.

Each round links every record to the least neighbour of its neighbours and
itself (alternating over larger and smaller neighbours), which halves the
longest chains; the links are written after each round, so that neither a lost
executor nor the number of rounds makes the lineage grow.  Stars with a
representative replace cliques, so a class of n records ends as n - 1 links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import stage


def _directed(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Of every record: its neighbours (all larger ones, or all that aren't larger and itself) linked to the least of all."""
    near = _directed(links) if larger else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = near.join(least, "a")
    if larger:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def classes(links: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """``id, class_id`` of every record in a link (``id_a, id_b``): class_id is the least id that it is linked to, however far."""
    now = stage(links.select(F.greatest("id_a", "id_b").cast("long").alias("a"), F.least("id_a", "id_b").cast("long").alias("b")).where("a <> b").distinct(), "links")
    total = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = total(now)
    for _ in range(most_rounds):
        now = stage(_star(_star(now, True), False), "links")
        after = total(now)
        if after == before:
            own = now.select(F.col("b").alias("id"), F.col("b").alias("class_id")).distinct()
            return now.select(F.col("a").alias("id"), F.col("b").alias("class_id")).unionByName(own)
        before = after
    raise RuntimeError(f"classes didn't settle in {most_rounds} rounds")
