"""Near-duplicate records: sketches, banding, and exact verification of the candidates.

Exact copies (records with the same set of units) form classes, and only one
representative of a class is banded and compared, so that a text that makes up
a third of all rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import only, stage
from . import hashing
from .groups import classes
from .sketch import band_keys, sketch

_UNITS, _BANDS = "id long, fp binary, low array<int>, high array<smallint>", "id long, fp binary, n int, bands array<bigint>"
#: Representatives that share a band and are compared by one task with all others that share it.
HOT_BAND = 1000


def _tokens(texts: list[str], unit: str, cache: hashing.TokenHashes) -> tuple[np.ndarray, np.ndarray]:
    lists = [hashing.words(t) for t in texts] if unit == "word" else [t.lower() for t in texts]
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((cache[w] for x in lists for w in x), np.uint64, int(lengths.sum()))
    return flat, lengths


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values))


def _sets(batches: Iterator[pa.RecordBatch], unit: str, size: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Ids and the sorted distinct units of every text that has any."""
    cache = hashing.TokenHashes()
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            flat, lengths = _tokens(part.column(1).to_pylist(), unit, cache)
            grams, counts = hashing.runs(flat, lengths, size)
            ends = np.cumsum(counts)
            sets = [np.unique(grams[e - c : e]) for e, c in zip(ends, counts, strict=True) if c]
            if sets:
                yield part.column(0).filter(pa.array(counts > 0)), sets


def _digests(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())


class UnitSets:
    """The records of one table as sets of units, for one choice of unit and bands."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, *, unit: str, size: int, bands: int, rows: int):
        self.src = only(df, id=F.col(f"`{id_col}`").cast("long"), text=text_col).where("id is not null and text is not null")
        self.unit, self.size, self.bands, self.rows = unit, size, bands, rows
        self.records = self._banded()

    def units(self) -> DataFrame:
        """``id, fp, low, high``, computed anew by each action: cheaper than keeping them, as they don't compress.

        Of each unit's hash 48 bits travel, in two arrays of 4 and 2 bytes: two
        sets of some hundred units are compared wrongly once in 10 ** 10 pairs.
        """
        unit, size = self.unit, self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, sets in _sets(batches, unit, size):
                counts = np.fromiter(map(len, sets), np.int64, len(sets))
                flat = np.concatenate(sets)
                low, high = flat.astype(np.uint32).view(np.int32), (flat >> np.uint64(32)).astype(np.uint16).view(np.int16)
                yield pa.RecordBatch.from_arrays([ids, _digests(sets), _lists(low, counts), _lists(high, counts)], names=["id", "fp", "low", "high"])

        return self.src.mapInArrow(run, _UNITS)

    def _banded(self) -> DataFrame:
        """``id, fp, n, bands``, written to the shared folder; fp identifies the set, n is its size."""
        unit, size, bands, rows = self.unit, self.size, self.bands, self.rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, sets in _sets(batches, unit, size):
                counts = np.fromiter(map(len, sets), np.int64, len(sets))
                keys = band_keys(sketch(np.concatenate(sets), counts, bands * rows), rows)
                yield pa.RecordBatch.from_arrays([ids, _digests(sets), pa.array(counts.astype(np.int32)), _lists(keys.reshape(-1), np.full(len(sets), bands))], names=["id", "fp", "n", "bands"])

        return stage(self.src.mapInArrow(run, _BANDS), "bands")


def _whole(low: str, high: str) -> Column:
    join = lambda l, h: F.shiftleft(h.cast("long"), 32).bitwiseOR(l.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))  # noqa: E731, E741
    return F.zip_with(low, high, join)


def band_pairs(banded: DataFrame, threshold: float, *, hot: int = HOT_BAND) -> DataFrame:
    """``id_a, id_b`` (id_a < id_b): records (``rep, n, key``) that share a band and whose sizes ``n`` allow the similarity.

    Records alone in their band leave before the join.  A band of more than
    ``hot`` records is cut into parts, each of which meets all of the band in
    a task of its own.
    """
    met = banded.withColumn("m", F.count("*").over(Window.partitionBy("key"))).where("m > 1")
    parts = F.ceil(F.col("m") / hot).cast("int")
    a = met.select("key", F.pmod(F.xxhash64("rep"), parts).cast("int").alias("part"), F.col("rep").alias("id_a"), F.col("n").alias("n_a"))
    b = met.select("key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("rep").alias("id_b"), F.col("n").alias("n_b"))
    near = F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")
    return a.join(b, ["key", "part"]).where((F.col("id_a") < F.col("id_b")) & near).select("id_a", "id_b").distinct()


def class_links(sets: UnitSets, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Verified links between classes of equal sets, and the members of classes with more than one.

    links: ``id_a, fp_a, id_b, fp_b``, the least ids of the two classes and
    their digests; copies: ``fp, id``.
    """
    records = sets.records
    reps = records.groupBy("fp").agg(F.min_by(F.struct("id", "n", "bands"), "id").alias("r"))
    banded = reps.select(F.col("r.id").alias("rep"), F.col("r.n").alias("n"), F.explode("r.bands").alias("key"))
    candidates = band_pairs(banded, threshold)
    units = sets.units()
    side = lambda x: units.select(*(F.col(c).alias(f"{c}_{x}") for c in units.columns))
    both = candidates.join(side("a"), "id_a").join(side("b"), "id_b")
    shared = F.size(F.array_intersect(_whole("low_a", "high_a"), _whole("low_b", "high_b")))
    similar = shared / (F.size("low_a") + F.size("low_b") - shared) >= threshold
    links = both.where(similar).select("id_a", "fp_a", "id_b", "fp_b").distinct()
    classes = records.groupBy("fp").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
    copies = records.select("id", "fp").join(classes.select("fp"), "fp", "left_semi").select("fp", "id").distinct()
    return links, copies


def similar_pairs(df: DataFrame, id_col: str, text_col: str, *, threshold: float = 0.8, unit: str = "word", size: int = 5, bands: int = 24, rows: int = 3) -> DataFrame:
    """All pairs ``id_a, id_b`` (id_a < id_b) of records whose units have a Jaccard similarity of at least ``threshold``.

    A unit is a run of ``size`` consecutive words (or characters, with
    unit="char") of the lower-cased text.  Two records agree in a band with
    probability s ** rows, so a pair of similarity s is a candidate with
    probability 1 - (1 - s ** rows) ** bands; every candidate is verified
    exactly.  Null ids, null texts and texts with fewer than ``size`` words
    never count, repeated rows of one id count once, and an id with several
    texts is compared by each of them.  An empty table gives no pairs.
    """
    sets = UnitSets(df, id_col, text_col, unit=unit, size=size, bands=bands, rows=rows)
    links, copies = class_links(sets, threshold)
    member = lambda x: copies.select(F.col("fp").alias(f"fp_{x}"), F.col("id").alias(f"member_{x}"))
    across = links.join(member("a"), "fp_a", "left").join(member("b"), "fp_b", "left")
    across = across.select(*(F.coalesce(f"member_{x}", f"id_{x}").alias(y) for x, y in ("ax", "by")))
    within = copies.withColumnRenamed("id", "x").join(copies.withColumnRenamed("id", "y"), "fp").select("x", "y")
    pairs = across.unionByName(within).where("x <> y")
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def similar_groups(df: DataFrame, id_col: str, text_col: str, *, threshold: float = 0.8, unit: str = "word", size: int = 5, bands: int = 24, rows: int = 3) -> DataFrame:
    """``id, class_id, copies, links`` of every record that has a unit: the class of records linked by similarity.

    ``class_id`` is the least id of the class, ``copies`` the number of records
    with the same set of units (the record itself included), ``links`` the
    number of other such sets that are similar to its own.  Copies and their
    pairs are never spelled out, so a text that a third of all records share
    costs one representative.  What doesn't count is as for similar_pairs; an
    empty table gives no rows.
    """
    sets = UnitSets(df, id_col, text_col, unit=unit, size=size, bands=bands, rows=rows)
    links, _ = class_links(sets, threshold)
    links = stage(links, "class-links")
    linked = classes(links).withColumnsRenamed({"id": "rep", "class_id": "linked"})
    ends = links.select(F.col("id_a").alias("rep")).unionByName(links.select(F.col("id_b").alias("rep")))
    degree = ends.groupBy("rep").agg(F.count("*").alias("links"))
    records = sets.records.select("id", "fp")
    per_class = records.groupBy("fp").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("copies"))
    per_class = per_class.join(linked, "rep", "left").join(degree, "rep", "left")
    per_class = per_class.select("fp", F.coalesce("linked", "rep").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
    return records.join(per_class, "fp").select("id", "class_id", "copies", "links").distinct()
