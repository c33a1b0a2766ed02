"""Keeping an index current: what changed, what vanished, replacing, upserting, numbering, reusing, backfilling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..runtime import stage


def changed(walked: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows of a walk (``path, content_sig, ...``) that the catalogue doesn't hold with the same signature; null never equals."""
    known = catalog.where("content_sig is not null").select("path", "content_sig")
    return walked.join(known, ["path", "content_sig"], "left_anti")


def vanished(catalog: DataFrame, seen: DataFrame, completed_roots: list[str]) -> DataFrame:
    """Catalogue rows below a completely walked root whose path the walk didn't see. Junk is seen but never listed, so it stays."""
    below = F.lit(False)
    for root in completed_roots:
        below = below | paths.in_root(F.col("path"), root)
    return catalog.where(below & ~paths.is_junk(F.col("path"))).join(seen.select("path"), "path", "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new``, and those rows of ``old`` whose key it lacks. Keys are unique on each side."""
    return new.select(old.columns).unionByName(old.join(new.select(key), key, "left_anti"))


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``old``, and those rows of ``new`` whose key it lacks."""
    return old.unionByName(new.select(old.columns).join(old.select(key), key, "left_anti"))


def replace_passages(passages: DataFrame, incoming: DataFrame, *, key: str = "file_id") -> DataFrame:
    """All passages of the incoming files replaced by the incoming ones."""
    return passages.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming.select(passages.columns))


def cascade(children: DataFrame, parents: DataFrame, key: str = "file_id") -> DataFrame:
    """The children that still have a parent."""
    return children.join(parents.select(key).distinct(), key, "left_semi")


def numbered(df: DataFrame, order: list[str | Column], start: int, name: str = "chunk_id") -> DataFrame:
    """``df`` with gapless ids above ``start`` by a total order, without sorting everything in one task.

    Rows are range-partitioned and sorted, written with their place in their
    partition, and the partitions' sizes - a number for each - give the offsets.
    """
    at = "__at"
    placed = stage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "numbered")
    part = F.shiftrightunsigned(F.col(at), 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    out = placed.withColumn("part", part).join(F.broadcast(offsets), "part")
    return out.withColumn(name, F.lit(start) + F.col("offset") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("part", "offset", at)


def reusable_vectors(files: DataFrame, passages: DataFrame) -> DataFrame:
    """``file_id, donor_id``: files without vectors and, of their fully embedded twins, the one of least id.

    Twins have the same known content hash and extractor, and the same
    passages in order, told by sums of digests, which need no more than a row for
    however large a file.
    """
    digest = lambda n: F.xxhash64(F.lit(n), "ordinal", F.md5(F.coalesce("text", F.lit("\x00")))).cast("decimal(38,0)")
    shape = passages.where("file_id is not null").groupBy("file_id").agg(
        F.struct(F.count("*").alias("n"), F.sum(digest(1)).alias("x"), F.sum(digest(2)).alias("y")).alias("shape"),
        F.count_if(F.col("embedding").isNull()).alias("missing"),
    )
    known = files.where("content_hash is not null").select("file_id", "content_hash", "extractor").join(shape, "file_id")
    donors = known.where("missing = 0").groupBy("content_hash", "extractor", "shape").agg(F.min("file_id").alias("donor_id"))
    return known.where("missing > 0").join(donors, ["content_hash", "extractor", "shape"]).select("file_id", "donor_id")


def repaired(files: DataFrame, passages: DataFrame) -> DataFrame:
    """``files`` without the signature of those whose first passage is missing, so that they are read again."""
    late = passages.where("file_id is not null").groupBy("file_id").agg(F.min("ordinal").alias("first")).where("first > 0").select("file_id", F.lit(True).alias("__late"))
    return files.join(late, "file_id", "left").withColumn("content_sig", F.when(F.col("__late").isNull(), F.col("content_sig"))).select(files.columns)


def resume_points(passages: DataFrame, progress: DataFrame) -> DataFrame:
    """``progress`` (``file_id, source_sig, next_ordinal``) with ``stored``: the passages already there below the next ordinal."""
    counted = passages.groupBy("file_id", "ordinal").agg(F.lit(1).alias("one"))
    both = progress.join(counted, "file_id", "left")
    return both.groupBy("file_id", "source_sig", "next_ordinal").agg(F.count_if(F.col("ordinal") < F.col("next_ordinal")).alias("stored"))


def backfill_device(files: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files with unknown devices filled in by ``known`` (``root, device``), and how many were checked, updated and unavailable."""
    joined = files.join(known, "root", "left")
    filled = joined.withColumn("source_device", F.coalesce("source_device", "device"))
    unknown = F.col("source_device").isNull()
    counts = joined.agg(F.count_if(unknown).alias("checked"), F.count_if(unknown & F.col("device").isNotNull()).alias("updated"), F.count_if(unknown & F.col("device").isNull()).alias("unavailable"))
    return filled.drop("device"), counts


def main_device(files: DataFrame) -> DataFrame:
    """``root, device``: the most frequent known device of each root, of equal ones the smaller."""
    counted = files.where("source_device is not null and root is not null").groupBy("root", "source_device").agg(F.count("*").alias("n"))
    return counted.groupBy("root").agg(F.min_by("source_device", F.struct(-F.col("n"), "source_device")).alias("device"))


def rotating_sample(files: DataFrame, cursor: int, n: int) -> DataFrame:
    """The next ``n`` files after the cursor by id; from the beginning if there is none."""
    after = files.where(F.col("file_id") > cursor)
    source = after if after.limit(1).count() else files
    return source.orderBy("file_id").limit(n)


def refresh_candidates(files: DataFrame, hits: list[str], cursor: int, limit: int = 12, most_bytes: int = 65_536) -> tuple[DataFrame, int]:
    """Files that a search repairs, and the cursor after them: half of the limit among its hits, half from the rotating sample.

    Each once, small text files that aren't junk only.  The cursor is the
    greatest id of the sample, or 0 if there was nothing to take.
    """
    ok = files.where((F.col("kind") == "text") & (F.col("size") <= most_bytes) & ~paths.is_junk(F.col("path")))
    chosen = ok.where(F.col("path").isin(hits[: limit // 2])) if hits else ok.limit(0)
    sample = rotating_sample(ok, cursor, limit // 2)
    following = sample.agg(F.max("file_id")).first()[0] or 0
    return chosen.unionByName(sample).dropDuplicates(["file_id"]), following


def storage_estimate(passages: DataFrame) -> DataFrame:
    """One row: the bytes that writing the passages may take, four times their encoded text with an overhead each."""
    return passages.agg(F.sum((F.octet_length(F.coalesce("text", F.lit(""))) * 4 + 4096) * 4).alias("estimated_bytes"))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row of counts: shared keys, and those of one side only."""
    both = a.select(key, F.lit(1).alias("l")).distinct().join(b.select(key, F.lit(1).alias("r")).distinct(), key, "full_outer")
    l, r = F.col("l").isNotNull(), F.col("r").isNotNull()  # noqa: E741
    return both.agg(F.count_if(l & r).alias("shared"), F.count_if(l & ~r).alias("only_first"), F.count_if(~l & r).alias("only_second"))


def empty_like(spark: SparkSession, df: DataFrame) -> DataFrame:
    return spark.createDataFrame([], df.schema)
