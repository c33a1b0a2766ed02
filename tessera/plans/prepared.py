"""What an index of a folder of tables keeps between queries: made once, written, and only read by the queries.

These are the catalogue's current rows, each passage once, the postings in
order of their terms with the corpus' figures, the searchable vectors, their
compressed matrix, and the cells of the early tier.  An index is known by its
folder and by the length and time of the files it was made from, so changed
tables get a new one.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import catalog, fusion, lexical, semantic
from ..runtime import kept, read, stage

DIM = 64
#: Hundredths of the ids that the matrix covers; the rest are its tail.
MATRIX_SHARE = 95
#: Ids of passages with several rows that go to the executors; if there are more, all passages are exchanged by their ids, and stored.
MOST_REPEATED = 200_000


class Prepared:
    def __init__(self, spark: SparkSession, d: str, key: tuple):
        self.spark, self.d, self.key = spark, d, key

    def _table(self, name: str, make) -> DataFrame:
        return kept((*self.key, name), lambda: stage(make(), name))

    @property
    def files(self) -> DataFrame:
        return self._table("files", lambda: catalog.current(read(self.spark, self.d, "files")))

    @property
    def passages(self) -> DataFrame:
        return self._table("passages", lambda: catalog.passages(read(self.spark, self.d, "chunks")))

    def once(self, *columns: str) -> DataFrame:
        """Some columns of each passage once, straight from the table: texts and vectors are neither exchanged nor stored for it."""

        def make() -> tuple[DataFrame, int]:
            ids = stage(catalog.repeated(read(self.spark, self.d, "chunks")), "repeated")
            return ids, ids.count()

        ids, many = kept((*self.key, "repeated"), make)
        if many > MOST_REPEATED:
            return self.passages.select(*columns)
        chunks = read(self.spark, self.d, "chunks").select(*dict.fromkeys(("chunk_id", "ordinal", *columns)))
        return catalog.passages_once(chunks, ids).select(*columns)

    @property
    def numbers(self) -> DataFrame:
        """The files that aren't junk, numbered in the order of their paths."""
        return self._table("numbers", lambda: fusion.numbered(self.files))

    @property
    def postings(self) -> DataFrame:
        return self._table("postings", lambda: lexical.by_term(lexical.postings(self.passages)))

    @property
    def stats(self):
        return kept((*self.key, "stats"), lambda: lexical.corpus_stats(lexical.lengths(self.passages)).first())

    @property
    def vectors(self) -> DataFrame:
        return self._table("vectors", lambda: semantic.valid_vectors(self.passages, DIM))

    @property
    def searchable(self) -> DataFrame:
        """Vectors of the passages whose file is in the catalogue and isn't junk."""
        whole = self.files.where(~paths.is_junk(F.col("path"))).select("file_id").distinct()
        # From the table, as neither the texts nor the vectors of all passages need be stored for it.
        return self._table("searchable", lambda: semantic.valid_vectors(self.once("chunk_id", "file_id", "embedding").join(whole, "file_id", "left_semi"), DIM))

    @property
    def watermark(self) -> int:
        return kept((*self.key, "watermark"), lambda: int(self.passages.agg(F.max("chunk_id")).first()[0] or 0) * MATRIX_SHARE // 100)

    @cached_property
    def matrix(self) -> DataFrame:
        """Compressed vectors up to the watermark, the stored ones after it."""

        def make() -> tuple[DataFrame, DataFrame]:
            codes, scale = semantic.matrix(self.searchable, self.watermark, "int8", DIM)
            return stage(codes, "matrix"), stage(scale, "scale")

        codes, scale = kept((*self.key, "matrix"), make)
        return semantic.with_tail(codes, scale, "int8", self.searchable, self.watermark)

    @property
    def cells(self) -> semantic.Cells:
        def make() -> semantic.Cells:
            c = semantic.build_cells(self.searchable, dim=DIM)
            return semantic.Cells(stage(c.rows, "cells"), c.centres, c.sample)

        return kept((*self.key, "cells"), make)


def prepared(spark: SparkSession, d: str) -> Prepared:
    """The index of a folder of tables."""
    jvm = spark.sparkContext._jvm
    key: list = [spark.sparkContext.applicationId, d]
    for name in ("files", "chunks"):
        p = jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
        status = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p)
        key += [status.getLen(), status.getModificationTime()]
    return Prepared(spark, d, tuple(key))
