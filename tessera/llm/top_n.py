"""The N best items of every group, by a loser-tree merge of stored sorted runs.

Batches of rows are cut to the N best of each group as they come, so a group
with millions of items reaches the exchange as a few rows of every batch.  Rows
are then put into runs, by group into buckets and within a bucket by item, as
many as their number asks for; each run is sorted by group and score and
stored in the shared folder.  One task per bucket merges the bucket's runs with
a loser tree.  A run is read by row groups, each cut to the N best of its
groups on arrays; after the N-th item of a group every run seeks to its next
group, by the statistics of its row groups, so what is left of a large group is
neither read nor held in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import shared_files, stage, stage_path

_KEY = ("g1", "g2", "score", "item")
_LAST = (np.inf,) * 4
#: Rows of a run and of a bucket, about; bytes of a row group.
RUN_ROWS, BUCKET_ROWS, ROW_GROUP_BYTES = 131_072, 2_000_000, 1 << 20

Columns = list[np.ndarray]


def best_of_groups(columns: Columns, n: int) -> np.ndarray:
    """Of sorted columns g1, g2, score, item the rows of the first n distinct items of each group, each at its best score."""
    g1, g2, _, item = columns
    if not len(g1):
        return np.empty(0, np.int64)
    new = np.concatenate([[True], (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1])])
    group = np.cumsum(new) - 1
    # The first row of each item of a group; rows of a group are in order of their score.
    order = np.lexsort((np.arange(len(item)), item, group))
    again = np.zeros(len(item), bool)
    again[order[1:]] = (item[order[1:]] == item[order[:-1]]) & (group[order[1:]] == group[order[:-1]])
    counted = np.cumsum(~again)
    place = counted - (counted - ~again)[new][group]
    return np.flatnonzero(~again & (place <= n))


class Run:
    """A cursor over one stored run; ``head`` is the key of its current row, or greater than any key at its end.

    ``files`` are Parquet files whose row groups are sorted, in sequence.
    """

    def __init__(self, files: list[pq.ParquetFile], n: int):
        self.n = n
        self.parts = [(f, i) for f in files for i in range(f.metadata.num_row_groups)]
        self.next_part = self.size = self.at = self.row_groups_read = 0
        self.passed: tuple | None = None
        self.last: tuple | None = None
        self.head: tuple = _LAST
        self._load()

    def _all_of(self, part: tuple[pq.ParquetFile, int], group: tuple) -> bool:
        """Whether a row group holds rows of this group only, by its statistics."""
        row_group = part[0].metadata.row_group(part[1])
        names = {row_group.column(c).path_in_schema: row_group.column(c).statistics for c in range(row_group.num_columns)}
        stats = [names.get(c) for c in ("g1", "g2")]
        return all(s is not None and s.has_min_max and s.min == s.max == g for s, g in zip(stats, group, strict=True))

    def _load(self) -> bool:
        while self.next_part < len(self.parts):
            part = self.parts[self.next_part]
            self.next_part += 1
            if self.passed and self._all_of(part, self.passed):
                continue
            self.row_groups_read += 1
            table = part[0].read_row_group(part[1], columns=list(_KEY), use_threads=False)
            columns = [table.column(c).to_numpy() for c in _KEY]
            if not table.num_rows:
                continue
            self._check(columns)
            keep = best_of_groups(columns, self.n)
            if self.passed:
                keep = keep[(columns[0][keep] != self.passed[0]) | (columns[1][keep] != self.passed[1])]
            if len(keep):
                columns = [c[keep] for c in columns]
                change = np.flatnonzero((columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])) + 1
                ends = np.append(change, len(keep))
                self.ends = np.repeat(ends, np.diff(np.concatenate([[0], ends]))).tolist()
                self.rows = list(zip(*(c.tolist() for c in columns), strict=True))
                self.size, self.at = len(keep), 0
                self.head = self.rows[0]
                return True
        self.size, self.head = 0, _LAST
        return False

    def _check(self, columns: Columns) -> None:
        """A run that isn't sorted would be merged wrongly; better no result."""
        later, same = np.zeros(len(columns[0]) - 1, bool), np.ones(len(columns[0]) - 1, bool)
        for c in columns:
            later |= same & (c[1:] > c[:-1])
            same &= c[1:] == c[:-1]
        first, before, self.last = tuple(c[0] for c in columns), self.last, tuple(c[-1] for c in columns)
        if not (later | same).all() or before is not None and first < before:
            raise ValueError("a stored run isn't sorted")

    def next(self) -> None:
        self.at += 1
        if self.at < self.size:
            self.head = self.rows[self.at]
        else:
            self._load()

    def seek_past(self, group: tuple) -> None:
        """To the first row of a later group."""
        self.passed = group
        while self.size and self.head[:2] == group:
            self.at = self.ends[self.at]
            if self.at < self.size:
                self.head = self.rows[self.at]
            else:
                self._load()


class LoserTree:
    """A tournament over the runs: inner nodes keep the losers, so a new head is played against one path only."""

    def __init__(self, runs: list[Run]):
        self.runs = runs
        self.k = len(runs)
        self.build()

    def build(self) -> None:
        k = self.k
        winner = [0] * k + list(range(k))
        self.losers = [0] * k
        for node in range(k - 1, 0, -1):
            a, b = winner[2 * node], winner[2 * node + 1]
            if self.runs[b].head < self.runs[a].head:
                a, b = b, a
            winner[node], self.losers[node] = a, b
        self.top = winner[1] if k > 1 else 0

    def replay(self, run: int) -> None:
        """After the head of the winner's run has changed."""
        best, node = run, (run + self.k) // 2
        while node:
            if self.runs[self.losers[node]].head < self.runs[best].head:
                best, self.losers[node] = self.losers[node], best
            node //= 2
        self.top = best

    def first_of_groups(self, n: int) -> Iterator[tuple[tuple, int]]:
        """The first n distinct items of every group, with their place."""
        while (head := self.runs[self.top].head) is not _LAST:
            group, place, seen = head[:2], 0, set()
            while head is not _LAST and head[:2] == group:
                if head[3] not in seen:
                    place += 1
                    seen.add(head[3])
                    yield head, place
                    if place == n:
                        break
                self.runs[self.top].next()
                self.replay(self.top)
                head = self.runs[self.top].head
            else:
                continue
            moved = [r for r in self.runs if r.head[:2] == group]
            for r in moved:
                r.seek_past(group)
            if len(moved) == 1 and moved[0] is self.runs[self.top]:
                self.replay(self.top)
            else:
                self.build()


def merge_bucket(files: Callable[[str], dict], path: str, n: int) -> Iterator[tuple[tuple, int]]:
    """The first n items of every group in the runs stored under one bucket's path; each of its files is a run."""
    opened = files(path)
    if opened:
        yield from LoserTree([Run([pq.ParquetFile(f)], n) for f in opened.values()]).first_of_groups(n)


def top_n(df: DataFrame, n: int, *, buckets: int | None = None, runs: int | None = None) -> DataFrame:
    """``g1, g2, item, score, place``: per group (g1, g2) the n items with the smallest scores, equal scores by the smaller item.

    ``df`` has the long columns g1, g2 and item and the double column score;
    other columns are ignored.  Rows with a null (or a score of NaN) among
    these don't count; of several scores of one item in a group the smallest
    counts, so repeated rows count once.  An empty table gives no rows.
    """
    spark = df.sparkSession
    rows = df.select(*(F.col(c).cast("double" if c == "score" else "long").alias(c) for c in _KEY)).dropna().where(~F.isnan("score"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in _KEY]
            order = np.lexsort(columns[::-1])
            keep = order[best_of_groups([c[order] for c in columns], n)]
            yield batch.take(pa.array(keep))

    cut_rows = stage(rows.mapInArrow(cut, "g1 long, g2 long, score double, item long"), "top-rows")
    left = cut_rows.count()
    buckets = buckets or max(4, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-left // BUCKET_ROWS))
    runs = runs or max(2, -(-left // buckets // RUN_ROWS))
    spread = cut_rows.withColumn("bucket", F.pmod(F.xxhash64("g1", "g2"), F.lit(buckets)).cast("int")).withColumn("run", F.pmod(F.xxhash64("item"), F.lit(runs)).cast("int"))
    path = stage_path(spark, "runs")
    spread.repartition("bucket", "run").sortWithinPartitions("bucket", "run", *_KEY).write.option("parquet.block.size", ROW_GROUP_BYTES).partitionBy("bucket", "run").parquet(path)
    files = shared_files(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket in batch.column(0).to_pylist():
                out: list[tuple] = []
                for head, place in merge_bucket(files, f"{path}/bucket={bucket}", n):
                    out.append((*head, place))
                    if len(out) == 50_000:
                        yield _batch(out)
                        out = []
                yield _batch(out)

    return spark.range(0, buckets, 1, buckets).mapInArrow(run, "g1 long, g2 long, item long, score double, place int")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    g1, g2, score, item, place = zip(*rows, strict=True) if rows else ((),) * 5
    return pa.RecordBatch.from_arrays([pa.array(g1, pa.int64()), pa.array(g2, pa.int64()), pa.array(item, pa.int64()), pa.array(score, pa.float64()), pa.array(place, pa.int32())], names=["g1", "g2", "item", "score", "place"])
