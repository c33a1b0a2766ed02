"""The k most similar vectors of every vector, by a hierarchical k-means tree.

The upper levels of the tree are fitted on a bounded sample (``sample_rows``).  Every row is indexed in a leaf
that is nearest to it; leaves that turn out too large, by exact counts over all rows, are split further by
fits among their own rows, so that the number of leaves grows with the rows and the size of a leaf doesn't.
A search walks the tree best bin first: a priority queue holds nodes and leaves by their cosine to the query,
each level with a calibrated lift, and only the children of nodes that come out are looked at.  The search ends
when what comes out is more than a margin below the best leaf, or when it has visited a number of leaves.  These are
widened until the wanted recall is reached, at the least number of visits, on exact neighbours: of sampled rows in the sample, or, where only neighbours above a
bound count, of sampled rows among all rows.  Queries then travel to the leaves they visit; no query meets
the whole collection.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.semantic import kmeans
from ..runtime import only, stage
from .hashing import U64, mix64

#: A leaf with more rows than SPLIT_LEAVES times the wanted number is split.
SPLIT_LEAVES = 2
#: Children of a node that is split, at most, and sampled rows that each child is fitted on.
FANOUT, FIT_ROWS = 256, 32
#: Leaves of a tree, at most: 34 MB of centroids of 64 dimensions on every executor.
MOST_LEAVES = 131_072
#: Rows of one block of a leaf; a larger leaf, which only a tree of MOST_LEAVES or of very many equal rows can have, is cut into several blocks.
BLOCK_ROWS = 4096
#: Visits that are tried as a bound of a search.
MOST_VISITS = 64
#: Bytes of vectors that one task compares, about.
TASK_BYTES = 8 << 20
#: Rows whose neighbours above a bound are sought among all rows for the calibration.
CALIBRATION_ROWS = 10_000


@dataclass
class Search:
    """How far a search goes: the margin below the best leaf, the lift of the nodes of each inner level, and how many leaves it visits at most and about on average."""

    margin: float
    lifts: list[float]
    most: int
    visits: float = 1.0


@dataclass
class Tree:
    """Levels of unit centroids; the children of node i of a level are first[level][i] to first[level][i + 1] of the next."""

    levels: list[np.ndarray]
    first: list[np.ndarray]

    @property
    def leaves(self) -> np.ndarray:
        return self.levels[-1]

    def parents(self, level: int) -> np.ndarray:
        """The parent of every node of the level after this one."""
        return np.repeat(np.arange(len(self.levels[level])), np.diff(self.first[level]))

    def _best_children(self, level: int, rows: np.ndarray, nodes: np.ndarray, vectors: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every (row, node) the ``keep`` children nearest to the row's vector, as rows, children and cosines."""
        order = np.argsort(nodes, kind="stable")
        rows, nodes = rows[order], nodes[order]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for part in np.split(np.arange(len(nodes)), np.flatnonzero(np.diff(nodes)) + 1):
            lo, hi = self.first[level][nodes[part[0]] : nodes[part[0]] + 2]
            near = vectors[rows[part]] @ self.levels[level + 1][lo:hi].T
            at = np.argsort(-near, axis=1, kind="stable")[:, :keep]
            out.append((np.repeat(rows[part], at.shape[1]), lo + at.ravel(), np.take_along_axis(near, at, 1).ravel()))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def home(self, vectors: np.ndarray, width: int = 4) -> np.ndarray:
        """The leaf in which every vector is indexed: the nearest one below the ``width`` nearest nodes of each level."""
        out = np.zeros(len(vectors), np.int64)
        for a in range(0, len(vectors), 8192):
            v = vectors[a : a + 8192]
            near = v @ self.levels[0].T
            at = np.argsort(-near, axis=1, kind="stable")[:, :width]
            rows, nodes, cosines = np.repeat(np.arange(len(v)), at.shape[1]), at.ravel(), np.take_along_axis(near, at, 1).ravel()
            for level in range(len(self.levels) - 1):
                rows, nodes, cosines = self._best_children(level, rows, nodes, v, width)
                order = np.lexsort((nodes, -cosines, rows))
                rows, nodes, cosines = rows[order], nodes[order], cosines[order]
                nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
                rows, nodes, cosines = rows[nth < width], nodes[nth < width], cosines[nth < width]
            one = np.searchsorted(rows, np.arange(len(v)))
            out[a : a + len(v)] = nodes[one]
        return out

    def visits(self, queries: np.ndarray, search: Search) -> tuple[np.ndarray, np.ndarray]:
        """The leaves that every query visits, as rows and numbers of leaves, best bin first.

        The queue begins with the top nodes.  A node that comes out puts its
        children into the queue, a leaf that comes out is visited; the search
        ends when the best of what is left is more than the margin below the
        best leaf seen, or after ``most`` leaves.  Nodes count with their level's lift.
        """
        rows: list[int] = []
        leaves: list[int] = []
        last, levels, margin = len(self.levels) - 1, self.levels, search.margin
        lifts, bounds = [*search.lifts, 0.0], [f.tolist() for f in self.first]
        pop, push = heapq.heappop, heapq.heappush
        for a in range(0, len(queries), 1000):
            tops = queries[a : a + 1000] @ levels[0].T + lifts[0]
            for q, keys in enumerate(tops):
                v = queries[a + q]
                best, left = float(keys.max()) if not last else -2.0, search.most
                queue = [(-k, 0, i) for i, k in enumerate(keys.tolist())]
                heapq.heapify(queue)
                while queue and left:
                    key, level, node = pop(queue)
                    if -key < best - margin:
                        break
                    if level == last:
                        rows.append(a + q)
                        leaves.append(node)
                        left -= 1
                        continue
                    lo, hi = bounds[level][node], bounds[level][node + 1]
                    level += 1
                    near = levels[level][lo:hi] @ v
                    if level == last:
                        best = max(best, float(near.max()))
                    near = near + lifts[level]
                    for i in np.flatnonzero(near >= best - margin).tolist():
                        push(queue, (-float(near[i]), level, lo + i))
        return np.array(rows, np.int64), np.array(leaves, np.int64)

    def gaps(self, queries: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per level and query, by how much the wanted leaf (or its ancestor) is farther than the query's best leaf, and how many leaves are nearer."""
        out, nearer = np.empty((len(self.levels), len(queries))), np.empty(len(queries), np.int64)
        node = wanted
        at = []
        for level in range(len(self.levels) - 1, -1, -1):
            at.append(node)
            node = self.parents(level - 1)[node] if level else node
        for a in range(0, len(queries), 1000):
            v = queries[a : a + 1000]
            near = v @ self.leaves.T
            best = near.max(axis=1)
            nearer[a : a + 1000] = (near > near[np.arange(len(v)), wanted[a : a + 1000]][:, None]).sum(axis=1)
            for level, nodes in zip(range(len(self.levels)), reversed(at), strict=True):
                out[level, a : a + 1000] = best - (v * self.levels[level][nodes[a : a + 1000]]).sum(axis=1)
        return out, nearer


def fit(sample: np.ndarray, leaves: int, seed: int = 42) -> Tree:
    """A tree of two levels and about ``leaves`` leaves over unit vectors."""
    rng = np.random.default_rng(seed)
    tops, own = kmeans(sample, max(1, round(math.sqrt(leaves))), rng)
    parts, first = [], [0]
    for t in range(len(tops)):
        members = sample[own == t]
        part = kmeans(members, max(1, round(leaves * len(members) / len(sample))), rng)[0] if len(members) else tops[t : t + 1]
        parts.append(part)
        first.append(first[-1] + len(part))
    return Tree([tops, np.concatenate(parts).astype(np.float32)], [np.array(first)])


def children_wanted(counts: np.ndarray, leaf_rows: int, most_leaves: int = MOST_LEAVES) -> np.ndarray:
    """Into how many leaves each leaf with so many rows is to be split: 1 for those that stay."""
    wanted = np.where(counts > SPLIT_LEAVES * leaf_rows, np.clip(-(-counts // leaf_rows), 1, FANOUT), 1)
    room = most_leaves - len(counts)
    extra = int((wanted - 1).sum())
    if extra > room:
        wanted = 1 + (wanted - 1) * max(0, room) // extra
    return wanted


def blocks_of(counts: np.ndarray) -> np.ndarray:
    """Blocks of each leaf."""
    return np.maximum(1, -(-counts // BLOCK_ROWS)).astype(int)


def counted(index: DataFrame, tree: Tree, dim: int) -> np.ndarray:
    """Rows of every leaf, exactly."""
    shared = index.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value.leaves), np.int64)
        for batch in batches:
            total += np.bincount(shared.value.home(_units(batch.column("vec"), dim).astype(np.float32)), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["leaf", "n"])

    found = index.select("vec").mapInArrow(run, "leaf int, n long").groupBy("leaf").agg(F.sum("n").alias("n")).toArrow()  # a row for a leaf
    out = np.zeros(len(tree.leaves), np.int64)
    out[found.column("leaf").to_numpy()] = found.column("n").to_numpy()
    return out


def grown(index: DataFrame, tree: Tree, counts: np.ndarray, wanted: np.ndarray, dim: int) -> Tree:
    """A tree in which every leaf that is to be split has been fitted on a sample of its own rows, each by one task.

    The new leaves take the place of the old ones as long as few are split;
    otherwise they make one more level below them.
    """
    spark = index.sparkSession
    rate = np.where(wanted > 1, np.minimum(1.0, FIT_ROWS * wanted / np.maximum(1, counts)), 0.0)
    shared = spark.sparkContext.broadcast((tree, (rate * 2**53).astype(np.uint64)))
    split = {int(i): int(wanted[i]) for i in np.flatnonzero(wanted > 1)}

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, least = shared.value
        for batch in batches:
            leaf = own.home(_units(batch.column("vec"), dim).astype(np.float32))
            keep = np.flatnonzero(mix64(batch.column("id").to_numpy().view(np.uint64) ^ U64(77)) >> U64(11) < least[leaf])
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(keep)), batch.column("vec").take(pa.array(keep)), pa.array(leaf[keep].astype(np.int32))], names=["id", "vec", "leaf"])

    def refit(members: pa.Table) -> pa.Table:
        members = members.sort_by("id")
        leaf = members.column("leaf")[0].as_py()
        centres = kmeans(_units(members.column("vec"), dim).astype(np.float32), split[leaf], np.random.default_rng(leaf))[0]
        return pa.table({"leaf": pa.array([leaf] * len(centres), pa.int32()), "nth": pa.array(range(len(centres)), pa.int32()), "centre": pa.array(list(centres.astype(np.float32)), pa.list_(pa.float32()))})

    fits = index.select("id", "vec").mapInArrow(drawn, "id long, vec array<float>, leaf int").groupBy("leaf").applyInArrow(refit, "leaf int, nth int, centre array<float>")
    table = fits.toArrow().sort_by([("leaf", "ascending"), ("nth", "ascending")])  # MOST_LEAVES rows at most
    leaf = table.column("leaf").to_numpy()
    centres = _matrix(table.column("centre"), dim) if table.num_rows else tree.leaves[:0]
    alone = np.setdiff1d(np.arange(len(tree.leaves)), leaf)
    order = np.argsort(np.concatenate([leaf, alone]), kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.maximum(1, np.bincount(leaf, minlength=len(tree.leaves))))])
    leaves = np.concatenate([centres, tree.leaves[alone]])[order].astype(np.float32)
    if len(leaves) < 2 * len(tree.leaves):
        return Tree([*tree.levels[:-1], leaves], [*tree.first[:-1], ends[tree.first[-1]]])
    return Tree([*tree.levels, leaves], [*tree.first, ends])


Pairs = tuple[np.ndarray, np.ndarray]


def calibrate(tree: Tree, sample: np.ndarray, k: int, least: float, recall: float, *, both_ways: bool = False, pairs: Pairs | None = None) -> tuple[Search, float]:
    """How far to search for ``recall`` of the pairs of a query and its neighbour, and the recall reached.

    Without ``pairs``, those of the k nearest in the sample whose cosine is
    ``least`` or more; with ``both_ways`` a pair also counts if the neighbour
    would find the query.
    """
    asking, wanted = pairs or sample_pairs(sample, k, least)
    inner = len(tree.levels) - 1
    if not len(asking):
        return Search(0.0, [0.0] * inner, 1), 1.0
    gap = tree.gaps(asking, tree.home(wanted))
    back = tree.gaps(wanted, tree.home(asking)) if both_ways else gap
    easier = np.where(gap[0][-1] <= back[0][-1], gap[0], back[0])
    # The inner levels together may lose half of what may be lost.
    opened = [float(np.quantile(g, 1 - (1 - recall) / 2 / inner, method="higher")) + 1e-6 for g in easier[:-1]]
    reached = [(np.where((g[:-1] <= np.array(opened)[:, None]).all(axis=0), g[-1], np.inf), nearer) for g, nearer in (gap, back)]
    some = asking[:: max(1, len(asking) // 1000)]
    near = -np.sort(-(some @ tree.leaves.T), axis=1)[:, :MOST_VISITS]
    best: tuple[float, Search, float] | None = None
    for most in range(1, near.shape[1] + 1):
        one = np.minimum(*(np.where(nearer < most, g, np.inf) for g, nearer in reached))
        margin = float(np.quantile(one, recall, method="higher")) + 1e-6
        if not math.isfinite(margin) and most < near.shape[1]:
            continue
        if not math.isfinite(margin):  # not by so few leaves: then by the margin alone
            most, one = len(tree.leaves), np.minimum(reached[0][0], reached[1][0])
            margin = float(np.quantile(one, recall, method="higher")) + 1e-6
        visits = float((near[:, :1] - near[:, :most] <= margin).sum(axis=1).mean())
        if best is None or visits < best[0]:
            best = visits, Search(margin, [o - margin for o in opened], most, visits), float((one <= margin).mean())
    return best[1:]


def sample_pairs(sample: np.ndarray, k: int, least: float = -1.0, queries: int = 500) -> Pairs:
    """Some vectors of the sample and their k nearest in it, as far as the cosine is ``least`` or more."""
    k = min(k, len(sample) - 1)
    if k < 1:
        return sample[:0], sample[:0]
    own = np.arange(0, len(sample), max(1, len(sample) // queries))
    cosines = sample[own] @ sample.T
    cosines[np.arange(len(own)), own] = -2
    near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    good = np.take_along_axis(cosines, near, 1) >= least
    return sample[np.repeat(own, good.sum(axis=1))], sample[near[good]]


def bounded_pairs(index: DataFrame, ids: np.ndarray, asked: np.ndarray, *, dim: int, k: int, least: float, fewest: int) -> Pairs:
    """Vectors that were asked for and of those of their k nearest among all rows whose cosine is ``least`` or more.

    Every batch hands on the best k of each query only.  If less than ``fewest``
    pairs come out, pairs that are just so near are made from the vectors.
    """
    shared = index.sparkSession.sparkContext.broadcast((ids, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = shared.value
        for batch in batches:
            own, m = batch.column("id").to_numpy(), _units(batch.column("vec"), dim).astype(np.float32)
            for a in range(0, len(q), 1000):
                cosines = q[a : a + 1000] @ m.T
                rows = np.flatnonzero(cosines.max(axis=1, initial=-2) >= least)
                cosines = cosines[rows]
                cosines[own[None, :] == q_ids[a + rows, None]] = -2
                near = np.argpartition(-cosines, k - 1, axis=1)[:, :k] if len(own) > k else np.broadcast_to(np.arange(len(own)), (len(rows), len(own)))
                good = np.take_along_axis(cosines, near, 1) >= least
                at = near[good]
                found = [pa.array(np.repeat(a + rows, good.sum(axis=1)), pa.int64()), batch.column("id").take(pa.array(at)), pa.array(np.take_along_axis(cosines, near, 1)[good].astype(np.float64)), batch.column("vec").take(pa.array(at))]
                yield pa.RecordBatch.from_arrays(found, names=["query", "id", "cosine", "vec"])

    found = index.select("id", "vec").mapInArrow(run, "query long, id long, cosine double, vec array<float>")
    best = Window.partitionBy("query").orderBy(F.desc("cosine"), "id")
    table = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k).select("query", "id", "vec").toArrow().sort_by([("query", "ascending"), ("id", "ascending")])
    asking, wanted = asked[table.column("query").to_numpy()], _units(table.column("vec"), dim).astype(np.float32) if table.num_rows else asked[:0]
    if len(asking) < fewest:
        rng = np.random.default_rng(9)
        x = asked[rng.choice(len(asked), 2000)]
        away = rng.normal(size=x.shape)
        away -= (away * x).sum(axis=1, keepdims=True) * x
        made = least * x + math.sqrt(max(0.0, 1 - least * least)) * away / np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-9)
        asking, wanted = np.concatenate([asking, x]), np.concatenate([wanted, made.astype(np.float32)])
    return asking, wanted


def usable_vectors(df: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """``id, vec`` once for every id whose vector has exactly ``dim`` finite values, not all zero."""
    src = only(df, id=F.col(f"`{id_col}`").cast("long"), vec=F.col(f"`{vector_col}`").cast("array<float>")).where((F.size("vec") == dim) & F.col("id").isNotNull())
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("vec", lambda x: x != 0)
    return src.where(~bad & some).groupBy("id").agg(F.first("vec").alias("vec"))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = flat.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dim)


def _units(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    m = _matrix(column, dim).astype(np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)  # the squares of very small or large values would not be finite
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _search(members: pa.Table, queries: pa.Table, dim: int, k: int, least: float, both_ways: bool) -> pa.Table:
    """The k nearest members of each query, by cosine in double precision rounded to 6 decimals, then by id.

    With ``both_ways`` each pair comes out from both ends: whoever is found has found its finder, too.
    """
    ids, first = np.unique(members.column("id").to_numpy(), return_index=True)
    m = _units(members.column("vec"), dim)[first]
    q_ids, qm = queries.column("id").to_numpy(), _units(queries.column("vec"), dim)
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    width = len(ids)
    step = max(1, 4_000_000 // max(1, width))
    for a in range(0, len(q_ids), step):
        micro = np.rint(qm[a : a + step] @ m.T * 1e6)
        own = ids[None, :] == q_ids[a : a + step, None]
        # One exact number, below 2 ** 53, orders by cosine, then by the smaller id: members are sorted by id, and fewer than 2 ** 32.
        key = micro * 4294967296.0 - np.arange(width)
        key[own] = -np.inf
        if least > -1:
            rows = np.flatnonzero((micro >= round(least * 1e6)).sum(axis=1) > own.sum(axis=1))
            key, micro = key[rows], micro[rows]
        else:
            rows = np.arange(len(key))
        if not len(rows):
            continue
        top = np.argpartition(-key, k - 1, axis=1)[:, :k] if width > k else np.broadcast_to(np.arange(width), (len(rows), width))
        cos = np.take_along_axis(micro, top, 1)
        good = np.isfinite(np.take_along_axis(key, top, 1)) & (cos >= least * 1e6 - 0.5)
        kept.append((np.repeat(q_ids[a + rows], top.shape[1])[good.ravel()], ids[top.ravel()][good.ravel()], cos.ravel()[good.ravel()] / 1e6))
    parts = [np.concatenate(x) if kept else np.empty(0, t) for x, t in zip(zip(*kept, strict=True) if kept else ((), (), ()), (np.int64, np.int64, np.float64), strict=True)]
    if both_ways:
        parts = [np.concatenate([parts[0], parts[1]]), np.concatenate([parts[1], parts[0]]), np.concatenate([parts[2], parts[2]])]
    return pa.table({"id": pa.array(parts[0], pa.int64()), "near": pa.array(parts[1], pa.int64()), "cosine": pa.array(parts[2], pa.float64())})


def nearest(df: DataFrame, id_col: str, vector_col: str, *, dim: int = 64, k: int = 5, least: float = -1.0, recall: float = 0.97, every: int = 1, leaf_rows: int = 1600, sample_rows: int = 20_000) -> DataFrame:
    """``id, near, cosine, place``: the k most similar other vectors of every vector (or of every id divisible by ``every``).

    Cosines are taken in double precision and rounded to 6 decimals; of equal
    cosines the smaller id is nearer.  Neighbours below ``least`` are left out,
    and the number of visited leaves is calibrated to ``recall`` of the others.
    Unusable vectors (null, of another length, with a null or a value that
    isn't finite, all zero) and null ids don't take part; repeated rows of an
    id count once.  Identical vectors form a class of which only the k + 1
    smallest ids are indexed: no other id of it can be among any k nearest.
    An empty table gives no rows.
    """
    spark = df.sparkSession
    usable = usable_vectors(df, id_col, vector_col, dim).withColumn("fp", F.struct(F.xxhash64("vec"), F.hash("vec")))
    by_class = Window.partitionBy("fp").orderBy("id")
    index = stage(usable.withColumn("nth", F.row_number().over(by_class)).where(F.col("nth") <= k + 1), "vectors")
    rows = index.count()
    empty = spark.createDataFrame([], "id long, near long, cosine double, place int")
    if rows < 2:
        return empty
    # In a fixed order, so that the same rows give the same tree on every run.
    drawn = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(rows))
    sample = index.select("id", "vec", drawn.alias("drawn"))
    if rows > sample_rows:
        sample = sample.where(F.col("drawn") < sample_rows + CALIBRATION_ROWS).orderBy("drawn", "id").limit(sample_rows + CALIBRATION_ROWS)
    table = sample.toArrow().sort_by([("drawn", "ascending"), ("id", "ascending")])
    unit = _units(table.column("vec"), dim).astype(np.float32)
    fitted, held = unit[:sample_rows], slice(sample_rows, None)
    # Rows that the tree wasn't fitted on tell how far to search, where there are enough of them; if it was fitted on all rows, these do.
    if len(unit) < sample_rows + 1000:
        held = slice(0, CALIBRATION_ROWS)
    tree = fit(fitted, max(1, min(rows // leaf_rows, len(fitted) // 8)))
    pairs = None
    if least > -1:
        pairs = bounded_pairs(index, table.column("id").to_numpy()[held], unit[held], dim=dim, k=k, least=least, fewest=min(1000, math.ceil(1 / max(1e-3, 1 - recall))))
    counts = counted(index, tree, dim)
    # Levels are added until every leaf is small; the rows of a leaf that can't be split any further are cut into blocks.
    largest = rows + 1
    while (wanted := children_wanted(counts, leaf_rows)).max() > 1 and counts.max() < largest:
        largest = counts.max()
        tree = grown(index, tree, counts, wanted, dim)
        counts = counted(index, tree, dim)
    search, _ = calibrate(tree, fitted, k, least, recall, both_ways=every == 1 and recall < 1, pairs=pairs)
    chosen = spark.sparkContext.broadcast(tree)

    def assign(route: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                units = _units(batch.column("vec"), dim).astype(np.float32)
                at, leaf = chosen.value.visits(units, search) if route else (np.arange(len(units)), chosen.value.home(units))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), batch.column("vec").take(pa.array(at)), pa.array(leaf.astype(np.int32))], names=["id", "vec", "leaf"])

        return run

    base = index.select("id", "vec")
    asked = base if every == 1 else base.where(F.col("id") % every == 0)
    homed = base.mapInArrow(assign(False), "id long, vec array<float>, leaf int")
    routed = asked.mapInArrow(assign(True), "id long, vec array<float>, leaf int")
    blocks = blocks_of(counts)
    cut = F.broadcast(spark.createDataFrame([(i, int(b)) for i, b in enumerate(blocks) if b > 1], "leaf int, n int"))  # no more rows than leaves

    def blocked(side: DataFrame, own: str, other: str) -> DataFrame:
        side = side.join(cut, "leaf", "left").withColumn("n", F.coalesce("n", F.lit(1)))
        side = side.withColumn(own, F.pmod(F.xxhash64("id", F.lit(own)), "n").cast("int"))
        return side.withColumn(other, F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("leaf", "mb", "qb", "id", "vec")

    members, queries = blocked(homed, "mb", "qb"), blocked(routed, "qb", "mb")
    keys = ["leaf", "mb", "qb"]
    # As many tasks as the vectors ask for, whatever the session's number of partitions is.
    sent = (rows + rows / every * search.visits) * (4 * dim + 40) * max(1.0, float((counts * blocks).sum()) / rows)
    tasks = max(2, math.ceil(sent / TASK_BYTES))
    members, queries = members.repartition(tasks, *keys), queries.repartition(tasks, *keys)
    found = members.groupBy(keys).cogroup(queries.groupBy(keys)).applyInArrow(lambda m, q: _search(m, q, dim, k, least, every == 1), "id long, near long, cosine double")
    if every == 1:
        found = found.distinct()
    # The other ids of a class of copies: their nearest are the first of the class.
    heads = index.groupBy("fp").agg(F.max("nth").alias("n"), F.sort_array(F.collect_list("id")).alias("heads")).where(F.col("n") > k)
    rest = usable.select("id", "fp").join(heads, "fp").where(~F.array_contains("heads", F.col("id")) & (F.col("id") % every == 0))
    copies = rest.select("id", F.explode(F.slice("heads", 1, k)).alias("near"), F.lit(1.0).alias("cosine"))
    order = Window.partitionBy("id").orderBy(F.desc("cosine"), "near")
    ranked = found.unionByName(copies).withColumn("place", F.row_number().over(order))
    return ranked.where(F.col("place") <= k)
