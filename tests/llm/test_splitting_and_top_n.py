import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.splitting import pieces, split
from tessera.llm.top_n import LoserTree, Run, best_of_groups, top_n


def greedy(t, limit=1200, overlap=180, floor=600):
    s, out = 0, []
    while len(t) > s + limit:
        b = max(t.rfind("\n\n", s, s + limit), t.rfind(". ", s, s + limit))
        e = b + 1 if b > s + floor else s + limit
        out.append((s, e))
        s = e - overlap
    return [*out, (s, len(t))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "bc", ". ", "\n\n", "\n", " ", "."]), min_size=1, max_size=120))
def test_place_order_fills_every_piece(parts):
    t = "".join(parts)
    if len(t) > 20:
        assert split(t, 20, 4, floor=10) == greedy(t, 20, 4, 10)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["abcdefgh", "bc", ". ", "\n\n", "\n", " ", "! "]), min_size=1, max_size=120))
def test_kind_order_covers_the_text(parts):
    t = "".join(parts)
    got = split(t, 20, 4, order="kind", floor=10)
    assert got[0][0] == 0 and got[-1][1] == len(t) and all(e - s <= 20 for s, e in got)
    assert all(b[0] == a[1] - 4 for a, b in zip(got, got[1:], strict=False))


def slow_by_kind(t, limit, overlap):
    """Pieces by looking through all boundaries again and again for the weakest across which both sides fit."""

    def strength(e):
        if not t[e - 1].isspace():
            return None
        return 3 if t[:e].endswith("\n\n") else 2 if t[e - 1] == "\n" else 1 if t[e - 2 : e - 1] in {".", "!"} else 0

    cuts = {e: k for e in range(1, len(t)) if (k := strength(e)) is not None}
    while True:
        around = [0, *sorted(cuts), len(t)]
        open_ = [(cuts[e], e) for a, e, b in zip(around, around[1:], around[2:], strict=False) if b - max(0, a - overlap) <= limit]
        if not open_:
            return [(max(0, a - overlap), b) for a, b in zip(around, around[1:], strict=False)]
        del cuts[min(open_)[1]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["abcdefgh", "bc", "def", "k"]), st.sampled_from([" ", ". ", "! ", "\n", ".\n\n", "\n\n"])), min_size=4, max_size=60))
def test_kind_order_merges_the_weakest_boundary_first(parts):
    t = "".join(w + b for w, b in parts).rstrip() + "x"
    if len(t) > 20:
        assert split(t, 20, 4, order="kind", floor=10) == slow_by_kind(t, 20, 4)


def test_kind_order_prefers_strong_boundaries():
    t = "one two three.\n\nfour five six"
    assert [t[s:e] for s, e in split(t, 20, 0, order="kind", floor=10)][0] == "one two three.\n\n"


def test_long_texts_alike():
    rng = random.Random(1)
    for _ in range(60):
        t = "".join(rng.choices(["word", ". ", "\n\n", " "], weights=[80, 1, 0.2, 10], k=4000))
        assert split(t) == greedy(t)
    t = "x" * 1_000_000
    assert split(t) == greedy(t)


def test_pieces(spark):
    long = "word. " * 400
    df = spark.createDataFrame([(1, long), (1, long), (2, "short"), (3, None), (None, long), (4, ""), (5, "é" * 1200), (6, "é" * 1201)], "k long, t string")
    got = rows(pieces(df.selectExpr("k", "t", "0 as id", "1 as piece"), "k", "t"))
    assert got == sorted([(1, p, s, e) for p, (s, e) in enumerate(greedy(long))] + [(6, 0, 0, 1200), (6, 1, 1020, 1201)], key=repr)
    assert pieces(df.limit(0), "k", "t").count() == 0
    shown = pieces(df, "k", "t", with_text=True).where("id = 6 and piece = 1").first()
    assert (shown.overlap_chars, shown.piece_text) == (180, "é" * 181)


def best(hits, n):
    out = {}
    for g1, g2, s, i in hits:
        if None not in (g1, g2, s, i) and s == s:
            d = out.setdefault((g1, g2), {})
            d[i] = min(s, d.get(i, s))
    return sorted(((*g, i, s, p) for g, d in out.items() for p, (s, i) in enumerate(sorted((s, i) for i, s in d.items())[:n], 1)), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_top_n_with_hot_groups_ties_and_repeats(spark, seed):
    rng = random.Random(seed)
    hits = [(rng.choice([1, 1, 2, 3]), rng.choice([7, 7, 7, 8, 9, None]), rng.choice([-1.0, -1.0, -2.5, rng.random(), None, float("nan")]), rng.randrange(600)) for _ in range(8000)]
    hits += hits[:500]
    df = spark.createDataFrame([(*h, "x") for h in hits], "g1 long, g2 long, score double, item long, bucket string")
    assert rows(top_n(df, 3, buckets=3, runs=5), "g1", "g2", "item", "score", "place") == best(hits, 3)
    assert rows(top_n(df, 100_000, buckets=1, runs=1), "g1", "g2", "item", "score", "place") == best(hits, 100_000)


def test_a_group_over_several_batches(spark):
    from tessera.llm import top_n as module

    hits = [(1, 1, float(i % 1000), i) for i in range(150_000)] + [(1, 2, 0.5, 1)]
    df = spark.createDataFrame(hits, "g1 long, g2 long, score double, item long")
    assert rows(module.top_n(df, 2, buckets=2, runs=1), "g1", "g2", "item") == [(1, 1, 0), (1, 1, 1000), (1, 2, 1)]


def stored(path, g1, g2, score, item, row_group):
    table = pa.table({"g1": pa.array(g1, pa.int64()), "g2": pa.array(g2, pa.int64()), "score": pa.array(score, pa.float64()), "item": pa.array(item, pa.int64())})
    pq.write_table(table, path, row_group_size=row_group)
    return pq.ParquetFile(path)


def test_a_hot_group_of_ten_million_rows_reads_few_row_groups(tmp_path):
    n = 10_000_000
    runs = []
    for i in range(2):
        g2 = np.concatenate([np.zeros(5), np.full(n // 2, 1), np.full(3, 2)])
        score = np.concatenate([np.arange(5), np.arange(n // 2), np.arange(3)]).astype(float)
        runs.append(Run([stored(f"{tmp_path}/{i}.parquet", np.zeros(len(g2)), g2, score, np.arange(len(g2)) * 2 + i, 50_000)], 3))
    found = [(head[:2], place) for head, place in LoserTree(runs).first_of_groups(3)]
    assert found == [((0, g), p) for g in (0, 1, 2) for p in (1, 2, 3)]
    assert all(r.row_groups_read <= 3 for r in runs) and len(runs[0].parts) > 100


def test_runs_that_are_not_sorted_are_refused(tmp_path):
    for i, score in enumerate(([3.0, 2.0, 4.0, 5.0], [3.0, 4.0, 1.0, 2.0])):
        with pytest.raises(ValueError):
            Run([stored(f"{tmp_path}/{i}.parquet", [1] * 4, [1] * 4, score, range(4), 2)], 9).seek_past((0, 0))
            r = Run([stored(f"{tmp_path}/{i}.parquet", [1] * 4, [1] * 4, score, range(4), 2)], 9)
            for _ in range(4):
                r.next()


def test_best_of_groups():
    rng = np.random.default_rng(3)
    c = [rng.integers(0, 3, 500), rng.integers(0, 2, 500), rng.integers(0, 9, 500).astype(float), rng.integers(0, 20, 500)]
    c = [x[np.lexsort(c[::-1])] for x in c]
    keep = best_of_groups(c, 4)
    want = [(*w[:2], w[3], w[2]) for w in best(list(zip(*(x.tolist() for x in c), strict=True)), 4)]
    assert sorted(zip(*(x[keep].tolist() for x in c), strict=True)) == sorted(want)
    assert len(best_of_groups([x[:0] for x in c], 4)) == 0


def test_top_n_of_nothing(spark):
    assert top_n(spark.createDataFrame([], "g1 long, g2 long, score double, item long"), 3).count() == 0
