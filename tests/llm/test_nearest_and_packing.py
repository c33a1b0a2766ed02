import math
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tessera.llm.nearest import BLOCK_ROWS, MOST_LEAVES, Search, _search, blocks_of, bounded_pairs, calibrate, children_wanted, counted, fit, grown, nearest
from tessera.llm.packing import DEFAULT_TOKENIZER, encoding, pack, taught, token_bytes, training_windows, windows

SCHEMA = "k long, v array<float>"


def exact(ids, m, k, least=-1.0):
    u = m.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    c = np.round(u @ u.T, 6)
    out = {}
    for a in range(len(ids)):
        near = sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-c[a, b], ids[b]))[:k]
        out[ids[a]] = [(ids[b], c[a, b]) for b in near if c[a, b] >= least]
    return out


def test_recall_on_clustered_vectors(spark):
    rng = np.random.default_rng(1)
    m = np.repeat(rng.normal(size=(300, 16)), 5, axis=0) + 0.15 * rng.normal(size=(1500, 16))
    ids = [3 * i + 1 for i in range(1500)]
    df = spark.createDataFrame(list(zip(ids, m.astype(np.float32).tolist(), strict=True)), SCHEMA)
    want = exact(ids, m.astype(np.float32), 4, 0.9)
    got: dict = {}
    for r in nearest(df, "k", "v", dim=16, k=4, least=0.9, recall=0.98, leaf_rows=50).collect():
        got.setdefault(r.id, []).append(r.near)
    hit = sum(len({n for n, _ in w} & set(got.get(i, []))) for i, w in want.items())
    assert hit >= 0.95 * sum(map(len, want.values())) > 0


def test_calibration_pairs_do_not_fall_with_the_rows(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(3000, 16))
    m = np.concatenate([m, m + 0.05 * rng.normal(size=m.shape)]).astype(np.float32)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    index = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vec array<float>")
    # Of few sampled rows hardly any neighbour is in the sample, but each has its own among all rows.
    some = np.arange(0, 3000, 60)
    asking, wanted = bounded_pairs(index, some, u[some], dim=16, k=4, least=0.95, fewest=1)
    cosines = u[some] @ u.T
    cosines[np.arange(len(some)), some] = -2
    assert len(asking) == (cosines >= 0.95).sum() >= len(some)
    assert ((asking * wanted).sum(axis=1) >= 0.95 - 1e-5).all()
    # Where there are none, pairs at the bound stand for them.
    asking, wanted = bounded_pairs(index, some, u[some], dim=16, k=4, least=0.9999999, fewest=1000)
    assert len(asking) >= 1000 and (asking * wanted).sum(axis=1) == pytest.approx(0.9999999, abs=1e-4)


def test_every_leaf_is_exact(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(120, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], SCHEMA)
    got = {(r.id, r.place): (r.near, r.cosine) for r in nearest(df, "k", "v", dim=8, k=3, recall=1.0, leaf_rows=30).collect()}
    want = exact(list(range(120)), m, 3)
    assert got == {(i, p): (n, pytest.approx(c, abs=1e-9)) for i, w in want.items() for p, (n, c) in enumerate(w, 1)}


def test_copies_ties_and_bad_vectors(spark):
    a, b = [1.0, 0.0, 0.0, 0.0], [0.9, 0.1, 0.0, 0.0]
    data = [(i, a) for i in range(40)] + [(100, b), (100, b), (None, a), (101, None), (102, [1.0]), (103, [0.0] * 4), (104, [float("nan"), 1.0, 0.0, 0.0]), (105, [float("inf"), 1.0, 0.0, 0.0]), (106, [None, 1.0, 0.0, 0.0]), (107, [1e30, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in data], SCHEMA + ", id int, leaf int")
    got: dict = {}
    for r in nearest(df, "k", "v", dim=4, k=3).orderBy("id", "place").collect():
        got.setdefault(r.id, []).append(r.near)
    assert got[0] == [1, 2, 3] and got[2] == [0, 1, 3] and got[39] == [0, 1, 2] and got[100] == [0, 1, 2] and got[107] == [0, 1, 2]
    assert sorted(got) == [*range(40), 100, 107]
    some = nearest(df, "k", "v", dim=4, k=3, every=10).select("id").distinct()
    assert rows(some) == [(0,), (10,), (100,), (20,), (30,)]


@pytest.mark.parametrize("data", [[], [(1, [1.0, 0.0])], [(1, None)]])
def test_too_few_vectors(spark, data):
    assert nearest(spark.createDataFrame(data, SCHEMA), "k", "v", dim=2, k=3).count() == 0


def test_calibration_reaches_its_recall():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = fit(x, 40)
    search, reached = calibrate(tree, x, 5, -1.0, 0.9)
    assert reached >= 0.9
    home, (rows_, leaves) = tree.home(x), tree.visits(x, search)
    assert (home == tree.home(x, width=len(tree.levels[0]))).mean() > 0.9
    assert (tree.home(x, width=len(tree.levels[0])) == (x @ tree.leaves.T).argmax(axis=1)).all()
    cos = x[:100] @ x.T
    cos[np.arange(100), np.arange(100)] = -2
    near = np.argsort(-cos, axis=1)[:, :5]
    seen = set(zip(rows_.tolist(), leaves.tolist(), strict=True))
    assert np.mean([(q, home[n]) in seen for q in range(100) for n in near[q]]) >= 0.85


def test_visits_are_best_bin_first():
    """A search with any margin visits the leaves that a search over all leaves would, as far as their nodes are opened."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2000, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = fit(x, 60)
    cosines = x[:50] @ tree.leaves.T
    for margin in (0.0, 0.1, 0.3):
        rows_, leaves = tree.visits(x[:50], Search(margin, [10.0], 99))
        want = set(zip(*(v.tolist() for v in np.nonzero(cosines >= cosines.max(axis=1, keepdims=True) - margin - 1e-7)), strict=True))
        assert set(zip(rows_.tolist(), leaves.tolist(), strict=True)) ^ want == set()
        assert all((np.diff(cosines[q][leaves[rows_ == q]]) <= 1e-6).all() for q in range(50))
    opened = tree.visits(x[:50], Search(0.1, [0.0], 99))
    few = tree.visits(x[:50], Search(0.3, [10.0], 3))
    assert np.bincount(few[0]).max() == 3 and all((cosines[q] > cosines[q][few[1][few[0] == q]].min() + 1e-6).sum() < 3 for q in range(50))
    assert len(opened[0]) <= len(tree.visits(x[:50], Search(0.1, [10.0], 99))[0])


def test_more_members_than_sixteen_bits_can_number():
    """With 140,000 members the order by cosine, then by id, still holds."""
    n = 140_000
    v = np.zeros((n, 4), np.float32)
    v[:, 0], v[:, 1] = 0.5, math.sqrt(0.75)
    v[n - 1] = [0.500001, math.sqrt(1 - 0.500001**2), 0, 0]
    v[n // 2] = [0.500001, math.sqrt(1 - 0.500001**2), 0, 0]
    members = pa.table({"id": pa.array(range(n), pa.int64()), "vec": pa.array(list(v), pa.list_(pa.float32()))})
    asked = pa.table({"id": pa.array([-1], pa.int64()), "vec": pa.array([[1.0, 0.0, 0.0, 0.0]], pa.list_(pa.float32()))})
    found = _search(members, asked, 4, 3, -1.0, False).sort_by([("cosine", "descending"), ("near", "ascending")])
    assert found.column("near").to_pylist() == [n // 2, n - 1, 0]


def test_leaves_grow_with_the_rows(spark):
    rng = np.random.default_rng(6)
    m = np.concatenate([rng.normal(size=(3000, 8)), rng.normal(size=(1, 8)) + 0.05 * rng.normal(size=(3000, 8))]).astype(np.float32)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    index = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vec array<float>")
    tree = fit(u[::60], 6)
    counts = counted(index, tree, 8)
    assert counts.sum() == 6000 and (counts == np.bincount(tree.home(u), minlength=len(tree.leaves))).all()
    wanted = children_wanted(counts, 100)
    more = grown(index, tree, counts, wanted, 8)
    assert len(more.leaves) == wanted.sum() and len(more.levels) == 3
    few = np.where(np.arange(len(counts)) == counts.argmax(), 2, 1)
    flat = grown(index, tree, counts, few, 8)
    assert len(flat.levels) == 2 and len(flat.leaves) == len(tree.leaves) + 1 == flat.first[0][-1] and (np.diff(flat.first[0]) >= np.diff(tree.first[0])).all()
    assert counted(index, more, 8).max() <= counts.max() / 3
    # The whole search, by a tree that must grow from 100 sampled rows.
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], SCHEMA)
    got: dict = {}
    for r in nearest(df, "k", "v", dim=8, k=3, recall=0.97, leaf_rows=60, sample_rows=200, every=50).collect():
        got.setdefault(r.id, set()).add(r.near)
    cosines = u[::50] @ u.T
    cosines[np.arange(len(cosines)), np.arange(0, 6000, 50)] = -2
    near = np.argsort(-cosines, axis=1)[:, :3]
    assert np.mean([len(got[50 * q] & set(w.tolist())) / 3 for q, w in enumerate(near)]) >= 0.9


def test_a_tree_for_sixteen_million_rows_needs_no_blocks():
    """By arithmetic: the tree of 2,500 leaves that the sample gives is split once, and then no vector is sent more often than to its one block."""
    rows_ = 16_000_000
    counts = np.full(2500, rows_ // 2500)
    wanted = children_wanted(counts, 400)
    assert wanted.sum() == rows_ // 400
    after = np.repeat(counts // wanted, wanted)
    assert blocks_of(3 * after).max() == 1 and children_wanted(after, 400).max() == 1
    assert blocks_of(np.array([0, BLOCK_ROWS, BLOCK_ROWS + 1, 10 * BLOCK_ROWS])).tolist() == [1, 1, 2, 10]
    assert children_wanted(np.full(2500, 10**7), 400).sum() <= MOST_LEAVES


def test_pack_keeps_all_limits():
    rng = np.random.default_rng(4)
    tokens = rng.integers(1, 2049, 5000)
    sizes = np.column_stack([tokens, (tokens * rng.random(5000)).astype(int), np.ones(5000, int)])
    limits = np.array([2048, 1024, 6])
    sizes[:, 1] = np.minimum(sizes[:, 1], 1024)
    number = pack(sizes, limits)
    used = np.zeros((number.max() + 1, 3), np.int64)
    np.add.at(used, number, sizes)
    assert (used <= limits).all() and len(number) == 5000
    bound = max(sizes[:, j].sum() / limits[j] for j in range(3))
    assert number.max() + 1 <= 1.1 * bound + 1


def test_windows_of_texts(spark):
    enc = encoding(DEFAULT_TOKENIZER)
    texts = {i: "word " * (i % 90 + 1) for i in range(300)} | {1000: "long text " * 400, 1001: "", 1002: " "}
    data = [*texts.items(), (1003, None), (None, "x"), (5, texts[5])]
    df = spark.createDataFrame([(*r, 9) for r in data], "k long, t string, id int")
    got = training_windows(df, "k", "t", capacity=128, segments=8).collect()
    tokens: dict = {}
    for r in got:
        tokens[r.id] = tokens.get(r.id, 0) + r.tokens
    assert tokens == {i: n for i, t in texts.items() if (n := len(enc.encode_ordinary(t)))}
    assert len({(r.id, r.piece) for r in got}) == len(got)
    by: dict = {}
    for r in got:
        w = by.setdefault(r.window, [0, 0])
        w[0] += r.tokens
        w[1] += 1
    assert all(t <= 128 and n <= 8 for t, n in by.values())
    assert [r.piece for r in sorted(got, key=lambda r: r.piece) if r.id == 1000] == list(range(-(-tokens[1000] // 128)))
    assert training_windows(df.limit(0), "k", "t").count() == 0


def test_pools_and_the_second_pass(spark):
    items = spark.range(3000).select("id", F.lit(0).cast("long").alias("piece"), (F.col("id") % 97 + 1).alias("tokens"))
    out = windows(items, {"tokens": 100}, pool_items=200)
    used = out.groupBy("window").agg(F.sum("tokens").alias("t"))
    assert out.count() == 3000 and out.select("id").distinct().count() == 3000
    assert used.agg(F.max("t")).first()[0] <= 100
    total = items.agg(F.sum("tokens")).first()[0]
    assert total / 100 / used.count() > 0.97


def test_markup_bears_no_loss():
    enc = encoding(DEFAULT_TOKENIZER)
    lengths = token_bytes(enc)
    for text in ("<p>Übung macht den Meister.</p><br/> 3 < 4 and 5 > 2", "plain words only", "", "<b>", "é<i>é</i>é" * 50):
        tokens = enc.encode_ordinary(text)
        data, at, want = text.encode(), 0, []
        for t in tokens:
            want.append(not any(m.start() <= at < m.end() for m in re.finditer(rb"</?[a-zA-Z][^<>]*>", data)))
            at += len(enc.decode_single_token_bytes(t))
        assert taught(text, lengths[np.array(tokens, np.int64)]).tolist() == want


def test_windows_keep_the_limit_of_loss(spark):
    texts = {i: ("<td>x</td>" * (i % 20) if i % 2 else "") + "some plain words here " * (i % 15 + 1) for i in range(400)} | {1000: "plain words " * 60}
    df = spark.createDataFrame(list(texts.items()), "k long, t string")
    got = training_windows(df, "k", "t", capacity=128, segments=8, loss_tokens=100).collect()
    by: dict = {}
    for r in got:
        w = by.setdefault(r.window, [0, 0, 0])
        for j, v in enumerate((r.tokens, r.loss_tokens, 1)):
            w[j] += v
    assert all(t <= 128 and n <= 8 and (lo <= 100 or n == 1) for t, lo, n in by.values()) and any(97 <= lo <= 100 for _, lo, _ in by.values())
    assert all(0 <= r.loss_tokens < r.tokens for r in got) and {r.id for r in got} == set(texts)
    assert sum(r.tokens for r in got if r.id == 3) == len(encoding(DEFAULT_TOKENIZER).encode_ordinary(texts[3]))
