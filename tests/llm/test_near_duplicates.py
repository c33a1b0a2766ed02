import random

import numpy as np
import pytest
from conftest import rows

from tessera.llm import hashing
from tessera.llm.groups import classes
from tessera.llm.near_duplicates import band_pairs, similar_groups, similar_pairs
from tessera.llm.sketch import EMPTY, sketch


def jaccard_pairs(records, threshold, size, unit):
    sets = {}
    for i, t in records:
        if i is None or t is None:
            continue
        seq = hashing.words(t) if unit == "word" else t.lower()
        s = {tuple(seq[k : k + size]) for k in range(len(seq) - size + 1)}
        if s:
            sets[i] = s
    ids = sorted(sets)
    return [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold]


def test_every_coordinate_fills():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 500):
        s = sketch(rng.integers(0, 2**63, n).astype(np.uint64), np.array([n]), 64)
        assert (s != EMPTY).all()
    assert (sketch(np.empty(0, np.uint64), np.array([0, 0]), 8) == EMPTY).all()


def test_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    common, a, b = (np.unique(rng.integers(0, 2**63, n)).astype(np.uint64) for n in (300, 100, 100))
    x, y = np.concatenate([common, a]), np.concatenate([common, b])
    s = sketch(np.concatenate([x, y]), np.array([len(x), len(y)]), 2000)
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.05


def test_a_set_is_sketched_alike_in_any_company():
    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (3, 90))
    both = sketch(np.concatenate([a, b]), np.array([3, 90]), 32)
    assert (both[0] == sketch(a, np.array([3]), 32)[0]).all() and (both[1] == sketch(b, np.array([90]), 32)[0]).all()


def test_runs_stay_in_their_text():
    flat = np.arange(1, 8, dtype=np.uint64)
    grams, counts = hashing.runs(flat, np.array([4, 1, 2]), 2)
    assert counts.tolist() == [3, 0, 1] and len(np.unique(grams)) == 4


def collection(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out, n = [], 0
    for _ in range(40):
        base = rng.choices(vocabulary, k=rng.randint(20, 90))
        for _ in range(rng.randint(1, 4)):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            out.append((n, " ".join(t)))
            n += 1
    hot = " ".join(rng.choices(vocabulary, k=40))
    out += [(n + i, hot.upper() if i % 2 else hot + "!") for i in range(len(out) // 2)]
    return out


@pytest.mark.parametrize(("threshold", "unit", "size", "bands", "rows_"), [(0.6, "word", 3, 24, 3), (0.8, "word", 5, 24, 3), (0.7, "char", 4, 72, 7)])
def test_pairs_equal_brute_force(spark, threshold, unit, size, bands, rows_):
    records = collection()
    want = jaccard_pairs(records, threshold, size, unit)
    df = spark.createDataFrame(records, "k long, t string")
    got = rows(similar_pairs(df, "k", "t", threshold=threshold, unit=unit, size=size, bands=bands, rows=rows_))
    assert set(got) <= set(want)
    assert len(got) >= 0.99 * len(want) > 0


def test_nulls_short_texts_repeats_and_clashing_names(spark):
    text = "one two three four five six seven"
    records = [(1, text), (1, text), (2, text), (None, text), (3, None), (4, ""), (5, "one two"), (6, "one two"), (7, "   ")]
    df = spark.createDataFrame([(*r, 0, "x", "y") for r in records], "k long, t string, id long, fp string, bands string")
    assert rows(similar_pairs(df, "k", "t")) == [(1, 2)]


def test_empty_table(spark):
    assert rows(similar_pairs(spark.createDataFrame([], "k long, t string"), "k", "t")) == []


def test_a_very_long_text(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200_000)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[100:])), (3, " ".join(words[: len(words) // 2]))], "k long, t string")
    assert rows(similar_pairs(df, "k", "t")) == [(1, 2)]


def components(pairs, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "ring"])
def test_classes_equal_union_find(spark, shape):
    rng = random.Random(3)
    ids = list(range(0, 900, 3))
    rng.shuffle(ids)
    pairs = {"chain": list(zip(ids[:200], ids[1:201], strict=True)), "star": [(ids[0], x) for x in ids[1:]], "ring": list(zip(ids, ids[1:] + ids[:1], strict=True)), "random": [tuple(rng.sample(ids, 2)) for _ in range(180)]}[shape]
    want = components(pairs, {x for p in pairs for x in p})
    got = classes(spark.createDataFrame([*pairs, (5, 5)], "id_a long, id_b long"))
    assert rows(got) == sorted(want.items(), key=repr)


def test_classes_of_nothing(spark):
    assert classes(spark.createDataFrame([], "id_a long, id_b long")).count() == 0


def test_groups(spark):
    records = collection(8)
    df = spark.createDataFrame([*records, records[0], (None, "a b c d e f"), (9999, "short")], "k long, t string")
    got = {r.id: r for r in similar_groups(df, "k", "t", threshold=0.6, size=3).collect()}
    want = components(jaccard_pairs(records, 0.6, 3, "word"), [i for i, _ in records])
    assert sum(got[i].class_id == c for i, c in want.items()) >= 0.99 * len(want) and len(got) == len(records)
    hot = [i for i, _ in records][-10:]
    assert {got[i].copies for i in hot} == {len(records) // 3} and got[hot[0]].class_id == want[hot[0]]


def test_a_hot_band_is_cut_and_loses_nothing(spark):
    banded = spark.createDataFrame([(i, 10 + i % 3, 1) for i in range(300)] + [(i, 10, 2 + i % 50) for i in range(300)] + [(900, 100, 1), (901, 10, 99)], "rep long, n int, key long")
    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if min(10 + a % 3, 10 + b % 3) >= 0.9 * max(10 + a % 3, 10 + b % 3) or a % 50 == b % 50}
    for hot in (7, 100, 10_000):
        got = rows(band_pairs(banded, 0.9, hot=hot))
        assert len(got) == len(set(got)) and set(got) == want
