import random
import re
import unicodedata

import numpy as np
import pytest
from conftest import rows

from tessera.llm import quality
from tessera.llm.leaks import INDEX_BYTES, Rule, edit_distances, keys, leaks, plain_words, repetitions
from tessera.llm.queries import NEAR, p7_near
from tessera.llm.quality import Rules, Summary, count_texts, statistics

CASES = "case_id long, question string, target string, id long"
SOFT, ZERO, ACUTE = chr(0xAD), chr(0x200B), chr(0x301)


@pytest.mark.parametrize(
    ("text", "words"),
    [
        ("Élan vital", ["elan", "vital"]), (f"e{ACUTE}lan", ["elan"]), (f"so{SOFT}ft{ZERO}ware", ["software"]), ("hyphen-\n  ated", ["hyphenated"]), ("hyphen- \r\nated", ["hyphenated"]),
        (f"a-{ZERO}\nb", ["ab"]), ("well-known", ["well", "known"]), ("STRASSE straße", ["strasse", "strasse"]), ("a_b", ["a", "b"]), ("", []), ("\n-\n", []),
    ],
)
def test_plain_words(text, words):
    assert plain_words(text) == words


def slow_distance(a, b):
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    return d


def test_edit_distances():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (5, 6), (7, 3)):
        a, b = rng.integers(0, 4, (100, n)), rng.integers(0, 4, (100, m))
        assert edit_distances(a, b).tolist() == [slow_distance(x, y)[-1][-1] for x, y in zip(a, b, strict=True)]
        assert edit_distances(a, b, open_end=True).tolist() == [min(slow_distance(x, y)[-1]) for x, y in zip(a, b, strict=True)]


def test_equal_windows_have_equal_keys_and_edits_often_do():
    rng = np.random.default_rng(1)
    x = rng.integers(1, 2**60, (3000, 12)).astype(np.uint64)
    y = x.copy()
    y[:, 6] = rng.integers(1, 2**60, 3000)
    rule = Rule(window=12, stride=1, run=0, edits=1, sampled=12)
    assert (keys(x, rule, 0) == keys(x.copy(), rule, 0)).all()
    assert (keys(x, rule, 0) == keys(y, rule, 0)).mean() > 0.1
    assert (keys(x, rule, 0) == keys(x[::-1], rule, 0)).mean() < 0.01


def corpus():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(200)]
    cases = [(i, " ".join(rng.choices(vocabulary, k=30)), " ".join(rng.choices(vocabulary, k=rng.randint(5, 60)))) for i in range(30)]
    cases += [(40, None, None), (41, cases[0][1], "short one")]
    docs = []
    for i in range(200):
        words = rng.choices(vocabulary, k=rng.randint(0, 120))
        if i % 3 == 0:
            c = rng.choice(cases[:30])[rng.choice([1, 2])].split()
            n = rng.choice([10, 11, 12, 13, 20])
            at, to = rng.randrange(len(c)), rng.randrange(len(words) + 1)
            words[to:to] = [w.upper() if rng.random() < 0.3 else w for w in c[at : at + n]]
        docs.append((i, " ".join(words)))
    return docs + [(500, None), (501, ""), (None, cases[1][1]), (0, docs[0][1])], cases


def brute(docs, cases, n=12):
    grams: dict = {}
    for c, *parts in cases:
        for p in parts:
            w = plain_words(p or "")
            for k in range(len(w) - n + 1):
                grams.setdefault(tuple(w[k : k + n]), set()).add(c)
    out = set()
    for i, t in docs:
        w = plain_words(t or "") if i is not None else []
        for k in range(len(w) - n + 1):
            out |= {(i, c) for c in grams.get(tuple(w[k : k + n]), ())}
    return sorted(out, key=repr)


@pytest.mark.parametrize("room", [INDEX_BYTES, 0])
def test_leaks_equal_brute_force(spark, room):
    docs, cases = corpus()
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, t string, case_id int")
    c = spark.createDataFrame([(*x, 1) for x in cases], CASES)
    want = brute(docs, cases)
    assert rows(leaks(d, "doc_id", "t", c, "case_id", ["question", "target"], index_bytes=room), "doc_id", "case_id") == want and want
    assert leaks(d.limit(0), "doc_id", "t", c, "case_id", ["question"], index_bytes=room).count() == 0


def test_no_cases(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, t string")
    assert leaks(d, "doc_id", "t", spark.createDataFrame([], CASES), "case_id", ["question", "target"]).count() == 0


def edited(words, kind, at):
    return words[:at] + ["other"] * (kind != "missing") + words[at + (kind != "inserted") :]


def planted(kinds, each):
    """Cases of 12 words and documents that hold them with one edit inside, some with words around."""
    rng = random.Random(6)
    places = [(kind, 1 + i % 10) for kind in kinds for i in range(each)]
    cases = [(i, " ".join(rng.sample([f"v{i}x{k}" for k in range(12)], 12)), None, 0) for i in range(len(places))]
    docs = []
    for i, (kind, at) in enumerate(places):
        once = edited(cases[i][1].split(), kind, at)
        docs.append((i, " ".join(once if i % 2 else ["before", *once, "after"])))
    return places, cases, docs


def test_p7_near_finds_inserted_missing_and_other_words(spark, tmp_path):
    kinds = ("inserted", "missing", "other")
    places, cases, docs = planted(kinds, 400)
    d, c = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(cases, CASES)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    c.write.parquet(f"{tmp_path}/relevance_cases.parquet")
    found = p7_near(spark, str(tmp_path)).collect()
    assert all(r.doc_id == r.case_id and r.edits == 1 for r in found)
    for kind in kinds:
        assert sum(places[r.case_id][0] == kind for r in found) >= 0.975 * 400


def test_both_ways_give_the_same_rows(spark):
    _, cases, docs = planted(("inserted", "missing", "other", "other"), 60)
    cases += [(1000 + i, f"too short {i}", None, 0) for i in range(500)] + [(2000, "just these seven words stand here whole", None, 0)]
    docs += [(900, "before JUST these seven words stood here whole after"), (901, "just these seven stand whole")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    found = []
    for rule in (NEAR, Rule(window=12, stride=1, run=0, edits=1, sampled=12, recall=0.8), Rule(window=12, stride=1, run=0, edits=2, sampled=9, recall=0.9)):
        for order in (1, -1):
            c = spark.createDataFrame(cases[::order], CASES).coalesce(1)
            found.append([rows(leaks(d, "doc_id", "text", c, "case_id", ["question"], rule, index_bytes=room)) for room in (INDEX_BYTES, 0)])
            assert found[-1][0] == found[-1][1]
        assert found[-1] == found[-2] and len(found[-1][0]) > 180
    assert [x[:2] for x in found[0][0] if x[1] == 2000] == [(900, 2000)]


def test_windows_of_the_size_of_a_short_item():
    rule = Rule(window=12, stride=1, run=0, edits=1, least=6)
    assert [one.window for one in rule.sizes] == list(range(6, 13)) and all(one.least is None for one in rule.sizes)
    for bad in ({"least": 6, "run": 12}, {"least": 1}, {"least": 13}):
        with pytest.raises(ValueError):
            Rule(**({"window": 12, "stride": 1, "run": 0, "edits": 1} | bad))


def test_repetitions_are_derived_from_the_rule():
    low, high = (repetitions(Rule(window=12, stride=1, run=0, edits=1, sampled=12, recall=r)) for r in (0.9, 0.99))
    assert 1 < low < high and repetitions(Rule()) == 1
    with pytest.raises(ValueError):
        repetitions(Rule(window=12, stride=1, run=0, edits=4, sampled=36, recall=0.999999))


def test_a_missing_or_inserted_word_costs_one():
    a, b = np.arange(1, 13), np.arange(1, 14)
    far = lambda x, y: edit_distances(x[None], y[None], open_end=True)[0]
    assert far(a, np.delete(b, 4)) == far(a, np.insert(a, 4, 99)) == 1
    assert far(a, b) == 0
    assert far(a, np.delete(a, [2, 7])) == 2


def test_one_edit_is_found(spark):
    rng = random.Random(4)
    words = [f"v{i}" for i in range(500)]
    cases = [(i, " ".join(rng.sample(words, 12)), None, 0) for i in range(60)]
    docs = []
    for i, q, *_ in cases:
        w = q.split()
        kind = i % 3
        at = rng.randrange(1, 11)
        w[at : at + (kind != 0)] = ["other"] * (kind != 2)
        docs.append((i, " ".join(["before", *w, "after"])))
    d, c = spark.createDataFrame(docs, "doc_id long, t string"), spark.createDataFrame(cases, CASES)
    found = leaks(d, "doc_id", "t", c, "case_id", ["question"], Rule(window=12, stride=1, run=0, edits=2, sampled=10, recall=0.97))
    assert sum(r.doc_id == r.case_id for r in found.collect()) >= 54


def test_a_wide_stride_is_refused(spark):
    d = spark.createDataFrame([(1, "a")], "doc_id long, t string")
    with pytest.raises(ValueError, match="stride"):
        leaks(d, "doc_id", "t", spark.createDataFrame([], CASES), "case_id", ["question"], Rule(stride=6))


PROSE = "The old lamp stands near the window, and nobody has seen it for a year.\nIt was in the house when they came.\n"
LIST = "- lamp\n- window\n- old house\n- 12 chairs\n"


def test_outcomes(spark):
    texts = {1: PROSE, 2: LIST, 3: "name | n/a | 12\nlamp | n/a | 3\n" * 5, 4: PROSE.upper(), 5: "<p>" + PROSE + "</p>", 6: "", 7: " \n ", 8: "aGVsbG8gd29ybGQ" * 30, 9: None, 10: PROSE * 3 + LIST}
    df = spark.createDataFrame([(*x, 1) for x in [*texts.items(), (1, PROSE), (None, PROSE)]], "k long, t string, words int")
    got = {r.id: r for r in statistics(df, "k", "t").collect()}
    assert {i: r.is_prose for i, r in got.items()} == {1: True, 2: False, 3: False, 4: True, 5: True, 6: None, 7: None, 8: False, 10: True}
    assert got[1].ended_line_share == 1.0 and got[2].bullet_line_share == 1.0 and got[6].words == 0 and got[6].mean_word_length == 0.0
    assert statistics(df.limit(0), "k", "t").count() == 0


def by_hand(text):
    words = [w for w in text.split()]
    lines = [x for x in text.split("\n")]
    filled = [x for x in lines if x.split()]
    core = [re.sub(r"^[\W_]+|[\W_]+$", "", w) for w in words]
    return len(words), sum(map(len, core)), len(lines), len(filled), sum(x.rstrip()[-1] in quality._ENDS for x in filled)


def test_counts_equal_a_plain_count():
    rng = random.Random(3)
    for _ in range(200):
        t = "".join(rng.choices(["the", "lamp", " ", "\n", ".", "9", "é", "-"], k=rng.randint(0, 200)))
        t = " ".join(w[:60] for w in t.split(" "))
        c = dict(zip(quality.COUNTS, count_texts([t], quality._Tokens(), Rules())[0].tolist(), strict=True))
        words, chars, lines, filled, ended = by_hand(t)
        assert (c["words"], c["word_chars"], c["lines"], c["filled_lines"], c["ended_lines"]) == (words, chars, lines, filled, ended)


def test_summaries_join_in_any_order():
    rng = random.Random(5)
    cache, rules = quality._Tokens(), Rules()
    for _ in range(400):
        t = "".join(rng.choices(["the", "lamp", " ", "\n", ".", "9", "<p>", "x" * 70, "\n\n", unicodedata.lookup("IDEOGRAPHIC SPACE")], k=rng.randint(1, 80)))
        size = rng.choice([1, 2, 7, 40])
        parts = [Summary.of(t[i : i + size], rules, cache) for i in range(0, len(t), size)]
        while len(parts) > 1:
            i = rng.randrange(len(parts) - 1)
            parts[i : i + 2] = [Summary.unpack(parts[i].join(parts[i + 1], rules).pack())]
        assert parts[0].total(rules).tolist() == count_texts([t], cache, rules)[0].tolist()


def test_huge_documents_are_cut(spark):
    texts = [(1, PROSE * 200), (2, LIST * 300), (3, "x" * 40_000), (4, PROSE)]
    df = spark.createDataFrame([*texts, texts[0]], "k long, t string")
    columns = ["id", "chars", "words", "lines", "mean_word_length", "prose_share", "ended_line_share", "is_prose"]
    assert rows(statistics(df, "k", "t", chunk_chars=50), *columns) == rows(statistics(df, "k", "t"), *columns)


def test_common_words_of_another_language_are_learnt(spark):
    rng = random.Random(9)
    small, other = ["het", "een", "van", "naar", "niet", "ook"], ["".join(rng.choices("bdfgklmnprstaeou", k=7)) for _ in range(1000)]
    text = lambda: "\n".join(" ".join(rng.choice(small if rng.random() < 0.4 else other) for _ in range(12)) + "." for _ in range(8))
    data = [(i, text(), rng.choice(["nl", "NL ", "nld"])) for i in range(60)] + [(100, "", "nl"), (101, None, "nl"), (102, "zq yx", None), (103, "a b c d e f", "sv"), (104, "\n".join(rng.sample(other, 9)), "nl")]
    df = spark.createDataFrame([(*x, 1) for x in data], "k long, t string, l string, lang int")
    learnt = {(r.lang, r.word) for r in quality.frequent_words(df, "t", "l").collect()}
    assert learnt == {("nl", w) for w in small}
    rules = quality.learnt_rules(df, "t", "l")
    assert rules.common - Rules().common == set(small) - Rules().common
    prose = lambda r: {x.id for x in statistics(df, "k", "t", r).where("is_prose").collect()}
    assert prose(rules) == set(range(60)) and not prose(Rules(common=Rules().common - set(small)))
    assert quality.learnt_rules(df.limit(0), "t", "l") == Rules()
