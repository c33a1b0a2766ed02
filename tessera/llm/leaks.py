"""Evaluation passages inside a corpus: edit distance mapped to Hamming distance, bit sampling, exact edit verification.

Windows of words of the held-out items and of the corpus are embedded by a
random walk: in 3w steps the current word is written out, and whether the walk
moves on to the next word is a random bit of the step and the word.  Windows at
a small edit distance get embeddings at a small Hamming distance.  Hashing a
few sampled coordinates of the embeddings, repeated with other walks and other
samples until the target recall is reached, brings such windows together; each
candidate is then verified by its exact edit distance.  A window of an item is
looked for in spans of the corpus that are shorter or longer by up to the
allowed edits, as an inserted or missing word moves the end of the span.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import only
from .hashing import U64, WORD, TokenHashes, mix64, runs, seeds

_UNSEEN = re.compile("[\u00ad\u034f\u061c\u180e\u200b-\u200f\u2060-\u2064\ufeff]")
_BROKEN = re.compile(r"[-\u2010\u2011][^\S\n\r\u2028\u2029]*[\n\r\u2028\u2029]\s*")
_MARKS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")
UNKNOWN = U64(0)


def plain_words(text: str) -> list[str]:
    """The words of a text without regard to case, diacritics, invisible characters and hyphenation at line ends."""
    if not text.isascii():
        text = _UNSEEN.sub("", text)
    if "\n" in text or "\r" in text or not text.isascii():
        text = _BROKEN.sub("", text)
    text = text.casefold()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFD", text))
    return WORD.findall(text)


@dataclass(frozen=True)
class Rule:
    """What counts as a leak: ``window`` words of an item and a span of the corpus at an edit distance of at most
    ``edits``, and, around them, a run of at least ``run`` words that are the same on both sides (0: no such demand).

    An item that is shorter than the window, but not than ``least`` words (by
    default the window), counts as one window of its own size.  Corpus spans
    begin at every ``stride``-th word.  With edits = 0 a stride of
    run - window + 1 loses nothing, as every run holds such a window.
    """

    window: int = 8
    stride: int = 5
    run: int = 12
    edits: int = 0
    sampled: int = 8
    recall: float = 0.99
    least: int | None = None

    def __post_init__(self) -> None:
        if self.edits == 0 and self.run and self.stride > self.run - self.window + 1:
            raise ValueError("a stride over run - window + 1 can miss a run")
        if self.least is not None and (self.run or not self.edits < self.least <= self.window):
            raise ValueError("least must be over edits and not over window, and goes with run = 0 only")

    @property
    def sizes(self) -> list[Rule]:
        """The rule for each size that a window of an item can have."""
        return [replace(self, window=w, least=None) for w in range(self.least or self.window, self.window + 1)]

    @property
    def intact(self) -> int:
        """Words in a row that a window must share with an item: so many edits leave one of edits + 1 parts whole."""
        return max(1, (self.window - self.edits) // (self.edits + 1))

    @property
    def spans(self) -> range:
        """Lengths of the corpus spans that can be so near to a window."""
        return range(max(1, self.window - self.edits), self.window + self.edits + 1)

    @property
    def context(self) -> int:
        """Words on either side of a window that decide about a run."""
        return max(0, self.run - self.window)


def windows(symbols: np.ndarray, starts: np.ndarray, w: int) -> np.ndarray:
    return symbols[starts[:, None] + np.arange(w)]


def keys(x: np.ndarray, rule: Rule, repetition: int) -> np.ndarray:
    """A 64-bit key of each row of symbols for one repetition: one random walk and one sample of its coordinates.

    Rows of any of the rule's lengths have comparable keys.
    """
    n, w = x.shape
    steps = 3 * rule.window
    walk = seeds(steps, 1000 + repetition)
    chosen = set(np.argsort(seeds(steps, 5000 + repetition))[: rule.sampled].tolist())
    padded = np.concatenate([x, np.full((n, 1), UNKNOWN)], axis=1).ravel()
    base, at = np.arange(n) * (w + 1), np.zeros(n, np.int64)
    key = np.zeros(n, np.uint64)
    for j in range(steps):
        now = padded[base + at]
        h = mix64(now ^ walk[j])
        if j in chosen:
            key = mix64(key ^ h)
        at = np.minimum(at + (h & U64(1)).astype(np.int64), w)
    return key


def edit_distances(a: np.ndarray, b: np.ndarray, *, open_end: bool = False) -> np.ndarray:
    """The word edit distance of every row of a and the same row of b; with ``open_end`` the row of b may end anywhere."""
    row = np.broadcast_to(np.arange(b.shape[1] + 1), (len(a), b.shape[1] + 1)).copy()
    for i in range(a.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        for j in range(b.shape[1]):
            new[:, j + 1] = np.minimum(np.minimum(row[:, j + 1], new[:, j]) + 1, row[:, j] + (a[:, i] != b[:, j]))
        row = new
    return row.min(axis=1) if open_end else row[:, -1]


@cache
def repetitions(rule: Rule, most: int = 400) -> int:
    """How many repetitions reach the rule's recall, from made windows with as many random edits as it allows.

    It depends on the rule only, not on which passages there are.
    Spans of each length must reach it on their own, so that inserted and missing words are found as often as other ones.
    """
    if rule.edits == 0:
        return 1
    rng = np.random.default_rng(7)
    rows = rng.integers(1, 2**62, (20_000, rule.window)).astype(np.uint64)
    pairs: dict[int, list] = {}
    for x in rows:
        y = x.tolist()
        for _ in range(rule.edits):
            kind, new = int(rng.integers(3)), int(rng.integers(1, 2**62))
            # All edits are inside, as those of the first and last word are found more easily.
            at = int(rng.integers(1, max(2, len(y) - (kind != 1))))
            y[at : at + (kind != 1)] = [new] * (kind != 2)
        pairs.setdefault(len(y), []).append((x, y))
    sides = [(np.array([x for x, _ in p], np.uint64), np.array([y for _, y in p], np.uint64)) for n, p in pairs.items() if n]
    missed = [np.ones(len(x), bool) for x, _ in sides]
    for r in range(most):
        for (x, y), m in zip(sides, missed, strict=True):
            m &= keys(x, rule, r) != keys(y, rule, r)
        if max(m.mean() for m in missed) <= 1 - rule.recall:
            return r + 1
    raise ValueError(f"{most} repetitions don't reach a recall of {rule.recall}")


@dataclass
class _Places:
    """Places in texts: the texts' symbols in sequence, and of each place its text's begin and end and its own position."""

    flat: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    at: np.ndarray

    def around(self, first: int, last: int, other: int) -> np.ndarray:
        """The symbols at these distances from the place, ``other`` outside of the text."""
        index = self.at[:, None] + np.arange(first, last)
        inside = (index >= self.begin[:, None]) & (index < self.end[:, None])
        return np.where(inside, self.flat[np.where(inside, index, 0)] if len(self.flat) else U64(other), U64(other))


def verified(corpus: _Places, items: _Places, rule: Rule) -> np.ndarray:
    """The edit distance of every candidate that is a leak by the rule, or -1: of the item's window and the nearest span that begins at the place in the corpus.

    Symbols of words are odd, so what is outside of the texts equals none of them.
    """
    w = rule.window
    a, b = items.around(0, w, 2), corpus.around(0, w + rule.edits, 4)
    d = edit_distances(a, b, open_end=True) if rule.edits else np.where((a == b).all(axis=1), 0, 1)
    good = d <= rule.edits
    if rule.run:
        n = rule.context
        before = np.cumprod(items.around(-n, 0, 2)[:, ::-1] == corpus.around(-n, 0, 4)[:, ::-1], axis=1).sum(axis=1)
        after = np.cumprod(items.around(w, w + n, 2) == corpus.around(w, w + n, 4), axis=1).sum(axis=1)
        good &= before + w + after >= rule.run
    return np.where(good, d, -1)


def _passages(cases: DataFrame, case_col: str, part_cols: list[str]) -> DataFrame:
    parts = F.array(*(F.struct(F.lit(p).alias("part"), F.col(f"`{p}`").alias("text")) for p in part_cols))
    return cases.where(F.col(f"`{case_col}`").isNotNull()).select(F.col(f"`{case_col}`").cast("long").alias("case_id"), F.explode(parts).alias("p")).select("case_id", "p.part", "p.text").where("text is not null").distinct()


def _starts(lengths: np.ndarray, w: int, stride: int, used: np.ndarray | bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Start of every window of the texts that are used in the joined symbols, and the text it belongs to."""
    counts = np.where(used, np.maximum(0, (lengths - w) // stride + 1), 0)
    owner = np.repeat(np.arange(len(lengths)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return (np.cumsum(lengths) - lengths)[owner] + nth * stride, owner


def _own_size(lengths: np.ndarray, rule: Rule, whole: Rule) -> np.ndarray:
    """Items that have windows of this size: all that are long enough for the rule's window, a shorter one for its own size."""
    return lengths >= max(rule.window, rule.run) if rule.window == whole.window else lengths == rule.window


def _spans(symbols: np.ndarray, lengths: np.ndarray, rule: Rule, shared: np.ndarray, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of spans, their texts, and for each length of span whether it can be a leak.

    ``shared`` tells of every place whether the run of ``rule.intact`` words
    there may be an item's, ``known`` of every word whether an item has it.
    """
    starts, owner = _starts(lengths, rule.spans[0], rule.stride)
    room = (np.cumsum(lengths))[owner] - starts
    runs_before = np.concatenate([[0], np.cumsum(shared)])
    unknown = None if known is None else np.concatenate([[0], np.cumsum(~known)])
    good = np.zeros((len(rule.spans), len(starts)), bool)
    for fits, n in zip(good, rule.spans, strict=True):
        at = np.flatnonzero(room >= n)
        s = starts[at]
        # A span without any run of words that some item has can't be a leak.
        may = runs_before[s + max(1, n - rule.intact + 1)] > runs_before[s] if n >= rule.intact else np.ones(len(s), bool)
        if unknown is not None:
            # Nor can one with more words that no item has than edits are allowed.
            may &= unknown[s + n] - unknown[s] <= rule.edits
        fits[at] = may
    return starts, owner, good


class _Index:
    """All windows of the items of one size with their keys, for as many items as are known to be few."""

    def __init__(self, rows: list, lists: list[np.ndarray], rule: Rule, whole: Rule):
        self.rule = rule
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        keep = np.flatnonzero(_own_size(lengths, rule, whole)).tolist()
        self.case, self.part = [rows[k].case_id for k in keep], [rows[k].part for k in keep]
        self.lengths = lengths[keep]
        self.flat = np.concatenate([lists[k] for k in keep]) if keep else np.empty(0, np.uint64)
        self.starts, self.owner = _starts(self.lengths, rule.window, 1)
        x = windows(self.flat, self.starts, rule.window)
        self.intact = np.unique(runs(self.flat, self.lengths, rule.intact)[0])
        self.tables = []
        for r in range(repetitions(rule) if keep else 0):
            k = keys(x, rule, r)
            order = np.argsort(k, kind="stable")
            self.tables.append((k[order], order))

    def search(self, symbols: np.ndarray, lengths: np.ndarray, known: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(text, word, item, item's word, edits) of the leaks, as arrays."""
        rule = self.rule
        if not self.tables or not len(symbols):
            return
        # Runs over the ends of texts only let more spans pass.
        shared = np.zeros(len(symbols), bool)
        whole = runs(symbols, np.array([len(symbols)]), rule.intact)[0]
        shared[: len(whole)] = np.isin(whole, self.intact)
        starts, owner, good = _spans(symbols, lengths, rule, shared, known)
        some = np.flatnonzero(good.any(axis=0))
        ends = np.cumsum(lengths)
        own_ends = np.cumsum(self.lengths)
        for a in range(0, len(some), 200_000):
            part = some[a : a + 200_000]
            spans = [(at, windows(symbols, starts[at], n)) for fits, n in zip(good, rule.spans, strict=True) for at in [part[fits[part]]]]
            pairs = [np.empty((2, 0), np.int64)]
            for r, (sorted_keys, order) in enumerate(self.tables):
                for at, x in spans:
                    k = keys(x, rule, r)
                    lo, hi = np.searchsorted(sorted_keys, k, "left"), np.searchsorted(sorted_keys, k, "right")
                    n = hi - lo
                    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    pairs.append(np.stack([np.repeat(at, n), order[np.repeat(lo, n) + nth]]))
            at, item = np.unique(np.concatenate(pairs, axis=1), axis=1)
            t, own = owner[at], self.owner[item]
            corpus = _Places(symbols, ends[t] - lengths[t], ends[t], starts[at])
            items = _Places(self.flat, own_ends[own] - self.lengths[own], own_ends[own], self.starts[item])
            d = verified(corpus, items, rule)
            ok = d >= 0
            yield t[ok], (corpus.at - corpus.begin)[ok], own[ok], (items.at - items.begin)[ok], d[ok]


_OUT = "id long, case_id long, part string, word long, case_word long, edits int"


def _batch(ids: pa.Array, cases: pa.Array, parts: pa.Array, *numbers: np.ndarray) -> pa.RecordBatch:
    word, case_word, edits = numbers
    return pa.RecordBatch.from_arrays([ids, cases, parts, pa.array(word, pa.int64()), pa.array(case_word, pa.int64()), pa.array(edits.astype(np.int32))], names=["id", "case_id", "part", "word", "case_word", "edits"])


def _symbols(texts: list[str], look) -> tuple[np.ndarray, np.ndarray]:
    lists = [plain_words(t) for t in texts]
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((look(w) for ws in lists for w in ws), np.uint64, int(lengths.sum())), lengths


def _few(src: DataFrame, items: list, rule: Rule) -> DataFrame:
    """The leaks of items that are known to be few: their index goes to the executors, which see every document once."""
    cache_ = TokenHashes()
    lists = [np.array([cache_[w] | 1 for w in plain_words(r.text)], np.uint64) for r in items]
    vocabulary = {w: cache_[w] | 1 for r in items for w in plain_words(r.text)}
    index = src.sparkSession.sparkContext.broadcast((vocabulary, [_Index(items, lists, one, rule) for one in rule.sizes]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, indexes = index.value
        hashes = TokenHashes()
        # Without edits the words that no item has needn't be told apart.
        look = (lambda w: hashes[w] | 1) if rule.edits else (lambda w: vocabulary.get(w, 0))
        every = np.unique(np.fromiter(vocabulary.values(), np.uint64, len(vocabulary)))
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                symbols, lengths = _symbols(part.column(1).to_pylist(), look)
                known = np.isin(symbols, every) if rule.edits else symbols != UNKNOWN
                for one in indexes:
                    for t, word, own, at, d in one.search(symbols, lengths, known):
                        yield _batch(part.column(0).take(pa.array(t)), pa.array([one.case[i] for i in own], pa.int64()), pa.array([one.part[i] for i in own], pa.string()), word, at, d)

    return src.mapInArrow(run, _OUT)


#: Bits of the filter of the items' runs of words: 16 MB on every executor, however many items there are.
FILTER_BITS = 27


def _run_filter(items: DataFrame, rule: Rule) -> np.ndarray:
    """A filter with one hash: bits at the hashes of all runs of words of which a leak must hold one, for each size of window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TokenHashes()
        for batch in batches:
            symbols, lengths = _symbols(batch.column("text").to_pylist(), lambda w: hashes[w] | 1)
            found = [np.unique(runs(symbols, lengths, n)[0] >> U64(64 - FILTER_BITS)) for n in {one.intact for one in rule.sizes}]
            at = np.unique(np.concatenate(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((U64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["word", "bits"])

    found = items.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def _many(src: DataFrame, items: DataFrame, rule: Rule) -> DataFrame:
    """The same leaks for any number of items: both sides emit their windows by key, and meet in a shuffle.

    Spans of the corpus without any run of words that some item may have, by a
    filter of fixed size, are left out before.
    """
    around = rule.context
    filled = src.sparkSession.sparkContext.broadcast(_run_filter(items, rule))

    def emit(own: list[str], corpus: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = TokenHashes()
            for batch in batches:
                for first in range(0, batch.num_rows, 500):
                    part = batch.slice(first, 500)
                    symbols, lengths = _symbols(part.column(part.num_columns - 1).to_pylist(), lambda w: hashes[w] | 1)
                    if not len(symbols):
                        continue
                    for one in rule.sizes:
                        yield from spans(part, symbols, lengths, one)

        def spans(part: pa.RecordBatch, symbols: np.ndarray, lengths: np.ndarray, one: Rule) -> Iterator[pa.RecordBatch]:
            if corpus:
                h = runs(symbols, np.array([len(symbols)]), one.intact)[0] >> U64(64 - FILTER_BITS)
                shared = np.zeros(len(symbols), bool)
                shared[: len(h)] = (filled.value[(h >> U64(6)).astype(np.int64)] >> (h & U64(63))) & U64(1) == 1
                starts, owner, good = _spans(symbols, lengths, one, shared, None)
                fit = [(at, windows(symbols, starts[at], n)) for ok, n in zip(good, one.spans, strict=True) for at in [np.flatnonzero(ok)]]
            else:
                starts, owner = _starts(lengths, one.window, 1, _own_size(lengths, one, rule))
                fit = [(np.arange(len(starts)), windows(symbols, starts, one.window))]
            if not sum(len(at) for at, _ in fit):
                return
            ends = np.cumsum(lengths)[owner]
            begins = ends - lengths[owner]
            lo, hi = np.maximum(begins, starts - around), np.minimum(ends, starts + one.window + max(around, one.edits))
            for r in range(repetitions(one)):
                given = np.zeros((len(fit), len(starts)), np.uint64)
                for i, (at, x) in enumerate(fit):
                    given[i, at] = keys(x, one, r)
                    # A start whose shorter span has the same key has been given out with it.
                    at = at[(given[:i, at] != given[i, at]).all(axis=0)]
                    near = pa.array([symbols[a:b].view(np.int64) for a, b in zip(lo[at], hi[at], strict=True)], pa.list_(pa.int64()))
                    fixed = [part.column(c).take(pa.array(owner[at])) for c in range(len(own))]
                    yield pa.RecordBatch.from_arrays([*fixed, pa.array(np.full(len(at), one.window, np.int32)), pa.array(given[i, at].view(np.int64)), pa.array(np.full(len(at), r, np.int32)), pa.array((starts - begins)[at]), pa.array((starts - lo)[at]), near], names=[*own, "size", "key", "rep", "word", "offset", "near"])

        return run

    tail = "size int, key long, rep int, word long, offset long, near array<bigint>"
    left = src.mapInArrow(emit(["id"], True), f"id long, {tail}")
    right = items.select("case_id", "part", "text").mapInArrow(emit(["case_id", "part"], False), f"case_id long, part string, {tail}").withColumnsRenamed({"word": "case_word", "offset": "case_offset", "near": "case_near"})

    def places(batch: pa.RecordBatch, near: str, offset: str) -> _Places:
        column = batch.column(near)
        flat, ends = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        begin = np.concatenate([[0], ends[:-1]])
        return _Places(flat, begin, ends, begin + batch.column(offset).to_numpy())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("size").to_numpy()
            for one in rule.sizes:
                part = batch.take(pa.array(np.flatnonzero(size == one.window)))
                if part.num_rows:
                    d = verified(places(part, "near", "offset"), places(part, "case_near", "case_offset"), one)
                    ok = pa.array(np.flatnonzero(d >= 0))
                    yield _batch(*(part.column(c).take(ok) for c in ("id", "case_id", "part")), part.column("word").take(ok).to_numpy(), part.column("case_word").take(ok).to_numpy(), d[d >= 0])

    return left.join(right, ["size", "rep", "key"]).mapInArrow(judge, _OUT)


#: Bytes that the index of a few items may have on every executor.
INDEX_BYTES = 64 << 20


def leaks(documents: DataFrame, id_col: str, text_col: str, cases: DataFrame, case_col: str, part_cols: list[str], rule: Rule = Rule(), *, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``doc_id, case_id, windows, edits``: the documents that hold a passage of a case, with the number of
    places in it that show it and their least edit distance.

    Null ids, texts and passages, and passages shorter than the rule's least
    size and run, never count; repeated rows count once; empty tables give no
    rows.  Items whose index needs at most ``index_bytes``, by the length of
    their texts, are indexed on the driver and sent to the executors, which see
    every document once; others meet the documents in a shuffle by key.  Both
    ways have the same keys, candidates and rows.
    """
    src = only(documents, id=F.col(f"`{id_col}`").cast("long"), text=text_col).where("id is not null and text is not null")
    items = _passages(cases, case_col, part_cols)
    # A word and what parts it from the next have two bytes at least; a window has a key and a number for each repetition.
    most = index_bytes * 2 // (16 * max(map(repetitions, rule.sizes)))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    found = _few(src, sorted(items.collect()), rule) if size <= most else _many(src, items, rule)
    return found.groupBy(F.col("id").alias("doc_id"), "case_id").agg(F.countDistinct("word").alias("windows"), F.min("edits").alias("edits"))
