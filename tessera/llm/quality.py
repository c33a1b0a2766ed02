"""Per-document text statistics, from partial counts of text chunks with boundary state.

A document over ``chunk_chars`` characters is cut into chunks, which are
counted in parallel.  A chunk's counts form an associative summary; what a cut
may split is kept open at its two ends and corrected when neighbours are
joined: the word at the very edge, and the line that the edge lies in.  The
summaries of a document are merged in a tree of two levels (a string in Spark
has less than 2**31 bytes, which bounds both levels), then the ratios and the
outcomes of the rules are derived.  Other documents are one closed summary and
are not shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import only

#: Common function words of the collection's languages (fixed values).
COMMON_WORDS = {
    "en": "the a an of to in on at by for with from and or but so if as than that this these those it its he she they we you i his her their our your my is are was were be been not no who which what when while where because since until unless although though after before into over under between through during without within near behind beside against every each any some one all both few more most other such only own same too very can will just there here then once everyone nobody",
    "de": "der die das den dem des ein eine einer eines einem einen und oder aber wenn weil dass damit obwohl bis denn mit von zu auf aus für ohne nach bei in im an am um unter über vor durch gegen zwischen ist sind war nicht kein keine er sie es wir ihr man jeder jede dieser diese unser mein dein sein jemand niemand",
    "fr": "le la les un une des du de et ou mais donc car ni que qui quoi dont où quand lorsque puisque si comme avec sans sous sur dans par pour vers chez entre depuis avant après contre pendant ce cet cette ces mon ton son notre votre leur leurs nous vous il elle ils elles on je tu ne pas plus chaque chacun personne aucun au aux",
    "es": "el la los las un una unos unas y o pero pues porque cuando mientras aunque si como con sin sobre bajo en por para hacia desde hasta entre según antes después contra este esta estos estas ese esa aquel su sus mi tu nuestro nuestra él ella ellos nosotros alguien nadie quien algún alguna cada no del al lo se que",
}
COMMON = frozenset(w for words in COMMON_WORDS.values() for w in words.split())
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_INVISIBLE = re.compile("[\\u00ad\\u200b-\\u200f\\u2060-\\u2064\\ufeff]")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_CLEAN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_BULLET = re.compile(r"[-*+•–—]|\[[xX]?\]?|\(?\d{1,3}[.)]|[a-zA-Z]\)")
_ENDS = frozenset(".!?…:;\"”»'")
#: No word is longer; a longer token is counted by its characters only.
LONGEST_WORD = 64
CHUNK_CHARS = 32_768

#: What is counted of a token: a token is a run of characters without blanks, a word a token without mark-up tags.
TOKEN = ("words", "word_chars", "clean_words", "common_words", "letters", "digits", "symbols")
#: What is counted of a document: the counts of its tokens, and of its lines.
COUNTS = (*TOKEN, "chars", "lines", "filled_lines", "ended_lines", "bullet_lines", "prose_chars", "line_chars")
_T = len(TOKEN)


@dataclass(frozen=True)
class Rules:
    """Thresholds of the outcomes, and the words that are common."""

    common_share: float = 0.18  # of the words of a line of prose are common words, at least
    clean_share: float = 0.6  # of the words of a line of prose consist of letters, at least
    prose_share: float = 0.45  # of the characters of a document of prose stand in lines of prose, at least
    common: frozenset[str] = COMMON


def token_counts(token: str, common_words: frozenset[str] = COMMON) -> tuple[int, ...]:
    """The counts TOKEN of one token, and whether it ends a sentence and whether it is a list mark."""
    letters = sum(map(str.isalpha, token))
    digits = sum(map(str.isdigit, token))
    ends, bullet = token[-1] in _ENDS, _BULLET.fullmatch(token) is not None
    if len(token) > LONGEST_WORD:
        return 1, len(token), 0, 0, letters, digits, len(token) - letters - digits, ends, bullet
    words = [w for x in _TAG.sub(" ", _INVISIBLE.sub("", token)).split() if (w := _EDGE.sub("", x)) or not x.isspace()]
    clean = sum(_CLEAN.fullmatch(w) is not None for w in words)
    common = sum(w.lower() in common_words for w in words)
    return len(words), sum(map(len, words)), clean, common, letters, digits, len(token) - letters - digits, ends, bullet


class _Tokens(dict):
    """Token to its row in ``table``, which grows as tokens come; both are emptied at ``room`` tokens."""

    def __init__(self, common: frozenset[str] = COMMON, room: int = 200_000):
        super().__init__()
        self.common, self.room, self.rows = common, room, []
        self._table = np.empty((0, _T + 2), np.int64)

    def __missing__(self, token: str) -> int:
        n = len(self.rows)
        self.rows.append(token_counts(token, self.common))
        if len(token) <= LONGEST_WORD:
            self[token] = n
        return n

    def table(self) -> np.ndarray:
        if len(self._table) != len(self.rows):
            new = np.array(self.rows[len(self._table) :], np.int64).reshape(-1, _T + 2)
            self._table = np.concatenate([self._table, new])
        return self._table

    def trim(self) -> None:
        if len(self.rows) > self.room:
            self.clear()
            self.rows, self._table = [], np.empty((0, _T + 2), np.int64)


def _line_rows(tokens: np.ndarray, chars: np.ndarray, ended: np.ndarray, bullet: np.ndarray, rules: Rules) -> np.ndarray:
    """COUNTS of every line, from its token sums, its length, and what its last and first token are."""
    words = tokens[:, 0]
    prose = (words > 0) & (tokens[:, 3] >= rules.common_share * words) & (tokens[:, 2] >= rules.clean_share * words)
    filled = words > 0
    return np.column_stack([tokens, chars, np.ones(len(chars), np.int64), filled, ended & filled, bullet & filled, np.where(prose, chars, 0), chars]).astype(np.int64)


def count_texts(texts: list[str], cache: _Tokens, rules: Rules) -> np.ndarray:
    """COUNTS of each text as a whole."""
    cache.trim()
    index: list[int] = []
    per_line: list[int] = []
    lengths: list[int] = []
    per_text: list[int] = []
    look = cache.__getitem__
    for text in texts:
        lines = text.split("\n")
        per_text.append(len(lines))
        for line in lines:
            tokens = line.split()
            index.extend(map(look, tokens))
            per_line.append(len(tokens))
            lengths.append(len(line))
    rows = cache.table()[np.array(index, np.int64)]
    n = np.array(per_line, np.int64)
    ends = np.cumsum(n)
    sums = np.concatenate([np.zeros((1, _T + 2), np.int64), np.cumsum(rows, axis=0)])
    total = sums[ends] - sums[ends - n]
    some = n > 0
    last, first = np.zeros(len(n), bool), np.zeros(len(n), bool)
    last[some] = rows[ends[some] - 1, _T] > 0
    first[some] = rows[(ends - n)[some], _T + 1] > 0
    counted = _line_rows(total[:, :_T], np.array(lengths, np.int64), last, first, rules)
    begin = np.concatenate([[0], np.cumsum(per_text)[:-1]]).astype(np.int64)
    return np.add.reduceat(counted, begin, axis=0) if len(texts) else np.empty((0, len(COUNTS)), np.int64)


@dataclass
class Fragment:
    """A part of a token: its text while it is short, else its counts."""

    text: str | None = ""
    chars: int = 0
    letters: int = 0
    digits: int = 0
    last: str = ""

    @classmethod
    def of(cls, text: str) -> Fragment:
        return cls(text if len(text) <= LONGEST_WORD else None, len(text), sum(map(str.isalpha, text)), sum(map(str.isdigit, text)), text[-1:])

    def __add__(self, other: Fragment) -> Fragment:
        if not self.chars or not other.chars:
            return self if self.chars else other
        text = self.text + other.text if self.text is not None and other.text is not None else None
        return Fragment(text if text is not None and len(text) <= LONGEST_WORD else None, self.chars + other.chars, self.letters + other.letters, self.digits + other.digits, other.last)

    def counts(self, common: frozenset[str]) -> tuple[int, ...]:
        if self.text is not None:
            return token_counts(self.text, common)
        return 1, self.chars, 0, 0, self.letters, self.digits, self.chars - self.letters - self.digits, self.last in _ENDS, False


@dataclass
class OpenLine:
    """A part of a line, without the fragments at its ends."""

    chars: int = 0
    tokens: list[int] = field(default_factory=lambda: [0] * _T)
    bullet: bool | None = None  # of its first token
    ended: bool | None = None  # of its last token

    def add(self, t: tuple[int, ...]) -> OpenLine:
        return self + OpenLine(0, list(t[:_T]), bool(t[_T + 1]), bool(t[_T]))

    def __add__(self, other: OpenLine) -> OpenLine:
        first, last = (self.bullet if self.bullet is not None else other.bullet), (other.ended if other.ended is not None else self.ended)
        return OpenLine(self.chars + other.chars, [a + b for a, b in zip(self.tokens, other.tokens, strict=True)], first, last)

    def closed(self, rules: Rules) -> np.ndarray:
        return _line_rows(np.array([self.tokens]), np.array([self.chars]), np.array([bool(self.ended)]), np.array([bool(self.bullet)]), rules)[0]


@dataclass
class Summary:
    """The counts of a stretch of text, open at both ends.

    ``solid``: no blank in it, then ``left`` is all of it.  Without a line break
    (``broken`` is false) ``first`` is the only line.
    """

    left: Fragment
    right: Fragment
    first: OpenLine
    last: OpenLine
    inner: np.ndarray
    broken: bool
    solid: bool

    @classmethod
    def of(cls, text: str, rules: Rules, cache: _Tokens) -> Summary:
        zero = np.zeros(len(COUNTS), np.int64)
        if text and not any(map(str.isspace, text)):
            return cls(Fragment.of(text), Fragment(), OpenLine(len(text)), OpenLine(), zero, False, True)
        body_at = next((i for i, c in enumerate(text) if c.isspace()), len(text))
        tail_at = next((i for i in range(len(text), body_at, -1) if text[i - 1].isspace()), body_at)
        left, right, body = Fragment.of(text[:body_at]), Fragment.of(text[tail_at:]), text[body_at:tail_at]
        lines = body.split("\n")

        def opened(line: str) -> OpenLine:
            out = OpenLine(len(line))
            for t in line.split():
                out = out.add(token_counts(t, rules.common))
            return out

        first = opened(lines[0])
        first.chars += left.chars
        if len(lines) == 1:
            first.chars += right.chars
            return cls(left, right, first, OpenLine(), zero, False, False)
        last = opened(lines[-1])
        last.chars += right.chars
        inner = count_texts(["\n".join(lines[1:-1])], cache, rules)[0] if len(lines) > 2 else zero
        return cls(left, right, first, last, inner, True, False)

    def join(self, other: Summary, rules: Rules) -> Summary:
        """The summary of both stretches in sequence."""
        a, b = self, other
        if a.solid and b.solid:
            return Summary(a.left + b.left, Fragment(), a.first + b.first, OpenLine(), a.inner, False, True)
        if a.solid:
            return Summary(a.left + b.left, b.right, a.first + b.first, b.last, b.inner, b.broken, False)
        end = a.last if a.broken else a.first
        if b.solid:
            end = end + b.first
            return Summary(a.left, a.right + b.left, a.first if a.broken else end, end if a.broken else a.last, a.inner, a.broken, False)
        word = a.right + b.left
        if word.chars:
            end = end.add(word.counts(rules.common))
        middle = end + b.first
        if a.broken and b.broken:
            return Summary(a.left, b.right, a.first, b.last, a.inner + b.inner + middle.closed(rules), True, False)
        if a.broken:
            return Summary(a.left, b.right, a.first, middle, a.inner + b.inner, True, False)
        return Summary(a.left, b.right, middle, b.last, a.inner + b.inner, b.broken, False)

    def total(self, rules: Rules) -> np.ndarray:
        """The counts once there is nothing more on either side."""
        head = OpenLine().add(self.left.counts(rules.common)) if self.left.chars else OpenLine()
        tail = OpenLine().add(self.right.counts(rules.common)) if self.right.chars else OpenLine()
        if not self.broken:
            return (head + self.first + tail).closed(rules)
        return (head + self.first).closed(rules) + self.inner + (self.last + tail).closed(rules)

    def pack(self) -> list:
        """As JSON-compatible values."""
        line = lambda x: [x.chars, list(map(int, x.tokens)), x.bullet, x.ended]
        part = lambda x: [x.text, x.chars, x.letters, x.digits, x.last]
        return [part(self.left), part(self.right), line(self.first), line(self.last), self.inner.tolist(), self.broken, self.solid]

    @classmethod
    def unpack(cls, x: list) -> Summary:
        return cls(Fragment(*x[0]), Fragment(*x[1]), OpenLine(*x[2]), OpenLine(*x[3]), np.array(x[4], np.int64), x[5], x[6])


#: A line from which common words are learnt has so many words at least, and so large a share of them of letters only.
LEARNT_WORDS, LEARNT_CLEAN = 6, 0.8


def frequent_words(df: DataFrame, text_col: str, lang_col: str, *, share: float = 0.4, least_documents: int = 50) -> DataFrame:
    """``lang, word, documents, df``: words that stand in sentence-like lines of at least ``share`` of a language's documents.

    Of the languages (by the first two letters of their name) that COMMON_WORDS
    lacks, with ``least_documents`` documents or more.  Each document counts a
    word once; documents without a text or a language don't count.
    """
    src = only(df, lang=F.lower(F.substring(F.trim(F.col(f"`{lang_col}`")), 1, 2)), text=text_col).where(F.col("text").isNotNull() & (F.length("lang") == 2) & ~F.col("lang").isin(list(COMMON_WORDS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, str], int] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                seen = {""}  # stands for the document
                for line in text.split("\n"):
                    words = [w for x in line.split() if (w := _EDGE.sub("", x))]
                    clean = [w.lower() for w in words if len(w) <= LONGEST_WORD and _CLEAN.fullmatch(w)]
                    if len(words) >= LEARNT_WORDS and len(clean) >= LEARNT_CLEAN * len(words):
                        seen.update(clean)
                for w in seen:
                    found[lang, w] = found.get((lang, w), 0) + 1
            langs, words = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "df"])

    counted = src.mapInArrow(run, "lang string, word string, df long").groupBy("lang", "word").agg(F.sum("df").alias("df"))
    documents = F.max(F.when(F.col("word") == "", F.col("df"))).over(Window.partitionBy("lang"))
    kept = counted.withColumn("documents", documents).where((F.col("word") != "") & (F.col("documents") >= least_documents) & (F.col("df") >= share * F.col("documents")))
    return kept.select("lang", "word", "documents", "df")


def learnt_rules(df: DataFrame, text_col: str, lang_col: str, rules: Rules = Rules()) -> Rules:
    """The rules with the frequent words of the corpus' other languages beside the fixed ones.

    No more words than a document has on average, divided by the share, are
    frequent in a language, and the names of languages have two letters.
    """
    return replace(rules, common=rules.common | {r.word for r in frequent_words(df, text_col, lang_col).collect()})


_COUNTED = "id long, " + ", ".join(f"{c} long" for c in COUNTS)


def counts(df: DataFrame, id_col: str, text_col: str, rules: Rules = Rules(), *, chunk_chars: int = CHUNK_CHARS, fan_in: int = 64) -> DataFrame:
    """``id`` and COUNTS of every text; null ids and null texts give nothing, an empty text counts one empty line."""
    import json

    src = only(df, id=F.col(f"`{id_col}`").cast("long"), text=text_col).where("id is not null and text is not null")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Tokens(rules.common)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                rows = count_texts(part.column(1).to_pylist(), cache, rules)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(rows[:, i]) for i in range(len(COUNTS)))], names=["id", *COUNTS])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = range(0, len(text), chunk_chars)
                for first in range(0, len(at), 256):
                    some = at[first : first + 256]
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(some), pa.int64()), pa.array([s // chunk_chars for s in some], pa.int64()), pa.array([text[s : s + chunk_chars] for s in some], pa.string())], names=["id", "chunk", "text"])

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Tokens(rules.common)
        for batch in batches:
            packed = [json.dumps(Summary.of(t, rules, cache).pack()) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.string())], names=["id", "chunk", "summary"])

    def joined(pdf: pd.DataFrame) -> Summary:
        out: Summary | None = None
        for x in pdf.sort_values("chunk")["summary"]:
            s = Summary.unpack(json.loads(x))
            out = s if out is None else out.join(s, rules)
        return out

    def lower(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": [pdf["id"].iloc[0]], "chunk": [pdf["chunk"].iloc[0] // fan_in], "summary": [json.dumps(joined(pdf).pack())]})

    def upper(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[pdf["id"].iloc[0], *joined(pdf).total(rules).tolist()]], columns=["id", *COUNTS])

    small = src.where(F.length("text") <= chunk_chars).mapInArrow(whole, _COUNTED)
    parts = src.where(F.length("text") > chunk_chars).mapInArrow(cut, "id long, chunk long, text string").dropDuplicates(["id", "chunk"])
    parts = parts.mapInArrow(summaries, "id long, chunk long, summary string")
    parts = parts.groupBy("id", (F.col("chunk") / fan_in).cast("long")).applyInPandas(lambda key, pdf: lower(pdf), "id long, chunk long, summary string")
    return small.unionByName(parts.groupBy("id").applyInPandas(upper, _COUNTED))


def _share(part: str | Column, of: str | Column) -> Column:
    part, of = (F.col(x) if isinstance(x, str) else x for x in (part, of))
    return F.when(of > 0, part / of).otherwise(0.0)


def statistics(df: DataFrame, id_col: str, text_col: str, rules: Rules = Rules(), *, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Counts and ratios of every text, and ``is_prose``: whether most of it is running sentences.

    A ratio without anything to divide by is 0.  ``is_prose`` is null for texts
    without any word.  Null ids and null texts give nothing, an empty table no
    rows; repeated rows of an id count once.
    """
    c = counts(df, id_col, text_col, rules, chunk_chars=chunk_chars).dropDuplicates(["id"])
    visible = F.col("letters") + F.col("digits") + F.col("symbols")
    return c.select(
        "id", "chars", "words", "lines",
        _share("word_chars", "words").alias("mean_word_length"),
        _share("symbols", visible).alias("symbol_ratio"),
        _share("digits", visible).alias("digit_ratio"),
        _share("ended_lines", "filled_lines").alias("ended_line_share"),
        _share("bullet_lines", "filled_lines").alias("bullet_line_share"),
        _share("common_words", "words").alias("common_word_share"),
        _share("clean_words", "words").alias("clean_word_share"),
        _share("prose_chars", "line_chars").alias("prose_share"),
        F.when(F.col("words") > 0, _share("prose_chars", "line_chars") >= rules.prose_share).alias("is_prose"),
    )
