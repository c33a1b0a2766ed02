"""Text functions as column expressions: tokenising, normalising, finding, chunking."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a query term, and what separates tokens of an indexed text.
QUERY_TERM = r"[\p{L}\p{M}\p{N}_-]+"
FILENAME_TERM = r"[\p{L}\p{M}\p{N}_.-]+"
SEPARATORS = r"[^\p{L}\p{N}\p{Co}]+"

#: White space at the ends of a text (Unicode), in a spelling that Java and RE2 share.
BLANK = r"[\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: Passage size, overlap and least length in characters.
CHUNK_SIZE, CHUNK_OVERLAP, CHUNK_LEAST = 1200, 180, 40


def _accents() -> tuple[str, str]:
    """Accented Latin, Greek and Cyrillic letters and their bases, by canonical decomposition."""
    pairs = {}
    for code in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(unicodedata.combining(c) for c in parts[1:]):
            pairs[chr(code)] = parts[0]
    return "".join(pairs), "".join(pairs.values())


_FROM, _TO = _accents()


def strip_accents(text: Column) -> Column:
    """Precomposed letters without their marks; combining marks are left out."""
    return F.regexp_replace(F.translate(text, _FROM, _TO), "[\\u0300-\\u036f]", "")


def tokens(text: Column) -> Column:
    """The index tokens of a text: lower case, no accents, split at anything but letters and digits."""
    return F.filter(F.split(strip_accents(F.lower(text)), SEPARATORS), lambda x: x != "")


def query_terms(query: Column, pattern: str = QUERY_TERM) -> Column:
    """The distinct terms of a query, in order."""
    return F.array_distinct(F.regexp_extract_all(query, F.lit(pattern), F.lit(0)))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+$", "")


def tidy(text: Column) -> Column:
    """Three and more line breaks become two, blanks at both ends go."""
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def last_index(text: Column, part: str) -> Column:
    """Position from 0 of the last occurrence, -1 without any."""
    back = F.instr(F.reverse(text), part[::-1])
    return F.when(back == 0, -1).otherwise(F.length(text) - back + 1 - len(part))


def chunk_spans(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """``array<struct<start, end>>``: overlapping passages of a text, ended after a blank line or sentence where
    there is one in the second half of the passage.

    A fold over as many steps as the text can need: each passage but the last
    moves on by more than half its size less the overlap.
    """
    n = F.length(text)
    start = F.struct(F.lit(0).alias("pos"), F.lit(False).alias("done"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(s: Column, _: Column) -> Column:
        full = F.least(n, s["pos"] + size)

        def ended(window: Column) -> Column:
            cut = F.greatest(last_index(window, "\n\n"), last_index(window, ". "))
            return F.when((full < n) & (cut > size // 2), s["pos"] + cut + 1).otherwise(full)

        def moved(end: Column) -> Column:
            span = F.struct(s["pos"].alias("start"), end.alias("end"))
            return F.struct(F.greatest(s["pos"] + 1, end - overlap).alias("pos"), (end >= n).alias("done"), F.concat(s["spans"], F.array(span)).alias("spans"))

        window = F.substring(text, s["pos"] + 1, F.lit(size))
        return F.when(s["done"], s).otherwise(_let(_let(window, ended), moved))

    steps = F.sequence(F.lit(0), F.floor(n / (size // 2 - overlap)).cast("int") + 1)
    return F.when(n > 0, F.aggregate(steps, start, step)["spans"]).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def chunks(text: Column, least: int = CHUNK_LEAST) -> Column:
    """The passages of a text as an array of strings; passages under ``least`` characters are left out."""

    def cut(t: Column) -> Column:
        parts = F.transform(chunk_spans(t), lambda s: strip(F.substring(t, s["start"] + 1, s["end"] - s["start"])))
        return F.filter(parts, lambda p: F.length(p) >= least)

    return _let(tidy(text), cut)
