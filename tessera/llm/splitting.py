"""Cutting long texts at natural boundaries by agglomerative merging.

A text is first cut at every boundary into atomic segments.  A heap holds the
boundaries between adjacent segments by their strength; the weakest is taken,
and its two neighbours are merged while their combined size plus the overlap
fits the limit.  A boundary across which nothing fits stays: it is a cut.

Two orders of strength are offered.  "place" takes the boundary nearest to the
beginning as the weakest, which fills every piece as far as it goes, and cuts
in mid-text where the last boundary that fits is too near to the piece's start.
"kind" takes blanks before sentence ends before line ends before blank lines,
so that the cuts that stay are the strongest ones.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import only

#: Boundaries of order "place": a double newline or a full stop with a blank. A piece ends after the first character.
_PLACE = re.compile(r"(?=\n\n|\. )")
#: Boundaries of order "kind", weakest first, with the pattern after whose match a piece may end.
_KINDS = [r"\s", r"[.!?…][\"'»”)]*\s", r"\n", r"\n\s*\n"]


class _Merger:
    """Segments as a doubly linked list of [start, end) ranges, and the heap of the boundaries between them."""

    def __init__(self, ends: list[int], limit: int, overlap: int):
        self.starts, self.ends = [0, *ends[:-1]], ends
        self.left, self.right = list(range(-1, len(ends) - 1)), [*range(1, len(ends)), -1]
        self.gone = [False] * len(ends)
        self.limit, self.overlap = limit, overlap

    def piece_start(self, i: int) -> int:
        """Where the piece of segment i starts: with the overlap, except at the beginning of the text."""
        return max(0, self.starts[i] - self.overlap)

    def find(self, i: int) -> int:
        """The segment that segment i has been merged into, or i itself; the way there is shortened."""
        while self.gone[i]:
            j = self.left[i]
            if self.gone[j]:
                self.left[i] = self.left[j]
            i = j
        return i

    def merge(self, i: int) -> None:
        """Segment i takes its right neighbour in."""
        j = self.right[i]
        self.ends[i], self.right[i], self.gone[j] = self.ends[j], self.right[j], True
        if self.right[i] >= 0:
            self.left[self.right[i]] = i

    def cut_inside(self, i: int) -> None:
        """Cuts segment i, which holds no boundary, into pieces of full length."""
        while self.ends[i] > (at := self.piece_start(i) + self.limit):
            k = len(self.ends)
            self.starts.append(at)
            self.ends.append(self.ends[i])
            self.left.append(i)
            self.right.append(self.right[i])
            self.gone.append(False)
            if self.right[i] >= 0:
                self.left[self.right[i]] = k
            self.ends[i], self.right[i] = at, k
            i = k

    def last(self, i: int, place: int) -> int:
        """The segment that ends at the place, i or one that was cut from it."""
        while self.ends[i] < place:
            i = self.right[i]
        return i

    def pieces(self) -> list[tuple[int, int]]:
        return sorted((self.piece_start(i), self.ends[i]) for i in range(len(self.ends)) if not self.gone[i])


def split_by_place(text: str, limit: int, overlap: int, floor: int) -> list[tuple[int, int]]:
    """Pieces of the text by order "place"."""
    n = len(text)
    ends = [m.start() + 1 for m in _PLACE.finditer(text) if m.start() + 1 < n] + [n]
    m = _Merger(ends, limit, overlap)
    heap = [(e, i) for i, e in enumerate(ends[:-1])]
    heapq.heapify(heap)
    m.cut_inside(0)
    while heap:
        place, i = heapq.heappop(heap)
        i = m.find(i)
        i = m.last(i, place)
        j, start = m.right[i], m.piece_start(i)
        # The boundary's second character belongs to it, so it must fit as well; the text's end has none.
        if m.ends[j] + (m.ends[j] < n) <= start + limit or m.ends[j] == start + limit and place <= start + floor + 1:
            m.merge(i)
            continue
        if place <= start + floor + 1:
            # The boundary is too near to the piece's start: the piece takes a part of the next segment in.
            m.ends[i] = m.starts[j] = start + limit
        m.cut_inside(j)
    return m.pieces()


def split_by_kind(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces of the text by order "kind"."""
    n, room = len(text), limit - overlap
    strength: dict[int, int] = {}
    for k, pattern in enumerate(_KINDS):
        for x in re.finditer(pattern, text):
            if x.end() < n:
                strength[x.end()] = k
    ends, last = [], 0
    for e in [*sorted(strength), n]:
        while e - last > room:  # a stretch without any boundary
            last += room
            ends.append(last)
        if e > last:
            ends.append(e)
            last = e
    m = _Merger(ends, limit, overlap)
    heap = [(strength.get(e, -1), e, i) for i, e in enumerate(ends[:-1])]
    heapq.heapify(heap)
    while heap:
        _, _, i = heapq.heappop(heap)
        i = m.find(i)
        if m.ends[m.right[i]] - m.piece_start(i) <= limit:
            m.merge(i)
    return m.pieces()


def split(text: str, limit: int = 1200, overlap: int = 180, *, order: str = "place", floor: int = 600) -> list[tuple[int, int]]:
    """Ranges [start, end) of the pieces of one text; a text within the limit, even an empty one, is one piece."""
    if not 0 <= overlap < floor < limit:
        raise ValueError("0 <= overlap < floor < limit must hold")
    if len(text) <= limit:
        return [(0, len(text))]
    return split_by_place(text, limit, overlap, floor) if order == "place" else split_by_kind(text, limit, overlap)


def pieces(df: DataFrame, id_col: str, text_col: str, *, limit: int = 1200, overlap: int = 180, order: str = "place", with_text: bool = False) -> DataFrame:
    """``id, piece, start_char, end_char`` (and ``overlap_chars, piece_text``) of every text longer than ``limit``.

    Positions count code points from 0, the end is exclusive, and consecutive
    pieces share ``overlap`` characters.  Null ids and null texts, and texts
    within the limit, give nothing; repeated rows of an id count once, and an
    empty table gives no rows.  The split of each text is local to its row, so
    only the narrow ranges are shuffled, to drop repeated rows.
    """
    src = only(df, id=F.col(f"`{id_col}`").cast("long"), text=text_col).where((F.length("text") > limit) & F.col("id").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                last = 0
                for p, (s, e) in enumerate(split(text, limit, overlap, order=order)):
                    rows.append((i, p, s, e, max(0, last - s), text[s:e]) if with_text else (i, p, s, e))
                    last = e
            columns = list(zip(*rows, strict=True)) if rows else [()] * (6 if with_text else 4)
            types = [pa.int64()] * (5 if with_text else 4) + [pa.string()] * with_text
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    names = ["id", "piece", "start_char", "end_char"] + ["overlap_chars", "piece_text"] * with_text
    schema = ", ".join(f"{n} {'string' if n == 'piece_text' else 'long'}" for n in names)
    return src.mapInArrow(run, schema).dropDuplicates(["id", "piece"])
