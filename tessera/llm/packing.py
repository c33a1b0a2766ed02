"""Filling fixed-capacity windows with texts: vector bin packing by the dot-product heuristic.

A window has limits on tokens, on segments and on loss-bearing tokens.  Items
are placed window by window: of the items that still fit, the one whose size
vector has the greatest dot product with the room left (both as shares of the
limits) comes next.  Pools of a bounded number of items are packed apart from
each other; items of windows that stay underfilled are packed once more, in
fewer pools, so that what is lost at the ends of the pools is small.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import only, stage

#: Pre-tokenisation of the byte-level vocabularies in the default tokenizer folder (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

_encodings: dict = {}


#: What bears no loss: mark-up tags.
UNTAUGHT = re.compile(rb"</?[a-zA-Z][^<>]*>")


def encoding(path: str, content: bytes | None = None):
    """The byte-level BPE of a rank file, made once per process, of its content if that is given."""
    if path not in _encodings:
        import tiktoken

        content = Path(path).read_bytes() if content is None else content
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}
        _encodings[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def token_bytes(enc) -> np.ndarray:
    """The number of bytes of every token."""
    out = np.zeros(enc.n_vocab, np.int64)
    for token in enc.token_byte_values():
        out[enc.encode_single_token(token)] = len(token)
    return out


def taught(text: str, lengths: np.ndarray) -> np.ndarray:
    """Of the tokens of a text, which have these numbers of bytes, those that begin outside of mark-up tags."""
    data = text.encode()
    spans = np.array([m.span() for m in UNTAUGHT.finditer(data)], np.int64).reshape(-1, 2)
    starts = np.cumsum(lengths) - lengths
    at = np.searchsorted(spans[:, 0], starts, "right") - 1
    return (at < 0) | (starts >= np.where(at < 0, 0, spans[np.maximum(at, 0), 1] if len(spans) else 0))


def token_pieces(df: DataFrame, id_col: str, text_col: str, *, capacity: int, tokenizer: str) -> DataFrame:
    """``id, piece, first_token, tokens, loss_tokens``: every text as one item, or as pieces of ``capacity`` tokens if it is longer.

    The first token of a piece has nothing before it in its segment, so it
    bears no loss, nor do the tokens of mark-up tags; all others do.  The
    tokenizer's file is read here and sent to the executors, about a megabyte.
    Null ids and null texts and texts without any token give nothing; repeated
    rows of an id count once.
    """
    src = only(df, id=F.col(f"`{id_col}`").cast("long"), text=text_col).where("id is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(tokenizer, shared.value)
        lengths = token_bytes(enc)
        for batch in batches:
            n, loss = np.zeros(batch.num_rows, np.int64), []
            for i, t in enumerate(batch.column(1).to_pylist()):
                tokens = np.array(enc.encode_ordinary(t), np.int64)
                n[i] = len(tokens)
                good = taught(t, lengths[tokens])
                good[::capacity] = False
                loss.append(np.add.reduceat(good.astype(np.int64), np.arange(0, len(good), capacity)) if len(good) else np.empty(0, np.int64))
            parts = -(-n // capacity)
            at = np.repeat(np.arange(len(n)), parts)
            piece = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
            tokens = np.minimum(capacity, n[at] - piece * capacity)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(piece), pa.array(piece * capacity), pa.array(tokens), pa.array(np.concatenate([*loss, np.empty(0, np.int64)]))], names=["id", "piece", "first_token", "tokens", "loss_tokens"])

    shared = df.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())
    return src.mapInArrow(run, "id long, piece long, first_token long, tokens long, loss_tokens long").dropDuplicates(["id", "piece"])


def pack(sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The bin of each item; ``sizes`` has a row per item and a column per limit, and no item exceeds a limit.

    Items of equal size are interchangeable, so the heuristic looks at the
    distinct sizes only.
    """
    kinds, kind_of, left = np.unique(sizes, axis=0, return_inverse=True, return_counts=True)
    kind_of = kind_of.reshape(-1)
    shares = kinds / limits
    members = np.argsort(kind_of, kind="stable")
    taken = np.concatenate([[0], np.cumsum(left)[:-1]])
    out = np.empty(len(sizes), np.int64)
    alive = np.arange(len(kinds))
    bin_no, remaining = 0, len(sizes)
    while remaining:
        room = limits.astype(np.int64).copy()
        fits = alive[left[alive] > 0]
        alive = fits
        while len(fits):
            fits = fits[(kinds[fits] <= room).all(axis=1)]
            if not len(fits):
                break
            best = fits[np.argmax(shares[fits] @ (room / limits))]
            out[members[taken[best]]] = bin_no
            taken[best] += 1
            left[best] -= 1
            remaining -= 1
            room -= kinds[best]
            if not left[best]:
                fits = fits[fits != best]
        bin_no += 1
    return out


def windows(items: DataFrame, limits: dict[str, int], *, pool_items: int = 20_000, full: float = 0.97, merge_pools: int = 16) -> DataFrame:
    """``items`` with the column ``window``: no window exceeds any of the limits.

    ``items`` has the long columns id and piece, which together are unique,
    and one long column for each limit; an item may not exceed a limit.  Other
    columns stay.  Pools hold about ``pool_items`` items however many rows or
    keys there are, as they are drawn by a hash of id and piece.
    """
    spark = items.sparkSession
    names = list(limits)
    caps = np.array([limits[n] for n in names], np.int64)
    fixed = items.select("id", "piece", *names)
    count = fixed.count()

    def packed(df: DataFrame, pools: int, shift: int) -> DataFrame:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["id", "piece"], ignore_index=True)
            number = pack(pdf[names].to_numpy(np.int64), caps)
            used = np.bincount(number, weights=pdf[names[0]].to_numpy(np.float64))
            return pdf.assign(window=((pdf["pool"].to_numpy(np.int64) << 28) + number) * 2 + shift, filled=used[number] / caps[0])[["id", "piece", *names, "window", "filled"]]

        schema = "id long, piece long, " + ", ".join(f"{n} long" for n in names) + ", window long, filled double"
        pooled = df.withColumn("pool", F.pmod(F.xxhash64("id", "piece", F.lit(shift)), F.lit(pools)))
        # A fixed number of partitions: by their few bytes, adaptive execution would put many pools into one task.
        return pooled.repartition(min(pools, 10_000), "pool").groupBy("pool").applyInPandas(run, schema)

    pools = max(1, -(-count // pool_items))
    first = stage(packed(fixed, pools, 0), "windows")
    open_ = first.where(F.col("filled") < full)
    again = packed(open_.select(*fixed.columns), max(1, pools // merge_pools, -(-open_.count() // pool_items)), 1)
    return first.where(F.col("filled") >= full).unionByName(again).select("id", "piece", "window", *names)


def training_windows(df: DataFrame, id_col: str, text_col: str, *, capacity: int = 2048, segments: int = 64, loss_tokens: int | None = None, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """``id, piece, first_token, tokens, loss_tokens, window`` of every text, or of every piece of a text longer than a window.

    A window holds at most ``capacity`` tokens, ``segments`` pieces and
    ``loss_tokens`` loss-bearing tokens (``capacity`` by default), unless one
    piece alone bears more than that: it has a window of its own then.  Null and empty texts have no window, repeated rows of an id
    count once, an empty table gives no rows.
    """
    items = stage(token_pieces(df, id_col, text_col, capacity=capacity, tokenizer=tokenizer), "items")
    most = loss_tokens or capacity
    # A piece that bears more loss than a window may counts as one that bears just so much, and fills all of its tokens.
    over = F.col("loss_tokens") > most
    sized = items.select("id", "piece", F.when(over, capacity).otherwise(F.col("tokens")).cast("long").alias("room"), F.least("loss_tokens", F.lit(most)).cast("long").alias("loss"), F.lit(1).cast("long").alias("segments"))
    placed = windows(sized, {"room": capacity, "loss": most, "segments": segments}).select("id", "piece", "window")
    return items.join(placed, ["id", "piece"]).select("id", "piece", "first_token", "tokens", "loss_tokens", "window")
