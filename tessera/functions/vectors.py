"""Functions of vectors as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NORM_FLOOR = 1e-12


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def is_valid(v: Column, dim: int) -> Column:
    """Not null, of the right length, and without null, NaN or infinite values."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) == dim) & ~bad, F.lit(False))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalized(v: Column) -> Column:
    """The vector at unit length; a zero vector stays as it is."""
    return F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x / F.when(n == 0, 1.0).otherwise(n)))[0]


def quantize(unit: Column, scale: Column, levels: int) -> Column:
    """Codes from -levels to levels, rounded half to even."""
    return F.zip_with(unit, scale, lambda x, s: F.greatest(F.lit(-levels), F.least(F.lit(levels), F.rint(x / s * float(levels)).cast("int"))))


def dequantize(codes: Column, scale: Column, levels: int) -> Column:
    return F.zip_with(codes, scale, lambda c, s: c.cast("double") * s / float(levels))


def pack_nibbles(codes: Column, levels: int = 7) -> Column:
    """Two codes a byte, the even dimension in the high four bits, each plus ``levels``."""
    pairs = F.sequence(F.lit(0), F.floor(F.size(codes) / 2).cast("int") - 1)
    return F.transform(pairs, lambda i: F.shiftleft(codes[i * 2] + levels, 4).bitwiseOR(codes[i * 2 + 1] + levels))


def unpack_nibbles(packed: Column, levels: int = 7) -> Column:
    halves = F.transform(packed, lambda b: F.array(F.shiftright(b, 4) - levels, b.bitwiseAND(F.lit(15)) - levels))
    return F.flatten(halves)


def _converted(df: DataFrame, source: str, target: str, convert, kind: str) -> DataFrame:
    names = [c for c in df.columns if c not in (source, target)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), convert(batch.column(source))], names=[*names, target])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema)
    return df.select(*names, source).mapInArrow(run, f"{kept}, `{target}` {kind}")


def packed(df: DataFrame, source: str, target: str) -> DataFrame:
    """``df`` with vectors as bytes of little-endian 32-bit floats in the place of ``source``; null stays null."""
    return _converted(df, source, target, lambda c: pa.array([None if x is None else np.asarray(x, "<f4").tobytes() for x in c.to_pylist()], pa.binary()), "binary")


def unpacked(df: DataFrame, source: str, target: str) -> DataFrame:
    """The way back; null for bytes that aren't a whole number of floats."""
    read = lambda x: None if x is None or len(x) % 4 else np.frombuffer(x, "<f4")
    return _converted(df, source, target, lambda c: pa.array([read(x) for x in c.to_pylist()], pa.list_(pa.float32())), "array<float>")
