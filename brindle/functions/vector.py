"""Vector functions as Columns. Components are widened to double before any arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

COSINE, L2 = "cosine", "l2"


def as_vector(v: Column | Sequence[float]) -> Column:
    """A column, or a literal query vector rounded to 32 bits first as stored vectors are."""
    if isinstance(v, Column):
        return v.cast("array<double>")
    return F.expr(f"array({', '.join(f'{x!r}D' for x in map(float, np.asarray(v, np.float32)))})") if len(v) else F.array().cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column | Sequence[float], b: Column | Sequence[float]) -> Column:
    """1 - cos, the cosine clamped to [-1, 1]; 1 if either norm is zero."""
    a, b = as_vector(a), as_vector(b)
    scale = norm(a) * norm(b)
    return F.when(scale == 0, 1.0).otherwise(1.0 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.nullif(scale, F.lit(0.0)))))


def l2_distance(a: Column | Sequence[float], b: Column | Sequence[float]) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(as_vector(a), as_vector(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def distance(metric: str, a: Column | Sequence[float], b: Column | Sequence[float]) -> Column:
    if metric == COSINE:
        return cosine_distance(a, b)
    if metric == L2:
        return l2_distance(a, b)
    raise ValueError(f"unknown metric {metric!r}: expected {COSINE!r} or {L2!r}")


def normalize(v: Column) -> Column:
    """The unit vector in 32 bits; a zero vector stays as it is."""
    wide = as_vector(v)
    size = norm(wide)
    return F.when(size == 0, v).otherwise(F.transform(wide, lambda x: x / F.nullif(size, F.lit(0.0))).cast("array<float>"))


def same_vector(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def residual_signs(v: Column, centre: Column) -> Column:
    """One bit a dimension: 1 where the component is at or above the centre's."""
    return F.zip_with(as_vector(v), as_vector(centre), lambda x, y: (x - y >= 0).cast("int"))


def packed_signs(signs: Column, dim: int) -> Column:
    """Bits in 64-bit words: bit d is bit d % 64 of word d / 64, the padding zero."""
    word = lambda w: F.aggregate(F.sequence(F.lit(64 * w), F.lit(min(dim, 64 * w + 64) - 1)), F.lit(0).cast("long"), lambda s, d: s.bitwiseOR(F.call_function("shiftleft", F.get(signs, d).cast("long"), d - 64 * w)))
    return F.array(*(word(w) for w in range(-(-dim // 64))))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def agreement(a: Column, b: Column, dim: int) -> Column:
    return dim - hamming(a, b)


def parse_vector(text: Column) -> Column:
    """Comma-separated numbers, blanks around them ignored."""
    return F.transform(F.split(text, ","), lambda x: F.trim(x).cast("float"))


def choose_k(n: int) -> int:
    """Clusters for n vectors: the root, rounded half up, at least 1."""
    return max(1, int(max(0, n) ** 0.5 + 0.5))
