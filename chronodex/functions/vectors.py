"""Vector arithmetic as column expressions, in double precision."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _fold(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), f), F.lit(0.0), lambda acc, x: acc + x)


def l2_distance(a: Column, b: Column) -> Column:
    """Euclidean distance; infinite for vectors of different length, null for a null vector."""
    d = F.sqrt(_fold(a, b, lambda x, y: (x - y) * (x - y)))
    return F.when(F.size(a) != F.size(b), F.lit(float("inf"))).otherwise(d)


def dot(a: Column, b: Column) -> Column:
    """Inner product; null for vectors of different length or a null vector."""
    return F.when(F.size(a) == F.size(b), _fold(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda acc, x: acc + x * x))


def normalize(v: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    # the norm stands in an argument, not in the lambda, so it is computed once per vector
    n = norm(v)
    return F.when(n > 0, F.zip_with(doubles(v), F.array_repeat(n, F.size(v)), lambda x, y: x / y)).otherwise(doubles(v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of the angle; null for a zero vector or different lengths."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def similarity(distance: Column) -> Column:
    """1 at distance 0, falling to 0."""
    return 1.0 / (1.0 + distance)


def usable(v: Column, dimensions: int | None = None) -> Column:
    """Not null or empty, finite, not all zero, and of the given length."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(fine & (F.size(v) == dimensions if dimensions else F.size(v) > 0), F.lit(False))


TEXT_DIMENSIONS = 96
_TEXT_WORD = re.compile(r"[a-z0-9]+")


@lru_cache(200_000)
def _dimension(word: str) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:6], 16) % TEXT_DIMENSIONS


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def text_vector(text: pd.Series) -> pd.Series:
    """Hashed word counts of a text (Latin letters and digits, lower case) at length 1; null without words.

    Stands in where no embedding of a text is given: it depends on nothing but the text.
    """

    def one(t: str | None) -> np.ndarray | None:
        at = [_dimension(w) for w in _TEXT_WORD.findall(t.lower())] if t else []
        if not at:
            return None
        v = np.bincount(at, minlength=TEXT_DIMENSIONS).astype(float)
        return v / np.sqrt((v * v).sum())

    return pd.Series([one(t) for t in text], dtype=object)


class _Dimensions(dict):
    """Dimension of each word that was seen, at most a million of them."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        at = self[word] = int(hashlib.md5(word.encode()).hexdigest()[:6], 16) % TEXT_DIMENSIONS
        return at


_dimensions = _Dimensions()


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def text_counts(text: pa.Array) -> pa.Array:
    """What :func:`text_vector` brings to length 1: the hashed word counts; null without words."""
    at, n = [], np.zeros(len(text), np.int64)
    for i, t in enumerate(text.to_pylist()):
        if t:
            words = _TEXT_WORD.findall(t.lower())
            n[i] = len(words)
            at.extend(map(_dimensions.__getitem__, words))
    row = np.cumsum(n > 0) - 1  # texts without words have no numbers
    full = int((n > 0).sum())
    counts = np.bincount(np.repeat(row, n) * TEXT_DIMENSIONS + np.array(at, np.int64), minlength=full * TEXT_DIMENSIONS)
    starts = np.append(0, np.cumsum(n > 0)) * TEXT_DIMENSIONS
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(counts, pa.int32()), mask=pa.array(n == 0))


#: Otherwise a filter on the counts would have them made twice.
text_counts = text_counts.asNondeterministic()
