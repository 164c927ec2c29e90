"""Arrays of numbers as vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value made once: an expression that a lambda mentions would be made again for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def cosine_score(a: Column, b: Column, norms: Column | None = None) -> Column:
    """(cosine + 1) / 2 in 0 to 1; 0 for missing, unequal-length or zero vectors.

    ``norms`` is the product of the vectors' lengths, where it is at hand.
    """
    cosine = F.try_divide(dot(a, b), norm(a) * norm(b) if norms is None else norms)
    # greatest and least skip nulls, so a missing cosine must not reach them.
    score = bound(cosine, lambda c: F.when(c.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c + 1) / 2))))
    return F.when(a.isNull() | b.isNull() | (F.size(a) != F.size(b)), 0.0).otherwise(score)


def l2_normalized(v: Column) -> Column:
    return bound(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v))


def softmax(v: Column) -> Column:
    """Softmax, shifted by the largest value."""
    raised = bound(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))
    share = lambda r: bound(F.aggregate(r, F.lit(0.0), lambda s, x: s + x), lambda total: F.transform(r, lambda x: x / total))
    return bound(raised, share)


def argmax(v: Column) -> Column:
    """Place of the first largest value, from 0."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def as_floats(v: Column) -> Column:
    """A vector as stored; null where there is nothing to store."""
    return F.when(F.size(v) > 0, v.cast("array<float>"))


@F.pandas_udf(BinaryType())
def encode_floats(v: pd.Series) -> pd.Series:
    """Contiguous little-endian float32 bytes, for stores without arrays."""
    return v.map(lambda x: np.asarray(x, dtype="<f4").tobytes() if len(x) else None, na_action="ignore")


@F.pandas_udf(ArrayType(FloatType()))
def decode_floats(b: pd.Series) -> pd.Series:
    """The vector behind encode_floats."""
    return b.map(lambda x: np.frombuffer(x, dtype="<f4"), na_action="ignore")
