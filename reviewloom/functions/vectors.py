"""Dense-vector expressions over ``array<float|double>`` columns, computed in double."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(a), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(a: Column) -> Column:
    """``v / max(|v|, 1e-12)``."""
    length = F.greatest(norm(a), F.lit(TINY))
    return F.transform(as_double(a), lambda x: x / length)


def cosine(a: Column, b: Column) -> Column:
    scale = F.greatest(norm(a), F.lit(TINY)) * F.greatest(norm(b), F.lit(TINY))
    return dot(a, b) / scale


def clamp0(score: Column) -> Column:
    return F.greatest(score, F.lit(0.0))


def round_score(score: Column, digits: int = 4) -> Column:
    return F.round(score, digits)


def scale(a: Column, factor: float) -> Column:
    return F.transform(as_double(a), lambda x: x * factor)


def argmax_name(scores: list[Column], names: list[str]) -> Column:
    """Name of the largest score; the first one wins a tie."""
    best = F.greatest(*scores)
    pairs = list(zip(scores, names))
    return reduce(
        lambda rest, pair: F.when(pair[0] == best, F.lit(pair[1])).otherwise(rest),
        reversed(pairs[:-1]),
        F.lit(pairs[-1][1]),
    )
