"""Equi-joins in which null is a key like any other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on ``keys`` by ``<=>``; the keys are kept once."""
    renamed = right.select(*[F.col(k).alias(f"__right_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"__right_{k}"))
        same = one if same is None else same & one
    return left.join(renamed, same, how).drop(*[f"__right_{k}" for k in keys])
