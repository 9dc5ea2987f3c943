"""Numbers and running totals in a given order, for tables and groups larger than a task.

Rows are dealt to range partitions of the order, so a group of any size is cut into consecutive parts. Each part
is counted by itself; the totals of the parts before it, one row for each part, are added afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewloom.session import materialize

_TOTALS = {"sum": F.sum, "xor": F.bit_xor, "max": F.max, "min": F.min}
#: ``monotonically_increasing_id`` holds the partition above this bit and the row's place in it below.
_PART_BIT = 33


def _cut(df: DataFrame, keys: list[str], order: list[Column], parts: int | None) -> DataFrame:
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(k).asc_nulls_first() for k in keys] + order
    rows = df.repartitionByRange(n, *by).sortWithinPartitions(*by)
    # Written once: a range partition computed again could have other borders.
    rows = materialize(rows.withColumn("__at", F.monotonically_increasing_id()), "ranked")
    return rows.withColumn("__part", F.shiftright("__at", _PART_BIT))


def _before(totals: DataFrame, keys: list[str], names: dict[str, str]) -> DataFrame:
    """For each part but a group's first, the totals of the parts before it. One row per part and group crossing its border."""
    earlier = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    return totals.select("__part", *keys, *[_TOTALS[how](n).over(earlier).alias(n) for n, how in names.items()])


def _add(how: str, before: Column, inside: Column) -> Column:
    if how == "sum":
        return F.coalesce(before + inside, before, inside)
    if how == "xor":
        return F.coalesce(before.bitwiseXOR(inside), before, inside)
    return (F.greatest if how == "max" else F.least)(before, inside)


def numbered(df: DataFrame, order: list[Column], name: str = "position", parts: int | None = None) -> DataFrame:
    """``df`` with the place of each row in ``order`` from 1, as ``name`` (long).

    One range shuffle; no window over the table. ``order`` should end in a unique key: rows that are equal in all of
    its columns are numbered in any order and stay in one range partition. Empty tables give empty tables.
    """
    rows = _cut(df.withColumn("__all", F.lit(0)), [], order, parts)
    counts = rows.groupBy("__all", "__part").agg(F.count("*").alias("n"))
    before = _before(counts, ["__all"], {"n": "sum"}).select("__part", F.coalesce("n", F.lit(0)).alias("__n"))
    place = F.col("__at").bitwiseAND(F.lit((1 << _PART_BIT) - 1))
    return (rows.join(F.broadcast(before), "__part").withColumn(name, F.col("__n") + place + 1)
            .select(*df.columns, name))


def running(df: DataFrame, keys: list[str], order: list[Column], totals: dict[str, tuple[str, str]],
            parts: int | None = None) -> DataFrame:
    """``df`` with running totals per group of ``keys`` in ``order``, the row itself included.

    ``totals`` maps a new column to ``(column, how)``; ``how`` is ``sum``, ``xor``, ``max`` or ``min``. Null keys are a
    group, null values add nothing. A group that fills several range partitions is totalled part by part.
    """
    rows = _cut(df, keys, order, parts)
    inside = W.partitionBy("__part", *keys).orderBy("__at").rowsBetween(W.unboundedPreceding, 0)
    hows = {n: how for n, (_, how) in totals.items()}
    done = rows.select("*", *[_TOTALS[how](c).over(inside).alias(f"__in_{n}") for n, (c, how) in totals.items()])
    each = rows.groupBy("__part", *keys).agg(*[_TOTALS[how](c).alias(n) for n, (c, how) in totals.items()])
    crossing = each.withColumn("__parts", F.count("*").over(W.partitionBy(*keys))).where("__parts > 1")
    before = _before(crossing, keys, hows)
    before = before.select(F.col("__part").alias("__p"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
                           *[F.col(n).alias(f"__b_{n}") for n in totals])
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = done.join(F.broadcast(before), same, "left")
    return out.select(*df.columns, *[_add(how, F.col(f"__b_{n}"), F.col(f"__in_{n}")).alias(n) for n, how in hows.items()])
