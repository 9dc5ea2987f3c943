"""Placement of rows on shards through a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A prime; well over 100 slots for each of some hundred shards keeps the loads within 1%.
TABLE_SIZE = 65537


def _preferences(name: str, size: int) -> tuple[int, int]:
    digest = hashlib.sha256(name.encode()).digest()
    return int.from_bytes(digest[:8], "little") % size, int.from_bytes(digest[8:16], "little") % (size - 1) + 1


def fill_table(shards: list[str], size: int = TABLE_SIZE, weights: list[int] | None = None) -> np.ndarray:
    """The shard number of every slot.

    Each shard walks the slots in its own order (``offset + j * skip`` modulo the prime size, so it meets
    every slot once) and the shards take turns claiming their next free slot, ``weights`` slots a turn.
    Removing a shard hands out its slots and moves few others.
    """
    if size < 2 or any(size % p == 0 for p in range(2, int(size ** 0.5) + 1)):
        raise ValueError("the table size must be a prime")
    if not shards or len(set(shards)) < len(shards) or len(shards) > size:
        raise ValueError("shards must be distinct names, at most one for each slot")
    weights = weights or [1] * len(shards)
    if len(weights) != len(shards) or min(weights) < 1:
        raise ValueError("weights are whole numbers from 1, one for each shard")
    walks = [_preferences(s, size) for s in shards]
    table, place, left = [-1] * size, [0] * len(shards), size
    while left:
        for k, (offset, skip) in enumerate(walks):
            for _ in range(min(weights[k], left)):
                while table[at := (offset + place[k] * skip) % size] >= 0:
                    place[k] += 1
                table[at] = k
                left -= 1
    return np.array(table, np.int32)


def assign_shards(rows: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE,
                  weights: list[int] | None = None, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """``rows`` with their slot and shard name.

    The table has exactly ``size`` entries whatever the data, so it is broadcast; a row costs one hash and
    one lookup and never moves. Rows of equal key share a shard; null keys share the slot of "null". Columns
    of ``rows`` named like the two new ones are replaced; empty input gives no rows.
    """
    names = np.array(shards, object)
    spark = rows.sparkSession
    lookup = spark.createDataFrame(
        [(i, str(s)) for i, s in enumerate(names[fill_table(shards, size, weights)])],
        f"__slot int, __shard string")
    hashed = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("null"))), F.lit(size)).cast("int")
    rows = rows.drop(*[c for c in (slot, shard) if c != key])
    return (rows.withColumn("__slot", hashed).join(F.broadcast(lookup), "__slot")
            .withColumnsRenamed({"__slot": slot, "__shard": shard}))


def write_shards(placed: DataFrame, path: str, shard: str = "shard", files: int = 8) -> None:
    """One folder per shard with up to ``files`` files each, so that no shard is one task's work."""
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in placed.columns if c != shard][:1]), F.lit(files))
    placed.repartition(F.col(shard), spread).write.partitionBy(shard).parquet(path)
