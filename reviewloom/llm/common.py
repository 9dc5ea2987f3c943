"""Byte-level word arithmetic on Arrow batches, and small helpers that several operators share.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``. Words are hashed to 64 bits for a whole
batch at once; equality of hashes stands for equality of words, shingles and lines (a false match
needs a collision among 2**64 values).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.session import materialize

#: Bytes of text that one round of array work covers; a longer text is taken by itself.
CHUNK_BYTES = 1 << 18
WORD = r"[^\x20\x09-\x0D]+"

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that are no part of a letter: letters are A-Z, a-z and everything outside ASCII.
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers, the same in every process."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                   + np.uint64(seed)) | np.uint64(1)


_BYTE = constants(256, 11)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        base = 0x9E3779B97F4A7C15
        size = max(n, 1 << 16)
        for name, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
            step = np.full(size, b, np.uint64)
            step[0] = 1
            _POWERS[name] = np.multiply.accumulate(step)
    return _POWERS["up"], _POWERS["down"]


def span_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans ``[begins, ends)`` of ``data``; a span's place does not matter."""
    out = np.empty(len(begins), np.uint64)
    at = 0
    while at < len(begins):
        low = int(begins[at])
        to = max(at + 1, int(np.searchsorted(ends, low + CHUNK_BYTES, "right")))
        part = data[low:int(ends[to - 1])]
        up, down = _powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[:len(part)], out=total[1:])
        b, e = begins[at:to] - low, ends[at:to] - low
        out[at:to] = mix((total[e] - total[b]) * down[b])
        at = to
    return out


class Texts(NamedTuple):
    """Some rows of a batch: bytes, the rows' bounds in them, and the words with their bounds by row."""

    rows: range
    data: np.ndarray
    bounds: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def spans(data: np.ndarray, gap: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs outside ``gap``; a run also ends where a row ends."""
    inside = ~gap
    begin, end = inside.copy(), inside
    if len(data):
        begin[1:] &= gap[:-1]
        end = inside.copy()
        end[:-1] &= gap[1:]
        edge = bounds[:-1][bounds[1:] > bounds[:-1]]
        begin[edge] |= inside[edge]
        edge = edge[edge > 0]
        end[edge - 1] |= inside[edge - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def texts(column: pa.Array | pa.ChunkedArray, table: np.ndarray | None = None,
          gaps: np.ndarray = IS_SPACE, latin: bool = False) -> Iterator[Texts]:
    """A string column as runs of rows of about ``CHUNK_BYTES``; null counts as empty.

    ``table`` maps every byte (for lower case) before anything else; ``latin`` also lower-cases U+00C0 to U+00DE.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pa.array(column.fill_null("") if column.null_count else column)
    wide = pa.types.is_large_string(column.type)
    _, offsets, payload = column.buffers()
    n = len(column)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1 + column.offset)[
        column.offset:].astype(np.int64) if n else np.zeros(1, np.int64)
    payload = np.frombuffer(payload, np.uint8) if payload is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        data = payload[offsets[at]:offsets[to]]
        if table is not None:
            data = table[data]
        if latin and len(data):
            upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
            data = data.copy()
            data[upper] += 0x20
        bounds = offsets[at:to + 1] - offsets[at]
        begins, ends = spans(data, gaps[data], bounds)
        yield Texts(range(at, to), data, bounds, begins, ends, np.searchsorted(begins, bounds))
        at = to


class KeyFilter:
    """A bitmap of fixed size over 64-bit keys: never denies a key it holds.

    A prefilter before an exact join. Its size does not depend on the data (2 MB by default), so it
    can be sent to every task; with more keys it only lets more through.
    """

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.mask = np.uint64(len(bits) * 8 - 1)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = mix(np.asarray(keys).astype(np.uint64, copy=False)) & self.mask
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

    @staticmethod
    def of(keys: DataFrame, column: str, log2_bits: int = 24) -> KeyFilter:
        """Built on the executors: one bitmap per task, merged by bytes of the same block."""
        size = 1 << (log2_bits - 3)
        block = 1 << 14

        def build(batches):
            bits = np.zeros(size, np.uint8)
            for batch in batches:
                got = batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
                at = mix(got.view(np.uint64)) & np.uint64(size * 8 - 1)
                np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64),
                                 np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
            for lo in range(0, size, block):
                words = bits[lo:lo + block].view(np.int64)
                if words.any():
                    used = np.flatnonzero(words)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(used + lo // 8, pa.int64()), pa.array(words[used], pa.int64())],
                        names=["at", "word"])
            give_back()

        merged = (keys.select(F.col(column).cast("long")).mapInArrow(build, "at long, word long")
                  .groupBy("at").agg(F.bit_or("word").alias("word"))).toArrow()
        bits = np.zeros(size // 8, np.int64)
        bits[merged["at"].to_numpy()] = merged["word"].to_numpy()
        return KeyFilter(bits.view(np.uint8))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows, at most ``rows`` at a time; what the allocators hold unused goes back when the task ends, as workers live on."""
    try:
        for batch in batches:
            for lo in range(0, len(batch), rows):
                yield batch.slice(lo, rows)
    finally:
        give_back()


def give_back() -> None:
    """Return free memory to the system, where the C library can; a worker that waits for its next task needs none."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def cross_fold(column: str = "doc_id"):
    """Remainder by 3 of the CRC-32 of the id as text; 1 is held out of every training."""
    return F.crc32(F.col(column).cast("string")) % 3


def sample(rows: DataFrame, most: int, *key: str) -> DataFrame:
    """About ``most`` of the rows (all, if there are fewer): those whose hash of ``key`` lies below a bound.

    Which rows are taken does not depend on partitions, and nothing is gathered to choose them.
    """
    many = rows.count()
    if many <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(*key, F.lit(29)), F.lit(1 << 40)) < int((1 << 40) * most / many))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at a table that survives lost executors."""
    return materialize(df, f"llm-{label}")


def arrow(rows: dict[str, np.ndarray | list], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[k], t) for k, t in types.items()], names=list(types))
