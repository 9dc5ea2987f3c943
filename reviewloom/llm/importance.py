"""Importance resampling towards a target collection by hashed n-grams.

An untrained ``tokenizers`` Regex Split over the ASCII-lowered text gives words with their offsets. Windows of one to
three offset pairs are the features; the CRC-32 of a feature's words, joined by one space, is its bucket. Bucket
counts of all documents and of the target give each bucket a gain, a document's weight is the sum of its gains, and
Gumbel noise from a hash of the id turns weights into a draw without replacement of the highest scores.

A text is tokenised once: its buckets, two bytes a feature, are written to the shared folder, from where both the
histogram and the weights read them. The histogram and the gains have one row a bucket, whatever the data.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import LOWER_ASCII, keep
from reviewloom.operators.ranks import numbered

BUCKETS = 10_000
LONGEST = 3
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters of a text that are split at a time; a piece ends at a separator.
PIECE = 1 << 19

_LOWER = LOWER_ASCII.tobytes()
_GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


def splitter():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True)


def words(split, text: bytes) -> Iterator[tuple[list[bytes], list[tuple[int, int]]]]:
    """The words of a UTF-8 text in lower case and their offsets (code points), in pieces of about ``PIECE`` characters."""
    lowered = text.translate(_LOWER).decode()
    at = 0
    while at < len(lowered):
        cut = _GAP.search(lowered, at + PIECE) if len(lowered) - at > PIECE else None
        to = cut.end() if cut else len(lowered)
        found = split.pre_tokenize_str(lowered[at:to])
        yield [w.encode() for w, _ in found], [(at + a, at + b) for _, (a, b) in found]
        at = to


def windows(split, text: str, buckets: int = BUCKETS) -> list[tuple[int, int, int]]:
    """Every feature of ``text`` as ``(start, end, bucket)``, offsets in code points: what a weight is made of."""
    said, pairs = [], []
    for some, offsets in words(split, text.encode()):
        said += some
        pairs += offsets
    return [(pairs[i][0], pairs[i + n][1], crc32(b" ".join(said[i:i + n + 1])) % buckets)
            for n in range(LONGEST) for i in range(len(said) - n)]


def _buckets(split, text: bytes, buckets: int) -> tuple[int, np.ndarray]:
    """Number of words and the buckets of all features. A longer feature continues the CRC of the one a word shorter."""
    count, parts, carried = 0, [], []
    for said, _ in words(split, text):
        count += len(said)
        run = carried + said
        spaced = [b" " + w for w in run]
        sums = list(map(crc32, run))
        for n in range(LONGEST):
            if n:
                sums = list(map(crc32, spaced[n:], sums))
            # Features that end in a word carried over were counted with the piece before.
            parts.append(np.array(sums[max(0, len(carried) - n):], np.uint32))
        carried = run[-(LONGEST - 1):]
    return count, (np.concatenate(parts) if parts else np.zeros(0, np.uint32)) % buckets


def features(rows: DataFrame, key: str, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``(key, n_words, n_features, buckets)`` of every row; ``buckets`` are unsigned 16-bit numbers, end to end.

    A null text is an empty one, without words and features. Rows stay as often as they are given.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must fit in 16 bits")
    kind = rows.schema[key].dataType

    def hashed(batches):
        split = splitter()
        for batch in batches:
            n_words, packed = [], []
            for value in batch.column(1):
                count, found = _buckets(split, value.as_buffer().to_pybytes() if value.is_valid else b"", buckets)
                n_words.append(count)
                packed.append(found.astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array([len(p) // 2 for p in packed], pa.int64()),
                 pa.array(packed, pa.binary())], names=[key, "n_words", "n_features", "buckets"])

    return rows.select(F.col(key), F.col(text)).mapInArrow(
        hashed, f"`{key}` {kind.simpleString()}, n_words long, n_features long, buckets binary")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a binary column and the bounds of its rows."""
    _, offsets, data = column.buffers()
    size = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(offsets, size, len(column) + 1 + column.offset)[column.offset:].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]].view("<u2"), (offsets - offsets[0]) // 2


def histogram(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features lie in each bucket: counted in the tasks, added up by bucket."""
    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(_flat(batch.column(0))[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["bucket", "n"])

    rows = found.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares in the target and in the source, rounded down."""
    n = len(source)
    all_source, all_target = float(source.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_source / ((s + 1.0) * all_target)))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weights(found: DataFrame, key: str, gain: np.ndarray) -> DataFrame:
    """``(key, n_words, n_features, weight)``: the sum of the gains of a row's features, 0 without any."""
    def weigh(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers, bounds = _flat(batch.column(3))
            total = np.concatenate([np.zeros(1, np.int64), np.cumsum(gain[numbers])])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(total[bounds[1:]] - total[bounds[:-1]])],
                                             names=[key, "n_words", "n_features", "weight"])

    kind = found.schema[key].dataType.simpleString()
    return found.select(key, "n_words", "n_features", "buckets").mapInArrow(
        weigh, f"`{key}` {kind}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", percent: int = 5, least_words: int = 20,
             seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """``(key, n_words, n_features, weight, score, rank)``, one row for each row of ``docs``; ``rank`` is null if not drawn.

    Of the rows with at least ``least_words`` words, ``percent`` in a hundred (rounded down) with the highest scores
    are drawn; ties go to the smaller key, then to fewer features, then to the lower weight. Null keys are hashed as empty text and
    lose ties. An empty target gives every bucket its source's share alone; empty ``docs`` give no rows.
    """
    found = keep(features(docs, key, buckets=buckets), "importance-features")
    goal = histogram(features(target.select(F.lit(0).alias("k"), "text"), "k", buckets=buckets), buckets)
    scored = weights(found, key, gains(histogram(found, buckets), goal))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))
    scored = keep(scored.withColumn("score", F.col("weight") + noise.cast("long")), "importance-scores")
    may = scored.where(F.col("n_words") >= least_words)
    draws = may.count() * percent // 100
    order = [F.col("score").desc(), F.col(key).asc_nulls_last(), F.col("n_features").asc(), F.col("weight").asc()]
    ranked = numbered(may, order, "rank").withColumn("rank", F.when(F.col("rank") <= draws, F.col("rank")))
    return ranked.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
