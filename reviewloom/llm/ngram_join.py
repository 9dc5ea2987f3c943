"""N-gram Jaccard join by PartEnum signatures.

A document's set holds its distinct 5-word shingles (fewer words: the whole sequence). Sizes are grouped
into overlapping bands such that any two sets similar enough meet in one band. In a band the feature
domain (the 64-bit shingle hashes) is partitioned into ``m`` ranges; a set's projection on a range, the
shingles it has there, stands for that partition. Sets of Jaccard similarity ``num/den`` and sizes a, b
differ in at most ``(a + b)(den - num)/(den + num)`` shingles and so in at most as many partitions:
of a set's non-empty partitions all but ``k`` agree with any partner's. Subsets of ``j`` agreeing partitions
are enumerated as signatures, from the first ``k + j`` partitions in one order for all sets (larger
projections first, as these are shared by fewer unrelated sets); two similar sets always have one in
common. A set with too few non-empty partitions for that also emits single shingles.

Signature groups are never expanded into pairs while that can be avoided. Rounds of star
edges (one edge from a set to the centre it shares most signatures with, on sets, then on components) join
what is similar; then only the pairs of a group that are still in different components are compared, in blocks, after an
exact lower bound of their difference, and only links that connect leave a block. Every link is verified on whole sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewloom.llm.common import LOWER_ASCII, KeyFilter, arrow, constants, keep, mix, sliced, span_hashes, texts
from reviewloom.operators.graph import connected_components
from reviewloom.session import discard

SHINGLE = 5
#: Jaccard threshold as a fraction.
NUM, DEN = 3, 4
#: Rounds of star edges before the remaining pairs are enumerated.
STAR_ROUNDS = 3
#: Pairs that a component proposes in a round.
PROPOSALS = 4
#: Most members of a block of a large signature group.
BLOCK = 1024
#: Pairs for each row of a block pair that are written; with more of them the rows are compared where they meet.
SPARSE = 4
#: Members from which a signature group is large, and how many large groups of a set are known to all of its rows.
LARGE, LEADS = 64, 4

_PLACE = constants(SHINGLE, 31)
_SALT = constants(8, 37)


def shingle_sets(column, table=LOWER_ASCII):
    """``(row, sorted distinct shingle hashes)`` of every text that has words."""
    for t in texts(column, table):
        words = span_hashes(t.data, t.begins, t.ends)
        rolled = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
        for j in range(SHINGLE):
            rolled += words[j:len(rolled) + j] * _PLACE[j]
        rolled = mix(rolled)
        for k, row in enumerate(t.rows):
            a, b = t.first[k], t.first[k + 1]
            if b - a >= SHINGLE:
                yield row, np.unique(rolled[a:b - SHINGLE + 1])
            elif b > a:
                whole = (words[a:b] * _PLACE[:b - a]).sum(dtype=np.uint64)
                yield row, mix(np.array([whole ^ _SALT[b - a]]))


def difference(a, b):
    """The most shingles that sets of sizes ``a`` and ``b`` may differ in and still be linked."""
    return a + b - 2 * -(-NUM * (a + b) // (NUM + DEN))


def bands(size: int):
    """``(number, low, high, subset size, partitions)`` of the one or two bands of a size."""
    number, low, high = 0, 1, 4
    while low <= size:
        if size <= high:
            if high <= 12:
                yield number, low, high, 1 + number, 64
            else:
                yield number, low, high, 1, math.ceil(high / (1.5 if high < 100 else 2.6))
        number, low = number + 1, -(-NUM * (high + 1) // DEN)
        high = 3 * low
    return


def signatures(own: np.ndarray) -> np.ndarray:
    """The signatures of one set (sorted distinct hashes)."""
    size, out = len(own), []
    mixed = mix(own ^ _SALT[6])
    for number, _, high, j, m in bands(size):
        k = (size + min(high, size * DEN // NUM)) * (DEN - NUM) // (DEN + NUM)
        part = ((own >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        count = np.diff(np.append(starts, size))
        salt = np.multiply(np.uint64(number + 1), _SALT[7:8])
        value = mix(np.add.reduceat(mixed, starts) + salt + part[starts] * _SALT[0])
        poor = len(starts) < k + j
        if not poor and len(starts) > k + j:
            order = ((np.uint64(255) - np.minimum(count, 255).astype(np.uint64)) << np.uint64(56)) | (value >> np.uint64(8))
            value = value[np.argpartition(order, k + j - 1)[:k + j]]
        if j == 2:
            a, b = np.triu_indices(len(value), 1)
            value = mix((value[a] + value[b]) ^ _SALT[1])
        out.append(value)
        if poor:
            out.append(mix(np.sort(mixed)[:k + 1] ^ (salt + _SALT[2:3])))
    return np.concatenate(out)


def sketch(own: np.ndarray) -> bytes:
    """How many shingles fall in each of ``2**s`` equal ranges of the hash, about one to a range: two bits each, 3 for more."""
    s = max(3, math.ceil(math.log2(max(1, len(own)))))
    counts = np.minimum(np.bincount((own >> np.uint64(64 - s)).astype(np.int64), minlength=1 << s), 3).astype(np.uint8)
    four = counts.reshape(-1, 4)
    return (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).tobytes()


def counts_of(drawn: bytes) -> np.ndarray:
    packed = np.frombuffer(drawn, np.uint8)
    return np.stack([packed >> k & 3 for k in (0, 2, 4, 6)], 1).ravel().astype(np.int8)


def fold(counts: np.ndarray, width: int) -> np.ndarray:
    """Counts of ``width`` wider ranges, 3 again for more. Cutting both sides at 3 never widens a difference."""
    return np.minimum(counts.reshape(width, -1).sum(1, dtype=np.int16), 3).astype(np.int8)


def may_link(a: np.ndarray, b: np.ndarray, size_a: int, size_b: int) -> bool:
    """False only if the sets differ too much: ranges of hashes that differ in their counts differ in shingles."""
    if NUM * max(size_a, size_b) > DEN * min(size_a, size_b):
        return False
    width = min(len(a), len(b))
    return int(np.abs(fold(a, width) - fold(b, width)).sum()) <= difference(size_a, size_b)


class Sketches:
    """The sketches of some rows, for a look at many pairs at once: the same verdicts as ``may_link`` gives pair by pair.

    Each count from 0 to 3 is written as so many of three bits, so two rows differ by the bits in which they differ. Sizes that
    may be linked lie within a factor of 2, so the narrower of two sketches meets the other one folded once.
    """

    def __init__(self, drawn: list[bytes]):
        self.width = np.array([len(d) for d in drawn], np.int64)
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for w in np.unique(self.width):
            own, wider = np.flatnonzero(self.width == w), np.flatnonzero(self.width == 2 * w)
            four = np.frombuffer(b"".join(drawn[i] for i in own), np.uint8).reshape(-1, w)
            if len(wider):
                twice = _halved(np.frombuffer(b"".join(drawn[i] for i in wider), np.uint8).reshape(-1, 2 * w))
                four = np.concatenate([four, twice])
            place = np.zeros(len(drawn), np.int64)
            place[np.concatenate([own, wider])] = np.arange(len(four))
            self.at[int(w)] = _unary(four), place

    def allowed(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """For each pair of rows, whether their sets may be linked."""
        na, nb = size[a], size[b]
        ok = NUM * np.maximum(na, nb) <= DEN * np.minimum(na, nb)
        width, bound = np.minimum(self.width[a], self.width[b]), difference(na, nb)
        for w in np.unique(width[ok]):
            bits, place = self.at[int(w)]
            pairs = np.flatnonzero(ok & (width == w))
            step = max(1, (1 << 20) // int(w))
            for lo in range(0, len(pairs), step):
                some = pairs[lo:lo + step]
                apart = np.bitwise_count(bits[place[a[some]]] ^ bits[place[b[some]]]).sum(axis=1, dtype=np.int64)
                ok[some] = apart <= bound[some]
        return ok


def _halved(packed: np.ndarray) -> np.ndarray:
    """Sketches of half as many ranges: sums of two neighbours, 3 for more."""
    low, high = (packed >> k & 0x33 for k in (0, 2))
    both = low + high  # up to 6 in each half of a byte
    two = [np.minimum(both >> k & 15, 3) for k in (0, 4)]
    nibble = two[0] | two[1] << 2
    return nibble[:, ::2] | nibble[:, 1::2] << 4


def _unary(packed: np.ndarray) -> np.ndarray:
    """Rows of words that hold for each two-bit count as many set bits as it says."""
    one, three = (packed | packed >> 1) & 0x55, packed & packed >> 1 & 0x55
    out = np.ascontiguousarray(np.concatenate([one | packed & 0xAA, three], axis=1))
    return out.view(np.uint64 if out.shape[1] % 8 == 0 else np.uint32)


def _read_sets(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``(id, row, n, digest, sketch, sigs)`` per input row; the last two only once per set and task."""
    kind = dict(documents.dtypes)[id_column]

    def run(batches):
        seen = set()
        for batch in sliced(batches):
            rows = len(batch)
            n, digest = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            sketches, sigs = [None] * rows, [None] * rows
            for row, own in shingle_sets(batch.column(2)):
                n[row] = len(own)
                key = int(mix(np.array([mix(own ^ _SALT[3]).sum(dtype=np.uint64) + np.uint64(len(own))])).view(np.int64)[0])
                digest[row] = key
                if key not in seen:
                    seen.add(key)
                    sketches[row], sigs[row] = sketch(own), signatures(own).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n), pa.array(digest, mask=n == 0),
                 pa.array(sketches, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))],
                names=["id", "row", "n", "digest", "sketch", "sigs"])

    return documents.select(
        F.col(id_column).alias("id"), _row_key(id_column, text_column).alias("row"),
        F.col(text_column).alias("text")).mapInArrow(
        run, f"id {kind}, row long, n long, digest long, sketch binary, sigs array<long>")


def _row_key(id_column: str, text_column: str):
    return F.xxhash64(F.col(id_column), F.col(text_column))


def _shared(batches):
    """From rows sorted by ``(sig, digest)``: each distinct row of a signature that two sets have, with the smallest
    digest of its signature. Holds one batch and one row."""
    held = None  # sig, digest, its signature's first digest, is it known to be shared
    for batch in batches:
        sig, dig = (batch.column(k).to_numpy() for k in (0, 1))
        known = np.zeros(len(sig), bool)
        if held is not None:
            sig, dig = np.append(held[0], sig), np.append(held[1], dig)
            known = np.append(held[3], known)
        new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (dig[1:] != dig[:-1])])
        sig, dig, known = sig[new], dig[new], known[new]
        if not len(sig):
            continue
        starts = np.concatenate([[True], sig[1:] != sig[:-1]])
        centre = dig[starts][np.cumsum(starts) - 1]
        if held is not None:
            centre[sig == held[0]] = held[2]
        ok = known | ~starts
        ok[:-1] |= ~starts[1:]
        held = (sig[-1], dig[-1], centre[-1], bool(ok[-1]))
        out = ok.copy()
        out[-1] = False
        if out.any():
            yield arrow({"sig": sig[out], "digest": dig[out], "centre": centre[out]},
                        {"sig": pa.int64(), "digest": pa.int64(), "centre": pa.int64()})
    if held is not None and held[3]:
        yield arrow({"sig": [held[0]], "digest": [held[1]], "centre": [held[2]]},
                    {"sig": pa.int64(), "digest": pa.int64(), "centre": pa.int64()})


def _sketch_filter(batches):
    for batch in sliced(batches):
        a, b, na, nb = (batch.column(k).to_numpy() for k in range(4))
        drawn, here = Sketches(batch.column(4).to_pylist() + batch.column(5).to_pylist()), np.arange(len(a))
        ok = drawn.allowed(here, here + len(a), np.concatenate([na, nb]))
        yield arrow({"a": a[ok], "b": b[ok]}, {"a": pa.int64(), "b": pa.int64()})


def _sets(batches):
    """``(digest, shingles)`` of texts that have words; sorted distinct hashes."""
    for batch in sliced(batches):
        rows, sets = [], []
        for row, own in shingle_sets(batch.column(1)):
            rows.append(row)
            sets.append(own.view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(sets, pa.list_(pa.int64()))],
                                         names=["digest", "shingles"])


def linked(s: np.ndarray, t: np.ndarray) -> bool:
    """Whether two sets (distinct hashes) are as similar as asked for."""
    if NUM * max(len(s), len(t)) > DEN * min(len(s), len(t)):
        return False
    both = np.sort(np.concatenate([s, t]), kind="stable")
    return (NUM + DEN) * int((both[1:] == both[:-1]).sum()) >= NUM * (len(s) + len(t))


def _lists(column: pa.Array) -> list[np.ndarray]:
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
    return [flat[a:b] for a, b in zip(ends, ends[1:])]


def _verify(batches):
    """Links among ``(a, b, shingles of a, shingles of b)``."""
    for batch in sliced(batches, 256):
        ok = np.array([linked(s, t) for s, t in zip(_lists(batch.column(2)), _lists(batch.column(3)))], bool)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok)], names=["a", "b", "linked"])


class _Join:
    def __init__(self, documents: DataFrame, id_column: str, text_column: str):
        self.documents, self.id, self.text = documents, id_column, text_column
        self.sets = keep(_read_sets(documents, id_column, text_column), "join-sets")
        #: One row a set: its size, sketch, and the row that its text is read from.
        self.about = (self.sets.where("digest IS NOT NULL").groupBy("digest").agg(
            F.min("row").alias("row"), F.max("n").alias("n"), F.max("sketch").alias("sketch")))

    def groups(self) -> DataFrame:
        rows = self.sets.where("sigs IS NOT NULL").select(F.explode("sigs").alias("sig"), "digest")
        return keep(rows.repartition("sig").sortWithinPartitions("sig", "digest").mapInArrow(
            _shared, "sig long, digest long, centre long"), "join-groups")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """``(a, b, linked)`` for distinct pairs of digests that the sketches do not rule out."""
        about = self.about
        met = (pairs.join(about.select(F.col("digest").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
               .join(about.select(F.col("digest").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
               .select("a", "b", "na", "nb", "sa", "sb"))
        pairs = keep(met.mapInArrow(_sketch_filter, "a long, b long"), "join-pairs")
        sets = self.sets_of(pairs.select(F.col("a").alias("digest")).union(pairs.select("b")).distinct())
        seen = (pairs.join(sets.select(F.col("digest").alias("a"), F.col("shingles").alias("sa")), "a")
                .join(sets.select(F.col("digest").alias("b"), F.col("shingles").alias("sb")), "b")
                .select("a", "b", "sa", "sb"))
        verified = keep(seen.mapInArrow(_verify, "a long, b long, linked boolean"), "join-verified")
        discard(pairs)
        discard(sets)
        return verified

    def sets_of(self, digests: DataFrame) -> DataFrame:
        """``(digest, shingles)`` of some sets, each read once from the row that stands for it."""
        wanted = keep(self.about.join(digests, "digest").select("digest", "row"), "join-wanted")
        passes = KeyFilter.of(wanted, "row")

        @F.pandas_udf("boolean")
        def named(row):
            import pandas as pd

            return pd.Series(passes(row.to_numpy().view(np.uint64)))

        rows = self.documents.select(_row_key(self.id, self.text).alias("row"), F.col(self.text).alias("text"))
        full = rows.where(named("row")).join(wanted, "row").select("digest", "text")
        # A repeated row gives its set more than once.
        sets = keep(full.mapInArrow(_sets, "digest long, shingles array<long>").dropDuplicates(["digest"]), "join-shingles")
        discard(wanted)
        return sets


def _rooted(rows: DataFrame, roots: DataFrame, digest: str, root: str) -> DataFrame:
    return rows.join(roots.select(F.col("node").alias(digest), F.col("root").alias(root)), digest, "left").withColumn(
        root, F.coalesce(root, digest))


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (node, root) after more links (a, b): components of the components, so only what is new is worked on."""
    ends = _rooted(_rooted(links.select("a", "b"), roots, "a", "src"), roots, "b", "dst").select("src", "dst")
    over = keep(connected_components(ends), "join-over")
    moved = _rooted(roots.select("node", F.col("root").alias("was")), over, "was", "root").select("node", "root")
    return keep(moved.unionByName(over.join(roots, "node", "left_anti")), "join-roots")


def _open_groups(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of the signatures whose sets are not all in one component, with component and the number of rows."""
    rooted = _rooted(groups, roots, "digest", "root")
    counts = rooted.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members"))
    return rooted.join(counts.where("low <> high"), "sig")


def _first_pairs(groups: DataFrame) -> DataFrame:
    """What ``_stars`` gives while every set is a component of its own: the ``PROPOSALS`` smallest digests of its signatures
    that a set shares most signatures with."""
    shared = groups.where("digest <> centre").repartition("digest").groupBy("digest", "centre").agg(F.count("*").alias("shared"))
    order = W.partitionBy("digest").orderBy(F.desc("shared"), "centre")
    return shared.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PROPOSALS).select(
        F.col("centre").alias("a"), F.col("digest").alias("b"))


def _stars(opened: DataFrame, tried: DataFrame | None, turn: int) -> DataFrame:
    """Up to ``PROPOSALS`` untried pairs for every component that is not the largest in one of its signatures: the pairs
    with up to three members of the largest one that share most signatures."""
    sizes = opened.groupBy("sig", "root").agg(F.count("*").alias("many"))
    largest = sizes.groupBy("sig").agg(F.max(F.struct("many", -F.col("root"))).alias("top")).select(
        "sig", (-F.col("top.col2")).alias("hub_root"))
    rows = opened.select("sig", "digest", "root").join(largest, "sig")
    mixed = F.struct(F.xxhash64("digest", F.lit(turn)).alias("h"), "digest")
    hubs = rows.where("root = hub_root").groupBy("sig").agg(F.array_distinct(F.array(
        F.min("digest"), F.min(mixed)["digest"], F.max(mixed)["digest"])).alias("hubs"))
    met = rows.where("root <> hub_root").join(hubs, "sig").select("root", "digest", F.explode("hubs").alias("hub"))
    pairs = met.groupBy("root", "digest", "hub").agg(F.count("*").alias("shared")).select(
        "root", F.least("digest", "hub").alias("a"), F.greatest("digest", "hub").alias("b"), "shared")
    order = W.partitionBy("root").orderBy(F.desc("shared"), "a", "b")

    def best(rows: DataFrame, most: int) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("rank")

    if tried is None:
        return best(pairs, PROPOSALS).select("a", "b").distinct()
    # A component has tried few pairs in each turn, so only as many more are looked up; what a large group shares is not.
    some = best(pairs, PROPOSALS * (turn + 1)).join(tried.select("a", "b"), ["a", "b"], "left_anti")
    return best(some, PROPOSALS).select("a", "b").distinct()


BLOCK_KEY = ["sig", "x", "y"]
BLOCK_ROW = [*BLOCK_KEY, "block", "digest", "root", "n"]


def _by_block(work):
    """``work(columns, cuts)`` for rows of whole block pairs, which end at the cuts, from rows sorted by block key; a key's rows are few."""
    def run(batches):
        held = None
        for batch in sliced(batches):
            rows = {c: batch.column(c).to_numpy() for c in BLOCK_ROW}
            rows["sketch"] = batch.column("sketch").to_pylist()
            if "shingles" in batch.schema.names:
                rows["shingles"] = _lists(batch.column("shingles"))
            if "lead" in batch.schema.names:
                rows["lead"] = batch.column("lead").flatten().to_numpy().reshape(-1, LEADS)
            if held is not None:
                rows = {c: np.concatenate([held[c], v]) if isinstance(v, np.ndarray) else held[c] + v for c, v in rows.items()}
            key = np.column_stack([rows[c] for c in BLOCK_KEY])
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1)]
            if len(cuts) > 1:
                yield from work(rows, cuts)
            held = {c: v[cuts[-1]:] for c, v in rows.items()}
        if held is not None and len(held["sig"]):
            yield from work(held, [0, len(held["sig"])])

    return run


class _Block:
    """The rows of a block pair: which of them the sketches let be linked."""

    def __init__(self, rows: dict, lo: int, hi: int):
        self.size, self.block, self.root, self.digest = (rows[c][lo:hi] for c in ("n", "block", "root", "digest"))
        self.two = rows["x"][lo] != rows["y"][lo]
        self.drawn = [counts_of(s) for s in rows["sketch"][lo:hi]]
        # All at the coarsest resolution among them, for a look at many at once.
        width = min(map(len, self.drawn))
        self.coarse = np.array([fold(d, width) for d in self.drawn])

    def later(self, i: int, part: np.ndarray) -> np.ndarray:
        """Rows after ``i`` in another part (and block, where there are two) that the coarse sketches do not rule out."""
        rest = np.arange(i + 1, len(self.size))
        ok = (part[rest] != part[i]) & (NUM * np.maximum(self.size[rest], self.size[i]) <= DEN * np.minimum(self.size[rest], self.size[i]))
        if self.two:
            ok &= self.block[rest] != self.block[i]
        rest = rest[ok]
        apart = np.abs(self.coarse[rest] - self.coarse[i]).sum(axis=1)
        return rest[apart <= difference(self.size[i], self.size[rest])]

    def may(self, i: int, k: int) -> bool:
        return may_link(self.drawn[i], self.drawn[k], int(self.size[i]), int(self.size[k]))


def _met_before(lead: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair of rows, whether both have a signature that comes before the one where they meet here."""
    return ((lead[a][:, :, None] == lead[b][:, None, :]) & (lead[a] != 0)[:, :, None]).any(axis=(1, 2))


def _open_pairs(rows, cuts):
    """The pairs of a block pair that the sketches allow, if they are few beside its rows; else the rows, to be compared where they meet.
    Pairs that have met before are no pairs of this block."""
    many = np.diff(cuts)
    key = np.repeat(np.arange(len(many)), many)
    root, block, size = (rows[c][:cuts[-1]] for c in ("root", "block", "n"))
    two = rows["x"][:cuts[-1]] != rows["y"][:cuts[-1]]
    drawn, room, found, lead = Sketches(rows["sketch"][:cuts[-1]]), SPARSE * many, [], rows.get("lead")
    here = np.arange(cuts[-1])
    # Each row beside the next one of its key, then the one after that, and so on; keys with too many pairs leave.
    for step in range(1, many.max()):
        here = here[here + step < cuts[-1]]
        here = here[(key[here] == key[here + step]) & (room[key[here]] >= 0)]
        if not len(here):
            break
        ok = (root[here] != root[here + step]) & (~two[here] | (block[here] != block[here + step]))
        pair = here[ok]
        if lead is not None:
            # Most pairs of near copies are known by their first large group; the others are looked at only if they are allowed.
            pair = pair[(lead[pair, 0] == 0) | (lead[pair, 0] != lead[pair + step, 0])]
        pair = pair[drawn.allowed(pair, pair + step, size)]
        if lead is not None:
            pair = pair[~_met_before(lead, pair, pair + step)]
        room -= np.bincount(key[pair], minlength=len(many))
        found.append(np.column_stack([pair, pair + step]))
    pairs = np.concatenate([np.zeros((0, 2), np.int64), *found])
    pairs = pairs[room[key[pairs[:, 0]]] >= 0]
    if len(pairs):
        ends = np.sort(rows["digest"][pairs], axis=1)
        blank = {c: pa.nulls(len(pairs), pa.int64()) for c in BLOCK_ROW} | {"sketch": pa.nulls(len(pairs), pa.binary())}
        yield pa.RecordBatch.from_pydict({"a": pa.array(ends[:, 0]), "b": pa.array(ends[:, 1])} | blank)
    dense = np.flatnonzero(room[key] < 0)
    if len(dense):
        own = {c: pa.array(rows[c][dense]) for c in BLOCK_ROW} | {"sketch": pa.array([rows["sketch"][i] for i in dense], pa.binary())}
        yield pa.RecordBatch.from_pydict({"a": pa.nulls(len(dense), pa.int64()), "b": pa.nulls(len(dense), pa.int64())} | own)


def _block_links(rows, cuts):
    """Links of a block pair that join what is not joined yet in it: fewer than its rows, however many pairs are similar."""
    links = []
    for lo, hi in zip(cuts, cuts[1:]):
        if hi - lo < 2:
            continue
        block, sets = _Block(rows, lo, hi), rows["shingles"][lo:hi]
        part = np.unique(block.root, return_inverse=True)[1]
        for i in range(hi - lo - 1):
            for k in block.later(i, part):
                if part[k] != part[i] and block.may(i, k) and linked(sets[i], sets[k]):
                    part[part == part[k]] = part[i]
                    links.append((lo + i, lo + k))
    if links:
        ends = np.sort(rows["digest"][np.array(links)], axis=1)
        yield arrow({"a": ends[:, 0], "b": ends[:, 1]}, {"a": pa.int64(), "b": pa.int64()})


def _in_blocks(rows: DataFrame, most: int) -> DataFrame:
    """Rows of groups (sig, members, digest and more), each once for every pair of blocks of its group that it belongs to."""
    return (rows.withColumn("blocks", F.ceil(F.col("members") / most))
            .withColumn("block", F.pmod(F.xxhash64("digest"), "blocks"))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            .withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other")))


def _with_leads(opened: DataFrame) -> DataFrame:
    """``opened`` with ``lead``: which of the first large groups of a row's set come before the row's own, 0 for none.

    Large groups come first, by signature. A pair is compared in the first group that both sets have, and not again where
    the leads of both show an earlier one: near copies share most of their signatures.
    """
    first = F.slice(F.array_sort(F.collect_set("sig")), 1, LEADS)
    leads = opened.where((F.col("members") >= LARGE) & (F.col("sig") != 0)).groupBy("digest").agg(first.alias("lead"))
    own = F.transform("lead", lambda s: F.when((F.col("members") < LARGE) | (s < F.col("sig")), s).otherwise(0))
    filled = F.slice(F.concat(F.coalesce(own, F.array().cast("array<long>")), F.array_repeat(F.lit(0).cast("long"), LEADS)), 1, LEADS)
    return opened.join(leads, "digest", "left").withColumn("lead", filled)


def _remaining(opened: DataFrame, join: _Join, tried: DataFrame | None) -> DataFrame:
    """Links (a, b) enough to connect what is similar in open groups and not connected yet.

    A group of many rows is dealt into blocks, pair by pair of blocks, and a pair of sets is compared in one group. Where the sketches allow
    few pairs, at most ``SPARSE`` for each row of the block pair, these are verified one by one. Where they allow more, as among many near
    copies, the rows meet again with their sets and give only links that connect. So what is written grows with the rows, not with their pairs.
    """
    def dealt(df: DataFrame, *more: str) -> DataFrame:
        return df.select(*BLOCK_ROW, "sketch", *more).repartition(*BLOCK_KEY).sortWithinPartitions(*BLOCK_KEY, "digest")

    kinds = ", ".join(f"{c} long" for c in ["a", "b", *BLOCK_ROW]) + ", sketch binary"
    rows = _in_blocks(_with_leads(opened), BLOCK).join(join.about.select("digest", "n", "sketch"), "digest")
    found = keep(dealt(rows, "lead").mapInArrow(_by_block(_open_pairs), kinds), "join-remaining")
    pairs = found.where("a IS NOT NULL").select("a", "b").distinct()
    if tried is not None:
        pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
    links = join.verify(pairs).where("linked").select("a", "b")
    dense = found.where("sig IS NOT NULL").select("sig", "digest", "root", "n", "sketch").distinct()
    if dense.isEmpty():
        return links
    # These are few groups, so they are dealt anew, into smaller blocks.
    dense = dense.join(dense.groupBy("sig").agg(F.count("*").alias("members")), "sig")
    sets = join.sets_of(dense.select("digest").distinct())
    return links.unionByName(keep(dealt(_in_blocks(dense, max(1, BLOCK // 4)).join(sets, "digest"), "shingles").mapInArrow(
        _by_block(_block_links), "a long, b long"), "join-links"))


def similar_components(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, row, n_shingles, component, keeper)``, one row per input row.

    ``component`` is the smallest id reachable by links, the row's own included; ``keeper`` marks the rows of one
    document per component (``row`` is a hash of id and text, the same for repeated rows). Null and empty texts have no
    shingles and are linked with nothing. Equal sets are linked. Rows with a null id take part; they are the smallest of
    nothing, and a component of such rows alone has a null id. Other columns are left out. Empty input: no rows.
    """
    join = _Join(documents, id_column, text_column)
    groups = join.groups()
    roots = documents.sparkSession.createDataFrame([], "node long, root long")
    tried = None
    for turn in range(STAR_ROUNDS + 1):
        if turn or not STAR_ROUNDS:
            # Components only grow, so what is open now was open before.
            opened = keep(_open_groups(groups, roots), "join-open")
            discard(groups)
            groups = opened.select("sig", "digest")
        if turn < STAR_ROUNDS:
            seen = join.verify(_stars(opened, tried, turn) if turn else _first_pairs(groups))
            tried = seen if tried is None else tried.unionByName(seen)
            links = seen.where("linked")
        else:
            links = _remaining(opened, join, tried)
        roots = _joined(roots, links)
    rooted = _rooted(join.sets.where("digest IS NOT NULL").select("id", "row", "n", "digest"), roots, "digest", "root")
    best = rooted.groupBy("root").agg(
        F.min("id").alias("component"),
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"))
    linked = rooted.join(best, "root").select(
        "id", "row", F.col("n").alias("n_shingles"), "component", (F.col("row") == F.col("first.row")).alias("keeper"))
    alone = join.sets.where("digest IS NULL").select(
        "id", "row", F.col("n").alias("n_shingles"), F.col("id").alias("component"), F.lit(True).alias("keeper"))
    return linked.unionByName(alone)
