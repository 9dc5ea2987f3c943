"""Packing of tokenised documents into sequences: bin completion with branch and bound over lengths."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewloom.llm.common import keep, sliced

CAPACITY = 4096
END_ID = 1
#: Ranges the pieces of one length are numbered in, so that a frequent length is not one task's work.
DEALT = 64
#: Steps of the search (fillings tried, and items tried for them) once a first packing is known; then the best so far is taken.
NODES = 200_000
#: Distinct words whose ids a task remembers.
REMEMBERED = 200_000


# ---- tokens

class Words(dict):
    """Ids (little-endian unsigned 32-bit) by word, and of whole texts word by word.

    Sound for tokenizers whose pre-tokenizer never joins across ASCII white space and drops it: the ids of a text are those
    of its words one after another. A word is put through the tokenizer itself when it is met, unless it is a Latin
    letter run in another case or before punctuation, for a tokenizer that ignores case and parts letters from
    punctuation. A lower-case Latin letter run is handed to the tokenizer's model at once, where the steps before the model do
    nothing to it. ``REMEMBERED`` words are remembered, the first met, which hold the frequent ones, for as long as the task runs.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        # Letters parted from punctuation, case ignored: checked on the tokenizer rather than assumed.
        parts = self.tokenizer.encode_batch(["Ab", "ab", "ab,.", ",."], add_special_tokens=False)
        self.simple = parts[0].ids == parts[1].ids and parts[2].ids == parts[1].ids + parts[3].ids
        # Bytes as the letters that a byte-level model knows them by: printable ones are their own, the others follow from 256 on.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        self.letters = {b: chr(b if b in own else next(rest)) for b in range(256)}
        self.model = self.tokenizer.model
        # Checked on the tokenizer as well, on words of one and several parts and letters of one and two bytes.
        some = ["a", "the", "through", "hyperbolically", "xqzvwk", "été", "straße", "größenordnungsmäßig", "ñandú", "ÿ", "ª", "µ"]
        self.direct = all(self._modelled(w) == self._encoded(w) for w in some)

    def _encoded(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _modelled(self, word: str) -> bytes:
        if not word.isascii():
            word = "".join(map(self.letters.__getitem__, word.encode()))
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _encode(self, word: str) -> bytes:
        if self.direct and word.isalpha() and word.islower() and (word.isascii() or all("\xdf" <= c <= "\xff" for c in word if c > "z")):
            return self._modelled(word)
        return self._encoded(word)

    def __missing__(self, word: str) -> bytes:
        out = self._composed(word)
        if out is None:
            out = self._encode(word)
        if len(self) < REMEMBERED:
            self[word] = out
        return out

    def _composed(self, word: str) -> bytes | None:
        core = word.rstrip(".,;:!?")
        plain = core.lower()
        if not self.simple or plain == word or not core.isalpha():
            return None
        try:  # in Latin-1 nothing composes, and letters and their cases are the same to every library
            core.encode("latin-1")
        except UnicodeEncodeError:
            return None
        tail = word[len(core):]
        return self[plain] + self[tail] if tail else self[plain]

    def ids(self, text: str) -> bytes:
        for space in "\t\n\x0b\x0c\r":
            text = text.replace(space, " ")
        return b"".join(map(self.__getitem__, text.split(" ")))


def cut_pieces(documents: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text",
               capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``(id, row, piece, start, length, ids_crc32[, ids])``: every document's ids and one end mark, cut only if longer
    than a sequence. Null text is empty: the mark alone. ``row`` is a hash of id and text."""
    kind = dict(documents.dtypes)[id_column]

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = Words(tokenizer)
        mark = np.array([END_ID], "<u4").tobytes()
        for part in sliced(batches, 512):
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            for k, text in enumerate(part.column(2)):
                own = encode.ids(text.as_py() or "") + mark
                for number, first in enumerate(range(0, len(own), 4 * capacity)):
                    cut = own[first:first + 4 * capacity]
                    at.append(k)
                    piece.append(number)
                    start.append(first // 4)
                    length.append(len(cut) // 4)
                    crc.append(zlib.crc32(cut))
                    if with_ids:
                        ids.append(np.frombuffer(cut, "<u4").astype(np.int32))
            columns = [part.column(0).take(pa.array(at, pa.int64())), part.column(1).take(pa.array(at, pa.int64())),
                       pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                       pa.array(crc, pa.int64())]
            names = ["id", "row", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"id {kind}, row long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return documents.select(F.col(id_column).alias("id"), F.xxhash64(id_column, text_column).alias("row"),
                            F.col(text_column).alias("text")).mapInArrow(run, schema)


# ---- bins

class _Counts:
    """How many items of each length are left; a bit mask of the lengths finds the largest below a bound."""

    def __init__(self, counts: np.ndarray):
        self.n = [int(c) for c in counts]
        self.mask = sum(1 << k for k, c in enumerate(self.n) if c)

    def at_most(self, bound: int) -> int:
        """The largest length left that is at most ``bound``; 0 if there is none."""
        return max(0, (self.mask & ((2 << bound) - 1)).bit_length() - 1) if bound > 0 else 0

    def add(self, length: int, many: int) -> None:
        self.n[length] += many
        if self.n[length]:
            self.mask |= 1 << length
        else:
            self.mask &= ~(1 << length)


def _complete(counts: _Counts, filling: list[int], capacity: int) -> list[int]:
    """``filling`` and then the largest item left that fits, again and again; ``counts`` is as before afterwards."""
    filling = list(filling)
    for x in filling:
        counts.add(x, -1)
    room = capacity - sum(filling)
    while length := counts.at_most(room):
        many = min(room // length, counts.n[length])
        filling += [length] * many
        counts.add(length, -many)
        room -= many * length
    for x in filling:
        counts.add(x, 1)
    return filling


class _Budget:
    """Steps that may still be taken."""

    def __init__(self, steps: int):
        self.left = steps

    def spend(self) -> bool:
        self.left -= 1
        return self.left >= 0


def _rests(counts: _Counts, room: int, longest: int, least: int, budget: _Budget) -> Iterator[list[int]]:
    """Sets of items left, none longer than ``longest``, that fill ``room`` but for at most ``least`` and leave no item that still fits."""
    length = counts.at_most(min(room, longest))
    if not length and room <= least and not counts.at_most(room):
        yield []
    while length:
        for many in range(min(room // length, counts.n[length]), 0, -1):
            if not budget.spend():
                return
            counts.add(length, -many)
            for rest in _rests(counts, room - many * length, length - 1, least, budget):
                yield [length] * many + rest
            counts.add(length, many)
        length = counts.at_most(length - 1)


def _fillings(counts: _Counts, first: int, capacity: int, slack: int, but: list[int], budget: _Budget) -> Iterator[list[int]]:
    """Undominated fillings around ``first`` that waste at most ``slack``, one at a time, but for one that was tried.

    ``counts`` is this search's own. Waste is let up in steps (0, 1, 3, 7, ..), so a filling of one step comes before those of later
    ones. A filling is dominated by an earlier one of as many items that are at least as long each.
    """
    counts.add(first, -1)
    kept = [but]
    below, limit = -1, 0
    while below < slack and budget.left > 0:
        limit = min(limit, slack)
        for rest in _rests(counts, capacity - first, first, limit, budget):
            filling = [first, *rest]
            if capacity - sum(filling) > below and not any(
                    len(g) == len(filling) and all(x >= y for x, y in zip(g, filling)) for g in kept):
                kept.append(filling)
                yield filling
        below, limit = limit, 2 * limit + 1


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """The larger of two counts: all tokens over the capacity; and for each threshold t, items too long to
    share a sequence plus what the rest of at least t needs beyond the room they leave."""
    n = counts.astype(np.int64)
    lengths = np.arange(len(n))
    total = int((n * lengths).sum())
    best = -(-total // capacity)
    many, mass = np.cumsum(n), np.cumsum(n * lengths)
    for t in [x for x in np.flatnonzero(n) if x <= capacity // 2]:
        big = int(many[-1] - many[capacity - t])
        middle = int(many[capacity - t] - many[capacity // 2])
        mid_mass = int(mass[capacity - t] - mass[capacity // 2])
        small = int(mass[capacity // 2] - (mass[t - 1] if t else 0))
        best = max(best, big + middle + max(0, -(-(small - (middle * capacity - mid_mass)) // capacity)))
    return best


def bin_completion(counts: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[list[int], int]]:
    """``(lengths of a sequence, how many such sequences)`` for the items counted by length.

    Branch and bound: the sequence of the largest item left is filled in each undominated way, used as often as the
    counts allow; a branch ends when its sequences and the waste bound of what is left cannot beat the
    incumbent. The first descent is the best fit, so the first solution is best-fit decreasing; it is free. From then on
    the last levels are undone first, their fillings come one at a time with the least waste first, and the search ends at the lower
    bound or after ``nodes`` steps, with the best packing found. The steps do not depend on the number of items.
    """
    counts = np.asarray(counts, np.int64)
    total = int((counts * np.arange(len(counts))).sum())
    floor = lower_bound(counts, capacity)
    state = _Counts(counts.copy())
    best: list[tuple[list[int], int]] = []
    best_bins: float = np.inf
    budget = _Budget(nodes)
    #: Per level: its filling and how often it is used, the length it is built around, and its other fillings once asked for.
    stack: list[list] = []
    bins, left = 0, total

    def use(level: list, filling: list[int]) -> None:
        nonlocal bins, left
        need: dict[int, int] = {}
        for x in filling:
            need[x] = need.get(x, 0) + 1
        t = min(state.n[x] // c for x, c in need.items())
        for x in filling:
            state.add(x, -t)
        level[0], level[1] = filling, t
        bins, left = bins + t, left - t * sum(filling)

    def undo(level: list) -> None:
        nonlocal bins, left
        for x in level[0]:
            state.add(x, level[1])
        bins, left = bins - level[1], left + level[1] * sum(level[0])

    while True:
        first = state.at_most(capacity)
        if not first:
            if bins < best_bins:
                best, best_bins = [(f, t) for f, t, _, _ in stack], bins
        elif bins + -(-left // capacity) < best_bins and (not best or budget.spend()):
            level = [None, 0, first, None]
            use(level, _complete(state, [first], capacity))
            stack.append(level)
            continue
        if best_bins <= floor:
            return best
        # Back to the last level that has another filling.
        while stack:
            level = stack[-1]
            undo(level)
            if budget.left <= 0:
                return best
            if level[3] is None:
                # What a better packing may waste in all, from this level on.
                slack = int(best_bins - 1 - bins) * capacity - left
                level[3] = _fillings(_Counts(state.n), level[2], capacity, min(slack, capacity - level[2]), level[0], budget) if slack >= 0 else iter(())
            other = next(level[3], None)
            if other is not None:
                use(level, other)
                break
            stack.pop()
        if not stack:
            return best


class Layout:
    """Where the r-th piece of a length goes: arrays sorted by (length, first rank)."""

    def __init__(self, bins: list[tuple[list[int], int]], limit: int):
        used: dict[int, int] = {}
        rows = []
        sequence = 0
        for filling, times in bins:
            offset = 0
            for length in sorted(set(filling), reverse=True):
                many = filling.count(length)
                rows.append((length, used.get(length, 0), many, sequence, offset))
                used[length] = used.get(length, 0) + many * times
                offset += many * length
            sequence += times
        rows.sort()
        cols = np.array(rows, np.int64).reshape(-1, 5).T
        self.key = cols[0] * (1 << 48) + cols[1]
        self.rank, self.many, self.sequence, self.offset = cols[1:]
        self.sequences = sequence

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.key, length * (1 << 48) + rank, "right") - 1
        inside = rank - self.rank[k]
        return self.sequence[k] + inside // self.many[k], self.offset[k] + inside % self.many[k] * length


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """``pieces`` (``id, row, piece, start, length, ids_crc32``; written, so that reruns agree) with ``sequence_id`` and ``offset``.

    Only the counts of pieces by length, at most ``capacity`` rows, come to the driver. A filling is used as often as the
    counts allow, which at least halves a length's count, so the layout that is sent to the tasks stays small. Pieces of a length are interchangeable; they are numbered within 64
    ranges by hash, which follow one another, so a length that a third of all pieces share is 64 tasks' work.
    """
    dealt = pieces.withColumn("dealt", F.pmod(F.xxhash64("row", "piece", "start"), F.lit(DEALT)))
    by_range = dealt.groupBy("length", "dealt").agg(F.count("*").alias("many"))
    by_range = keep(by_range, "pack-counts")
    counted = by_range.groupBy("length").agg(F.sum("many").alias("many")).collect()
    counts = np.zeros(capacity + 1, np.int64)
    for r in counted:
        counts[r["length"]] = r["many"]
    layout = Layout(bin_completion(counts, capacity, nodes), capacity)
    before = by_range.withColumn("before", F.coalesce(F.sum("many").over(
        W.partitionBy("length").orderBy("dealt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("many")
    ranked = dealt.join(before, ["length", "dealt"]).withColumn("rank", F.col("before") - 1 + F.row_number().over(
        W.partitionBy("length", "dealt").orderBy("row", "piece")))

    columns = pieces.columns

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = layout(length, rank)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns], pa.array(sequence), pa.array(offset)],
                names=[*columns, "sequence_id", "offset"])

    fields = ", ".join(f"{n} {t}" for n, t in pieces.dtypes)
    return ranked.select(*pieces.columns, "rank").mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(documents: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text",
                   capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """``(id, piece, start, length, ids_crc32, sequence_id, offset)`` for every piece of every row.

    Repeated rows are packed each; a null id is kept as it is; other columns are left out; empty input gives no rows.
    """
    pieces = keep(cut_pieces(documents, tokenizer, id_column, text_column, capacity), "pack-pieces")
    return pack_pieces(pieces, capacity, nodes).drop("row").withColumnRenamed("id", id_column)


def packed_sequences(documents: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text",
                     capacity: int = CAPACITY) -> DataFrame:
    """``(sequence_id, ids array<int>, pieces array<struct<offset, length, id>>)``: the sequences themselves, at most
    ``capacity`` ids each."""
    pieces = keep(cut_pieces(documents, tokenizer, id_column, text_column, capacity, True), "pack-ids")
    placed = pack_pieces(pieces, capacity)
    ordered = F.sort_array(F.collect_list(F.struct("offset", "length", "id", "ids")))
    return placed.groupBy("sequence_id").agg(ordered.alias("p")).select(
        "sequence_id", F.flatten(F.col("p.ids")).alias("ids"),
        F.transform("p", lambda x: F.struct(x["offset"], x["length"], x["id"])).alias("pieces"))
