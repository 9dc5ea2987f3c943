"""Term counts per document, made where the document's words are.

A task takes the words of some documents at a time (Arrow batches), numbers the different words and counts runs of these
numbers. What it holds is bounded by :data:`PIECE` words or one document, whatever the size of its partition, and what
leaves it are counts, not occurrences. The words themselves come from Spark expressions (``functions/text.py``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.session import materialize

#: Words that are counted at a time; a longer document is one piece.
PIECE = 1_000_000


def by_words(df: DataFrame, keys: list[str], words: Column, text: str) -> DataFrame:
    """``(keys, words)``, the rows of one document (its id is the last key) next to each other.

    Text is shuffled, not the larger lists of words.
    """
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.select(*keys, text).repartition(count, keys[-1]).sortWithinPartitions(*keys)
    return dealt.select(*keys, words.alias("words"))


def pieces(batches, n_keys: int, most: int = PIECE):
    """``(batch, document number of each row)``: rows of whole documents, from rows that lie together by document."""
    held, last = [], None
    size = 0
    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(n_keys))))
        many = pc.fill_null(pc.list_value_length(batch.column(n_keys)), 0).to_numpy(zero_copy_only=False)
        low = 0
        for row, key in enumerate(keys):
            if size >= most and key != last:
                if row > low:
                    held.append((batch.slice(low, row - low), keys[low:row]))
                yield _together(held)
                held, low, size = [], row, 0
            size += int(many[row])
            last = key
        if len(keys) > low:
            held.append((batch.slice(low), keys[low:]))
    if held:
        yield _together(held)


def _together(held):
    keys = [k for _, own in held for k in own]
    new = [False] + [a != b for a, b in zip(keys, keys[1:])]
    table = pa.Table.from_batches([b for b, _ in held]).combine_chunks()
    return table.to_batches()[0], np.cumsum(np.array(new, np.int64))


class Grams:
    """The n-grams of a piece: per length ``(document, number of the n-gram)`` of every occurrence, and the terms by number.

    With ``bridge=False`` an empty word voids the n-grams that it is part of.
    """

    def __init__(self, words: pa.Array, doc: np.ndarray, hi: int, bridge: bool = True):
        many = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        self.empty = doc[many == 0]
        coded = words.flatten().dictionary_encode()
        self.names = coded.dictionary
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(doc)), many)
        if not bridge:
            void = pc.equal(self.names, "").to_numpy(zero_copy_only=False)
        self.doc, self.number, self.parts = {}, {}, {}
        at, number = np.arange(len(code)), code
        if not bridge:
            at = at[~void[code]]
            number = code[at]
        distinct = np.arange(len(self.names))
        self.doc[1], self.number[1], self.parts[1] = doc[row[at]], number, (distinct,)
        for n in range(2, hi + 1):
            # The run of n - 1 words from here on goes on with one more word of the same text.
            more = at + (n - 1) < len(code)
            at, number = at[more], number[more]
            ok = row[at + (n - 1)] == row[at]
            if not bridge:
                ok &= ~void[code[at + (n - 1)]]
            at, number = at[ok], number[ok]
            pairs, number = np.unique(number * len(self.names) + code[at + (n - 1)], return_inverse=True)
            before, own = pairs // max(1, len(self.names)), pairs % max(1, len(self.names))
            self.doc[n], self.number[n] = doc[row[at]], number
            self.parts[n] = (*(p[before] for p in self.parts[n - 1]), own)

    def terms(self, n: int, some: np.ndarray | None = None) -> pa.Array:
        parts = self.parts[n] if some is None else [p[some] for p in self.parts[n]]
        words = [self.names.take(pa.array(p)) for p in parts]
        return words[0] if n == 1 else pc.binary_join_element_wise(*words, " ")

    def counts(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(document, number, occurrences)``, by document and number."""
        wide = max(1, len(self.parts[n][0]))
        both, tf = np.unique(self.doc[n] * wide + self.number[n], return_counts=True)
        return both // wide, both % wide, tf


def _kinds(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def term_lists(words: DataFrame, lo: int, hi: int, bridge: bool = True, keep_empty: bool = False) -> DataFrame:
    """``(keys, ngram_len, terms, tf)`` of rows ``(keys, words)`` (:func:`by_words`): one row per document and length of n-grams
    that it has, with its distinct terms and their counts.

    ``keep_empty`` gives a document with texts without any word a row with one null term, which counts these.
    """
    keys = words.columns[:-1]

    def run(batches):
        for batch, doc in pieces(batches, len(keys)):
            grams, first = Grams(batch.column(len(keys)), doc, hi, bridge), np.unique(doc, return_index=True)[1]

            def rows(own, terms, n, tf):
                one, begins = np.unique(own, return_index=True)
                ends, at = pa.array(np.append(begins, len(own)), pa.int32()), pa.array(first[one])
                return pa.RecordBatch.from_arrays(
                    [*(batch.column(k).take(at) for k in range(len(keys))), pa.array(np.full(len(one), n, np.int32)),
                     pa.ListArray.from_arrays(ends, terms), pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int64)))],
                    names=[*keys, "ngram_len", "terms", "tf"])

            for n in range(lo, hi + 1):
                own, number, tf = grams.counts(n)
                if len(own):
                    yield rows(own, grams.terms(n).take(pa.array(number)), n, tf)
            if keep_empty and len(grams.empty):
                own, tf = np.unique(grams.empty, return_counts=True)
                yield rows(own, pa.nulls(len(own), pa.string()), lo, tf)

    return words.mapInArrow(run, f"{_kinds(words, keys)}, ngram_len int, terms array<string>, tf array<long>")


def term_counts(words: DataFrame, lo: int, hi: int, bridge: bool = True, keep_empty: bool = False) -> DataFrame:
    """``(keys, ngram_len, term, tf)``: :func:`term_lists`, one row per document and term."""
    lists = term_lists(words, lo, hi, bridge, keep_empty)
    return lists.select(*words.columns[:-1], "ngram_len", F.inline(F.arrays_zip(F.col("terms").alias("term"), "tf")))


def term_totals(words: DataFrame, lo: int, hi: int, known: list[str] | None = None) -> DataFrame:
    """``(term, ngram_len, total, df)``: occurrences and documents of every term. ``known`` leaves out n-grams with other words.

    The counts of many documents are added up in the tasks before they are shuffled.
    """
    keys = len(words.columns) - 1

    def run(batches):
        listed = None if known is None else pa.array(known, pa.string())
        for batch, doc in pieces(batches, keys):
            column = batch.column(keys)
            if listed is not None:
                column = _blanked(column, listed)
            grams = Grams(column, doc, hi, listed is None)
            for n in range(lo, hi + 1):
                own, number, tf = grams.counts(n)
                wide = len(grams.parts[n][0])
                df = np.bincount(number, minlength=wide)
                total = np.bincount(number, tf, wide).astype(np.int64)
                some = np.flatnonzero(df)
                if len(some):
                    yield pa.RecordBatch.from_arrays(
                        [grams.terms(n, some), pa.array(np.full(len(some), n, np.int32)), pa.array(total[some]), pa.array(df[some])],
                        names=["term", "ngram_len", "total", "df"])

    return words.mapInArrow(run, "term string, ngram_len int, total long, df long").groupBy("term", "ngram_len").agg(
        F.sum("total").alias("total"), F.sum("df").alias("df"))


def _blanked(column: pa.Array, listed: pa.Array) -> pa.Array:
    """The lists with all words but the listed ones emptied; a null list is an empty one."""
    many = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    kept = pc.if_else(pc.is_in(flat, listed), flat, "")
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), kept)


class Lexicon:
    """A capped vocabulary as the tasks hold it: its terms, and columns of numbers by term."""

    def __init__(self, terms: list[str], **columns: np.ndarray):
        self.terms, self.columns = terms, columns

    def met(self, grams: Grams, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(document, place in the vocabulary, occurrences)``, by document."""
        value_set, parts = pa.array(self.terms, pa.string()), []
        for n in range(lo, hi + 1):
            place = pc.fill_null(pc.index_in(grams.terms(n), value_set), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            known = place[grams.number[n]]
            kept = known >= 0
            both, tf = np.unique(grams.doc[n][kept] * len(self.terms) + known[kept], return_counts=True)
            parts.append(np.stack([both, tf]))
        both, tf = np.concatenate(parts, axis=1)
        order = np.argsort(both, kind="stable")
        both, tf = both[order], tf[order]
        wide = max(1, len(self.terms))
        return both // wide, both % wide, tf


def sublinear_rows(words: DataFrame, lexicon: Lexicon, hi: int) -> DataFrame:
    """``(keys, term, weight, df)`` of rows ``(keys, words)``: unit-length ``(1 + ln tf) * idf`` of the vocabulary terms."""
    keys = words.columns[:-1]

    def run(batches):
        names = pa.array(lexicon.terms, pa.string())
        for batch, doc in pieces(batches, len(keys)):
            first = np.unique(doc, return_index=True)[1]
            own, place, tf = lexicon.met(Grams(batch.column(len(keys)), doc, hi), 1, hi)
            if not len(own):
                continue
            raw = (1 + np.log(tf)) * lexicon.columns["idf"][place]
            length = np.sqrt(np.bincount(own, raw * raw, len(first)))
            at = pa.array(first[own])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(at) for k in range(len(keys))), names.take(pa.array(place)),
                 pa.array(raw / length[own]), pa.array(lexicon.columns["df"][place])], names=[*keys, "term", "weight", "df"])

    return words.mapInArrow(run, f"{_kinds(words, keys)}, term string, weight double, df long")


def theme_rows(words: DataFrame, lexicon: Lexicon, hi: int, n_themes: int) -> DataFrame:
    """``(keys, themes)`` of rows ``(keys, words)``: one row per document with its cosine to every theme, 0 without a known term."""
    keys = words.columns[:-1]

    def run(batches):
        for batch, doc in pieces(batches, len(keys)):
            first = np.unique(doc, return_index=True)[1]
            own, place, tf = lexicon.met(Grams(batch.column(len(keys)), doc, hi), 1, hi)
            raw = (1 + np.log(tf)) * lexicon.columns["idf"][place]
            length = np.sqrt(np.bincount(own, raw * raw, len(first)))
            dots = np.stack([np.bincount(own, raw * lexicon.columns["themes"].reshape(-1, n_themes)[place, i], len(first)) for i in range(n_themes)], axis=1)
            cosine = dots / np.where(length > 0, length, 1)[:, None]
            at = pa.array(first)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(at) for k in range(len(keys))),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1) * n_themes, pa.int32()), pa.array(cosine.ravel()))],
                names=[*keys, "themes"])

    return words.mapInArrow(run, f"{_kinds(words, keys)}, themes array<double>")


def lexicon_of(words: DataFrame, *columns: str) -> Lexicon:
    """The capped vocabulary ``words`` (term and number columns) as a :class:`Lexicon`."""
    rows: pd.DataFrame = words.select("term", *columns).toPandas()
    return Lexicon(rows["term"].tolist(), **{
        c: np.stack(rows[c].to_numpy()) if len(rows) and isinstance(rows[c].iloc[0], (list, np.ndarray)) else rows[c].to_numpy()
        for c in columns})


#: Texts of a block: documents that are counted, and later weighted, together.
BLOCK_TEXTS = 2_000


def _mix(x: np.ndarray) -> np.ndarray:
    """64 bits to 64 bits, each of which depends on all."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _hash(values) -> np.ndarray:
    return pd.util.hash_array(np.array(values, dtype=object), categorize=False)


def gram_hashes(parts: list[np.ndarray], hashed: np.ndarray) -> np.ndarray:
    """Hashes of n-grams from the places of their words and the hashes of these; equality of hashes stands for equality."""
    out = np.full(len(parts[0]), len(parts), np.uint64)
    for part in parts:
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + hashed[part])
    return out


def term_hashes(terms: list[list[str]]) -> np.ndarray:
    """The hash of each n-gram, given by its words, as a signed number."""
    out = np.zeros(len(terms), np.uint64)
    for i, words in enumerate(terms):
        out[i] = gram_hashes([np.array([k]) for k in range(len(words))], _hash(words))[0]
    return out.view(np.int64)


def found_at(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The place of each value among sorted ones, -1 for others."""
    if not len(known):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)


class Block(Grams):
    """The n-grams of the texts of a block, from ``(block, group, doc, words)``; ``first``: a row of each document."""

    def __init__(self, table: pa.Table, hi: int):
        table = table.combine_chunks()
        numbers: dict = {}
        doc = np.array([numbers.setdefault(k, len(numbers)) for k in zip(table.column(1).to_pylist(), table.column(2).to_pylist())], np.int64)
        self.known: dict = {}
        self.doc_of_row, self.first = doc, np.unique(doc, return_index=True)[1]
        of: dict = {}
        self.group = np.array([of.setdefault(g, len(of)) for g, _ in numbers], np.int64)
        self.groups, self.table = list(of), table
        self.salt = _hash([repr(g) for g in of])
        super().__init__(table.column(3).chunk(0), doc, hi)
        self.hashed = _hash(self.names.to_pylist()) if len(self.names) else np.zeros(0, np.uint64)

    def hashes(self, n: int) -> np.ndarray:
        """A hash of every n-gram, by number; equality of hashes stands for equality."""
        return gram_hashes(self.parts[n], self.hashed)

    def in_group(self, hashes: np.ndarray, group: np.ndarray) -> np.ndarray:
        return _mix(hashes + self.salt[group]).view(np.int64)

    def counts(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if n not in self.known:
            self.known[n] = super().counts(n)
        return self.known[n]

    def place(self, n: int, own: np.ndarray, number: np.ndarray) -> np.ndarray:
        """One number for group and n-gram."""
        return self.group[own] * max(1, len(self.parts[n][0])) + number

    def counted(self, hi: int) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
        """Hashes of group and n-gram in order, in how many documents of the block each is, and per length where the hash of a place stands."""
        found, many, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], {}
        for n in range(1, hi + 1):
            own, number, _ = self.counts(n)
            hashes = self.hashes(n)
            places[n], times = np.unique(self.place(n, own, number), return_counts=True)
            if len(times):
                found.append(self.in_group(hashes[places[n] % len(hashes)], places[n] // len(hashes)))
                many.append(times)
        found = np.concatenate(found).view(np.uint64)
        order, low, at = np.argsort(found), 0, {}
        rank = np.empty(len(found), np.int64)
        rank[order] = np.arange(len(found))
        for n in range(1, hi + 1):
            at[n] = np.zeros(len(self.groups) * max(1, len(self.parts[n][0])), np.int64)
            at[n][places[n]] = rank[low:low + len(places[n])]
            low += len(places[n])
        return found[order], np.concatenate(many)[order], at

    def rows(self, own: np.ndarray) -> list[pa.Array]:
        """Group and document of each document number."""
        at = pa.array(self.first[own])
        return [self.table.column(k).chunk(0).take(at) for k in (1, 2)]


def in_blocks(df: DataFrame, group: str, doc: str, text: str, words: Column, stored: bool = False) -> DataFrame:
    """``(block, group, doc, words)``, dealt by document; the number of blocks grows with the texts.

    The texts are made once: they are written, as every pass over the blocks reads them, unless the caller's are ``stored``, a
    table of files. Text is shuffled, not the larger lists of words.
    """
    texts = df.select(group, doc, text) if stored else materialize(df.select(group, doc, text), "texts")
    blocks = texts.agg(F.count("*")).first()[0] // BLOCK_TEXTS + 1
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.select(F.pmod(F.xxhash64(doc), F.lit(blocks)).alias("block"), group, doc, text)
    return dealt.repartition(count, "block").sortWithinPartitions("block").select("block", group, doc, words.alias("words"))


def rows_of_groups(blocks: DataFrame) -> dict:
    """The texts of each group, which is named as in a :class:`Block`."""
    table = blocks.groupBy(blocks.columns[1]).agg(F.count("*").alias("n")).toArrow()
    return dict(zip(table.column(0).to_pylist(), table.column(1).to_pylist()))


def hashes_in_groups(groups: list, hashes: np.ndarray) -> np.ndarray:
    """Hashes of group and n-gram (:meth:`Block.in_group`), a row for each group."""
    salts = _hash([repr(g) for g in groups]) if groups else np.zeros(0, np.uint64)
    return _mix(hashes.view(np.uint64)[None, :] + salts[:, None])


#: Blocks whose n-grams, in one range of the hashes, are about as many as those of a block.
BLOCKS_OF_RANGE = 4


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers as bytes, all first bytes first: where numbers are small, those that follow are zero and compress."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T).tobytes()


def _numbers(planes: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _ranges(blocks: DataFrame) -> int:
    return (blocks.agg(F.max("block")).first()[0] or 0) // BLOCKS_OF_RANGE + 1  # reads no text


def _sent(blocks: DataFrame, hi: int, ranges: int) -> DataFrame:
    """``(block, part, hashes, n)``: for each block and range of the hashes those of its groups and n-grams there, and their counts."""
    def send(table: pa.Table) -> pa.Table:
        hashes, many, _ = Block(table, hi).counted(hi)
        part = (hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
        cuts = np.searchsorted(part, np.arange(ranges + 1, dtype=np.uint64))
        some = [(k, lo, up) for k, (lo, up) in enumerate(zip(cuts, cuts[1:])) if up > lo]
        number = table.column(0)[0].as_py()
        return pa.table([pa.array([number] * len(some), pa.int64()), pa.array([k for k, _, _ in some], pa.int32()),
                         pa.array([_planes(np.diff(hashes[lo:up], prepend=np.uint64(0))) for _, lo, up in some], pa.binary()),
                         pa.array([_planes(many[lo:up].astype(np.uint32)) for _, lo, up in some], pa.binary())],
                        names=["block", "part", "hashes", "n"])

    return blocks.groupBy("block").applyInArrow(send, "block long, part int, hashes binary, n binary")


def _hashes(planes: bytes) -> np.ndarray:
    return np.cumsum(_numbers(planes, np.uint64), dtype=np.uint64)


def _added(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """What blocks sent to a range: the hashes of each, and of all together their order, whether one differs from that before it
    in this order, and the sums by hash."""
    parts = [_hashes(h) for h in table.column("hashes").to_pylist()]
    hashes = np.concatenate(parts)
    many = np.concatenate([_numbers(n, np.uint32) for n in table.column("n").to_pylist()])
    # Runs that are sorted already.
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    return parts, order, new, np.add.reduceat(many[order].astype(np.int64), np.flatnonzero(new)).astype(np.uint32)


#: The number that the answer to no block has.
NO_BLOCK = -1


def packed_frequencies(blocks: DataFrame, hi: int, named: bool = False, listed: np.ndarray | None = None) -> DataFrame:
    """``(block, part, df, hashes)``: for each block and range of the hashes in how many documents of the group its n-grams are, by order of their hash.

    A block sends one row for each range, which holds its hashes of group and n-gram there as differences, and their counts in the
    block. A range adds up what blocks sent and answers each with counts alone: a block knows its hashes (:meth:`Block.counted`).
    With ``named`` the answer repeats them. The ``listed`` hashes, in order, that some text has are answered as well, by
    name, with no block's number (:func:`listed_counts`).
    """
    def add_up(table: pa.Table) -> pa.Table:
        parts, order, new, sums = _added(table)
        df = np.empty(len(order), np.uint32)
        df[order] = sums[np.cumsum(new) - 1]
        ends = np.cumsum([0, *map(len, parts)])
        numbers, dfs = table.column("block").to_pylist(), [_planes(df[a:b]) for a, b in zip(ends, ends[1:])]
        names = table.column("hashes").to_pylist() if named else [None] * len(parts)
        if listed is not None:
            at = found_at(listed, np.concatenate(parts)[order[new]])
            numbers.append(NO_BLOCK)
            dfs.append(_planes(sums[at[at >= 0]]))
            names.append(_planes(np.diff(listed[at >= 0], prepend=np.uint64(0))))
        part = table.column("part")[0].as_py()
        return pa.table([pa.array(numbers, pa.int64()), pa.array([part] * len(numbers), pa.int32()), pa.array(dfs, pa.binary()),
                         pa.array(names, pa.binary())], names=["block", "part", "df", "hashes"])

    return _sent(blocks, hi, _ranges(blocks)).groupBy("part").applyInArrow(add_up, "block long, part int, df binary, hashes binary")


def listed_counts(answers: DataFrame) -> dict[int, int]:
    """The documents of the listed hashes of :func:`packed_frequencies` that some text has."""
    rows = answers.where(F.col("block") == NO_BLOCK).collect()
    return {int(h): int(n) for r in rows for h, n in zip(_hashes(r["hashes"]), _numbers(r["df"], np.uint32))}


def fitted_frequencies(blocks: DataFrame, hi: int) -> DataFrame:
    """``(part, ranges, hashes, df)``: one row for each range of the hashes, with the different ones of groups and n-grams there and in
    how many documents of the group each is."""
    ranges = _ranges(blocks)

    def add_up(table: pa.Table) -> pa.Table:
        parts, order, new, sums = _added(table)
        hashes = np.concatenate(parts)[order[new]]
        return pa.table([table.column("part").slice(0, 1), pa.array([ranges], pa.int64()), pa.array([_planes(np.diff(hashes, prepend=np.uint64(0)))], pa.binary()),
                         pa.array([_planes(sums)], pa.binary())], names=["part", "ranges", "hashes", "df"])

    return _sent(blocks, hi, ranges).groupBy("part").applyInArrow(add_up, "part int, ranges long, hashes binary, df binary")


def fitted_counts(fitted: DataFrame, listed: np.ndarray) -> dict[int, int]:
    """The documents of the ``listed`` hashes that :func:`fitted_frequencies` found."""
    def run(batches):
        for batch in batches:
            for h, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = found_at(listed, _hashes(h))
                yield pa.RecordBatch.from_arrays([pa.array(listed[at >= 0].view(np.int64)), pa.array(_numbers(n, np.uint32)[at[at >= 0]].astype(np.int64))],
                                                 names=["hash", "df"])

    rows = fitted.select("hashes", "df").mapInArrow(run, "hash long, df long").collect()
    return {r["hash"] & 0xFFFFFFFFFFFFFFFF: r["df"] for r in rows}


def answers_of(fitted: DataFrame, blocks: DataFrame, hi: int) -> DataFrame:
    """``(block, part, df)`` as :func:`packed_frequencies` gives them, from the counts of other texts (:func:`fitted_frequencies`); 0 for
    n-grams that these have not."""
    # One range at least, also of a model of no texts.
    ranges = fitted.agg(F.max("ranges")).first()[0] or 1

    def look_up(sent: pa.Table, known: pa.Table) -> pa.Table:
        hashes = [_hashes(h) for h in known.column("hashes").to_pylist()]
        counts = [_numbers(n, np.uint32) for n in known.column("df").to_pylist()]

        def df(mine: np.ndarray) -> bytes:
            if not hashes:
                return _planes(np.zeros(len(mine), np.uint32))
            at = found_at(mine, hashes[0])
            return _planes(np.where(at >= 0, counts[0][at], 0).astype(np.uint32))

        return pa.table([sent.column("block"), sent.column("part"), pa.array([df(_hashes(h)) for h in sent.column("hashes").to_pylist()], pa.binary())],
                        names=["block", "part", "df"])

    return _sent(blocks, hi, ranges).groupBy("part").cogroup(fitted.groupBy("part")).applyInArrow(look_up, "block long, part int, df binary")


def frequencies(blocks: DataFrame, hi: int) -> DataFrame:
    """``(block, hash, df)``: :func:`packed_frequencies` as rows, for the n-grams that are in two documents of a group or more."""
    def rows(batches):
        for batch in batches:
            for block, df, hashes in zip(*(batch.column(c).to_pylist() for c in ("block", "df", "hashes"))):
                df, hashes = _numbers(df, np.uint32), _hashes(hashes).view(np.int64)
                some = df > 1
                yield pa.RecordBatch.from_arrays([pa.array(np.full(some.sum(), block, np.int64)), pa.array(hashes[some]),
                                                  pa.array(df[some].astype(np.int64))], names=["block", "hash", "df"])

    return packed_frequencies(blocks, hi, True).mapInArrow(rows, "block long, hash long, df long")


def weigh(blocks: DataFrame, hi: int, give, schema: str, answers: DataFrame | None = None) -> DataFrame:
    """Rows that ``give(block, dfs)`` makes of every block, as an Arrow table; ``dfs(n, own, number)``: in how many documents of
    its group a document's n-gram is. ``answers``: those of :func:`packed_frequencies`, unless they are others'."""
    def run(table: pa.Table, counted: pa.Table) -> pa.Table:
        block = Block(table, hi)
        at = block.counted(hi)[2]
        parts = sorted(zip(counted.column("part").to_pylist(), counted.column("df").to_pylist()))
        df = np.concatenate([np.zeros(0, np.uint32), *(_numbers(d, np.uint32) for _, d in parts)]).astype(float)

        def dfs(n: int, own: np.ndarray, number: np.ndarray) -> np.ndarray:
            return df[at[n][block.place(n, own, number)]]

        return give(block, dfs)

    answers = packed_frequencies(blocks, hi) if answers is None else answers
    return blocks.groupBy("block").cogroup(answers.select("block", "part", "df").groupBy("block")).applyInArrow(run, schema)
