"""Line deduplication with a log-template tree.

A line is parsed at fixed depth: by its number of tokens, then by its first three tokens, where a token with a
digit is a variable field. The lines of a leaf are generalised to templates: a position keeps the token that most of
a group's lines have there, or becomes variable. A line belongs to the template if it agrees with it at enough of the
positions that are not variable; the lines that do not are grouped anew, so a leaf holds as many templates as recur in
it. Each line is a template of its own besides. Templates that recur across documents are dropped from all of them.

Copies of whole documents are no evidence of that: they are for a near-duplicate stage to handle. Documents whose sets of
five-word shingles are similar from 0.75 on, the similarity which that stage links at, count as one. The similarity is estimated from one
permutation's minima in 256 parts of the hash range. So lines are dropped only where unlike documents share them. Texts of fewer
than five words have no shingles to compare and are not counted; their lines go with those of others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import LOWER_ASCII, KeyFilter, constants, keep, mix, sliced, span_hashes, spans, texts

#: Leading tokens in the tree; a shorter line has end marks for those it lacks.
DEPTH = 3
#: Documents of their own that make a template recurring.
MIN_DOCUMENTS = 3
#: Tokens of a line from which two documents of their own are enough, if the line is the same in both.
LONG, LONG_DOCUMENTS = 50, 2
#: Share of a group's lines that a token needs to stay in the template, and share of its tokens that a member agrees with.
MAJORITY, AGREEMENT = 0.5, 0.7
#: Share of a template's positions that hold a word; a line that is the same in all documents needs none.
CONSTANT = 0.5
#: Words of a shingle, minima of a sketch, and similarity of shingle sets from which documents are copies of each other.
SHINGLE, MINIMA, COPY = 5, 256, 0.75
#: Unlike documents beyond the needed ones after which no more of a template are looked for.
SPARE = 5
#: Templates known to have enough unlike documents that a task remembers.
REMEMBERED = 1 << 16

_SHINGLE = constants(SHINGLE, 61)
_NONE = np.uint16(0xFFFF)
_LEAD = constants(DEPTH + 1, 53)
_VARIABLE = constants(1, 59)[0]
_SAME = constants(1, 67)[0]
_END = constants(1, 71)[0]
_SHORT_VARIABLE = int((_VARIABLE >> np.uint64(32)).astype(np.uint32).view(np.int32))
_IS_BREAK = np.zeros(256, bool)
_IS_BREAK[10] = True
_IS_DIGIT = np.zeros(256, bool)
_IS_DIGIT[48:58] = True


def _before(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags)])


def _lines(column):
    """Lines that have a token by runs of rows: rows, then by line: row within the run, number, leaf, where its tokens are
    among all tokens; then all tokens with digits variable, and as they are."""
    for t in texts(column, LOWER_ASCII):
        exact = span_hashes(t.data, t.begins, t.ends)
        word = exact.copy()
        digits = _before(_IS_DIGIT[t.data])
        word[digits[t.ends] > digits[t.begins]] = _VARIABLE
        begin, end = spans(t.data, _IS_BREAK[t.data], t.bounds)
        a, b = np.searchsorted(t.begins, begin), np.searchsorted(t.begins, end)
        use = b > a
        begin, a, b = begin[use], a[use], b[use]
        row = np.searchsorted(t.bounds, begin, "right") - 1
        breaks = _before(_IS_BREAK[t.data])
        number = breaks[begin] - breaks[t.bounds[row]]
        leaf = (b - a).astype(np.uint64) * _LEAD[DEPTH]
        for d in range(DEPTH):
            has = b - a > d
            leaf[has] += word[a[has] + d] * _LEAD[d]
            leaf[~has] += np.multiply(_END, _LEAD[d:d + 1])
        yield t.rows, row, number, mix(leaf).view(np.int64), a, b, word, exact


def _whole(leaf: np.ndarray, a: np.ndarray, b: np.ndarray, token: np.ndarray) -> np.ndarray:
    """A hash of each line ``[a, b)`` of tokens: each token by its place in the line."""
    many = b - a
    start = np.cumsum(many) - many
    at = np.arange(int(many.sum()), dtype=np.int64) - np.repeat(start, many)
    placed = _before_wrapping(mix(token[np.repeat(a, many) + at] + at.astype(np.uint64) * _LEAD[0]))
    return mix((placed[start + many] - placed[start]) ^ leaf.view(np.uint64))


def _before_wrapping(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=out[1:])
    return out


def _leaves(batches):
    for batch in sliced(batches, 4096):
        out = []
        for _, row, _, leaf, a, b, _, _ in _lines(batch.column(0)):
            if len(leaf):
                _, at = np.unique(mix(leaf.view(np.uint64) + row.astype(np.uint64) * _LEAD[1]), return_index=True)
                out.append(np.column_stack([leaf[at], (b - a)[at]]))
        if out:
            out = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["leaf", "tokens"])


def _candidates(passes: KeyFilter):
    """Distinct lines of every row in leaves that may recur: ``(row, leaf, line, same, numbers, tokens)``."""
    def run(batches):
        for batch in sliced(batches):
            keys = batch.column(1).to_numpy()
            for rows, row, number, leaf, a, b, word, exact in _lines(batch.column(0)):
                hit = passes(leaf.view(np.uint64))
                if not hit.any():
                    continue
                row, number, leaf, a, b = (x[hit] for x in (row, number, leaf, a, b))
                line, same = _whole(leaf, a, b, word).view(np.int64), mix(_whole(leaf, a, b, exact) ^ _SAME).view(np.int64)
                order = np.lexsort((number, same, row))
                new = np.concatenate([[True], (row[order][1:] != row[order][:-1]) | (same[order][1:] != same[order][:-1])])
                first = order[new]
                short = (word >> np.uint64(32)).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[rows.start + row[first]]), pa.array(leaf[first]), pa.array(line[first]), pa.array(same[first]),
                     pa.ListArray.from_arrays(np.append(np.flatnonzero(new), len(order)).astype(np.int32),
                                              number[order].astype(np.int32)),
                     pa.array([short[a[k]:b[k]] for k in first], pa.list_(pa.int32()))],
                    names=["row", "leaf", "line", "same", "numbers", "tokens"])
    return run


def _templates(distinct: DataFrame, min_documents: int) -> DataFrame:
    """``(leaf, line, group)``: lines of ``distinct`` (leaf, line, documents, tokens) by the template they belong to.

    A leaf holds as many templates as it needs. Each round gives every group its majority template and takes out the lines
    that agree with it; the others form a group again, or, where none agreed, one group for each token at the position
    whose most frequent token has the most votes. Groups of one line, or in too few documents, are done.
    """
    spark = distinct.sparkSession
    found = spark.createDataFrame([], "leaf long, line long, group long")
    groups = distinct.withColumn("group", F.col("leaf"))
    while True:
        votes = (groups.select("group", "documents", F.posexplode("tokens").alias("at", "token"))
                 .groupBy("group", "at", "token").agg(F.sum("documents").alias("votes"), F.count("*").alias("lines")))
        positions = votes.groupBy("group", "at").agg(F.max(F.struct("votes", "token")).alias("top"), F.sum("votes").alias("cast"),
                                                     F.sum("lines").alias("lines"))
        split = F.when(F.col("top.votes") < F.col("cast"), F.struct(F.col("top.votes").alias("votes"), (-F.col("at")).alias("at")))
        shapes = (positions.groupBy("group").agg(
            F.max("cast").alias("cast"), F.max("lines").alias("lines"), F.max(split).alias("split"),
            F.sort_array(F.collect_list(F.struct("at", F.when(F.col("top.votes") > MAJORITY * F.col("cast"), F.col("top.token"))
                                                 .alias("token")))).alias("template"))
            .where((F.col("cast") >= min_documents) & (F.col("lines") > 1)).drop("cast", "lines"))
        # A position without majority is a variable field: it neither agrees nor disagrees.
        fixed = F.size(F.filter("template", lambda x: x["token"].isNotNull()))
        said = F.size(F.filter("template", lambda x: x["token"] != _SHORT_VARIABLE))
        agree = F.size(F.filter(F.zip_with("tokens", "template", lambda x, y: x == y["token"]), lambda same: F.coalesce(same, F.lit(False))))
        judged = keep(groups.join(shapes, "group").withColumn("member", (said >= CONSTANT * F.size("template")) & (
            agree >= AGREEMENT * fixed)).drop("template"), "lines-judged")
        if judged.isEmpty():
            return found
        found = found.unionByName(judged.where("member").select("leaf", "line", "group"))
        taken = judged.where("member").select("group").distinct().withColumn("taken", F.lit(True))
        token = F.get("tokens", -F.col("split.at"))
        groups = judged.where("NOT member").join(taken, "group", "left").where("taken OR split IS NOT NULL").withColumn(
            "group", F.when(F.col("taken"), F.xxhash64("group")).otherwise(F.xxhash64("group", "split.at", token))).drop("split", "member", "taken")


def _sketches(named: KeyFilter):
    """The least hash of each named row's shingles in each of ``MINIMA`` parts; rows without a shingle are left out."""
    def run(batches):
        for batch in sliced(batches):
            keys = batch.column(1).to_numpy()
            yield from _minima(batch.filter(pa.array(named(keys.view(np.uint64)))))
    return run


def _minima(batch):
    keys = batch.column(1).to_numpy()
    for t in texts(batch.column(0), LOWER_ASCII):
        word = span_hashes(t.data, t.begins, t.ends)
        many = np.maximum(np.diff(t.first) - SHINGLE + 1, 0)
        has = np.flatnonzero(many)
        if not len(has):
            continue
        row = np.repeat(np.arange(len(has)), many[has])
        at = np.arange(len(row)) + np.repeat(t.first[has] - (np.cumsum(many[has]) - many[has]), many[has])
        total = np.zeros(len(at), np.uint64)
        for d in range(SHINGLE):
            total += word[at + d] * _SHINGLE[d]
        total = mix(total)
        least = np.full(len(has) * MINIMA, _NONE)
        np.minimum.at(least, row * MINIMA + (total >> np.uint64(56)).astype(np.int64),
                      np.minimum(((total >> np.uint64(40)) & np.uint64(0xFFFF)).astype(np.uint16), _NONE - np.uint16(1)))
        data = least.tobytes()
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[t.rows.start + has]), pa.array([data[k:k + 2 * MINIMA] for k in range(0, len(data), 2 * MINIMA)], pa.binary())],
            names=["row", "sketch"])


def _add_unlike(have: list[bytes], sketch: bytes) -> None:
    """Put ``sketch`` among ``have`` if none of them is a copy of it."""
    new = np.frombuffer(sketch, np.uint16)
    if have:
        old = np.frombuffer(b"".join(have), np.uint16).reshape(-1, MINIMA)
        same, held = (old == new) & (new != _NONE), (old != _NONE) | (new != _NONE)
        if (same.sum(1) >= COPY * held.sum(1)).any():
            return
    have.append(sketch)


def _unlike(enough: int):
    """Of the documents (row, key, sketch) of every template up to ``enough`` that are no copies of each other, by batch."""
    def run(batches):
        done: set[int] = set()
        for batch in batches:
            found: dict[int, list[bytes]] = {}
            key, sketch = batch.column("key").to_pylist(), batch.column("sketch")
            for k, own in enumerate(key):
                if own not in done:
                    have = found.setdefault(own, [])
                    if len(have) < enough:
                        _add_unlike(have, sketch[k].as_py())
            out = [(own, x) for own, have in found.items() for x in have]
            if len(done) < REMEMBERED:
                done.update(own for own, have in found.items() if len(have) >= enough)
            yield pa.RecordBatch.from_arrays([pa.array([own for own, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())],
                                             names=["key", "sketch"])
    return run


def _documents_of_their_own(enough: int):
    def run(batches):
        for batch in batches:
            many = []
            for sketches in batch.column("sketches"):
                have: list[bytes] = []
                for x in sorted(sketches.as_py()):
                    if len(have) < enough:
                        _add_unlike(have, x)
                many.append(len(have))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(many, pa.int32())], names=["key", "documents"])
    return run


def recurring_lines(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                    min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``(row, numbers)``: which lines of which rows are dropped (``row``: hash of id and text)."""
    rows = documents.select(F.col(text_column).alias("text"), F.xxhash64(id_column, text_column).alias("row"))
    fewest = min(LONG_DOCUMENTS, min_documents)
    leaves = keep(rows.select("text").mapInArrow(_leaves, "leaf long, tokens long").groupBy("leaf", "tokens").agg(F.count("*").alias("documents"))
                  .where(F.col("documents") >= F.when(F.col("tokens") >= LONG, fewest).otherwise(min_documents)), "lines-leaves")
    lines = keep(rows.mapInArrow(_candidates(KeyFilter.of(leaves, "leaf")),
                                 "row long, leaf long, line long, same long, numbers array<int>, tokens array<int>")
                 .join(leaves.select("leaf"), "leaf"), "lines-candidates")
    # One row a distinct line, with the number of documents that have it.
    counted = lines.select("row", "leaf", "line").distinct().groupBy("leaf", "line").agg(F.count("*").alias("documents"))
    one = lines.select("leaf", "line", "tokens").dropDuplicates(["leaf", "line"])
    distinct = keep(counted.join(one, ["leaf", "line"]), "lines-distinct")
    # A line by itself and the template it belongs to, if there is one. Numbers alone are no template.
    said = F.size(F.filter("tokens", lambda x: x != _SHORT_VARIABLE))
    keys = distinct.join(_templates(distinct, min_documents), ["leaf", "line"], "left").select("leaf", "line", F.array_compact(
        F.array(F.when(said >= CONSTANT * F.size("tokens"), F.col("line")), "group")).alias("keys"))
    # Each line under its keys, with the documents that these must be in: as it is, with digits variable, its template.
    # As it is matters only for long lines and those of numbers; for others it is within the line with digits variable.
    long = F.size("tokens") >= LONG
    itself = lines.where(long | (said < CONSTANT * F.size("tokens"))).select(
        "row", "numbers", F.col("same").alias("key"), F.when(long, fewest).otherwise(min_documents).alias("needed"))
    found = keep(lines.drop("tokens", "same").join(keys, ["leaf", "line"]).select(
        "row", "numbers", F.explode("keys").alias("key"), F.lit(min_documents).alias("needed")).unionByName(itself), "lines-members")
    shared = found.groupBy("key", "needed").agg(F.count_distinct("row").alias("documents")).where("documents >= needed")
    common = keep(found.join(shared.select("key"), "key"), "lines-common")
    # Only texts that share a line are compared.
    sketches = rows.mapInArrow(_sketches(KeyFilter.of(common, "row")), "row long, sketch binary").dropDuplicates(["row"])
    enough = min_documents + SPARE
    own = (common.select("key", "row").distinct().join(sketches, "row").mapInArrow(_unlike(enough), "key long, sketch binary")
           .groupBy("key").agg(F.collect_list("sketch").alias("sketches"))
           .mapInArrow(_documents_of_their_own(enough), "key long, documents int")
           .join(shared.select("key", "needed"), "key").where("documents >= needed"))
    return (common.join(own.select("key"), "key").select("row", F.explode("numbers").alias("number")).distinct()
            .groupBy("row").agg(F.collect_list("number").alias("numbers")))


def drop_lines(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text",
               min_documents: int = MIN_DOCUMENTS, dropped: str = "dropped_lines") -> DataFrame:
    """``documents`` with the recurring lines gone from their texts, and the number of lines dropped.

    Lines are parted by line breaks alone. Lines without a token stay. Null texts stay null, empty ones
    empty; a text all of whose lines are dropped becomes empty, its row stays. Repeated rows are treated alike;
    other columns are kept, but one named like ``dropped`` is replaced; an empty table gives no rows.
    """
    gone = recurring_lines(documents, id_column, text_column, min_documents)
    columns = [c for c in documents.columns if c != dropped]
    rows = documents.select(*columns).withColumn("__row", F.xxhash64(id_column, text_column)).join(
        gone.withColumnsRenamed({"row": "__row", "numbers": "__gone"}), "__row", "left")
    rows = rows.withColumn("__lines", F.split(text_column, "\n", -1))
    # Set difference of line numbers and one look-up a line, however many lines go.
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    text = F.array_join(F.transform(kept, lambda k: F.get("__lines", k)), "\n")
    text = F.when(F.col("__gone").isNull() | F.col(text_column).isNull(), F.col(text_column)).otherwise(text)
    return rows.select(*[text.alias(c) if c == text_column else F.col(c) for c in columns],
                       F.coalesce(F.size("__gone"), F.lit(0)).alias(dropped))
