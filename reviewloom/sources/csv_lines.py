"""CSV with quoted line breaks, read in as many splits as the file has.

A line says where it ends, inside a quoted cell or outside, only if one knows where it began. So every split is first read
under both assumptions; composing the splits' answers in file order, one row a split, settles how each really begins and the number of
its first record. The second reading then cuts records in all splits at once; only a record that runs over the end of a split is
put together from its pieces. Lines come from Spark's own text reader: any store, any compression it knows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.session import materialize


def ends_inside(line: str, inside: bool, quote: str = '"', comma: str = ",") -> bool:
    """Whether a quoted cell is open at the end of ``line``, given whether one was open at its beginning.

    A quote opens a cell only as its first character; two quotes in a quoted cell are one; what follows a closing quote
    belongs to the cell up to the next comma.
    """
    at = 0
    while True:
        if inside:
            at = line.find(quote, at)
            while at >= 0 and line.startswith(quote, at + 1):
                at = line.find(quote, at + 2)
            if at < 0:
                return True
            inside = False
        elif line.startswith(quote, at):
            inside, at = True, at + 1
            continue
        at = line.find(comma, at)
        if at < 0:
            return False
        at += 1


def _runs(batches: Iterator[pa.RecordBatch], quote: str) -> Iterator[tuple[tuple[str, int], list[str], list[bool]]]:
    """Lines of one split at a time, in file order, with whether they hold a quote."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lines, quoted = batch.column(0).to_pylist(), pc.match_substring(batch.column(0), quote).to_pylist()
        files, blocks = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        begin = 0
        for k in range(1, batch.num_rows + 1):
            if k == batch.num_rows or blocks[k] != blocks[begin] or files[k] != files[begin]:
                yield (files[begin], blocks[begin]), lines[begin:k], quoted[begin:k]
                begin = k


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def split_states(lines: DataFrame, quote: str = '"', comma: str = ",") -> list[dict]:
    """For each split: whether it ends inside a cell and how many records begin in it, if it begins outside (0) or inside (1)."""
    def count(batches):
        split, state, begun = None, None, None

        def row():
            return pa.RecordBatch.from_pydict({"file": [split[0]], "block": [split[1]], "end0": [state[0]], "end1": [state[1]],
                                               "begun0": [begun[0]], "begun1": [begun[1]]})

        for key, some, quoted in _runs(batches, quote):
            if key != split:
                if split is not None:
                    yield row()
                split, state, begun = key, [False, True], [0, 0]
            for line, has in zip(some, quoted):
                for h in (0, 1):
                    if not state[h]:
                        begun[h] += line not in ("", "\r")
                    if has:
                        state[h] = ends_inside(line, state[h], quote, comma)
        if split is not None:
            yield row()

    found = lines.mapInArrow(count, "file string, block long, end0 boolean, end1 boolean, begun0 long, begun1 long")
    return sorted((r.asDict() for r in found.collect()), key=lambda r: (r["file"], r["block"]))


def records(lines: DataFrame, quote: str = '"', comma: str = ",") -> DataFrame:
    """``(file, record, ordinal, text)``: every record, numbered from 0 in its file, and over all files without their first ones.

    Blank lines between records are none. A file that ends inside a quoted cell is an error. One row for each split is gathered.
    """
    places: dict[tuple[str, int], tuple[bool, int, int]] = {}
    file, inside, record, skipped = None, False, 0, 0
    total = 0
    for r in split_states(lines, quote, comma):
        if r["file"] != file:
            if inside:
                raise ValueError(f"{file} ends inside a quoted cell")
            file, inside, record = r["file"], False, 0
            skipped += 1
        places[r["file"], r["block"]] = (inside, record, total - skipped)
        begun = r["begun1"] if inside else r["begun0"]
        record, total = record + begun, total + begun
        inside = r["end1"] if inside else r["end0"]
    if inside:
        raise ValueError(f"{file} ends inside a quoted cell")
    schema = pa.schema([("file", pa.string()), ("record", pa.int64()), ("ordinal", pa.int64()), ("block", pa.int64()),
                        ("whole", pa.bool_()), ("text", pa.string())])

    def cut(batches):
        split = None
        inside = whole = False
        record = ordinal = 0
        held: list[str] = []
        out: list[tuple] = []

        def close(ended: bool):
            if held:
                out.append((split[0], record, ordinal, split[1], whole and ended, "\n".join(held)))
                held.clear()

        def batch():
            rows = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [[]] * len(schema), schema)], schema=schema)
            out.clear()
            return rows

        for key, some, quoted in _runs(batches, quote):
            if key != split:
                close(not inside)
                split = key
                if key not in places:
                    raise RuntimeError("the files were split anew since their records were counted; read them again")
                inside, begun, before = places[key]
                # What is left of the record before, if its cell is still open.
                record, ordinal, whole = begun - 1, before - 1, False
            for line, has in zip(some, quoted):
                if not inside:
                    close(True)
                    if line in ("", "\r"):
                        continue
                    record, ordinal, whole = record + 1, ordinal + 1, True
                held.append(line)
                if has:
                    inside = ends_inside(line, inside, quote, comma)
            if len(out) >= 4096:
                yield batch()
        close(not inside)
        yield batch()

    pieces = lines.mapInArrow(cut, "file string, record long, ordinal long, block long, whole boolean, text string")
    pieces = materialize(pieces, "csv-records")
    joined = pieces.where("NOT whole").groupBy("file", "record", "ordinal").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda p: p["text"]), "\n").alias("text"))
    return pieces.where("whole").select("file", "record", "ordinal", "text").unionByName(joined)


def _names(header: list[str]) -> list[str]:
    """Column names as Spark's reader gives them: empty ones by place, repeated ones with their place."""
    lowered = [h.lower() for h in header]
    return [f"_c{i}" if not h else f"{h}{i}" if lowered.count(h.lower()) > 1 else h for i, h in enumerate(header)]


def read_csv(spark: SparkSession, path: str, ordinal: str = "source_row_id") -> DataFrame:
    """All cells as strings under the names of the first file's header, with the row number over all files from 0.

    Every file begins with a header. Rows with fewer cells get nulls, further cells are left out.
    """
    import csv

    found = records(_lines(spark, path))
    first = found.where("record = 0").orderBy("file").select("text").first()
    if first is None:
        raise ValueError(f"{path} has no header")
    header = next(csv.reader([first["text"].rstrip("\r")])) if "\n" not in first["text"] else next(csv.reader(first["text"].splitlines(True)))
    names = _names(header)
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    text = F.regexp_replace("text", r"\r\z", "")
    cells = F.from_csv(text, schema, {"escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"})
    return found.where("record > 0").select(cells.alias("cells"), F.col("ordinal").alias(ordinal)).select("cells.*", ordinal)
