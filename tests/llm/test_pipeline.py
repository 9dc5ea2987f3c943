"""The five stages on the smallest tables."""

import re

import pytest

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_stages(spark):
    pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, tables = docs.columns, [docs.toPandas()]
    for k, (name, stage) in enumerate(P.STAGES):
        docs = P.keep(stage(spark, docs, SF), f"test-{name}")
        tables.append(docs.toPandas())
        if k < 4:
            assert docs.columns == columns
    start, clean, lines, single, mixed, packed = tables
    # Stage 1 leaves texts as they are and drops few documents.
    assert set(clean.doc_id) <= set(start.doc_id) and len(clean) > 0.85 * len(start)
    assert dict(zip(clean.doc_id, clean.text)).items() <= dict(zip(start.doc_id, start.text)).items()
    # Stage 2 keeps every document; its texts lose whole lines.
    assert sorted(lines.doc_id) == sorted(clean.doc_id)
    before = dict(zip(clean.doc_id, clean.text))
    for d, text in zip(lines.doc_id, lines.text):
        left = iter(before[d].split("\n"))
        assert all(line in left for line in text.split("\n")) or text == ""
    # Stage 3 keeps the smallest id of every component of its input.
    from test_words_join import brute_components

    want = {int(c) for _, n, c in brute_components(list(zip(lines.doc_id.tolist(), lines.text))) if n}
    assert {d for d, t in zip(single.doc_id, single.text) if size(t)} == want
    assert {d for d, t in zip(lines.doc_id, lines.text) if not size(t)} <= set(single.doc_id)
    # Stage 4 uses a document up to three times.
    assert set(mixed.doc_id) <= set(single.doc_id) and mixed.doc_id.value_counts().max() <= 3
    total = sum(map(size, single.text))
    assert abs(sum(map(size, mixed.text)) - total) < 0.2 * total
    # Stage 5 packs every row.
    assert len(packed[packed.piece == 0]) == len(mixed)
    assert packed.groupby("sequence_id").length.sum().max() <= 4096


def test_rows_go_whether_or_not_ids_and_texts_are_null(spark):
    rows = [(1, "a"), (None, "b"), (2, None), (3, "c"), (3, "c")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    gone = docs.where("doc_id = 3 OR text = 'b'").select(P._row().alias("row"))
    assert sorted((str(r.doc_id), str(r.text)) for r in P._without(docs, gone).collect()) == [("1", "a"), ("2", "None")]
    single = P.keep_one_of_similar(spark, docs, SF)
    assert sorted(str(r.doc_id) for r in single.collect()) == ["1", "2", "3", "None"]
