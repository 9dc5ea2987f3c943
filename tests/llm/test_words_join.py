"""Word arithmetic, n-gram join, line templates and packing against plain versions."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reviewloom.llm import common, line_dedup, ngram_join, packing

SCHEMA = "doc_id long, text string, row string, n long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_word_hashes_agree_with_a_plain_split():
    rows = ["", None, "a b  a\tb\x0bc", "no", "x" * 70000 + " y", "é é é", "tail "]
    seen, index = {}, 0
    for t in common.texts(pa.array(rows)):
        got = common.span_hashes(t.data, t.begins, t.ends)
        for k, row in enumerate(t.rows):
            own = got[t.first[k]:t.first[k + 1]]
            assert len(own) == len(words(rows[row]))
            for w, h in zip(words(rows[row]), own):
                assert seen.setdefault(w, h) == h
                index += 1
    assert len(set(seen.values())) == len(seen) and index


def test_key_filter_never_denies_a_key(spark):
    keys = spark.range(0, 5000, 7).withColumn("key", F.xxhash64("id"))
    may = common.KeyFilter.of(keys, "key", 16)
    held = np.array([r.key for r in keys.collect()], np.int64).view(np.uint64)
    assert may(held).all()
    assert not common.KeyFilter.of(keys.where("false"), "key", 16)(held).any()


def brute_components(rows):
    def shingles(text):
        w = [re.sub("[A-Z]", lambda m: m.group().lower(), x) for x in words(text)]
        if not w:
            return frozenset()
        return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[find(i)] = min(best.get(find(i), d), d)
    return sorted((str(d), len(s), str(best.get(find(i)))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def test_ngram_join_equals_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(300)]
    shared = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 5, 6, 8, 9, 14, 30, 80, 200, 700]))]
        if rng.random() < 0.3:
            base += shared
        for _ in range(rng.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                k = rng.randrange(len(w))
                w[k:k + rng.choice([0, 1, 2])] = [rng.choice(vocabulary)]
            rows.append(" ".join(w).upper() if rng.random() < 0.2 else "  ".join(w))
    rows = list(enumerate(rows)) + [(None, rows[0]), (900, ""), (901, None), (902, " \n "), (5, rows[5]), (903, "w1 " * 5000)]
    given = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], SCHEMA)
    got = ngram_join.similar_components(given).collect()
    assert sorted((str(r.id), r.n_shingles, str(r.component)) for r in got) == brute_components(rows)
    kept = {}
    for r in got:
        if r.n_shingles and r.keeper:
            kept.setdefault(r.component, set()).add(r.row)
    assert all(len(v) == 1 for v in kept.values())


def test_ngram_join_of_an_empty_table(spark):
    assert ngram_join.similar_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_signatures_of_similar_sets_meet():
    rng = np.random.default_rng(2)
    for size in [1, 2, 3, 4, 5, 7, 9, 12, 13, 20, 31, 60, 100, 257, 900, 2500]:
        for _ in range(30):
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64) * np.uint64(2))
            most = [(i, j) for i in range(size) for j in (0, size // 5, size // 3)
                    if 4 * (size - i) >= 3 * (size + j)]
            drop, add = most[rng.integers(len(most))]
            b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2**63, add).astype(np.uint64)]))
            assert set(ngram_join.signatures(a)) & set(ngram_join.signatures(b))
            x, y = (ngram_join.counts_of(ngram_join.sketch(s)) for s in (a, b))
            assert ngram_join.may_link(x, y, len(a), len(b))


def test_sketches_of_many_pairs_agree_with_one_pair_at_a_time():
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 2**63, 3000, dtype=np.uint64) << np.uint64(1))
    sets = []
    for size in [1, 2, 3, 4, 7, 8, 9, 12, 16, 17, 21, 33, 60, 64, 65, 80, 120, 129, 500, 513, 600, 2000]:
        own = rng.choice(base, size, replace=False)
        for share in (0, 0.05, 0.12, 0.2, 1):
            other = rng.random(size) < share
            sets.append(np.unique(np.where(other, rng.integers(0, 2**63, size, dtype=np.uint64), own)))
    drawn = [ngram_join.sketch(s) for s in sets]
    size = np.array([len(s) for s in sets])
    a, b = np.triu_indices(len(sets), 1)
    many = ngram_join.Sketches(drawn).allowed(a, b, size)
    counts = [ngram_join.counts_of(d) for d in drawn]
    assert many.tolist() == [ngram_join.may_link(counts[i], counts[k], len(sets[i]), len(sets[k])) for i, k in zip(a, b)]
    assert many.any() and not many.all()


def test_open_pairs_equal_a_plain_loop_and_dense_blocks_stay_rows():
    rng = np.random.default_rng(6)
    base = [np.unique(rng.integers(0, 2**63, 200, dtype=np.uint64)) for _ in range(8)]
    rows = {c: [] for c in [*ngram_join.BLOCK_ROW, "sketch"]}
    cuts = [0]
    for sig, (members, kinds, two) in enumerate([(1, 1, 0), (6, 6, 0), (40, 8, 1), (60, 1, 0), (3, 1, 1), (20, 5, 0)]):
        for i in range(members):
            own = np.unique(np.append(base[i % kinds][rng.random(200) > 0.05], rng.integers(0, 2**63, 5, dtype=np.uint64)))
            for c, v in zip(rows, [sig, 0, two, rng.integers(0, 1 + two), 1000 * sig + i, rng.integers(0, 30), len(own), ngram_join.sketch(own)]):
                rows[c].append(v)
        cuts.append(cuts[-1] + members)
    rows = {c: v if c == "sketch" else np.array(v) for c, v in rows.items()}
    pairs, dense = set(), set()
    for lo, hi in zip(cuts, cuts[1:]):
        own = {tuple(sorted((rows["digest"][i], rows["digest"][k]))) for i in range(lo, hi) for k in range(i + 1, hi)
               if rows["root"][i] != rows["root"][k] and (rows["x"][i] == rows["y"][i] or rows["block"][i] != rows["block"][k])
               and ngram_join.may_link(*(ngram_join.counts_of(rows["sketch"][j]) for j in (i, k)), rows["n"][i], rows["n"][k])}
        if len(own) > ngram_join.SPARSE * (hi - lo):
            dense |= set(rows["digest"][lo:hi].tolist())
        else:
            pairs |= own
    out = [r for batch in ngram_join._open_pairs(rows, cuts) for r in batch.to_pylist()]
    assert pairs and {(r["a"], r["b"]) for r in out if r["a"] is not None} == pairs
    assert dense and {r["digest"] for r in out if r["sig"] is not None} == dense


def test_large_groups_go_through_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "STAR_ROUNDS", 0)
    rng = random.Random(1)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(30):
        w = list(base)
        for _ in range(k % 5):
            w[rng.randrange(120)] = f"x{rng.randrange(9)}"
        rows.append((k, " ".join(w)))
    got = ngram_join.similar_components(spark.createDataFrame([(d, t, "", 0) for d, t in rows], SCHEMA))
    assert sorted((str(r.id), r.n_shingles, str(r.component)) for r in got.collect()) == brute_components(rows)


def test_many_near_copies_give_few_links(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "STAR_ROUNDS", 0)
    rng = random.Random(4)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(500):
        w = list(base)
        w[rng.randrange(60)] = f"x{k}"
        rows.append((k, " ".join(w)))
    counted = []
    remaining = ngram_join._remaining

    def counting(*args):
        found = remaining(*args)
        counted.append(found.count())
        return found

    monkeypatch.setattr(ngram_join, "_remaining", counting)
    got = ngram_join.similar_components(spark.createDataFrame([(d, t, "", 0) for d, t in rows], SCHEMA))
    assert sorted((str(r.id), r.n_shingles, str(r.component)) for r in got.collect()) == brute_components(rows)
    # Fewer links than rows of signature groups, where all pairs would be over 100,000.
    sets = ngram_join.shingle_sets(pa.array([t for _, t in rows]))
    rows_of_groups = sum(len(ngram_join.signatures(own)) for _, own in sets)
    assert len(counted) == 1 and counted[0] < ngram_join.SPARSE * rows_of_groups < 100_000


# ---- lines

def test_lines_of_long_texts_null_ids_and_any_partitions(spark):
    rng = random.Random(12)
    unlike = lambda n: " ".join(f"v{rng.randrange(10 ** 6)}" for _ in range(n))
    shared = "this page was printed from the archive of the town library"
    rows = [(k, f"{unlike(30)}\n{shared}\n{unlike(20)}") for k in range(6)] + [(None, f"{unlike(30)}\n{shared}"), (7, None), (8, "")]
    rows.append((9, "\n".join([unlike(8) for _ in range(6000)] + [shared])))
    docs = [(d, t, "x", 1) for d, t in rows]
    results = []
    for parts in (1, 6):
        got = line_dedup.drop_lines(spark.createDataFrame(docs, SCHEMA).repartition(parts)).collect()
        assert len(got) == len(rows)
        results.append(sorted((str(r.doc_id), r.text, r.dropped_lines) for r in got))
    assert results[0] == results[1]
    for (d, text, dropped), (_, before) in zip(results[0], sorted((str(d), t) for d, t in rows)):
        assert text == (None if before is None else "\n".join(x for x in before.split("\n") if x != shared))
        assert dropped == (0 if not before else 1)


def test_recurring_lines_go_and_copies_stay(spark):
    rng = random.Random(3)
    say = lambda n: " ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(n))
    passage, notice = say(60), "page {} of the public notice number {} ends here"
    rows = []
    for k in range(12):
        lines = [say(40) for _ in range(6)]
        if k < 5:
            lines.insert(2, passage)
        if k < 4:
            lines.append(notice.format(k, k * 7))
        rows.append((k, "\n".join(lines)))
    rows += [(100 + k, rows[11][1]) for k in range(6)]  # copies of a whole document
    rows += [(200, None), (201, ""), (202, "a b\n\na b"), (203, "a b\nc")]
    rows += [(204, "a b\nd"), (205, "a b\ne")]
    rows += [(210 + k, f"{say(30)}\n1 {k} 3 4 5") for k in range(5)]
    given = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], SCHEMA)
    got = {r.doc_id: r for r in line_dedup.drop_lines(given).collect()}
    for d, t in rows:
        gone = [] if not t else [x for x in t.split("\n") if x == passage or "public notice" in x]
        want = t if not t else "\n".join(x for x in t.split("\n") if x not in gone)
        assert (got[d].text, got[d].dropped_lines) == (want, len(gone)), d
    assert got[3].row == "clash"
    assert line_dedup.drop_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def dropped(spark, rows):
    return {r.doc_id: r.dropped_lines for r in line_dedup.drop_lines(spark.createDataFrame([(d, t, "", 1) for d, t in rows], SCHEMA)).collect()}


def test_a_leaf_holds_several_templates(spark):
    rng = random.Random(4)
    say = lambda n: " ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(n))
    two = ["one two three " + say(7) for _ in range(2)]
    rows = [(k, f"{say(40)}\n{two[k % 2]}") for k in range(10)]
    once = "four five six " + say(6)
    rows += [(100 + k, f"{say(40)}\nfour five six {say(6)}") for k in range(40)] + [(200 + k, f"{say(40)}\n{once}") for k in range(4)]
    begin, end = "seven eight nine " + say(2), say(2)
    rows += [(300 + k, f"{say(40)}\n{begin} {say(3)} {end}") for k in range(5)]
    got = dropped(spark, rows)
    assert {d for d, n in got.items() if n} == {*range(10), *range(200, 204), *range(300, 305)}


def test_only_copies_of_each_other_count_as_one_document(spark):
    rng = random.Random(5)
    say = lambda n: " ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(n))
    passage, several, twice = say(60), [say(8) for _ in range(5)], say(40)
    rows = [(k, f"{say(20)}\n{passage}") for k in range(4)]
    rows += [(100 + k, "\n".join([*rng.sample(several, 4), say(12)])) for k in range(12)]
    # Two documents of their own and near copies of one of them.
    own = [say(60) for _ in range(8)]
    rows += [(200 + k, "\n".join([*own, f"{say(3)}", twice])) for k in range(6)] + [(300, f"{say(80)}\n{twice}")]
    got = dropped(spark, rows)
    assert {d: n for d, n in got.items() if n} == {**{k: 1 for k in range(4)}, **{100 + k: 4 for k in range(12)}}


def test_two_documents_are_enough_for_a_long_line(spark):
    rng = random.Random(6)
    say = lambda n: " ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(n))
    long, short, whole = say(50), say(49), say(90)
    rows = [(k, f"{say(60)}\n{long}\n{say(30)}") for k in range(2)] + [(10 + k, f"{say(60)}\n{short}") for k in range(2)]
    rows += [(20 + k, f"{whole}\n{say(3)}") for k in range(2)]
    rows += [(30 + k, f"{say(60)}\n{say(3)} {k} {say(56)}") for k in range(2)]
    assert {d: n for d, n in dropped(spark, rows).items() if n} == {0: 1, 1: 1}


def test_short_lines_and_lines_of_numbers_go(spark):
    rng = random.Random(7)
    say = lambda n: " ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(n))
    rows = [(k, f"Share\n{say(30)}\n\nRead more\n2024-05-01 12:30 $9.99\n{k} {k + 1} 7") for k in range(4)]
    rows += [(10 + k, f"{say(30)}\nOnly {'ab'[k]}") for k in range(2)]
    assert {d: n for d, n in dropped(spark, rows).items() if n} == {k: 3 for k in range(4)}


# ---- packing

public = pytest.importorskip("public_tokenizers")


def test_packing_is_exact(spark):
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice(["The", "straße", "ΣΑΣ", "it's", "'ll", "12", "x\u0085y", "<|endoftext|>", "é", "İ"])
                         for _ in range(rng.choice([0, 1, 40, 900])))) for k in range(40)]
    rows += [(50, None), (51, ""), (None, "no id"), (52, "word " * 9000), (3, rows[3][1]), (53, "\x1c a　b  ")]
    got = packing.pack_documents(spark.createDataFrame([(d, t, "", 0) for d, t in rows], SCHEMA), path).toPandas()
    want = []
    for d, t in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
        for p, lo in enumerate(range(0, len(ids), 4096)):
            cut = np.array(ids[lo:lo + 4096], "<u4")
            want.append((str(d), p, lo, len(cut), zlib.crc32(cut.tobytes())))
    have = [("None" if np.isnan(r.doc_id) else str(int(r.doc_id)), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()]
    assert sorted(have) == sorted(want)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= 4096 and list(s.offset) == list(np.cumsum(s.length) - s.length)
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), path).count() == 0


def test_bin_completion_finds_small_optima():
    def fewest(items, capacity):
        best = len(items)

        def put(k, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if k == len(items):
                best = len(bins)
                return
            for i in range(len(bins)):
                if bins[i] + items[k] <= capacity:
                    bins[i] += items[k]
                    put(k + 1, bins)
                    bins[i] -= items[k]
            put(k + 1, [*bins, items[k]])
        put(0, [])
        return best

    rng = np.random.default_rng(6)
    off = 0
    for _ in range(40):
        items = sorted(rng.integers(1, 30, 10).tolist(), reverse=True)
        counts = np.bincount(items, minlength=31)
        found = packing.bin_completion(counts, 30)
        used = np.zeros(31, int)
        for filling, times in found:
            assert sum(filling) <= 30
            for x in filling:
                used[x] += times
        assert (used == counts).all()
        off += sum(t for _, t in found) - fewest(items, 30)
    assert off <= 1
    # Many small items of one length, and of no other.
    assert packing.bin_completion(np.bincount([1] * 5000, minlength=4097)) == [([1] * 4096, 1), ([1] * 904, 1)]
    # Best fit alone needs three sequences here.
    assert sum(t for _, t in packing.bin_completion(np.bincount([5, 4, 4, 3, 2, 2], minlength=11), 10)) == 2


def test_the_search_runs_on_large_tables_and_never_ends_worse(monkeypatch):
    spent = []

    class Counted(packing._Budget):
        def spend(self):
            spent.append(1)
            return super().spend()

    monkeypatch.setattr(packing, "_Budget", Counted)
    rng = np.random.default_rng(3)
    counts = np.bincount(np.concatenate([rng.integers(1100, 1500, 900_000), rng.integers(2049, 3000, 100_000)]), minlength=4097)
    bins = lambda found: sum(t for _, t in found)
    first = bins(packing.bin_completion(counts, nodes=0))
    assert len(spent) <= 1
    found = packing.bin_completion(counts, nodes=20_000)
    assert 20_000 <= len(spent) <= 21_000 and bins(found) <= first
    used = np.zeros(4097, np.int64)
    for filling, times in found:
        assert sum(filling) <= 4096
        np.add.at(used, filling, times)
    assert (used == counts).all()


def test_fillings_come_by_rising_waste_and_none_is_dominated():
    counts = packing._Counts(np.bincount([9, 7, 6, 5, 5, 4, 3, 2, 1], minlength=21))
    found = list(packing._fillings(counts, 9, 20, 5, [9, 7, 4], packing._Budget(10 ** 6)))
    assert all(f[0] == 9 and sum(f) <= 20 for f in found) and len(found) == len({tuple(f) for f in found}) > 3
    steps = [(20 - sum(f)).bit_length() for f in found]
    assert steps == sorted(steps)
    for i, f in enumerate(found):
        assert not any(len(g) == len(f) and all(x >= y for x, y in zip(g, f)) for g in [[9, 7, 4], *found[:i]])
    assert counts.n[9] == 0 and counts.n[5] == 2


def test_only_the_best_pairs_of_a_component_are_looked_up_among_the_tried(spark):
    # A component of 40 sets shares a signature with each of 60 members of a larger one.
    rows = [(s, 1000 + s, 1000, 100) for s in range(60)] + [(s, d, 1, 100) for s in range(60) for d in range(1, 41)]
    rows += [(s, 2000 + d, 1000, 100) for s in range(60) for d in range(60)]
    opened = spark.createDataFrame(rows, "sig long, digest long, root long, members long")
    first = ngram_join._stars(opened, None, 0)
    tried = first.selectExpr("a", "b", "false AS linked").localCheckpoint()
    again = ngram_join._stars(opened, tried, 1)
    assert first.count() == again.count() == ngram_join.PROPOSALS
    assert again.join(tried, ["a", "b"]).isEmpty()
    plan = again._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan[plan.index("LeftAnti"):]


def test_first_pairs_are_the_stars_of_single_sets(spark):
    rng = random.Random(9)
    groups = {(s, d) for s in range(40) for d in rng.sample(range(-30, 30), rng.choice([2, 3, 12]))}
    low = {s: min(d for t, d in groups if t == s) for s, _ in groups}
    rows = [(s, d, low[s], d, sum(t == s for t, _ in groups)) for s, d in groups]
    given = spark.createDataFrame(rows, "sig long, digest long, centre long, root long, members long")
    plain = sorted(map(tuple, ngram_join._stars(given.drop("centre"), None, 0).collect()))
    assert plain and sorted(map(tuple, ngram_join._first_pairs(given).collect())) == plain


def test_near_copies_are_compared_in_one_of_their_groups(spark, monkeypatch):
    # Near copies of one text, most too far apart to be linked, that share most of their signatures.
    rng = random.Random(7)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(90):
        w = list(base)
        for place in rng.sample(range(0, 196, 6), 5):
            w[place] = f"x{k}"
        rows.append((k, " ".join(w)))
    written, keep = [], ngram_join.keep

    def counting(df, label):
        kept = keep(df, label)
        if label == "join-remaining":
            written.append(kept.count())
        return kept

    monkeypatch.setattr(ngram_join, "keep", counting)
    monkeypatch.setattr(ngram_join, "STAR_ROUNDS", 0)
    for large, block in ((64, 1024), (2, 16)):
        monkeypatch.setattr(ngram_join, "LARGE", large)
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        got = ngram_join.similar_components(spark.createDataFrame([(d, t, "", 0) for d, t in rows], SCHEMA))
        assert sorted((str(r.id), r.n_shingles, str(r.component)) for r in got.collect()) == brute_components(rows)
    groups = sum(len(ngram_join.signatures(own)) for _, own in ngram_join.shingle_sets(pa.array([t for _, t in rows])))
    assert written and written[0] < groups / 2, (written, groups)


def test_a_pair_is_a_pair_of_its_first_group_only():
    rng = np.random.default_rng(8)
    base = np.unique(rng.integers(0, 2**63, 200, dtype=np.uint64))
    sketches = [ngram_join.sketch(base[rng.random(200) > 0.02]) for _ in range(4)]
    rows = {c: [] for c in [*ngram_join.BLOCK_ROW, "sketch", "lead"]}
    for sig in (3, 5, 9):
        for i in range(4):
            # The last set has no part in the first group, and the leads name no group that comes later.
            if sig == 3 and i == 3:
                continue
            lead = [s for s in ((3, 5, 9) if i < 3 else (5, 9)) if s < sig]
            for c, v in zip(rows, [sig, 0, 0, 0, i, i, 200, sketches[i], lead + [0] * (ngram_join.LEADS - len(lead))]):
                rows[c].append(v)
    rows = {c: v if c == "sketch" else np.array(v) for c, v in rows.items()}
    out = [r for batch in ngram_join._open_pairs(rows, [0, 3, 7, 11]) for r in batch.to_pylist()]
    assert sorted((r["a"], r["b"]) for r in out) == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
