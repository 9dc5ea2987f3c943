"""Chat format, models, graph search, shard table, rules and mixing against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.llm import ann, chat, langid, mixing, quality, sharding, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_words long, score double"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, lang, s, 7, 0.5) for d, t, lang, s in rows], DOCS)


# ---- chat

def test_chats_come_back_as_they_were(spark):
    nasty = ["\\### Assistant: </turn> ok", "\\", "\\\\#", "####", "</turn></turn>", "<\\/turn>", "a\n### user: b", "", None,
             "é😀", ": :", "$1 \\1", "x" * 50000]
    rows = [(1, k, "user" if k % 5 < 2 else "assistant", t) for k, t in enumerate(nasty)]
    rows += [(2, 0, None, "x"), (2, 1, "a: b\\", "y"), (None, None, "user", "z"), (None, 1, "assistant", "z"),
             (3, 1, "assistant", "same"), (3, 1, "assistant", "same"), (3, 0, "### ", "q")]
    given = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, loss string, turns string")
    got = chat.format_chats(given).select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
                                          chat.loss_text(F.col("formatted"), F.col("loss")).alias("learned")).collect()
    want = {}
    for c, _, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in got} == want
    assert {r.conv_id: r.learned for r in got} == {c: "".join(x for r, x in t if r == "assistant") for c, t in want.items()}
    blocks = next(r.formatted for r in got if r.conv_id == 1).count("### ")
    assert blocks == sum(k == 0 or want[1][k][0] != want[1][k - 1][0] for k in range(len(want[1])))
    assert chat.format_chats(given.where("false")).count() == 0


# ---- toxicity

def labelled(spark, n=400, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("ba", "ko", "ti", "ru", "se") for b in ("lam", "nor", "pik", "dus", "fen", "gol")]
    rows, labels = [], []
    for k in range(n):
        bad = k % 4 == 0
        w = [rng.choice(vocabulary) for _ in range(rng.choice([12, 40, 150]))]
        if bad:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["Snarl!", "gnash", "VENOM", "spite"])
        rows.append((k, " ".join(w), "en", "s"))
        labels.append((k, int(bad), "clash"))
    return rows, spark.createDataFrame([*labels, (None, 1, ""), (7, None, "")], "doc_id long, toxic int, text string")


def test_toxic_words_are_learned_and_the_join_path_agrees(spark):
    rows, labels = labelled(spark)
    rows += [(1000, None, None, None), (1001, "", None, None), (1002, "snarl", None, None), (None, "nothing bad", None, None),
             (5, rows[5][1], "en", "s")]
    given = docs(spark, rows)
    got = toxicity.toxicity_scores(given, labels).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    held = got[got.held_out & (got.doc_id < 400)]
    bad = held.doc_id % 4 == 0
    assert ((held.predicted == 1) == bad).mean() > 0.95
    import zlib
    assert (got.held_out == [not np.isnan(d) and zlib.crc32(str(int(d)).encode()) % 3 == 1 for d in got.doc_id]).all()
    few = toxicity.toxicity_scores(given, labels, head=8).toPandas()
    key = ["doc_id", "row"]
    a, b = (x.sort_values(key).reset_index(drop=True) for x in (got, few))
    assert np.allclose(a.score, b.score, atol=1e-4)


def test_toxicity_without_labels_or_rows(spark):
    rows, labels = labelled(spark, 20)
    got = toxicity.toxicity_scores(docs(spark, rows), labels.where("false")).collect()
    assert len(got) == 20 and all(r.predicted == 0 for r in got)
    assert toxicity.toxicity_scores(docs(spark, []), labels).count() == 0


def test_labels_that_the_fit_does_not_use_are_counted(spark, monkeypatch):
    rows, labels = labelled(spark)
    counted, count = [], toxicity.count_expressions
    monkeypatch.setattr(toxicity, "FITTED", 5)
    monkeypatch.setattr(toxicity, "count_expressions", lambda training: (counted.append(training.count()), count(training))[1])
    got = toxicity.toxicity_scores(docs(spark, rows), labels).toPandas()
    assert counted[0] > 0.93 * (~got.held_out).sum()


# ---- neighbours

def test_graph_search_finds_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 12))
    x[700:720] = x[3]  # a frequent vector
    rows = [(k, v.tolist(), "q") for k, v in enumerate(x)]
    rows += [(2000, None, ""), (2001, [0.0] * 12, ""), (2002, [float("nan")] * 12, ""), (2003, [1.0, None], ""), (2004, [], ""),
             (2005, [float("inf")] * 12, ""), (2100, [1.0, 2.0], ""), (2101, [1.0, 3.0], ""), (5, x[5].tolist(), ""), (None, x[9].tolist(), "")]
    given = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    index = ann.build_index(given, shard_nodes=400)
    asked = given.where("vec_id % 100 in (0, 3)")
    got = ann.search(index, asked, block=8).toPandas()
    hit = total = 0
    for q in [k for k in range(1500) if k % 100 in (0, 3)]:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        best = [k for k in np.lexsort((np.arange(1500), d)) if k != q][:10]
        own = got[got.query_id == q].sort_values("rank")
        assert list(own["rank"]) == list(range(1, 11)) and q not in set(own.vec_id)
        assert np.allclose(own.score, d[own.vec_id], rtol=1e-12)
        assert (np.diff(own.score) >= 0).all()
        hit += len(set(best) & set(own.vec_id))
        total += 10
        if q == 3:
            assert list(own.vec_id) == [*range(700, 710)]
    assert hit / total >= 0.95
    assert list(got[got.query_id == 2100].vec_id) == [2101]
    assert not set(got.query_id) & {2000, 2003}
    assert ann.search(ann.build_index(given.where("false")), asked.where("false")).count() == 0


# ---- shards

def test_lookup_table_is_filled_in_turns():
    names, size = [f"s{k}" for k in range(7)], 101
    table = sharding.fill_table(names, size)
    orders = []
    for n in names:
        d = hashlib.sha256(n.encode()).digest()
        offset, skip = int.from_bytes(d[:8], "little") % size, int.from_bytes(d[8:16], "little") % (size - 1) + 1
        orders.append([(offset + j * skip) % size for j in range(size)])
    want, turn = {}, 0
    while len(want) < size:
        want[next(s for s in orders[turn % 7] if s not in want)] = turn % 7
        turn += 1
    assert table.tolist() == [want[k] for k in range(size)]
    loads = Counter(sharding.fill_table([f"x{k}" for k in range(64)]).tolist())
    assert max(loads.values()) - min(loads.values()) <= 1
    fewer = sharding.fill_table(names[:-1], size)
    assert sum(a != b for a, b in zip(table, fewer) if a != 6) <= size // 5
    twice = Counter(sharding.fill_table(names, size, [2, 1, 1, 1, 1, 1, 1]).tolist())
    assert twice[0] > 1.7 * twice[1]
    with pytest.raises(ValueError):
        sharding.fill_table(names, 100)


def test_rows_keep_their_shard(spark, tmp_path):
    given = spark.range(500).selectExpr("id AS doc_id", "'old' AS shard").unionByName(
        spark.createDataFrame([(None, "old"), (3, "old")], "doc_id long, shard string"))
    placed = sharding.assign_shards(given, "doc_id", ["a", "b", "c"], 101)
    rows = placed.collect()
    assert len(rows) == 502 and {r.shard for r in rows} == {"a", "b", "c"}
    assert len({r.shard for r in rows if r.doc_id == 3}) == 1
    sharding.write_shards(placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 502
    assert sharding.assign_shards(given.where("false"), "doc_id", ["a"], 101).count() == 0


# ---- rules

def plain_statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    times = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    marked = {i + j for i in range(len(w) - 2) if times[tuple(w[i:i + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def test_statistics_equal_plain_counts(spark):
    rng = random.Random(2)
    rows = [None, "", " \n", "a", "a b c a b c", "x x x x", "é# ü*\n \n \nz", "same\nsame\n same\n\nsame", "a b c\na b c d"]
    rows += [" ".join(rng.choice("abc#\n") for _ in range(rng.randrange(200))) for _ in range(60)] + ["w " * 40000]
    got = quality.with_statistics(docs(spark, [(k, t, None, None) for k, t in enumerate(rows)])).collect()
    assert {r.id: tuple(r[f] for f in quality.FEATURES) for r in got} == {k: plain_statistics(t) for k, t in enumerate(rows)}


def test_rules_are_learned_in_order():
    rng = np.random.default_rng(4)
    a, b = rng.random(4000), rng.random(4000)
    good = ~((a > 0.8) | ((b < 0.2) & (a < 0.5)))
    rules = quality.learn({"a": a, "b": b}, good)
    verdict = np.ones(4000, bool)
    done = np.zeros(4000, bool)
    for rule in rules.rules:
        holds = ~done
        for f, upper, v in rule.conditions:
            x = {"a": a, "b": b}[f]
            holds &= x <= v if upper else x >= v
        verdict[holds] = rule.good
        done |= holds
    assert 1 <= len(rules.rules) <= 6 and (verdict == good).mean() > 0.97
    assert quality.learn({"a": a[:0], "b": b[:0]}, good[:0]) == quality.DecisionList((), True)


def test_verdicts(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for k in range(300):
        w = [f"w{rng.randrange(999)}" for _ in range(rng.randrange(60, 200))]
        if k % 3 == 0:
            w = [x + "###" if rng.random() < 0.5 else x for x in w]
        rows.append((k, " ".join(w), None, None))
        labels.append((k, int(k % 3 != 0)))
    rows += [(900, None, None, None), (901, "few words", None, None), (902, "again and again " * 50, None, None)]
    got = quality.quality_verdicts(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")).toPandas().set_index("doc_id")
    assert got.loc[[900, 901, 902], "base_failed"].all() and not got.loc[[900, 901, 902], "kept"].any()
    assert (got.loc[:299, "kept"] == (np.arange(300) % 3 != 0)).mean() > 0.97
    empty = quality.quality_verdicts(docs(spark, []), spark.createDataFrame([], "doc_id long, quality int"))
    assert empty.count() == 0


def test_rules_do_not_depend_on_the_order_of_the_rows(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice(["a", "bb", "###", "long" * 3]) for _ in range(rng.randrange(40, 160))), None, None) for k in range(400)]
    labels = spark.createDataFrame([(k, int(rng.random() < 0.3 or len(t) % 7 > 3)) for k, t, _, _ in rows], "doc_id long, quality int")
    lists = [quality.learn_rules(quality.with_statistics(docs(spark, rows).repartition(n)), labels.repartition(n), min_precision=0.5)
             for n in (1, 5, 13)]
    assert lists[0] == lists[1] == lists[2] and lists[0].rules


# ---- languages

def test_languages(spark):
    rng = random.Random(6)
    parts = {"aa": "ka lo mi nu", "bb": "sch ung ein der", "cc": "ção não éu"}
    rows = []
    for k in range(240):
        lang = "abc"[k % 3] * 2
        rows.append((k, " ".join("".join(rng.choices(parts[lang].split(), k=3)) for _ in range(rng.choice([4, 30, 200]))), lang, None))
    rows += [(500, None, "aa", None), (501, "", "aa", None), (502, "12 !? \n", "bb", None), (503, "SCHUNG einder", None, None), (None, "kalo", "aa", None)]
    given = docs(spark, rows)
    model = langid.train(given)
    got = langid.identify(given, model).toPandas()
    own = got[got.doc_id < 240]
    held = own[own.held_out]
    assert (held.lang_pred == ["abc"[int(d) % 3] * 2 for d in held.doc_id]).all() and got.score.between(0, 1).all()
    assert set(got[got.doc_id.isin([500, 501, 502])].lang_pred) == {"und"}
    assert got[got.doc_id == 503].lang_pred.item() == "bb"
    assert (model.weights == 0).mean() > 0.5
    assert langid.train(given.where("false")) is None
    assert set(langid.identify(given, None).toPandas().lang_pred) == {"und"}


# ---- mixing

def test_targets_and_flow():
    assert mixing.target_quotas([10, 10, 10], [1, 1, 1], 3) == [10, 10, 10]
    got = mixing.target_quotas([1, 100, 100], [50, 1, 1], 3)
    assert got[0] == 3 and math.isclose(sum(got), 201) and math.isclose(got[1], got[2])
    # Pattern 0 serves both sources, pattern 1 only the second: no second use is needed.
    flow = mixing.min_cost_flow([100, 50], [[0, 1], [1]], [80, 60], 3)
    assert flow[0, 0] == 80 and flow[0, 1] + flow[1, 1] == 60 and flow[1, 1] <= 50 and flow[0, 1] <= 20
    # The first use of everything comes before a second one of anything.
    flow = mixing.min_cost_flow([10, 100], [[0], [0]], [115], 3)
    assert flow[0, 0] in (10, 15) and flow[0, 0] + flow[1, 0] == 115


def test_mixing_meets_targets(spark):
    rng = random.Random(7)
    rows = [(k, "w " * rng.randrange(0, 60), None, rng.choice(["a", "a", "a", "a", "b", "c", None])) for k in range(3000)]
    rows += [(4000, None, None, "a"), (4001, "", None, "only")]
    given = docs(spark, rows)
    used, sources = mixing.mix_sources(given)
    got, by = used.toPandas(), sources.toPandas()
    assert len(got) == len(rows) and got.repeats.between(0, 3).all()
    assert list(by.source.where(by.source.notna(), None)) == ["a", "b", "c", "only", None] and list(by.weight) == [1, 2, 3, 1, 2]
    assert math.isclose(by.target.sum(), got["size"].sum())
    got["name"] = [p[0] for p in got.pattern]
    for s, target, size in zip(by.source, by.target, by.source_size):
        own = got[got.name.isna()] if s is None or s != s else got[got.name == s]
        assert own["size"].sum() == size and target <= 3 * size
        assert abs((own["size"] * own.repeats).sum() - target) <= 120
    again = mixing.mix_sources(given.repartition(7))[0].toPandas()
    pick = lambda x: sorted(zip(x.id, x.seeded, x.repeats))
    assert pick(got) == pick(again)
    assert mixing.mix_sources(given.where("false"))[0].count() == 0


def test_overlapping_sources(spark):
    rng = random.Random(9)
    rows = [(k, "w " * rng.randrange(1, 40), rng.choice([["a"], ["a", "b"], ["b", "a", "b"], ["b", "c"], [], None])) for k in range(2000)]
    given = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    used, sources = mixing.mix_sources(given, weights=lambda n: [1.0] * n)
    got, by = used.toPandas(), sources.toPandas()
    assert set(map(tuple, got.pattern)) == {("a",), ("a", "b"), ("b", "c"), (None,)}
    taken = Counter()
    for r in got.itertuples():
        for s in r.use:
            taken[s] += r.size
    for s, target in zip(by.source, by.target):
        s = None if s is None or s != s else s
        assert abs(taken[s] - target) <= 200, (s, taken, target)
