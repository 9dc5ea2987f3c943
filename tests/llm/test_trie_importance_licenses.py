"""Prefix trie, importance resampling and license scans against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest

from reviewloom.llm import importance, licenses, trie

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def said(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


# ---- trie

def plain_trie(paths):
    """Node by node from ``{conversation: [(role, text), ..]}``."""
    members = {}
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members.setdefault(tuple(paths[c][:d]), []).append(c)
    children = Counter(p[:-1] for p in members if p)
    out = {}
    for p, of in members.items():
        inside = [q for q in members if q[:len(p)] == p]
        ends = ",".join(str(c) for c in of if len(paths[c]) == len(p))
        out[of[0], len(p)] = (
            members[p[:-1]][0] if p else None, len(of), children[p], sum(not children[q] for q in inside),
            sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in inside if q), hashlib.sha256(ends.encode()).hexdigest())
    return out


def built(nodes):
    rows = nodes.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def ordered(rows):
    def digest(r):
        return hashlib.md5(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest()

    out = {}
    for c, _, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, digest(r))):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


SCHEMA = "conv_id long, turn long, role string, text string, conv string, pos int, id string, bytes string"


def given(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], SCHEMA).repartition(parts)


def test_trie_of_rebuilt_conversations(spark):
    rng = random.Random(5)
    rows = [(None, 0, "user", "nobody"), (12, None, None, "é😀"), (12, None, None, "é😀"), (12, 3, "user", None), (12, 3, "a", "")]
    # 20 is long, 21 to 24 share a head with it; 25 is absent, so 26 and 27 lose turns, 28 all of its one.
    rows += [(20, k, "user" if k % 2 else "assistant", f"t{k}") for k in range(30)]
    rows += [(c, k, "user", rng.choice("ab")) for c in (21, 22, 23, 24, 26, 27) for k in range(rng.randrange(1, 12))] + [(28, 0, "user", "q")]
    rows += [(c, k, "user", f"same {k}") for c in range(40, 70) for k in range(4 + c % 2)]
    orig = ordered(rows)
    want = {}
    for c, turns in orig.items():
        h = crc32(str(c).encode()) % 9
        want[c] = orig.get(c - c % 5, [])[:h] + turns[h:]
    assert any(not turns for turns in want.values()) and max(map(len, want.values())) > 2 * trie.WIDTH
    for parts in (1, 6):
        turns, members = trie.with_shared_heads(trie.turn_ids(given(spark, rows, parts)))
        got = built(trie.with_ends(*trie.prefix_trie(turns, members)))
        assert got == plain_trie(want)


def test_trie_without_rebuilding_and_without_rows(spark):
    rows = [(c, k, "user", "x" * (k % 3)) for c, n in ((3, 40), (1, 17), (2, 16), (9, 40), (8, 8), (7, 9)) for k in range(n)]
    turns = trie.turn_ids(given(spark, rows))
    nodes, ends = trie.prefix_trie(turns)
    assert built(trie.with_ends(nodes, ends)) == plain_trie(ordered(rows))
    assert {r.conv: r.depth for r in ends.collect()} == {3: 40, 1: 17, 2: 16, 9: 40, 8: 8, 7: 9}
    empty = trie.turn_ids(given(spark, rows).where("false"))
    assert trie.with_ends(*trie.prefix_trie(empty)).count() == 0


def test_digests_of_a_popular_node_come_in_runs(spark, monkeypatch):
    monkeypatch.setattr(trie, "IDS", 16)
    ends = spark.createDataFrame([(c, 1, 5, 6) for c in range(-40, 900)] + [(7, 2, 5, 6)], "conv long, depth long, k1 long, k2 long")
    got = {r.depth: r.ends_sha256 for r in trie._digests(ends.repartition(9)).collect()}
    assert got == {1: hashlib.sha256(",".join(map(str, range(-40, 900))).encode()).hexdigest(), 2: hashlib.sha256(b"7").hexdigest()}


# ---- importance resampling

def plain_features(text):
    w = said(text)
    return [crc32(" ".join(w[i:i + n]).encode()) % importance.BUCKETS for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_resample(docs, goal):
    source, target = Counter(), Counter()
    for _, t in docs:
        source.update(plain_features(t))
    for t in goal:
        target.update(plain_features(t))
    s_all, t_all = sum(source.values()) + importance.BUCKETS, sum(target.values()) + importance.BUCKETS
    gain = {b: math.floor(1000 * math.log((target[b] + 1) * s_all / ((source[b] + 1) * t_all))) for b in source}
    out = []
    for doc, text in docs:
        f = plain_features(text)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(said(text))])
    may = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k in range(5 * len(may) // 100):
        may[k][4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def test_draws_are_those_of_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(importance, "PIECE", 64)
    rng = random.Random(9)
    vocabulary = ["Alpha", "bETA", "été", "ÉTÉ", "x1", "ligne", "a\x00b", "long" * 40, "中文"]
    docs = [(k, rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, k=rng.choice([1, 3, 25, 60])))) for k in range(120)]
    docs += [(500, None), (501, ""), (502, " .,\t"), (None, " ".join(["null"] * 30)), (7, docs[7][1]), (7, "other " * 30), (503, "word " * 40000)]
    goal = ["été alpha x1", None, "", "beta " * 50]
    rows = spark.createDataFrame([(d, t, 1, "r", 2.0) for d, t in docs], "doc_id long, text string, rank int, buckets string, weight double")
    target = spark.createDataFrame([(k, t) for k, t in enumerate(goal)], "item_id long, text string")
    for parts in (1, 5):
        got = importance.resample(rows.repartition(parts), target).select("doc_id", "n_features", "weight", "score", "rank").collect()
        assert sorted(map(tuple, got), key=repr) == plain_resample(docs, goal)
    assert importance.resample(rows.where("false"), target).count() == 0
    assert importance.resample(rows, target.where("false")).where("rank IS NOT NULL").count() == 5 * sum(len(said(t)) >= 20 for _, t in docs) // 100


def test_windows_name_their_words(monkeypatch):
    monkeypatch.setattr(importance, "PIECE", 8)
    text = "Été,  der\x00Über-x 9 " * 5
    found = importance.windows(importance.splitter(), text)
    assert sorted(b for _, _, b in found) == sorted(plain_features(text))
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text)
    for start, end, bucket in found:
        assert crc32(" ".join(said(lowered[start:end])).encode()) % importance.BUCKETS == bucket


# ---- licenses

def plain_scan(text, templates):
    """Every template as a regular expression from every word on."""
    w = said(text)
    found = []
    for at in range(len(w)):
        rest = "".join(" " + x for x in w[at:])
        for number, t in enumerate(templates):
            if re.match(licenses.as_regex(t.wording), rest):
                found.append((number, at))
    return len(w), found


TEMPLATES = licenses.BASE + licenses.NOTICES + (
    licenses.Template("own", "made by <<var;name=who;words=1-3>> for <<beginOptional>>the <<beginOptional>>great<<endOptional>> public"
                             "<<endOptional>> use <<var;name=how;match=in peace|as is>>"),
    licenses.Template("open", "copyright notice <<var;name=year;words=0-2>>"))


def license_texts():
    rng = random.Random(2)
    texts = [None, "", "mit", "under the", "Released under the MIT License.", "under the mit license under the MIT-license, under the mit licenses",
             "Apache License, Version 2.0 or CC BY-NC 4.0", "under the\x00mit\nlicense", "ünder the mit license",
             "GNU General Public License as published by the Free Software Foundation; either version 3", "gnu general public license version",
             "GNU Lesser General Public License, v2", "creative commons attribution non commercial", "Creative Commons Attribution 4.0 International Public License"]
    texts += [re.sub(r"<<.*?>>", " ", t.wording) for t in licenses.NOTICES]
    pool = "made by a b for the great public use in peace as is copyright notice under mit license".split()
    texts += [" ".join(rng.choices(pool, k=rng.randrange(4, 60))) for _ in range(150)]
    texts += [f"made by {'a ' * n}for {middle}use {how}" for n in range(5) for middle in ("", "the public ", "the great public ", "great public ")
              for how in ("in peace", "as is", "as peace")]
    return texts + ["under the mit license " * 3000 + "x " * 20000]


def test_accepted_places_are_those_of_regular_expressions(spark):
    texts = license_texts()
    docs = spark.createDataFrame([(k, t, "m", 3) for k, t in enumerate(texts)] + [(4, texts[4], "m", 3), (None, texts[6], "m", 3)],
                                 "doc_id long, text string, matches string, n_words int").repartition(4)
    rows = licenses.scan(docs, templates=TEMPLATES).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = texts[r.doc_id] if r.doc_id is not None else texts[6]
        if len(text or "") < 10_000:
            n, found = plain_scan(text, TEMPLATES)
            assert (r.n_words, sorted((m.template, m.first) for m in r.matches)) == (n, sorted(found)), text
        else:
            assert (r.n_words, len(r.matches)) == (32_000, 3000)
        assert all(m.first < m.last for m in r.matches)
    one = licenses.summary(licenses.scan(docs.where("doc_id = 5"))).first()
    assert (one.n_base, one.first_word, one.last_word, one.base_labels, one.labels, one.score) == (2, 0, 4, "mit", "mit", 0.8)
    none = licenses.summary(licenses.scan(docs.where("doc_id = 0"))).first()
    assert (none.n_words, none.n_base, none.first_word, none.base_labels, none.labels, none.score) == (0, 0, None, "", "", 0.0)
    whole = {r.labels for r in licenses.summary(licenses.scan(docs.where("doc_id BETWEEN 14 AND 17"))).collect()}
    assert whole == {"mit", "apache-2", "isc", "bsd"}
    assert licenses.scan(docs.where("false")).count() == 0


@pytest.mark.parametrize("wording", ["<<beginOptional>>a<<endOptional>> b c", "a <<var;name=x;words=1-2>> b", "a b <<beginOptional>>c", "a b <<endOptional>>",
                                     "a b <<var;name=x>>"])
def test_unusable_markup_is_refused(wording):
    with pytest.raises(ValueError):
        licenses.parse(wording)
